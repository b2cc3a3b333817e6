"""A PySpark analytics engine for long-read sequencing data and named motifs."""
