"""Schemas of the data model, and small tables from driver-side definitions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "FLOAT": T.FloatType(), "STRING": T.StringType(), "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType())}


def _struct(columns: str) -> T.StructType:
    """A schema from NAME TYPE pairs; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


READ = _struct("rec_no BIGINT, read_id STRING, description STRING, seq STRING, qual STRING")
FASTA = _struct("rec_no BIGINT, id STRING, description STRING, seq STRING")
QUERY = _struct("query_idx INT, query_name STRING, query_seq STRING")
MATCH = _struct("seq_id STRING, query_name STRING, position INT, length SMALLINT, score FLOAT")
MATCH_ORDINAL = _struct("seq_id INT, query_name STRING, position INT, length SMALLINT, score FLOAT")
NEIGHBOUR_RULE = _struct("start STRING, end STRING, orientation STRING")
PRIMER_RULE = _struct("primer STRING, distance_min INT, distance_max INT, orientation STRING")
REGION = _struct("seq_id BIGINT, start_pos INT, end_pos INT, orientation STRING")
EMBEDDING = _struct("seq_id STRING, features ARRAY<DOUBLE>")
ASSIGNMENT = _struct("seq_id STRING, cluster INT")


def queries_df(spark: SparkSession, motifs: Mapping[str, str]) -> DataFrame:
    """The query set: names and motifs in order; the order is query_idx."""
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(motifs.items())], QUERY)


def neighbour_rules(spark: SparkSession, rules: Iterable[Mapping[str, str]]) -> DataFrame:
    return spark.createDataFrame([(r["start"], r["end"], r.get("orientation", "direct")) for r in rules], NEIGHBOUR_RULE)


def primer_rules(spark: SparkSession, rules: Iterable[Mapping]) -> DataFrame:
    return spark.createDataFrame([(r["primer"], int(r.get("distance_min", 0)), int(r["distance_max"]), r.get("orientation", "direct")) for r in rules], PRIMER_RULE)


def with_reverse(motifs: Mapping[str, str], prefix: str = "RC") -> dict[str, str]:
    """The motifs, and the reverse complement of each under a prefixed name."""
    from seqframe.functions.sequence import complement_of

    return dict(motifs) | {prefix + n: complement_of(s) for n, s in motifs.items()}


def parse_primers(arguments: Iterable[str], reverse: bool = True) -> dict[str, str]:
    """NAME=SEQ arguments, upper-cased; RC_ variants are IUPAC complements."""
    from seqframe.functions.sequence import iupac_complement_of

    found: dict[str, str] = {}
    for argument in arguments:
        name, mark, seq = argument.partition("=")
        if not mark or not name.strip() or not seq.strip():
            raise ValueError(f"expected NAME=SEQ, not {argument!r}")
        found[name.strip()] = seq.strip().upper()
        if reverse:
            found["RC_" + name.strip()] = iupac_complement_of(seq.strip().upper())
    return found
