"""End-to-end pipelines and views for ad-hoc SQL."""
