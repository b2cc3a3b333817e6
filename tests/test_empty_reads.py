"""Queries against their SQL on tables with reads without a letter."""

import duckdb

from seqframe import catalog


def test_an_empty_read_leaves_no_tree(spark, tmp_path):
    rows = [(1, "Some words", "a"), (2, "12 34", "a"), (3, None, "b"), (4, "Some words", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sql = catalog.ORACLE_SQL["motif_tree"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE want AS {sql}")
    want = con.execute("SELECT count(*) FROM want").fetchall()[0][0]
    assert catalog.QUERIES["motif_tree"](spark, str(tmp_path)).count() == want == 0
