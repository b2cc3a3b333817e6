from pyspark.sql import functions as F

import corpus_pipeline
from seqframe.llm import bpe, langid, simhash
from seqframe.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, documents):
    """Each stage against its rule, on what the one before it kept."""
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "byte_bpe"]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        kept.append(docs.count())
        assert name == "byte_bpe" or docs.columns == documents.columns
        if name == "near_duplicates":
            assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
        if name == "secret_scan":
            texts = docs.where("text rlike '[0-9a-f]{24,}' or text rlike 'AKIA[A-Z0-9]{16,}'").count()
            assert texts == 0
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    assert docs.columns == ["doc_id", "n_tokens", "ids"]


def test_odd_rows(spark, odd):
    sf = "/root/testdata/sf0.001"
    docs = odd.withColumnRenamed("ids", "__gone")
    docs = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in docs.where("doc_id is not null").collect()) == [1, 2, 5, 7, 8, 9]  # of the repeated row one stays
    assert corpus_pipeline.redaction(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.decontamination(spark, docs.limit(0), sf).count() == 0


def test_rows_are_judged_one_by_one(spark):
    """Shared and missing ids, repeated rows, clashing names, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 400 and 900").orderBy("doc_id").limit(3).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    made = [(3, "%% 12 ??"), (3, prose[0]), (None, "!! 1"), (None, prose[1]), (None, prose[1]), (5, item), (5, prose[2]), (6, None), (7, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, "x") for k, t in made], "doc_id long, text string, lang string, source string, n_chars long, h int, lang_pred string")
    plain = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id", "text").collect()]
    assert sorted(plain, key=str) == sorted([m for i, m in enumerate(made) if i not in (4, 8)], key=str)
    clean = [tuple(r) for r in corpus_pipeline.decontamination(spark, docs, sf).select("doc_id", "text").collect()]
    assert sorted(clean, key=str) == sorted([m for m in made if m != (5, item)], key=str)
    corpus = spark.read.parquet(f"{sf}/documents.parquet")
    both = corpus.withColumns({"h": F.lit(1), "lang_pred": F.lit("x")}).unionByName(docs)
    told = corpus_pipeline.language(spark, both, sf)
    assert told.columns == both.columns
    left = {(r.doc_id, r.text) for r in told.collect()}
    assert {(3, prose[0]), (None, prose[1]), (5, prose[2])} <= left and not left & {(3, "%% 12 ??"), (None, "!! 1"), (6, None), (7, "")}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_registry():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and bpe and langid
