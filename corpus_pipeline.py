"""A training-data pipeline: each stage is one operator of seqframe.llm, and takes what
the stage before it kept. All stages but the last return the columns of documents.

Rows are told apart by id and text together, so that rows that share an id are judged one
by one, and rows without an id like all others. A row without text, or with an empty one,
has no language and goes with the first stage; a later stage that gets one keeps it, as one
of the group of all such rows. Of repeated rows, and of ties within a group of
near-duplicates, one row stays: the one with the smallest id (null last), then with the
smallest hash of its text. Texts of any length are worked on whole. Columns besides those
of documents are passed on, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import bpe, decontaminate, langid, secrets, simhash
from seqframe.llm.common import cut, drop, scope

#: A document goes if no language has at least this share of its letters' votes.
LEAST_SCORE = 0.35


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose doc_id and h (hash of the text) are in gone."""
    k, h = _free(docs, "__id"), _free(docs, "__h")
    gone = gone.select(F.col("doc_id").alias(k), F.col("h").alias(h)).distinct()
    return docs.join(gone, F.expr(f"doc_id <=> `{k}` and xxhash64(text) = `{h}`"), "left_anti")


def _labelled() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the model knows, go."""
    model = langid.fit(docs, where=_labelled())
    found = langid.predict(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"))
    names = [f"c{i}" for i in range(len(found.columns))]
    found = found.toDF(*names).where((F.col(names[-2]) != langid.UNKNOWN) & (F.col(names[-1]) >= LEAST_SCORE))
    return found.select(*names[:-2]).toDF("doc_id", *[c for c in docs.columns if c != "doc_id"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id."""
    found = simhash.near_duplicates(docs)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("x")).select("x.doc_id", "x.h")
    rows = found.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    k, h, n = (_free(docs, c) for c in ("__id", "__h", "__n"))
    stays = first.join(rows.toDF("id2", "h2", "n"), F.expr("doc_id <=> id2 and h = h2")).select(F.col("doc_id").alias(k), F.col("h").alias(h), F.col("n").alias(n))
    stays, _ = cut(stays)
    kept = docs.join(stays, F.expr(f"doc_id <=> `{k}` and xxhash64(text) = `{h}`"))
    once = kept.where(F.col(n) == 1).select(*docs.columns)
    return once.union(kept.where(F.col(n) > 1).dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets and their linked parts are replaced by a mark; n_chars follows."""
    key, h, spans = (_free(docs, n) for n in ("__id", "__h", "__spans"))
    found = secrets.scan(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("h").alias(h), F.col("spans").alias(spans)).distinct()
    found, _ = cut(found)
    joined = docs.join(found, F.expr(f"doc_id <=> {key} and xxhash64(text) = {h}"), "left")
    known = F.col(spans).isNotNull()
    text = F.when(known, secrets.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    out = joined.withColumn("text", text).withColumn("n_chars", F.when(known, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each kept text, little-endian unsigned 32-bit integers."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", redaction),
    ("byte_bpe", encoding),
]

#: SQL can't express the learned first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each one's result is written as Parquet and read again;
    what a stage needed in between, and its input, are deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scope(spark) as made:
            docs, path = cut(stage(spark, docs, sf_dir))
            made.remove(path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
