"""Queries over the given tables, one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.llm import align, bpe, decontaminate, extract, fim, langid, perplexity, secrets, simhash, substrings, tokencount, urlfilter, vafile
from seqframe.llm.oracle import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), budget=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(_table(spark, sf_dir, "documents"), span=50)
    n = F.size("starts").cast("long")
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), n.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, where=~_held_out())
    return langid.predict(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return perplexity.classify(_table(spark, sf_dir, "documents"), trusted)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    count = {f"n_{k}": F.size(secrets.of_kind(F.col("spans"), k)).cast("long") for k in secrets.BASE}
    base = secrets.written(secrets.of_kind(F.col("spans"), *secrets.BASE))
    return found.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(base, 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


#: Fixed values of op11's contract.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.rearrange(fim.pack(_table(spark, sf_dir, "documents")), seed=42, rate=50, spm=80))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_repeated_substrings, op4_top_k, op5_language_id, op6_main_text, op7_byte_bpe, op8_quality, op9_simhash, op10_secrets, op11_url_filter, op12_fill_in_middle, op13_alignment)}
