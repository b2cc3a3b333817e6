"""Quality by perplexity under an interpolated modified Kneser-Ney model.

classify() takes the model of codepoints.py: order 4 over whole code points, counted on
trusted text only. A document's perplexity is that of a code point. A part of the trusted
documents, chosen by a hash of their key, is held out from the counts; the thresholds are
quantiles of these, by language. A document is kept if it is at most the threshold of its
language; a language without held-out documents takes the threshold of all.

Trusted keys may be few or many: a bitmap of fixed size lets trusted documents pass and few
others, whose keys are found by a join of keys and taken out again; with far more keys than bits
these others are many and Spark shuffles the texts to take them out. Quantiles are of Spark's
approximate kind, within one part in 10,000 of the ranks, for bounded memory.

Null and empty texts have perplexity null and aren't kept. Null lang is a language of
its own. A text just at the threshold is kept. Each input row gives one output row;
repeated rows too, but a repeated trusted row counts twice in training; null keys are never
trusted. Without trusted text all perplexities are those of the uniform model
and the threshold is null, which keeps every text that isn't empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm import codepoints
from seqframe.llm.common import bitmap, cut, passes, text_of

#: One in so many trusted documents is held out.
HELD_OUT = 5


def held_out(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("held out")), F.lit(HELD_OUT)) == 0


def classify(docs: DataFrame, trusted_keys: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = 0.99) -> DataFrame:
    """Columns: key, lang, perplexity, threshold, keep. trusted_keys: keys of trusted
    documents in the same column; keys without a document do nothing."""
    good = trusted_keys.select(F.col(key).alias("id")).where("id is not null").distinct()
    rows = docs.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    learn = good.where(~held_out("id"))
    learn, _ = cut(learn)
    # The bitmap lets all of these pass and few others, whose ids alone are sorted out: so the texts stay where they are.
    some = passes(bitmap(learn))
    others, _ = cut(rows.select("id").where(some).join(learn.hint("merge"), "id", "left_anti").distinct())
    counts, _ = cut(codepoints.count_grams(rows.select("id", "text").where(some).join(others, "id", "left_anti")))
    scored, _ = cut(codepoints.perplexities(rows, counts))
    known = scored.where("perplexity is not null").join(good.where(held_out("id")), "id")
    border = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = known.groupBy(F.col("lang").alias("of")).agg(border.alias("own"))
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(known.agg(border.alias("every"))))  # one row
    threshold = F.coalesce("own", "every")
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(F.col("id").alias(key), F.col("lang").alias(lang), "perplexity", threshold.alias("threshold"), keep.alias("keep"))
