"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is `span` consecutive words of a benchmark item; an item of fewer words is one
window. Among the k-word grams of a window the one with the least hash is its
fingerprint. A document's fingerprints are the least hashes of all its runs of as many
grams, so that every window that occurs in it has its fingerprint among them; that is
the guarantee of winnowing. The fingerprints are joined, and a hit is extended to the
whole window: it is compared with the benchmark's as text, in the keys of the same join.

Nearly all of a document's fingerprints are unknown to the benchmark. A bitmap of fixed
size says so on the spot, in the array; it may let some pass, never hold one back. What passes is
written with the words of its window, and meets the benchmark's table in a join that Spark
plans by measured sizes. The plan is the same for every size; with far more fingerprints
than 2**BITS the bitmap lets most pass and the join does its work.

Words: A-Z is lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null and empty texts
have no words, documents without words are clean, items without words have no window.
Each input row gives one output row, repeated rows and rows that share a key too. Items
that share an id are one item with the windows of all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 19  # of a fingerprint that the bitmap knows
GRAMS = 4  # grams of a window; a gram has the other words, but one at least


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same where all is ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: str) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(F.col(text), F.lit(""))), BETWEEN), "")


def _gram(span: int) -> int:
    return max(1, span - GRAMS + 1)


def _along(array: Column, n: int, body: Callable[[list[Column]], Column]) -> Column:
    """body of each run of n elements; none if there are fewer. Elements are looked up by
    their place: slice() within a lambda would copy the whole array each time."""
    starts = F.slice(array, 1, F.greatest(F.size(array) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: body([x, *(F.get(array, i + k) for k in range(1, n))]))


def fingerprints(words: Column, span: int) -> Column:
    """array<struct<at, f>>: the fingerprint of each run of span words, by the place of the run."""
    grams = lambda h: _along(h, _gram(span), lambda run: F.xxhash64(*run, F.lit(span)))
    width = span - _gram(span) + 1
    least = lambda g: _along(g, width, lambda run: F.least(*run) if width > 1 else run[0])
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h), least))


def windows(words: Column, span: int) -> Column:
    """array<struct<at, text>>: windows of span words by their place."""
    starts = F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, span), " ").alias("text")))


def item_windows(items: DataFrame, *, key: str, text: str, span: int) -> DataFrame:
    """Columns: span, text, f (fingerprint), items: each different window once."""
    rows = items.select(F.col(key).cast("string").alias("item"), words_of(text).alias("w")).where("item is not null and size(w) > 0")
    rows = rows.withColumn("span", F.least(F.size("w"), F.lit(span)))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("span"))
    every = rows.select("item", "span", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.col("span")), " "))).alias("text"))
    every = every.groupBy("span", "text").agg(F.sort_array(F.collect_set("item")).alias("items"))
    first = F.lit(None).cast("long")
    for s in range(1, span + 1):
        first = F.when(F.col("span") == s, F.get(fingerprints(F.split("text", " "), s), 0)).otherwise(first)
    return every.withColumn("f", first)


def _bitmap(prints: DataFrame) -> Column:
    """array<long>: a bit for each possible beginning of a fingerprint, as a literal."""
    words = [0] * (1 << (BITS - 6))
    for row in prints.select(F.shiftrightunsigned("f", 64 - BITS).alias("bit")).distinct().toLocalIterator():  # at most 2**BITS numbers
        words[row["bit"] >> 6] |= 1 << (row["bit"] & 63)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")


def _known(least: Column, bitmap: Column) -> Column:
    """array<int>: places of the fingerprints that the bitmap has."""
    has = lambda f: F.bit_get(F.get(bitmap, F.shiftrightunsigned(f, 70 - BITS).cast("int")), F.shiftrightunsigned(f, 64 - BITS).bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.filter(F.transform(least, lambda f, i: F.when(has(f), i)), lambda i: i.isNotNull())


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", span: int = 13, share: int = 20) -> DataFrame:
    """Columns: key, h (hash of the text), n_words long, n_hit long (words inside a window
    that occurs), n_items long, items array<string> (sorted), contaminated boolean
    (n_hit > 0 and share * n_hit >= n_words)."""
    table, _ = cut(item_windows(items, key=item_key, text=item_text, span=span))
    spans = [r["span"] for r in table.select("span").distinct().orderBy("span").collect()]  # at most `span` numbers
    bitmap = _bitmap(table)
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), words_of(text).alias("w"))
    rows = rows.select("*", *[fingerprints(F.col("w"), s).alias(f"f{s}") for s in spans])
    places = [F.transform(_known(F.col(f"f{s}"), bitmap), lambda i: F.struct(F.lit(s).alias("span"), i.alias("at"))) for s in spans]
    none = F.array(F.lit(None).cast("struct<span:int,at:int>"))  # stands for the document itself
    rows = rows.select("*", F.explode(F.concat(none, *places)).alias("c"))
    f = F.lit(None).cast("long")
    for s in spans:
        f = F.when(F.col("c.span") == s, F.get(f"f{s}", F.col("c.at"))).otherwise(f)
    window = F.when(F.col("c.span").isNotNull(), F.array_join(F.slice("w", F.col("c.at") + 1, F.col("c.span")), " "))
    rows = rows.select("id", "h", F.size("w").cast("long").alias("n_words"), F.col("c.span").alias("span"), F.col("c.at").alias("start"), f.alias("f"), window.alias("text"))
    rows, _ = cut(rows)
    hits = rows.where("f is not null").join(table, ["span", "f", "text"])
    hits = hits.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("span")).alias("end")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
        lambda a: a["n"],
    )
    hits = hits.select(F.col("id").alias("id2"), F.col("h").alias("h2"), covered.alias("n_hit"), "items")
    out = rows.where("f is null").join(hits, F.expr("id <=> id2 and h = h2"), "left")
    nothing = F.array().cast("array<string>")
    out = out.select(F.col("id").alias(key), "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing).alias("items"))
    out = out.select(key, "h", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))
