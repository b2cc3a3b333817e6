"""SimHash near-duplicates by multi-index hashing.

Fingerprints: XXH64 of each word shingle, bit by bit a vote of all shingles. Equal
fingerprints are one node from here on, so that copies cost nothing.

Links: two fingerprints that differ in at most two of 64 bits are within one bit of
each other in the upper half or equal in the lower half (else they would differ in two
bits above and one below). There is a table for each half. A fingerprint is looked up
in the upper table under all 33 members of the Hamming ball of radius one around its
upper half, in the lower table under its lower half. Of a bucket the table keeps the
number of members and the smallest and largest one, which is the whole bucket up to
two members: these candidates are verified over all 64 bits.

Larger buckets are never listed, for that would make pairs within a group. Every
fingerprint whose lookup meets one goes on to an exact second index over whole
fingerprints: it is entered under all 65 members of the ball of radius one around
itself. Two fingerprints share an entry if and only if they differ in at most two bits,
and no entry has more than 65 members; each is linked to the smallest one of its entry.

Groups are the connected components of the links, and are named after their smallest
document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut, kind_of, slices, text_of
from seqframe.llm.components import connected

_LOW = (1 << 32) - 1
_PART = 1 << 16  # shingles whose votes are counted at once
_TEXTS = 4 << 20  # bytes of texts that are taken together


def fingerprint(text: str, width: int = 3) -> int:
    """Signed 64-bit SimHash of shingles of `width` words. Words are what ASCII white
    space separates, A-Z lower-cased. Fewer words: one shingle; none: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, _PART):
        part = words[at : at + _PART + width - 1]
        shingles = zip(*(part[k:] for k in range(width)), strict=False) if len(words) >= width else [part]
        hashes = b"".join([digest(b" ".join(s), 42) for s in shingles])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Columns: key, h (hash of the text), fingerprint long. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, _TEXTS):
            prints = [fingerprint(t, width) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(prints, pa.int64())], names=[key, "h", "fingerprint"])

    return docs.select(key, F.xxhash64(text).alias("h"), text_of(text).alias(text)).mapInArrow(run, f"`{key}` {kind_of(docs, key)}, h long, fingerprint long")


def _halves(f) -> tuple:
    """Bucket keys: the upper half, and the lower one above all upper ones."""
    return F.shiftrightunsigned(f, 32), f.bitwiseAND(F.lit(_LOW)) + F.lit(1 << 32)


def _ball(f, bits: int) -> list:
    return [f, *(f.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(bits))]


def links(prints: DataFrame, f: str = "fingerprint") -> DataFrame:
    """Columns: a, b: links between different fingerprints, enough to connect each two
    that differ in at most two bits. One row to a fingerprint is expected. Spark sizes an
    exploded table like the one before, and would broadcast it: the hints forbid that."""
    f = F.col(f)
    upper, lower = _halves(f)
    table = prints.select(f.alias("a"), F.explode(F.array(upper, lower)).alias("key"))
    table = table.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    lookups = prints.select(f.alias("a"), F.explode(F.array(*_ball(upper, 32), lower)).alias("key"))
    met = lookups.hint("merge").join(table.hint("merge"), "key").where("n > 1 or lo <> a").select("a", "n", "lo", "hi")
    met, _ = cut(met.select("a", F.when(F.col("n") <= 2, F.array("lo", "hi")).alias("near")).distinct())
    few = met.select("a", F.explode("near").alias("b"))
    many = met.where("near is null").select("a").distinct()
    entries = many.select("a", F.explode(F.array(*_ball(F.col("a"), 64))).alias("z")).groupBy("z").agg(F.collect_set("a").alias("members"))
    entries = entries.where(F.size("members") > 1)
    hubs = entries.select(F.array_min("members").alias("b"), F.explode("members").alias("a"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return few.union(hubs.select("a", "b")).where(apart.between(1, 2)).distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Columns: key, h (hash of the text), fingerprint long, group long (the least fingerprint
    of the component), component_id long: the smallest key that links lead to, itself included.

    One row to each input row, repeated rows too; rows that share a key share nothing
    else by that. Null and empty texts have fingerprint 0 and are linked like others.
    A null key stays null and names no component unless it has no other member."""
    prints, _ = cut(fingerprints(docs, key=key, text=text, width=width))
    nodes, _ = cut(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    grouped = connected(links(nodes), "a", "b").withColumnRenamed("node", "fingerprint")
    nodes = nodes.hint("merge")
    named = grouped.join(nodes, "fingerprint")
    least = named.groupBy("component").agg(F.min("least").alias("of_component"))
    named, _ = cut(grouped.join(least.hint("merge"), "component").select("fingerprint", F.col("component").alias("group"), "of_component"))
    labels = nodes.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("group", "fingerprint").alias("group"), F.when(F.col("group").isNull(), F.col("least")).otherwise(F.col("of_component")).alias("component_id"))
    labels, _ = cut(labels)
    return prints.join(labels.hint("merge"), "fingerprint").select(key, "h", "fingerprint", "group", "component_id")


def hexadecimal(f: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(f), 16, "0"))
