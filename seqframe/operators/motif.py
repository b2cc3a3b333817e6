"""Position matrices, consensus and motif trees of aligned sequences."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqframe.functions.sequence import letters
from seqframe.scratch import settled, small

BASES = ("A", "C", "G", "T")


def _cut(seqs: DataFrame, seq: str, upto: int | None) -> DataFrame:
    """Sequences cut to the shortest length (or upto), one letter a row: pos, base."""
    shortest = F.broadcast(seqs.agg(F.min(F.length(seq)).alias("__n")))
    n = F.col("__n") if upto is None else F.least(F.col("__n"), F.lit(upto))
    rows = seqs.crossJoin(shortest).select(F.posexplode(letters(F.substring(F.col(seq), F.lit(1), n))).alias("pos", "base"))
    return rows


def position_counts(seqs: DataFrame, *, seq: str = "seq", upto: int | None = None) -> DataFrame:
    """pos, base, n: for each position and each of A, C, G and T, 0 where there is none."""
    counts = _cut(seqs, seq, upto).where(F.col("base").isin(*BASES)).groupBy("pos", "base").agg(F.count("*").alias("n"))
    every = counts.select("pos").distinct().select("pos", F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    return every.join(counts, ["pos", "base"], "left").fillna(0, ["n"])


def position_weights(seqs: DataFrame, *, seq: str = "seq", upto: int | None = None) -> DataFrame:
    """pos, base, n, freq: the counts over the number of sequences."""
    total = F.broadcast(seqs.agg(F.count(seq).alias("__n")))
    return position_counts(seqs, seq=seq, upto=upto).crossJoin(total).select("pos", "base", "n", (F.col("n") / F.col("__n")).alias("freq"))


def consensus(weights: DataFrame) -> DataFrame:
    """pos, base: the most frequent base, the first of equals by name."""
    return weights.groupBy("pos").agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("base"))


def consensus_sequence(weights: DataFrame) -> DataFrame:
    """One row: the consensus as a string."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "base")))
    return consensus(weights).agg(F.array_join(F.transform(in_order, lambda x: x["base"]), "").alias("consensus"))


def consensus_sets(weights: DataFrame, share: float = 0.5) -> DataFrame:
    """pos, base of bases with strictly more than that share of the position's greatest count."""
    top = F.max("n").over(Window.partitionBy("pos"))
    return weights.withColumn("__top", top).where(F.col("n") > F.col("__top") * share).select("pos", "base", "n")


def windows(reads: DataFrame, motif: str, size: int, *, seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """seq: `size` letters from each occurrence of the motif on, overlapping ones too; what
    runs past a read's end is left out. So reads are aligned at a motif."""
    if size < len(motif):
        raise ValueError("windows hold their motif")
    found = F.regexp_extract_all(F.col(seq), F.lit(rf"(?=(\Q{motif}\E.{{{size - len(motif)}}}))"), F.lit(1))
    return reads.select(*keep, F.explode(found).alias("seq"))


_LEVELS = 6  # letters that a round of motif_tree() goes down


def _pruned(counts: dict[str, int], start: int, end: int, threshold: float) -> dict[str, int]:
    """Counts by the first `end` letters of strings that share the first `start`, where every letter between was
    among the most frequent behind what stands before it."""
    for k in range(start + 1, end + 1):
        level, top = Counter(), {}
        for s, n in counts.items():
            level[s[:k]] += n
        level = {m: n for m, n in level.items() if m[-1] in BASES}
        for m, n in level.items():
            top[m[:-1]] = max(n, top.get(m[:-1], 0))
        kept = {m for m, n in level.items() if n >= top[m[:-1]] * (1 - threshold)}
        counts = {s: n for s, n in counts.items() if s[:k] in kept}
    return counts


def _pruner(start: int, end: int, threshold: float):
    def prune(group: pa.Table) -> pa.Table:
        left = _pruned(dict(zip(group.column("motif").to_pylist(), group.column("n").to_pylist(), strict=True)), start, end, threshold)
        return pa.table({"motif": pa.array(list(left), pa.string()), "n": pa.array(list(left.values()), pa.int64())})

    return prune


def motif_tree(seqs: DataFrame, depth: int, threshold: float = 0.1, *, seq: str = "seq") -> DataFrame:
    """motif, n: prefixes of `depth` letters reached by taking, at each position, every
    base whose count among the sequences with the prefix so far is at least
    (1 - threshold) of the greatest. Rounds of a few levels: the sequences, counted once, that go on from the
    frontier are counted by their next letters, with partial counts; to a branch of the frontier that is a trie of
    a few thousand strings at most, which is pruned by itself, and what is left is written as
    the next frontier. So plans stay as small as a round, however deep the tree is. No prefix has no
    letters: of depth 0, as with an empty sequence among the others, the tree is empty."""
    if depth < 1:
        return seqs.select(F.col(seq).cast("string").alias("motif"), F.lit(0).cast("long").alias("n")).limit(0)
    rows = settled(seqs.where(F.length(seq) >= depth).select(F.substring(F.col(seq), 1, depth).alias("seq")).groupBy("seq").agg(F.count("*").alias("n")))
    kept, at = rows.select(F.col("seq").alias("motif"), "n"), 0
    while at < depth:
        start, end = at, min(depth, at + _LEVELS)
        alive = rows if not at else rows.join(small(kept.select("motif")), F.substring("seq", 1, at) == F.col("motif"), "left_semi")
        trie = alive.groupBy(F.substring("seq", 1, end).alias("motif")).agg(F.sum("n").alias("n")).withColumn("branch", F.substring("motif", 1, start))
        kept, at = settled(trie.groupBy("branch").applyInArrow(_pruner(start, end, threshold), "motif string, n long")), end
    return kept


def motif_graph(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, label) and edges(source, target, value): all bases of a position to all
    of the next one; at most sixteen edges to a position."""
    name = F.concat(F.col("pos").cast("string"), F.lit("_"), F.col("base"))
    nodes = sets.select(name.alias("id"), F.col("base").alias("label"), "pos")
    ahead = nodes.select(F.col("id").alias("target"), (F.col("pos") - 1).alias("pos"))
    edges = nodes.join(ahead, "pos").select(F.col("id").alias("source"), "target", F.lit(1).alias("value"))
    return nodes.select("id", "label"), edges
