"""Modified Kneser-Ney grams of four whole code points, with no fixed alphabet.

Letters lose their case, nothing else is folded; a text begins after spaces. The uniform
model below the first order is that over all of Unicode, so that the probabilities after
any context sum to one there.

Documents are dealt into blocks of about BLOCK symbols in the order in which they are read,
and a block's distinct grams are listed. Grams of trusted texts
are counted by task and added up by gram; the lower orders count distinct left
neighbours. What is asked (the distinct grams of all blocks) meets the count tables in
joins sharded by gram or context, from the first order to the last. The log
probabilities go back to their blocks, packed by task and block; there the block's documents, read a second
time and sent as compressed Arrow data, stream past them. So texts are shuffled once and never written. Nothing but the counts of
counts goes to the driver, and no table is broadcast; a task holds the distinct grams of one block.

The two readings must give the same rows in the same order, as scans of files do; otherwise a gram is
missing from its block and the job stops with an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import cut, slices

ORDER, SIGNS = 4, 0x110000
BLOCK = 1 << 23
_CHUNK = 1 << 19  # bytes of text in a packed row, about
_COUNTED = 1 << 18  # distinct grams after which a task hands on its counts
_PAD = np.full(ORDER - 1, ord(" "), np.int64)
_ROWS = 1 << 16


def pieces(text: str) -> Iterator[np.ndarray]:
    """The symbols of a text in parts of at most BLOCK, each after the three before it."""
    s = np.concatenate([_PAD, np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)])
    for k in range(0, len(s) - len(_PAD), BLOCK):
        yield s[k : k + BLOCK + len(_PAD)]


def size_of(text: str) -> int:
    return len(text.lower())


def _pairs(s: np.ndarray) -> np.ndarray:
    return s[:-1] << 21 | s[1:]


def tally(parts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The distinct grams of some pieces and their counts."""
    ends = np.cumsum([len(p) for p in parts])
    s = np.concatenate(parts)
    within = np.ones(len(s) - ORDER + 1, bool)
    within[(ends[:-1, None] - np.arange(1, ORDER)).ravel()] = False
    pair = _pairs(s)
    pairs = np.unique(pair)
    at = np.searchsorted(pairs, pair)
    gram, count = np.unique((at[:-2] * len(pairs) + at[2:])[within], return_counts=True)
    a, b = pairs[gram // len(pairs)], pairs[gram % len(pairs)]
    low = (1 << 21) - 1
    joined = np.stack([a >> 21, a & low, b >> 21, b & low], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [joined[k : k + ORDER] for k in range(0, len(joined), ORDER)], count


class Table:
    """Log probabilities of a block's grams."""

    def __init__(self, grams: str, logp: np.ndarray):
        c = np.frombuffer(grams.encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, ORDER)
        a, b = c[:, 0] << 21 | c[:, 1], c[:, 2] << 21 | c[:, 3]
        self.pairs = np.unique(np.concatenate([a, b]))
        g = np.searchsorted(self.pairs, a) * len(self.pairs) + np.searchsorted(self.pairs, b)
        order = np.argsort(g)
        self.grams, self.logp = g[order], logp[order]

    def score(self, text: str) -> float:
        """The log probability of a text all of whose grams are in the table."""
        total = 0.0
        for s in pieces(text):
            pair = _pairs(s)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            g = at[:-2] * len(self.pairs) + at[2:]
            where = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
            if (self.pairs[at] != pair).any() or (self.grams[where] != g).any():
                raise ValueError("a document isn't in the block that it was listed in: its table changed between two readings")
            total += float(self.logp[where].sum())
        return total


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        grams, counts = list(seen), list(seen.values())
        for k in range(0, len(grams), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + _ROWS], pa.string()), pa.array(counts[k : k + _ROWS], pa.int64())], names=["gram", "c"])
        seen.clear()

    for part in slices(batches, 0, 2 * _CHUNK):
        held = [s for text in part.column(0).to_pylist() for s in pieces(text)]
        for k in range(0, len(held), 1 << 12):
            grams, count = tally(held[k : k + (1 << 12)])
            seen.update(dict(zip(grams, count.tolist(), strict=True)))
            if len(seen) > _COUNTED:
                yield from out()
    yield from out()


def count_grams(texts: DataFrame, text: str = "text") -> DataFrame:
    """Columns: gram, c: counts in all texts, which aren't null."""
    return texts.select(text).mapInArrow(_count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


_LISTED = "block long, grams array<string>"
_PACKED = "block long, docs binary"
_DOCS = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[np.ndarray], bool]]:
    """Block, some rows of it, their symbols, and whether the block ends with them."""
    block, filled, before = None, 0, None
    for some in slices(batches, 2, _CHUNK):
        block = some.column(3)[0].as_py() << 32 if block is None else block
        held = [s for text in some.column(2).to_pylist() for s in pieces(text)]
        if before is not None:
            yield *before, False
        filled += sum(map(len, held))
        before = block, some, held
        if filled >= BLOCK:
            yield *before, True
            block, filled, before = block + 1, 0, None
    if before is not None:
        yield *before, True


def _list(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for block, _, held, last in _blocks(batches):
        for k in range(0, len(held), 1 << 12):
            seen.update(tally(held[k : k + (1 << 12)])[0])
        if last:
            grams = list(seen)
            for k in range(0, len(grams), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([grams[k : k + _ROWS]], pa.list_(pa.string()))], names=["block", "grams"])
            seen.clear()


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, some, _, _ in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(some.columns[:3], _DOCS.types, strict=True)], schema=_DOCS))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, gram, logp row by row -> a row to a block of what the task has of it."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("block", "ascending")])).combine_chunks()
        block, grams, logp = rows["block"].to_numpy(), rows["gram"].to_pylist(), rows["logp"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([block[x]]), pa.array(["".join(grams[x:y])]), pa.array([logp[x:y].tobytes()], pa.binary())], names=["block", "grams", "logp"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1 << 19:
            yield from out()
            held, size = [], 0
    if size:
        yield from out()


def kneser_ney(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """Columns: gram, p for the grams asked for. counts: gram, c of the trusted text."""
    tables = [counts]
    wanted = [asked.select("gram").distinct()]
    for _ in range(ORDER - 1):
        tables.append(cut(tables[-1].select(F.expr("substring(gram, 2)").alias("gram")).groupBy("gram").agg(F.count("*").alias("c")))[0])
        wanted.append(wanted[-1].select(F.expr("substring(gram, 2)").alias("gram")).distinct())
    lower = None
    for k, (table, want) in enumerate(zip(reversed(tables), reversed(wanted), strict=True), 1):
        of = [F.sum((F.col("c") == n).cast("double")).alias(f"n{n}") for n in (1, 2, 3, 4)]
        n1, n2, n3, n4 = (float(x or 0) for x in table.agg(*of).first())
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
        d = [m - (m + 1) * y * b / a if a else 0.5 for m, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        d = [x if x > 0 else 0.5 for x in d]  # a context that keeps nothing back would rule out what it hasn't seen
        cut_off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).when(F.col("c") > 2, d[2]).otherwise(0.0)
        context = F.expr(f"substring(gram, 1, {k - 1})").alias("context")
        after = table.groupBy(context).agg(F.sum("c").alias("total"), F.sum(cut_off).alias("kept_back"))
        every = want.select("gram", context, F.expr("substring(gram, 2)").alias("shorter"))
        every = every.join(table.hint("merge"), "gram", "left").join(after.hint("merge"), "context", "left")
        if lower is None:
            every = every.withColumn("q", F.lit(1.0 / SIGNS))
        else:
            every = every.join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("q")).hint("merge"), "shorter")
        own = F.greatest(F.coalesce("c", F.lit(0)) - F.coalesce(cut_off, F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((own + F.col("kept_back") * F.col("q")) / F.col("total"))
        lower, _ = cut(every.select("gram", p.alias("p")))
    return lower


def _score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, table = None, None
    grams: list[str] = []
    logp: list[bytes] = []
    for batch in batches:
        for one in range(batch.num_rows):
            now, is_doc, packed, g, l = (batch.column(c)[one] for c in range(5))
            if now.as_py() != block:
                block, table, grams, logp = now.as_py(), None, [], []
            if not is_doc.as_py():
                grams.append(g.as_py())
                logp.append(l.as_py())
                continue
            if table is None:
                table = Table("".join(grams), np.frombuffer(b"".join(logp)))
            docs = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
            worth = [float(np.exp(-table.score(t) / size_of(t))) if t else None for t in docs["text"].to_pylist()]
            yield from pa.table([docs["id"], docs["lang"], pa.array(worth, pa.float64())], names=["id", "lang", "perplexity"]).to_batches()


def perplexities(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Columns: id, lang, perplexity (per code point; null for empty texts). docs: id long,
    lang string, text string not null; counts: of trusted texts, by count_grams()."""
    docs = docs.select("id", "lang", "text", F.spark_partition_id().cast("long").alias("part"))
    listed, _ = cut(docs.mapInArrow(_list, _LISTED))
    listed = listed.select("block", F.explode("grams").alias("gram"))
    found = kneser_ney(counts, listed)
    known = listed.join(found.hint("merge"), "gram").select("block", "gram", F.log("p").alias("logp")).mapInArrow(_gather, "block long, grams string, logp binary")
    none = lambda kind: F.lit(None).cast(kind)
    known = known.select("block", F.lit(False).alias("is_doc"), none("binary").alias("docs"), "grams", "logp")
    rows = docs.mapInArrow(_pack, _PACKED).select("block", F.lit(True).alias("is_doc"), "docs", none("string").alias("grams"), none("binary").alias("logp"))
    met = known.unionByName(rows).repartition("block").sortWithinPartitions("block", "is_doc")
    return met.mapInArrow(_score, "id long, lang string, perplexity double")
