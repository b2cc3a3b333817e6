"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers encode the same bytes. Tokens of one and the other that share a byte are
linked; the connected groups of these links are what lies between two offsets at which
tokens of both end. To find them every token points to the token that reaches farthest to
the right among those it overlaps (itself included; of two that end together, the one of
A): that of the other tokenizer which holds its last byte. Successor doubling, for all
tokens of many texts at once, takes each pointer to its component's terminal token, which
names the group.

Both encoders here cut at the border between a character that isn't white space and a
space: no token lies across. The stretches between such borders repeat, so that each worker
aligns a stretch once and keeps it in a cache that is bounded in bytes; long stretches
aren't kept. B's model puts a space in front of what it is given, and so does the text
of A get one.

How many documents hold an id pair linked is a count over the whole corpus. Texts are taken
in slices of bounded size; a slice counts its pairs, the slices' counts are summed by a
shuffle, and return to their slice with the mark of each A id's highest. What a slice knows
of its documents is written once, so that nothing is encoded twice and a repeated task
finds the same slices.

Null and empty texts have no tokens, and so have texts whose tokens don't give the bytes
back (a text with U+2581, for B): zeros. They count for no pair. Each input row gives one
output row, and repeated rows count once each as documents. Very long texts are slices of
their own. Empty tables give empty results. Other columns aren't looked at, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.bpe import Recent
from seqframe.llm.common import cut, kind_of, slices, text_of
from seqframe.llm.tokencount import byte_letters

BORDER = re.compile(r"(?<=\S)(?= )")
_TEXTS = 2 << 20  # bytes of texts that are aligned together
_SLICE = 16 << 20  # bytes of texts that share a table of pairs, about
_CACHE_BYTES = 96 << 20
_ASKED = 1 << 18  # characters of stretches that are encoded at once


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of A, then of B, whose ends are given and which cover the same bytes: the
    terminal token that pointer jumping leads to, and for those of A the token of B that
    holds the last byte."""
    last = np.searchsorted(ends_b, ends_a)
    n = len(ends_a)
    to = np.concatenate([np.where(ends_b[last] > ends_a, n + last, np.arange(n)), np.searchsorted(ends_a, ends_b)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to, last
        to = further


class Aligner:
    """Encodes and aligns by two vocabulary files."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = {letter: b for b, letter in enumerate(byte_letters())}
        spelled = sorted((i, t) for t, i in self.a.get_vocab().items())
        self.bytes_a = [b""] * (spelled[-1][0] + 1)
        for i, t in spelled:
            self.bytes_a[i] = bytes([value[c] for c in t]) if all(c in value for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Ids of A and of B, each within a group and at the end of one.
        self.spelled = [f"{i}{sign}" for n, end in ((len(self.bytes_a), "|"), (len(pieces), ";")) for i in range(n) for sign in (",", end)]
        self.spelled_length = np.array(list(map(len, self.spelled)), np.int64)
        self.space = self.b.piece_to_id("▁")
        self.known = Recent(_CACHE_BYTES, lambda v: 200 + len(v[0]) + len(v[1]) if v else 0)

    def _encoded(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        return a, [ids if s != " " else [self.space] for s, ids in zip(stretches, b, strict=True)]

    def fresh(self, stretches: list[str]) -> dict[str, tuple | None]:
        """For each stretch: its groups as text, its id pairs (A's id in the upper half) and the
        numbers of tokens of A and B and of groups; None if the bytes don't come back."""
        out: dict[str, tuple | None] = {}
        turn = np.cumsum([len(s) for s in stretches]) // _ASKED
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(stretches)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            some = stretches[x:y]
            a, b = self._encoded(some)
            if not (self._back(some, a, self.bytes_a, self.length_a) and self._back(some, b, self.bytes_b, self.length_b)):
                whole = [b"".join(map(self.bytes_a.__getitem__, i)) == s.encode() == b"".join(map(self.bytes_b.__getitem__, j)) for s, i, j in zip(some, a, b, strict=True)]
                out.update((s, None) for s, ok in zip(some, whole, strict=True) if not ok)
                some, a, b = ([v for v, ok in zip(values, whole, strict=True) if ok] for values in (some, a, b))
            if some:
                out.update(zip(some, self._aligned(a, b), strict=True))
        return out

    def _back(self, some: list[str], ids: list[list[int]], table: list[bytes], length: np.ndarray) -> bool:
        """Whether the tokens of all stretches give their bytes back, each its own."""
        text = "".join(some)
        flat = list(chain.from_iterable(ids))
        if b"".join(map(table.__getitem__, flat)) != text.encode():
            return False
        ends = np.cumsum(list(map(len, some)) if text.isascii() else [len(s.encode()) for s in some])
        return bool((np.concatenate([[0], np.cumsum(length[flat])])[np.cumsum(list(map(len, ids)))] == ends).all())

    def _aligned(self, a: list[list[int]], b: list[list[int]]) -> Iterator[tuple]:
        size_a, size_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, size_a), (b, size_b)))
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        to, last = successors(ends_a, ends_b)
        n = len(ids_a)
        first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), side="right")
        many = last - first + 1
        pairs = np.repeat(ids_a << 32, many) | ids_b[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        # Terminal tokens are tokens of A and stand in order. Each token is written with the sign behind it.
        close_a, close_b = np.diff(to[:n], append=-1) != 0, np.diff(to[n:], append=-1) != 0
        written = np.concatenate([2 * ids_a + close_a, 2 * (ids_b + len(self.bytes_a)) + close_b])
        written = written[np.argsort(np.concatenate([2 * to[:n], 2 * to[n:] + 1]), kind="stable")]
        text = "".join(map(self.spelled.__getitem__, written.tolist()))
        text_ends = np.cumsum(self.spelled_length[written])[np.cumsum(size_a + size_b) - 1].tolist()
        groups = np.diff(np.cumsum(close_a)[np.cumsum(size_a) - 1], prepend=0).tolist()
        packed, pair_ends = pairs.astype("<u8").tobytes(), (8 * np.cumsum(many)[np.cumsum(size_a) - 1]).tolist()
        at, done = 0, 0
        for end, stop, x, y, z in zip(text_ends, pair_ends, size_a.tolist(), size_b.tolist(), groups, strict=True):
            yield text[at : end - 1], packed[done:stop], x, y, z
            at, done = end, stop

    def align(self, texts: list[str]) -> tuple[list[list[str]], dict[str, tuple | None]]:
        """The stretches of each text, and what is known of each stretch."""
        cuts = [BORDER.split(" " + t) if t else [] for t in texts]
        return cuts, self.known.found(set().union(*cuts), self.fresh)


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One to a Python process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def _summed(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of their weights (1 by default)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    if weights is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights


class Slice:
    """Documents and the table of their id pairs."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []  # values of each document
        self.keys: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = []  # pairs, their documents, and each document's pairs by place with multiplicity
        self.size = 0

    def add(self, keys: pa.Array, texts: list[str], to: Aligner, digest: bool) -> None:
        cuts, known = to.align(texts)
        every = list(set().union(*cuts))
        found = list(map(known.__getitem__, every))
        if None in found:
            bad = {c for c, v in zip(every, found, strict=True) if v is None}
            cuts = [some if bad.isdisjoint(some) else [] for some in cuts]
            every, found = ([x for x, v in zip(values, found, strict=True) if v is not None] for values in (every, found))
        place = dict(zip(every, range(len(every)), strict=True))
        text = [v[0] for v in found]
        sizes = np.array([v[2:] for v in found], np.int64).reshape(-1, 3)
        many = np.array([len(v[1]) >> 3 for v in found], np.int64)
        pairs, code = np.unique(np.frombuffer(b"".join([v[1] for v in found]), "<u8").astype(np.int64), return_inverse=True)
        n, which = len(texts), [list(map(place.__getitem__, some)) for some in cuts]
        flat = np.fromiter(chain.from_iterable(which), np.int64)
        at, times = _summed(np.repeat(np.arange(n), list(map(len, which))) * len(every) + flat, None)
        doc, stretch = at // max(1, len(every)), at % max(1, len(every))
        tokens = [np.bincount(doc, times * sizes[stretch, k], n).astype(np.int64).tolist() for k in range(3)]
        links = many[stretch]
        here = code[np.repeat((np.cumsum(many) - many)[stretch] - (np.cumsum(links) - links), links) + np.arange(int(links.sum()))]
        at, times = _summed(np.repeat(doc, links) * len(pairs) + here, np.repeat(times, links))
        doc, here = at // max(1, len(pairs)), at % max(1, len(pairs))
        total = np.bincount(doc, times, n).astype(np.int64).tolist()
        borders = np.searchsorted(doc, np.arange(n + 1)).tolist()
        groups = [";".join(map(text.__getitem__, some)) for some in which]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        self.rows += zip(*tokens, total, groups, strict=True)
        self.keys.append(keys)
        self.parts.append((pairs, np.bincount(here, minlength=len(pairs)), [(here[x:y], times[x:y]) for x, y in zip(borders[:-1], borders[1:], strict=True)]))
        self.size += sum(map(len, texts)) + 64 * n

    def done(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Each document's pairs, packed; the pairs of the slice and their documents."""
        every = np.unique(np.concatenate([p for p, _, _ in self.parts]))
        total, held = np.zeros(len(every), np.int64), []
        for pairs, docs_of, of_docs in self.parts:
            at = np.searchsorted(every, pairs)
            total[at] += docs_of
            held += [packed_links(at[x], n) for x, n in of_docs]
        return held, every, total


def packed_links(at: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each is linked, as zstandard-compressed byte planes."""
    both = np.stack([np.diff(at, prepend=0), times]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes())


def read_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    both = np.ascontiguousarray(planes.reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4")[..., 0].astype(np.int64)
    return np.cumsum(both[0]), both[1]


def _slices(docs: DataFrame, path_a: str, path_b: str, key: str, text: str, digest: bool, most: int = _SLICE) -> DataFrame:
    """Rows of documents, and one row to each slice with its pairs (packed)."""
    kind = kind_of(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, part_id, made = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        now, schema = Slice(), None

        def flush() -> Iterator[pa.RecordBatch]:
            number = part_id << 32 | made
            held, every, total = now.done()
            keys, at = pa.concat_arrays(now.keys), 0
            while at < len(held):  # batches of bounded size
                end, size = at, 0
                while end < len(held) and size < 8 << 20:
                    size += len(held[end]) + len(now.rows[end][4]) + 64
                    end += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*now.rows[at:end]), [pa.int64()] * 4 + [pa.string()], strict=True)]
                nothing = pa.nulls(end - at, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([number] * (end - at), pa.int64()), keys.slice(at, end - at), *columns, pa.array(held[at:end], pa.binary()), nothing, nothing], names=names)
                at = end
            if len(every):
                one = [pa.array([number], pa.int64()), pa.nulls(1, keys.type), *(pa.nulls(1, t) for t in [pa.int64()] * 4 + [pa.string(), pa.binary()])]
                yield pa.RecordBatch.from_arrays([*one, pa.array([every.astype("<i8").tobytes()], pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

        for part in slices(batches, 1, min(_TEXTS, most)):
            now.add(part.column(0), part.column(1).to_pylist(), to, digest)
            if now.size >= most:
                yield from flush()
                now, made = Slice(), made + 1
        if now.rows:
            yield from flush()

    names = ["slice", key, "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "held"]
    return docs.select(key, text_of(text).alias(text)).mapInArrow(run, f"slice long, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs binary, held binary")


def _listed(tables: DataFrame) -> DataFrame:
    """Columns: slice, at int (place in the slice's table), pair, n long (documents in the slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, held = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<i8")
                for k in range(0, len(pairs), 1 << 16):
                    p = pairs[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), number, np.int64)), pa.array(np.arange(k, k + len(p), dtype=np.int32)), pa.array(p), pa.array(held[k : k + len(p)])], names=["slice", "at", "pair", "n"])

    return tables.select("slice", "pairs", "held").mapInArrow(run, "slice long, at int, pair long, n long")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: a, b, n long: how many documents hold ids a and b linked."""
    tables, _ = cut(_slices(docs, path_a, path_b, key, text, True).where("pairs is not null").select("slice", "pairs", "held"))
    counted = _listed(tables).groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0")  # 0: only in stretches of texts without tokens
    return counted.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n")


def align(docs: DataFrame, path_a: str, path_b: str, *, key: str = "doc_id", text: str = "text", digest: bool = False, slice_size: int = _SLICE) -> DataFrame:
    """Columns: key, n_a, n_b, n_groups, n_links, n_best, count_sum long and groups string
    (a1,a2|b1;a3|b2,b3: ids of A and B in order; with digest its SHA-256 in lowercase hex,
    which spares several times the text). n_best: links whose pair is the most frequent one
    of their A id, ties included; count_sum: the sum of the pairs' documents over all links.
    Both paths must lead to the vocabulary files on every executor. slice_size: bytes of
    texts that share a table of pairs, about."""
    kept, _ = cut(_slices(docs, path_a, path_b, key, text, digest, slice_size))
    rows = _listed(kept.where("pairs is not null"))
    counts, _ = cut(rows.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.shiftright("pair", 32)))
    highest = counts.groupBy("a").agg(F.max("total").alias("most"))
    known = counts.join(highest, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    told = rows.join(known, "pair").select("slice", "at", "total", "best")
    fields = ["n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    of_docs = kept.where("pairs is null").select("slice", F.col(key).alias("k"), *fields)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros((2, right.num_rows), np.int64)
        at = right.column("at").to_numpy()
        total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        sums = [(int(best[x] @ n), int(total[x] @ n)) for x, n in map(read_links, left.column("links").to_pylist())]
        made = [pa.array(c, pa.int64()) for c in zip(*sums)] if sums else [pa.array([], pa.int64())] * 2
        columns = {key: left.column("k"), **{c: left.column(c) for c in fields[:-1]}, "n_best": made[0], "count_sum": made[1]}
        return pa.table(columns).select([key, *fields[:4], "n_best", "count_sum", "groups"])

    schema = f"`{key}` {kind_of(docs, key)}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return of_docs.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, schema)
