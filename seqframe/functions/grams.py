"""k-mers of whole slices of reads at once, in numpy: a k-mer is a number of its letters' places
in the slice's alphabet, so that counting needs no strings but for the different ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLICE = 1 << 21  # letters that are worked on together, about


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about that many letters in all; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        turn = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def _places(column: pa.Array, k: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All strings as one, its code points, where k-mers begin and whose they are."""
    text = pc.fill_null(column.cast(pa.string()), "")
    joined = "".join(text.to_pylist())
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    many = np.maximum(sizes - k + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), many)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(many) - many), many)
    return joined, codes, at, owner


def counted(column: pa.Array, k: int, whole: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Row, k-mer and number of each different k-mer of each row; whole: of all rows as one."""
    joined, codes, at, owner = _places(column, k)
    seen, letter = np.unique(codes, return_inverse=True) if codes.dtype != np.uint8 else (np.flatnonzero(np.bincount(codes, minlength=256)), None)
    if letter is None:
        table = np.zeros(256, np.int64)
        table[seen] = np.arange(len(seen))
        letter = table[codes]
    base, name, room = max(2, len(seen)), np.zeros(len(at), np.int64), 1

    def fits(name: np.ndarray, room: int, more: int) -> tuple[np.ndarray, int]:
        """Named anew by the different ones, if numbers would grow too large."""
        if room * more < 1 << 62:
            return name, room
        kinds, name = np.unique(name, return_inverse=True)
        return name, len(kinds)

    for i in range(k):
        name, room = fits(name, room, base)
        name, room = name * base + letter[at + i], room * base
    rows = 1 if whole else max(1, len(column))
    name, room = fits(name, room, rows)
    both = name if whole else owner * room + name
    if room * rows <= 1 << 22:
        n, first = np.bincount(both, minlength=room * rows), np.zeros(room * rows, np.int64)
        first[both] = at
        kinds = np.flatnonzero(n)
        n, first = n[kinds], first[kinds]
    else:
        kinds, place, n = np.unique(both, return_index=True, return_counts=True)
        first = at[place]
    return kinds // room, [joined[a : a + k] for a in first.tolist()], n


def spelled(column: pa.Array, k: int) -> pa.Array:
    """The k-mers of each row in order, as lists; none of a null."""
    joined, codes, at, owner = _places(column, k)
    many = np.bincount(owner, minlength=len(column))
    if codes.dtype == np.uint8:
        letters = np.empty((len(at), k), np.uint8)
        for i in range(k):
            letters[:, i] = codes[at + i]
        words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(letters)])
    else:
        words = pa.array([joined[a : a + k] for a in at.tolist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), words)


def by_slice(reads: DataFrame, seq: str | Column, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, *keep: str) -> DataFrame:
    """What run returns for slices of the columns in keep followed by the sequence."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, len(keep)):
            yield run(part)

    return reads.select(*keep, (F.col(seq) if isinstance(seq, str) else seq).cast("string").alias("seq")).mapInArrow(every, schema)


def kmer_lists(reads: DataFrame, k: int, *, key: str, seq: str) -> DataFrame:
    """key, tokens: the k-mers of each read in order."""
    kind = reads.select(key).schema[0].dataType.simpleString()
    return by_slice(reads, seq, lambda part: pa.RecordBatch.from_arrays([part.column(0), spelled(part.column(1), k)], names=[key, "tokens"]), f"`{key}` {kind}, tokens array<string>", key)


def kmer_totals(reads: DataFrame, k: int, *, seq: str = "seq") -> DataFrame:
    """kmer, n over all reads; a row to a k-mer leaves each slice."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        _, words, n = counted(part.column(0), k, whole=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["kmer", "n"])

    return by_slice(reads, seq, run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def kmer_counts(reads: DataFrame, k: int, *, key: str, seq: str) -> DataFrame:
    """key, kmer, n: a row to each different k-mer of a read, before reads of one key meet."""
    kind = reads.select(key).schema[0].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        row, words, n = counted(part.column(1), k)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=[key, "kmer", "n"])

    return by_slice(reads, seq, run, f"`{key}` {kind}, kmer string, n long", key)
