"""Motif search: a theta join of reads and a small set of motifs that yields matches.

Matches have seq_id, query_name, position (0-based), length and score. Motifs come as a
dictionary or as a table of schema.QUERY, and are searched for in blocks of bounded size,
of which most sets have one: a block goes to every task, and all its motifs are found in
one pass over the reads (seeds.py).

Exact search, wildcards, edit distance, window similarity and local alignment run over Arrow batches in numpy. All reads of a slice are one text then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqframe.functions.grams import slices
from seqframe.functions.sequence import edit_budget, exact_edit_budget, reverse_complement
from seqframe.operators.localalign import aligned
from seqframe.operators.seeds import Automaton, Budgeted, Letters, Text
from seqframe.scratch import dealt

_BLOCK = 1 << 20  # letters of motifs that are searched for together, about
_SLICE = 1 << 21  # letters of reads that are one text
_ROWS = 1 << 17  # of an output batch


def motif_blocks(queries: DataFrame | Mapping[str, str]) -> Iterator[list[tuple[str, str]]]:
    """Names and sequences in order, in blocks of bounded size; one empty block if there are none.
    A table of motifs comes to the driver block by block."""
    rows = queries.items() if isinstance(queries, Mapping) else queries.orderBy("query_idx").select("query_name", "query_seq").toLocalIterator()
    block, size, any_block = [], 0, False
    for name, motif in rows:
        if size and size + len(motif or "") > _BLOCK:
            yield block
            block, size, any_block = [], 0, True
        block.append((name, motif or ""))
        size += len(motif or "") + 16
    if block or not any_block:
        yield block


def _by_block(queries: DataFrame | Mapping[str, str], search: Callable[[list[tuple[str, str]]], DataFrame]) -> DataFrame:
    """One pass over the reads for each block of motifs."""
    return reduce(DataFrame.unionAll, map(search, motif_blocks(queries)))


def _searched(reads: DataFrame, motifs: list[tuple[str, str]] | None, finder: Callable, key: str, seq: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Matches by finder(), called once a task: it gives a function from a text to motif, owner,
    position, length and score of each match; without motifs it names them itself. The columns in
    keep are taken along."""
    kept = [key, *keep]
    names = [*(f"k{i}" for i in range(len(kept))), "query_name", "position", "length", "score"]
    types = [reads.select(c).schema[0].dataType.simpleString() for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, called = finder(), None if motifs is None else pa.array([n for n, _ in motifs], pa.string())
        for part in slices(batches, len(kept), _SLICE):
            found = find(Text([s or "" for s in part.column(len(kept)).to_pylist()]))
            for k in range(0, len(found[0]), _ROWS):
                motif, owner, *rest = (x[k : k + _ROWS] for x in found)
                own = [c.take(pa.array(owner)) for c in part.columns[: len(kept)]]
                rest = [pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int32(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(motif, pa.string()) if called is None else called.take(pa.array(motif)), *rest], names=names)

    schema = ", ".join(f"k{i} {t}" for i, t in enumerate(types)) + ", query_name string, position int, length int, score double"
    found = reads.select(*kept, F.col(seq).cast("string").alias("seq")).mapInArrow(run, schema)
    return found.toDF(*kept, *names[len(kept) :]).select(key, *names[len(kept) :], *keep)


_LENGTHS = 8  # of motifs that are joined
_BITS = 27  # of a place in the filter


def _window_hash(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` letters."""
    many = max(0, len(codes) - size + 1)
    h, base = np.zeros(many, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(size):
        h *= base
        h += codes[i : i + many]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in the filter."""
    return (h >> np.uint64(64 - _BITS)).astype(np.int64), (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _filter(queries: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the motifs of a length, of 2^_BITS bits however many they are; comes to the
    driver as the words that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = Text(batch.column(0).to_pylist())
            at = np.concatenate(_bits(_window_hash(text.codes, size)[text.starts]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    rows = queries.where(F.length("query_seq") == size).select("query_seq").mapInArrow(run, "word long, bits long")
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (_BITS - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint8)


def _joined(reads: DataFrame, queries: DataFrame, size: int, key: str, seq: str, keep: tuple[str, ...]) -> DataFrame:
    """Occurrences of any number of motifs of one length: places of the reads that pass a filter of the
    motifs are joined with them by their letters."""
    sent = reads.sparkSession.sparkContext.broadcast(_filter(queries, size))

    def finder():
        table = sent.value

        def passes(at: np.ndarray) -> np.ndarray:
            return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

        def find(text: Text) -> tuple:
            a, b = _bits(_window_hash(text.codes, size))
            left = np.repeat(text.ends, text.ends - text.starts + 1) - np.arange(len(text.codes))
            at = np.flatnonzero(passes(a) & (left[: len(a)] >= size))
            at = at[passes(b[at])]
            owner = text.owner(at)
            return [text.joined[i : i + size] for i in at.tolist()], owner, at - text.starts[owner], np.full(len(at), size), np.ones(len(at))

        return find

    found = _searched(reads, None, finder, key, seq, keep).withColumnRenamed("query_name", "query_seq")
    named = queries.where(F.length("query_seq") == size).select("query_name", "query_seq")
    return found.join(named, "query_seq").select(key, "query_name", "position", "length", "score", *keep)


def exact_matches(reads: DataFrame, queries: DataFrame | Mapping[str, str], *, key: str = "seq_id", seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """All occurrences, overlapping ones too, of any number of motifs in one pass. Score is
    1.0. Empty motifs match nothing; columns of reads named in keep follow. A table of more
    motifs than a block holds, of few lengths, takes one pass to a length (_joined)."""
    if not isinstance(queries, Mapping):
        size = F.length("query_seq")
        sizes = queries.where(size > 0).groupBy(size.alias("m")).agg(F.sum(size + 16).alias("n")).orderBy("m").limit(_LENGTHS + 1).collect()
        blocks = sum(r["n"] for r in sizes) // _BLOCK
        if len(sizes) <= min(blocks, _LENGTHS):
            return reduce(DataFrame.unionAll, [_joined(reads, queries, r["m"], key, seq, keep) for r in sizes])

    def search(block: list[tuple[str, str]]) -> DataFrame:
        motifs = [(n, q) for n, q in block if q]

        def finder():
            machine = Automaton([q for _, q in motifs])
            size = np.array([len(q) for _, q in motifs], np.int64)

            def find(text: Text) -> tuple:
                motif, at = machine.find(text)
                owner = text.owner(at)
                return motif, owner, at - text.starts[owner], size[motif], np.ones(len(at))

            return find

        return _searched(reads, motifs, finder, key, seq, keep)

    return _by_block(queries, search)


def wildcard_scan(reads: DataFrame, queries: DataFrame | Mapping[str, str], threshold: float, *, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Every window with wildcard similarity of at least the threshold; * skips."""

    def search(block: list[tuple[str, str]]) -> DataFrame:
        motifs = [(n, q) for n, q in block if q]

        def finder():
            def find(text: Text) -> tuple:
                plain, out = text.codes != ord("*"), []
                left = np.repeat(text.ends, text.ends - text.starts + 1) - np.arange(len(text.codes))  # letters from here to the read's end
                for k, (_, q) in enumerate(motifs):
                    many = max(0, len(text.codes) - len(q) + 1)
                    same, known = np.zeros(many, np.int32), np.zeros(many, np.int32)
                    for i, c in enumerate(q):
                        if c != "*":
                            known += plain[i : i + many]
                            same += text.codes[i : i + many] == ord(c)
                    score = same / np.maximum(1, known)
                    at = np.flatnonzero((score >= threshold) & (left[:many] >= len(q)))
                    owner = text.owner(at)
                    out.append((np.full(len(at), k), owner, at - text.starts[owner], np.full(len(at), len(q)), score[at]))
                return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 4 + (np.empty(0),)

            return find

        return _searched(reads, motifs, finder, key, seq)

    return _by_block(queries, search)


_BIG = np.int64(1) << 32


def best_places(text: Text, motif: str, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start, end and distance of the places with the least edit distance between the
    motif and any substring of a read, if that is within the budget: one place to each end,
    with the earliest start. Looks everywhere, for budgets that leave no piece of a motif. Distance and start share one number, so that the least
    distance wins and the earliest start breaks ties. Nothing goes on over the end of a read."""
    q = np.frombuffer(motif.encode("utf-32-le"), np.uint32)
    m, reach = len(q), len(q) + 2 * budget
    every = np.arange(-2 * budget, len(text.codes))
    ends, keys = [], []
    padded = np.concatenate([np.zeros(reach, np.uint32), text.codes.astype(np.uint32), np.zeros(reach, np.uint32)])
    up = np.arange(m + 1, dtype=np.int64)[:, None] * _BIG
    for k in range(0, len(every), 1 << 15):
        first = every[k : k + (1 << 15)]
        column = up + np.maximum(first, 0)
        for j in range(reach):
            c = padded[first + reach + j]
            old, column = column, np.empty_like(column)
            column[0] = np.maximum(first + j + 1, 0)
            step = np.minimum(old[:-1] + (q[:, None] != c) * _BIG, old[1:] + _BIG)
            for i in range(1, m + 1):
                np.minimum(step[i - 1], column[i - 1] + _BIG, out=column[i])
            border = np.flatnonzero(c == 0)
            column[:, border] = up + column[0, border]  # starts anew behind it
            good = np.flatnonzero((column[m] >> np.int64(32) <= budget) & (c != 0))
            ends.append(first[good] + j + 1)
            keys.append(column[m, good])
    end, value = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ends, keys))
    order = np.lexsort((value, end))
    end, value = end[order], value[order]
    new = np.diff(end, prepend=-1) != 0
    end, value = end[new], value[new]
    owner, distance = text.owner(end - 1), value >> np.int64(32)
    least = np.full(len(text.starts), m + 1)
    np.minimum.at(least, owner, distance)
    best = distance == least[owner]
    owner, end, value = owner[best], end[best], value[best]
    base = text.starts[owner]
    return owner, (value & (_BIG - 1)) - base, end - base, value >> np.int64(32)


def _placed(motifs: list[str], budgets: list[int]) -> Callable[[Text], tuple]:
    """A function from a text to motif, owner, start, end and distance of the best places."""
    seeded = Budgeted(motifs, budgets)

    def find(text: Text) -> tuple:
        found = [seeded.find(text)]
        for k in seeded.loose:
            owner, *rest = best_places(text, motifs[k], budgets[k])
            found.append((np.full(len(owner), k), owner, *rest))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return find


def best_locations(seqs: list[str], motif: str, budget: int) -> list[list[tuple[int, int, int]]]:
    """By read the best places of a motif: (start, end, distance)."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in seqs]
    for _, o, *place in zip(*(x.tolist() for x in _placed([motif], [budget])(Text(seqs))), strict=True):
        found[o].append(tuple(place))
    return found


def edit_matches(reads: DataFrame, queries: DataFrame | Mapping[str, str], threshold: float = 0.9, *, key: str = "seq_id", seq: str = "seq", exact_budget: bool = False, length_mode: str = "span") -> DataFrame:
    """The best places of each motif in each read within the edit budget of the
    threshold; score 1 - distance / length of the motif. length_mode 'span' gives the
    characters covered, 'reference' one fewer, as it is stored there."""
    if length_mode not in ("span", "reference"):
        raise ValueError(f"no length mode {length_mode!r}")
    budget = (exact_edit_budget if exact_budget else edit_budget)("q", threshold)
    less = 1 if length_mode == "reference" else 0

    def search(block: list[tuple[str, str]]) -> DataFrame:
        motifs = [(n, q) for n, q in block if q]
        table = reads.sparkSession.createDataFrame([(q,) for _, q in motifs], "q string").select("q", budget.alias("k"))
        allowed = {r["q"]: r["k"] for r in table.collect()} if motifs else {}  # a row to each motif of the block

        def finder():
            places = _placed([q for _, q in motifs], [allowed[q] for _, q in motifs])
            size = np.array([len(q) for _, q in motifs], np.int64)

            def find(text: Text) -> tuple:
                motif, owner, start, end, distance = places(text)
                return motif, owner, start, end - start - less, 1.0 - distance / size[motif]

            return find

        return _searched(reads, motifs, finder, key, seq)

    return _by_block(queries, search)


def window_scores(text: Text, motif: str) -> np.ndarray:
    """For each place of a text the indel similarity of the window as long as the motif that begins
    there: the longest common subsequence over the length; -1 where a read ends within. Bit vectors, with
    a step for each letter of the window and all windows of a part at once."""
    letters = Letters([np.frombuffer(motif.encode("utf-32-le"), np.uint32)])
    m, n, words = len(motif), len(text.codes), letters.words
    out = np.full(n, -1.0)
    inside = np.flatnonzero(text.ends[text.owner(np.arange(n))] - np.arange(n) >= m)
    table = np.concatenate([letters.masks, np.zeros((words, 1), np.uint64)], axis=1)  # of letters that the motif lacks
    code = np.where(letters.coded(text.codes) == len(letters.alphabet), table.shape[1] - 1, letters.coded(text.codes))
    low = np.array([(1 << min(64, m - 64 * w)) - 1 for w in range(words)], np.uint64)
    for k in range(0, len(inside), 1 << 15):
        at = inside[k : k + (1 << 15)]
        free = [np.full(len(at), ~np.uint64(0)) for _ in range(words)]
        for j in range(m):
            masks, carry = table[:, code[at + j]], None
            for w in range(words):
                used = free[w] & masks[w]
                total = free[w] + used
                over = total < used
                if carry is not None:
                    total += carry
                    over |= total < carry
                free[w] = total | (free[w] & ~used)
                carry = over.astype(np.uint64)
        left = sum(np.bitwise_count(f & x).astype(np.int64) for f, x in zip(free, low, strict=True))
        out[at] = (m - left) / m
    return out


def peaks(x: np.ndarray, *, width: float | None = None, apart: int | None = None) -> list[int]:
    """Indices of local maxima (the middle of plateaus; never at an edge): those whose
    width at half of their prominence is at least `width`, then of those closer than
    `apart` the higher ones."""
    n, found, i = len(x), [], 1
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    if apart is not None:
        keep = dict.fromkeys(found, True)
        place = {p: k for k, p in enumerate(found)}  # in order, so that those too near are neighbours
        for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
            if keep[p]:
                for step in (-1, 1):
                    k = place[p] + step
                    while 0 <= k < len(found) and abs(found[k] - p) < apart:
                        keep[found[k]] = False
                        k += step
        found = [p for p in found if keep[p]]
    return [p for p in found if width is None or _half_width(x, p) >= width]


def _half_width(x: np.ndarray, p: int) -> float:
    sides = []
    for step in (-1, 1):
        i = low = p
        while 0 <= i + step < len(x) and x[i + step] <= x[p]:
            i += step
            low = i if x[i] < x[low] else low
        sides.append(low)
    height = x[p] - (x[p] - max(x[sides[0]], x[sides[1]])) * 0.5
    ends = []
    for step, low in ((-1, sides[0]), (1, sides[1])):
        i = p
        while i != low and x[i] > height:
            i += step
        at = float(i)
        if x[i] < height:
            at -= step * (height - x[i]) / (x[i - step] - x[i])
        ends.append(at)
    return ends[1] - ends[0]


def fragment_peaks(positions: np.ndarray, scores: np.ndarray, gap: int) -> list[int]:
    """The first of the highest scores of each run of positions at most `gap` apart."""
    if not len(positions):
        return []
    cuts = np.flatnonzero(np.diff(positions) > gap) + 1
    return [int(a[0] + np.argmax(scores[a])) for a in np.split(np.arange(len(positions)), cuts)]


def window_matches(reads: DataFrame, queries: DataFrame | Mapping[str, str], threshold: float = 0.9, *, key: str = "seq_id", seq: str = "seq", pick: str = "width") -> DataFrame:
    """Windows as long as the motif with indel similarity of at least the threshold.
    pick 'all' returns each; 'width' the peaks of the passing scores that are as wide as
    the motif, or the best of each fragment if there are none; 'distance' the peaks at least
    50 passing scores apart, without that fallback."""
    if pick not in ("all", "width", "distance"):
        raise ValueError(f"no way {pick!r} to pick")

    def search(block: list[tuple[str, str]]) -> DataFrame:
        motifs = [(n, q) for n, q in block if q]

        def find(text: Text) -> tuple:
            found = []
            for k, (_, q) in enumerate(motifs):
                scores = window_scores(text, q)
                at = np.flatnonzero(scores >= threshold) if threshold > 0 else np.flatnonzero(scores >= 0)
                owner = text.owner(at)
                if pick != "all" and len(at):
                    cuts = np.flatnonzero(np.diff(owner)) + 1
                    best = []
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):  # reads with passing windows only
                        score, place = scores[at[a:b]], at[a:b] - text.starts[owner[a]]
                        best += [a + i for i in (peaks(score, apart=50) if pick == "distance" else peaks(score, width=len(q)) or fragment_peaks(place, score, len(q)))]
                    at, owner = at[best], owner[best]
                found.append((np.full(len(at), k), owner, at - text.starts[owner], np.full(len(at), len(q)), scores[at]))
            return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, np.int64) for _ in range(5))

        return _searched(reads, motifs, lambda: find, key, seq)

    return _by_block(queries, search)


def best_of_islands(passing: DataFrame, *, key: str = "seq_id") -> DataFrame:
    """The fallback over a table of passing windows: runs of positions at most a motif
    apart, and the first of the best scores of each."""
    by = Window.partitionBy(key, "query_name").orderBy("position")
    new = (F.col("position") - F.lag("position").over(by) > F.col("length")).cast("int")
    rows = dealt(passing, key).withColumn("island", F.sum(F.coalesce(new, F.lit(0))).over(by))
    best = Window.partitionBy(key, "query_name", "island").orderBy(F.desc("score"), "position")
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "island")


def align_local(motif: str, seq: str) -> tuple[int, list[tuple[int, int, int, int]], int]:
    """Best local alignment with +1 for equal, 0 for unequal and -1 for gaps: score,
    blocks (from and to in the motif, from and to in the sequence), equal pairs. Among
    equally good ones the earliest end in the sequence, diagonal steps first."""
    return aligned(Text([seq]), motif)[0]


def drawn(motif: str, seq: str, blocks: list[tuple[int, int, int, int]], width: int = 60) -> str:
    """The alignment in three lines, wrapped."""
    top = middle = bottom = ""
    last: tuple[int, int] | None = None
    for a, b, c, d in blocks:
        if last is not None:
            top += motif[last[0] : a] + "-" * (c - last[1])
            bottom += "-" * (a - last[0]) + seq[last[1] : c]
            middle += " " * (a - last[0] + c - last[1])
        top, bottom = top + motif[a:b], bottom + seq[c:d]
        middle += "".join("|" if x == y else "." for x, y in zip(motif[a:b], seq[c:d], strict=True))
        last = b, d
    lines = [line[k : k + width] for k in range(0, len(top), width) for line in (top, middle, bottom)]
    return "\n".join(lines)


_ALIGNED = "{id} {type}, query_name string, score int, alignment_length int, percent_identity double, starts array<int>, ends array<int>, motif_aligned string, seq_aligned string, marked string, drawing string"


def local_alignments(reads: DataFrame, queries: DataFrame | Mapping[str, str], *, key: str = "seq_id", seq: str = "seq", denominator: str = "primer", drawing: bool = False) -> DataFrame:
    """The best alignment of each motif with each read. percent_identity is 100 * equal
    pairs over the length of the primer or of the sequence, unrounded. drawing: the
    alignment in lines, only if asked for (else null)."""
    if denominator not in ("primer", "sequence"):
        raise ValueError(f"no denominator {denominator!r}")
    kind = reads.select(key).schema[0].dataType.simpleString()
    schema = _ALIGNED.format(id=key, type=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    ints = pa.list_(pa.int32())
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), ints, ints, pa.string(), pa.string(), pa.string(), pa.string()]

    def search(motifs: list[tuple[str, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 1, _SLICE):
                seqs = [s or "" for s in part.column(1).to_pylist()]
                text = Text(seqs)
                for q, motif in motifs:
                    rows = []
                    for s, (score, blocks, equal) in zip(seqs, aligned(text, motif), strict=True):
                        ma, sa = ("".join([x[b[k] : b[k + 1]] for b in blocks]) for x, k in ((motif, 0), (s, 2)))
                        a, e = (blocks[0][2], blocks[-1][3]) if blocks else (0, 0)
                        marked = f"{s[:a]}<{q}>{s[a:e]}</{q}>{s[e:]}" if blocks else s
                        whole = len(motif) if denominator == "primer" else len(s)
                        rows.append((q, score, len(ma), 100.0 * equal / whole if whole else 0.0, [b[2] for b in blocks], [b[3] for b in blocks], ma, sa, marked, drawn(motif, s, blocks) if drawing else None))
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True))], names=names)

        return reads.select(key, F.col(seq).cast("string").alias("seq")).mapInArrow(run, schema)

    return _by_block(queries, search)


def primer_report(alignments: DataFrame, threshold: float = 80.0, *, key: str = "seq_id") -> DataFrame:
    """One row to a read: all hits by primer, and those at or over the threshold."""
    hit = F.struct("query_name", F.struct("score", "alignment_length", F.bround("percent_identity", 1).alias("percent_identity")).alias("hit"))
    hits = F.map_from_entries(F.array_sort(F.collect_list(hit)))
    return alignments.groupBy(key).agg(hits.alias("hits")).withColumn("detected", F.map_filter("hits", lambda _, h: h["percent_identity"] >= threshold))


def primer_summary(alignments: DataFrame, threshold: float = 80.0, *, key: str = "seq_id") -> DataFrame:
    """One row: reads, reads with any primer at or over the threshold, their percentage
    (null without reads)."""
    per_read = alignments.groupBy(key).agg(F.coalesce(F.bool_or(F.bround("percent_identity", 1) >= threshold), F.lit(False)).alias("any"))
    total, above = F.count("*"), F.coalesce(F.sum(F.col("any").cast("bigint")), F.lit(0))
    return per_read.agg(total.alias("total_sequences"), above.alias("above"), F.bround(F.try_divide(above * 100.0, total), 1).alias("percent_above"))


def both_orientations(matches_of, reads: DataFrame, queries: Mapping[str, str], **options) -> DataFrame:
    """Matches in the reads and in their reverse complements."""
    turned = reads.withColumn("seq", reverse_complement("seq"))
    one, two = matches_of(reads, queries, **options), matches_of(turned, queries, **options)
    return one.withColumn("orientation", F.lit("direct")).unionByName(two.withColumn("orientation", F.lit("reverse")))
