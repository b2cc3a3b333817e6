"""Local alignment of a motif with many reads at once: +1 for equal, 0 for unequal letters,
-1 for gaps.

Scores: all reads of a slice are one text with a border between reads. The dynamic program
goes over the motif letter by letter, for the whole text at a time; a gap along the text is taken
in doubled steps.
What is kept is the best score of each read and where it ends. Tracebacks: an alignment with
a score spans at most twice the motif in the read, so that its cells are computed anew in a
window of four times the motif before its end, for many reads at a time, and only there.
"""

from __future__ import annotations

import numpy as np

from seqframe.operators.seeds import Text

_WINDOWS = 1 << 21  # cells of windows that are computed together
_PART = 1 << 15  # letters of reads whose scores are computed together: they stay in a core's cache
_ZERO, _ONE = np.int32(0), np.int32(1)


def best_ends(text: Text, motif: str) -> tuple[np.ndarray, np.ndarray]:
    """For each read the best score, and how many of its letters stand before the earliest
    end of an alignment with that score. 0, 0 without any."""
    q, reads = np.frombuffer(motif.encode("utf-32-le"), np.uint32), len(text.starts)
    out = np.zeros((2, reads), np.int64)
    turn = text.ends // _PART
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), reads]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b and len(q):
            first = text.starts[a]
            out[:, a:b] = _best_ends(text.codes[first : text.ends[b - 1] + 1], text.starts[a:b] - first, text.ends[a:b] - first, q)
    return out[0], out[1]


def _best_ends(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small integers, as no score is over the motif's length; a border is as long as the motif, so
    that every gap that runs into it is worth nothing behind it."""
    m, kind = len(q), np.int8 if len(q) < 120 else np.int32
    border = np.zeros(len(codes), np.int64)
    border[ends] = m
    place = np.arange(len(codes)) + np.cumsum(border) - border
    n = int(place[-1]) + m + 1
    letters, inside = np.zeros(n, codes.dtype), np.zeros(n, kind)
    letters[place] = codes
    inside[place] = np.where(codes == 0, 0, np.iinfo(kind).max)
    starts, ends = place[starts], place[ends]
    same = {letter: (letters == letter).astype(kind) for letter in np.unique(q).tolist()}
    last, row, less, best = (np.zeros(n, kind) for _ in range(4))
    for letter in q.tolist():
        np.add(last[:-1], same[letter][1:], out=row[1:])
        row[0] = same[letter][0]
        np.subtract(last, 1, out=less)
        np.maximum(row, less, out=row)
        np.maximum(row, 0, out=row)
        step = 1
        while step < m:  # a gap of any length, by doubled ones
            np.subtract(row[:-step], step, out=less[step:])
            np.maximum(row[step:], less[step:], out=row[step:])
            step *= 2
        np.minimum(row, inside, out=row)
        np.maximum(best, row, out=best)
        last, row = row, last
    score = np.maximum.reduceat(best, starts)
    hits = np.flatnonzero(best == np.repeat(score, np.diff(np.append(starts, n))))  # in order
    owner = np.searchsorted(starts, hits, side="right") - 1
    first = hits[np.flatnonzero(np.diff(owner, prepend=-1))]
    return score, np.where(score > 0, first + 1 - starts, 0)


def _cells(q: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Scores by window, letters of the motif and letters of the window."""
    n, wide = windows.shape
    h = np.zeros((n, len(q) + 1, wide + 1), np.int32)
    fall = np.arange(wide + 1, dtype=np.int32)
    for i, letter in enumerate(q, 1):
        row = np.maximum(np.maximum(h[:, i - 1, 1:] - _ONE, h[:, i - 1, :-1] + (windows == letter)), _ZERO)
        row[windows == 0] = 0
        h[:, i, 1:] = row
        h[:, i] = np.maximum.accumulate(h[:, i] + fall, axis=1) - fall
        h[:, i, 1:][windows == 0] = 0
    return h


def _traced(h: np.ndarray, q: np.ndarray, window: np.ndarray, i: int, j: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Blocks (from and to in the motif and in the window) and equal pairs; diagonal steps first."""
    blocks: list[list[int]] = []
    equal, joined = 0, False
    here = int(h[i, j])
    while i and j and here:
        same = bool(q[i - 1] == window[j - 1])
        if here == h[i - 1, j - 1] + same:
            equal += same
            if joined:
                blocks[-1][0], blocks[-1][2] = i - 1, j - 1
            else:
                blocks.append([i - 1, i, j - 1, j])
            i, j, joined = i - 1, j - 1, True
        else:
            i, j = (i - 1, j) if here == h[i - 1, j] - 1 else (i, j - 1)
            joined = False
        here = int(h[i, j])
    return [tuple(b) for b in reversed(blocks)], equal


def aligned(text: Text, motif: str) -> list[tuple[int, list[tuple[int, int, int, int]], int]]:
    """For each read: score, blocks (from and to in the motif, from and to in the read), equal pairs."""
    score, ends = best_ends(text, motif)
    out: list[tuple[int, list, int]] = [(0, [], 0)] * len(score)
    q = np.frombuffer(motif.encode("utf-32-le"), np.uint32)
    wide = 4 * len(q) + 4
    some = np.flatnonzero(score > 0)
    padded = np.concatenate([np.zeros(wide, np.uint32), text.codes.astype(np.uint32)])
    step = max(1, _WINDOWS // ((len(q) + 1) * (wide + 1)))
    for k in range(0, len(some), step):
        part = some[k : k + step]
        stop = text.starts[part] + ends[part]
        windows = padded[stop[:, None] + np.arange(wide)]  # the letters before the end
        short = ends[part, None] < wide - np.arange(wide)
        windows[short] = 0  # of other reads
        h = _cells(q, windows)
        for at, read in enumerate(part.tolist()):
            row = int(np.argmax(h[at, :, wide] == score[read]))  # the earliest end in the motif
            blocks, equal = _traced(h[at], q, windows[at], row, wide)
            shift = int(ends[read]) - wide
            out[read] = (int(score[read]), [(a, b, c + shift, d + shift) for a, b, c, d in blocks], equal)
    return out
