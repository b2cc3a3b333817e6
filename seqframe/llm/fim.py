"""Fill-in-the-middle transformation over seekable compressed frames.

pack() stores a text as independent zstandard frames of bounded size (one after the other
in `frames`, which is a valid zstandard stream as a whole) with an index: for each frame the
stored bytes, text bytes, code points and units up to its end. A unit is a run of characters
without white space with the white space before it; white space at the end of a text is one
more. rearrange() finds its two cuts in the index, decompresses the frames that hold a cut
and no others, and takes the rest over as they are: the output is frames again, with the
sentinels as frames of their own. digests() and restored() read the frames in order, one at a
time, so that a text of any length costs the memory of its compressed form and one frame. To
restore a text only its output and its form are needed: the sentinels are looked for in it.

All is map only. Null text counts as empty (and is plain), a null key draws as the empty
string. Each input row gives one output row, repeated rows too; rows with the same key draw
the same numbers. A unit longer than a frame goes through several frames. Empty tables give
empty results. Columns besides the key and the text aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import kind_of, slices, text_of

FRAME = 1 << 16  # bytes of text in a frame, about
_LEVEL = 1
_TEXTS = 4 << 20  # bytes of rows that are worked on together
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _ends(part: bytes) -> np.ndarray:
    """Where units end in a part of a text, if nothing but white space follows it."""
    space = _SPACE[np.frombuffer(part, np.uint8)]
    after = np.ones(len(space), bool)
    after[:-1] = space[1:]
    return np.flatnonzero(~space & after) + 1


class Frames:
    """A text in frames. index: a row for each frame with the stored bytes, text bytes,
    code points and units up to its end (units as far as they are known)."""

    def __init__(self, stored: bytes, index: np.ndarray):
        self.stored, self.index = stored, index
        self.read = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.index)

    def before(self, k: int) -> np.ndarray:
        return self.index[k - 1] if k else np.zeros(4, np.int64)

    def kept(self, k: int) -> bytes:
        return self.stored[int(self.before(k)[0]) : int(self.index[k, 0])]

    def frame(self, k: int) -> bytes:
        return self.read(self.kept(k))

    def total(self, what: int) -> int:
        return int(self.index[-1, what]) if len(self.index) else 0

    def __iter__(self) -> Iterator[bytes]:
        return map(self.frame, range(len(self)))

    def cut(self, unit: int) -> int:
        """Text bytes of the first `unit` units: one frame is decompressed."""
        if not unit:
            return 0
        k = int(np.searchsorted(self.index[:, 3], unit))
        first, part = self.before(k), self.frame(k)
        ends, nth = _ends(part), unit - int(first[3])
        return int(first[1]) + (int(ends[nth - 1]) if nth <= len(ends) else len(part))  # else: white space at the end

    def span(self, a: int, b: int) -> Iterator[tuple[int, bytes | None]]:
        """Frame by frame what lies between text bytes a and b; None: the whole frame."""
        if a < b:
            for k in range(int(np.searchsorted(self.index[:, 1], a, side="right")), len(self)):
                start, end = int(self.before(k)[1]), int(self.index[k, 1])
                if start >= b:
                    break
                yield k, None if a <= start and end <= b else self.frame(k)[max(0, a - start) : b - start]

    def find(self, *wanted: bytes) -> tuple[int, bytes] | None:
        """Place and name of the first of some short strings."""
        keep, done, most = b"", 0, max(map(len, wanted)) - 1
        for part in self:
            here = keep + part
            found = [(at, w) for w in wanted if (at := here.find(w)) >= 0]
            if found:
                at, w = min(found)
                return done + at, w
            keep = here[len(here) - most :] if most and len(here) > most else here if most else b""
            done += len(here) - len(keep)
        return None


class Writer:
    """Takes parts and whole frames of other texts and makes frames of them."""

    def __init__(self) -> None:
        self.compress = zstandard.ZstdCompressor(level=_LEVEL).compress
        self.parts: list[bytes] = []
        self.rows: list[tuple[int, int, int, int]] = []

    def add(self, part: bytes, units: int = 0) -> None:
        if part:
            self._put(self.compress(part), len(part), int(np.count_nonzero(_HEAD[np.frombuffer(part, np.uint8)])), units)

    def take(self, other: Frames, k: int) -> None:
        _, size, chars, _ = (other.index[k] - other.before(k)).tolist()
        self._put(other.kept(k), size, chars, 0)

    def _put(self, stored: bytes, size: int, chars: int, units: int) -> None:
        self.parts.append(stored)
        self.rows.append((len(stored), size, chars, units))

    def done(self) -> Frames:
        return Frames(b"".join(self.parts), np.cumsum(np.array(self.rows, np.int64).reshape(-1, 4), axis=0))


def compressed(text: bytes, most: int = FRAME) -> Frames:
    """A text in frames of about `most` bytes, cut at the end of a unit where there is one."""
    out, at, n, most = Writer(), 0, len(text), max(4, most)  # a code point at least
    while at < n:
        end = min(n, at + most)
        if end < n:
            while text[end] & 0xC0 == 0x80:
                end -= 1
        part = text[at:end]
        ends = _ends(part)
        if end == n:
            units = len(ends) + bool(_SPACE[part[-1]])
        else:
            whole = ends if _SPACE[text[end]] else ends[ends < len(part)]
            if len(whole):
                part = part[: int(whole[-1])]
            units = len(whole)
        out.add(part, units)
        at += len(part)
    return out.done()


def _draws(key: str, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def rearranged(text: Frames, key: str, *, seed: int, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[Frames, str, int | None, int | None]:
    """The output, its form, and the code points of prefix and middle."""
    h1, h2, h3, h4 = _draws(key, seed)
    p, s, m = (x.encode() for x in sentinels)
    n = text.total(3)
    if not n or h3 % 100 >= rate or text.find(p, s, m):
        return text, "plain", None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, end = text.cut(first), text.cut(second), text.total(1)
    form = "spm" if h4 % 100 < spm else "psm"
    order = [(p, 0, a), (s, b, end), (m, a, b)] if form == "psm" else [(s, b, end), (p, 0, a), (m, a, b)]
    out, chars = Writer(), {}
    for mark, x, y in order:
        out.add(mark)
        before = sum(r[2] for r in out.rows)
        for k, part in text.span(x, y):
            out.take(text, k) if part is None else out.add(part)
        chars[mark] = sum(r[2] for r in out.rows) - before
    return out.done(), form, chars[p], chars[m]


def restored(out: Frames, form: str, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Iterator[bytes]:
    """The text that an output was made of, in parts."""
    if form == "plain":
        yield from out
        return
    p, s, m = (x.encode() for x in sentinels)
    opened, between = (p, s) if form == "psm" else (s, p)
    one, two = out.find(between)[0], out.find(m)[0]  # the text holds no sentinel
    parts = {opened: (len(opened), one), between: (one + len(between), two), m: (two + len(m), out.total(1))}
    for mark in (p, m, s):
        for k, part in out.span(*parts[mark]):
            yield out.frame(k) if part is None else part


def _digest(parts: Iterator[bytes]) -> str:
    to = hashlib.sha256()
    for part in parts:
        to.update(part)
    return to.hexdigest()


def _by_row(df: DataFrame, column: str, fn: Callable, fields: dict[str, str], *inputs: str) -> DataFrame:
    """fn takes a row's inputs and gives the values of fields; the key goes along."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, _TEXTS):
            rows = [fn(*values) for values in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
            made = [pa.array(values, kinds[t]) for values, t in zip(zip(*rows), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[column, *fields])

    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    return df.select(column, *inputs).mapInArrow(run, f"`{column}` {kind_of(df, column)}, {schema}")


_STORED = {"frames": "binary", "index": "binary"}


def _open(stored: bytes, index: bytes) -> Frames:
    return Frames(stored, np.frombuffer(index, "<i8").reshape(-1, 4))


def _closed(f: Frames) -> tuple[bytes, bytes]:
    return f.stored, f.index.astype("<i8").tobytes()


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", frame: int = FRAME) -> DataFrame:
    """Columns: key, draw string (the key as text), frames, index binary (rows of four
    little-endian 64-bit integers: stored bytes, text bytes, code points and units so far)."""
    rows = docs.select(F.col(key), text_of(text).alias("t"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"))
    return _by_row(rows, key, lambda t, d: (d, *_closed(compressed(t.encode(), frame))), {"draw": "string", **_STORED}, "t", "d")


def rearrange(packed: DataFrame, *, key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Columns: key, n long (units), form, prefix_chars, middle_chars long (null if plain),
    frames, index: the output. `rate` of 100 texts are rearranged, `spm` of 100 of those
    with the suffix first; texts that hold a sentinel never are."""

    def fn(stored: bytes, index: bytes, draw: str) -> tuple:
        f = _open(stored, index)
        out, form, prefix, middle = rearranged(f, draw, seed=seed, rate=rate, spm=spm, sentinels=sentinels)
        return f.total(3), form, prefix, middle, *_closed(out)

    return _by_row(packed, key, fn, {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", **_STORED}, "frames", "index", "draw")


def digests(done: DataFrame, *, key: str = "doc_id", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Columns: key, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256
    (of the text rebuilt from the output), from what rearrange() returns."""

    def fn(stored: bytes, index: bytes, n: int, form: str, prefix: int, middle: int) -> tuple:
        f = _open(stored, index)
        return n, form, prefix, middle, _digest(iter(f)), _digest(restored(f, form, sentinels))

    fields = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output_sha256": "string", "restored_sha256": "string"}
    return _by_row(done, key, fn, fields, "frames", "index", "n", "form", "prefix_chars", "middle_chars")


def texts(done: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Columns: key, output string, from what pack() or rearrange() returns."""
    return _by_row(done, key, lambda stored, index: (b"".join(_open(stored, index)).decode(),), {"output": "string"}, "frames", "index")
