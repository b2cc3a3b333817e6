"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

encode(): every match of the split pattern is merged by itself. The pairs of many
pre-tokens wait in one queue of buckets, one for each merge rank; a bucket holds
positions of the linked list of parts. Two levels of bitmaps say which buckets hold
something: find-first-set on the upper, then on the lower word gives the next rank
without a search. Entries are never removed when their pair changes: what comes out
of the queue is compared with the pair that stands there now and skipped if it is
stale. A pre-token of n bytes takes about n log n steps however long it is.

Pre-tokens repeat, so that each worker keeps what it has encoded in a cache that is
bounded in bytes; texts are taken in slices that are bounded in bytes too. Nothing is
shuffled: the work is one pass over the rows.

Null text counts as empty, which encodes to no ids. Each input row gives one output
row, repeated rows too. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqframe.llm.common import kind_of, slices, text_of

_BITS = 8  # 256 ranks share a lower word of the bitmap
_LOW = (1 << _BITS) - 1
_CACHE_BYTES = 96 << 20  # of an encoder's cache, about
_ENTRY = 200  # bytes of an entry besides its text and value
_LONG = 48  # longer texts aren't kept
_TEXTS = 4 << 20  # bytes of texts that are encoded together
_MERGED = 1 << 20  # characters of pre-tokens that share a queue, about
_MANY, _SMALL = 64, 16  # entries of a large bucket; so many small ones in a row end the work by buckets
_SHORT = 256  # bytes of pre-tokens that are merged by buckets, with one entry of each at a time


class Recent:
    """What has been worked out lately, in two generations of bounded size in bytes: the
    older one goes when the younger one is full, so that what is in use stays. size: of a value."""

    def __init__(self, most: int = _CACHE_BYTES, size: Callable = len):
        self.most, self.size, self.held, self.young, self.old = most // 2, size, 0, {}, {}

    def found(self, texts: set[str], work: Callable[[list[str]], dict]) -> dict:
        """A table with the values of all texts; work() makes those that aren't there."""
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        missing = texts.difference(young)
        again = missing.intersection(old)
        fresh = {t: old[t] for t in again}
        if len(missing) > len(again):
            fresh.update(work(list(missing.difference(again))))
        long = [t for t in fresh if len(t) > _LONG]
        if long:
            out = young | fresh
            for t in long:
                del fresh[t]
        young.update(fresh)
        self.held += _ENTRY * len(fresh) + 2 * sum(map(len, fresh)) + sum(map(self.size, fresh.values()))
        return out if long else young


class Chain:
    """A linked list of parts, at first the single bytes of all pre-tokens."""

    def __init__(self, text: bytes, sizes: np.ndarray, starts: np.ndarray, one: np.ndarray, two: np.ndarray):
        n = len(text)
        raw = np.frombuffer(text + b"\0", np.uint8).astype(np.int32)
        self.border = np.zeros(n + 1, np.uint8)  # 1 where a pre-token starts, and at the end
        self.border[starts] = self.border[n] = 1
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.token = one[raw[:-1]]  # of the part that starts at i
        self.pair = np.where(self.border[1:] == 1, -1, two[raw[:-1] << 8 | raw[1:]]).astype(np.int32)  # rank of the part at i with the next one; -1: none, or no part starts here


class Queue:
    """Buckets of positions by rank under a hierarchical bitmap: `top` has a bit for each
    word of `words`, a word has a bit for each of 256 ranks."""

    def __init__(self, most: int):
        self.words, self.top, self.buckets = [0] * ((most >> _BITS) + 1), 0, {}

    def least(self) -> int:
        """Find-first-set on both levels; -1 if nothing waits."""
        if not self.top:
            return -1
        high = (self.top & -self.top).bit_length() - 1
        return (high << _BITS) | ((self.words[high] & -self.words[high]).bit_length() - 1)

    def push(self, at: np.ndarray, ranks: np.ndarray) -> int:
        """Positions wait at their ranks (-1: they don't). Returns the least rank."""
        some = np.flatnonzero(ranks >= 0)
        if not len(some):
            return 1 << 62
        some = some[np.argsort(ranks[some], kind="stable")]
        at, ranks = at[some], ranks[some]
        cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
        for r, x, y in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
            if (held := self.buckets.get(r)) is not None:
                held.append(at[x:y])
            else:
                self.buckets[r] = [at[x:y]]
                self.words[r >> _BITS] |= 1 << (r & _LOW)
                self.top |= 1 << (r >> _BITS)
        return int(ranks[0])

    def drop(self, r: int) -> None:
        high = r >> _BITS
        if r not in self.buckets:
            self.words[high] &= ~(1 << (r & _LOW))
            if not self.words[high]:
                self.top &= ~(1 << high)


class Encoder:
    """Encodes by a table from byte strings to ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.one = np.array([ranks.get(bytes([a]), 0) for a in range(256)], np.int32)
        self.two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        made = sorted((get_a << 32 | get_b, r) for t, r in ranks.items() for k in range(1, len(t)) if (get_a := ranks.get(t[:k])) is not None and (get_b := ranks.get(t[k:])) is not None)
        self.pairs, self.pair_ranks = np.array([x for x, _ in made], np.int64), np.array([x for _, x in made], np.int32)
        #: Ids of stretches that follow a space, by what follows it.
        self.known = Recent()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, as little-endian unsigned 32-bit integers. All share
        one linked list, in which nothing crosses the border of a pre-token, and one queue.
        The ranks of a pre-token come up in the same order as if it were alone: the least of
        all that wait is its least too, and within a bucket the leftmost goes first."""
        text = b"".join(pieces)
        n = len(text)
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        queue = Queue(max(self.ranks.values(), default=0))
        chain = Chain(text, sizes, starts, self.one, self.two)
        queue.push(np.arange(n), chain.pair)
        if int(sizes.max(initial=0)) <= _SHORT:
            self._merge_many(chain, queue)
        border = bytes(chain.border)
        after, before, token, pair = (array("i", x.tobytes()) for x in (chain.after, chain.before, chain.token, chain.pair))
        buckets = {r: np.concatenate(x).tolist() for r, x in queue.buckets.items()}
        get, words, top = self.ranks.get, queue.words, queue.top
        while top:
            high = (top & -top).bit_length() - 1
            bit = words[high] & -words[high]
            least = r = (high << _BITS) | (bit.bit_length() - 1)
            bucket = buckets[r]
            if len(bucket) > 1:
                bucket.sort()
            for at, i in enumerate(bucket, 1):
                if pair[i] != r:
                    continue  # stale
                j = after[i]
                k = after[i] = after[j]
                pair[j] = -1
                token[i] = r
                new = -1
                if not border[k]:
                    before[k] = i
                    new = get(text[i : after[k]], -1)
                    if new >= 0:
                        if (held := buckets.get(new)) is not None:
                            held.append(i)
                        else:
                            buckets[new] = [i]
                            words[new >> _BITS] |= 1 << (new & _LOW)
                            top |= 1 << (new >> _BITS)
                        if new < least:
                            least = new
                pair[i] = new
                if not border[i]:
                    h = before[i]
                    pair[h] = new = get(text[h:k], -1)
                    if new >= 0:
                        if (held := buckets.get(new)) is not None:
                            held.append(h)
                        else:
                            buckets[new] = [h]
                            words[new >> _BITS] |= 1 << (new & _LOW)
                            top |= 1 << (new >> _BITS)
                        if new < least:
                            least = new
                if least < r:  # comes before what is left of this bucket
                    buckets[r] = bucket[at:]
                    break
            if least == r or not buckets[r]:
                del buckets[r]
                words[high] ^= bit
                if not words[high]:
                    top ^= 1 << high
        out, cuts, i = [], [], 0
        while i < n:
            if border[i]:
                cuts.append(4 * len(out))
            out.append(token[i])
            i = after[i]
        ids = np.array(out, "<u4").tobytes()
        return [ids[x:y] for x, y in zip(cuts, [*cuts[1:], len(ids)])]

    def _merge_many(self, chain: Chain, queue: Queue) -> None:
        """The same steps for whole buckets at a time, as long as these are large: of each
        pre-token the leftmost entry, then the next, unless a lower rank has come up."""
        after, before, pair, token, border = chain.after, chain.before, chain.pair, chain.token, chain.border
        small = 0
        while small < _SMALL and (r := queue.least()) >= 0:
            bucket = np.concatenate(queue.buckets.pop(r))
            small = 0 if len(bucket) >= _MANY else small + 1
            wait = np.sort(bucket[pair[bucket] == r])  # the others are stale
            least = r
            while len(wait) and least == r:
                new = np.diff(chain.owner[wait], prepend=-1) != 0
                i, wait = wait[new], wait[~new]
                j = after[i]
                k = after[j]
                after[i], token[i], pair[j] = k, r, -1
                right = border[k] == 0
                before[k[right]] = i[right]
                ahead = np.full(len(i), -1, np.int32)
                ahead[right] = self._rank(r, token[k[right]])
                pair[i] = ahead
                left = before[i[border[i] == 0]]
                behind = self._rank(token[left], r)
                pair[left] = behind
                least = min(least, queue.push(np.concatenate([i, left]), np.concatenate([ahead, behind])))
                wait = wait[pair[wait] == r]
            if len(wait):
                queue.buckets[r] = [wait]
            else:
                queue.drop(r)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 for none."""
        keys = np.int64(a) << 32 | b if np.isscalar(a) else a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], -1).astype(np.int32) if len(self.pairs) else np.full(len(keys), -1, np.int32)

    def chunks(self, text: str) -> list[str]:
        """The text in stretches that no pre-token crosses: none goes on from a character
        that isn't space to a space, so that a text can be cut before each run of space."""
        if RUN.search(text):
            at = [m.start() for m in EDGE.finditer(text)]
            return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]]

    def encode(self, text: str) -> tuple[bytes, int]:
        """The ids of a text as bytes, and their number."""
        ids = self.encode_all([text])[0]
        return ids, len(ids) >> 2

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        cut = [self.chunks(t) for t in texts]
        ids = self.known.found(set().union(*cut), self._fresh).__getitem__
        return [b"".join(map(ids, c)) for c in cut]

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of stretches, and of their pre-tokens."""
        parts = {c: [c] if PLAIN.fullmatch(c) else self.split.findall(c) for c in chunks}
        asked = set().union(*parts.values())
        young, old = self.known.young, self.known.old
        made = {p: got for p in asked if (got := young.get(p) or old.get(p))}
        rest = sorted(asked.difference(made), key=len)
        long = [p for p in rest if len(p) > _SHORT // 4]
        rest = rest[: len(rest) - len(long)]
        made.update(zip(long, self.merge([p.encode() for p in long])) if long else ())
        turn = np.cumsum([len(p) for p in rest]) // _MERGED
        for k in range(int(turn[-1]) + 1 if rest else 0):
            some = rest[np.searchsorted(turn, k) : np.searchsorted(turn, k, side="right")]
            made.update(zip(some, self.merge([p.encode() for p in some])))
        get = made.__getitem__
        return made | {c: b"".join(map(get, p)) for c, p in parts.items() if len(p) != 1}


#: A space beside other white space: there the split at single spaces would not do.
RUN = re.compile(r" \s|\s ")
EDGE = re.compile(r"(?<=\S)(?=\s)")
#: One pre-token for sure: Latin letters after a space or none.
PLAIN = re.compile(r" ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F]+")


class Decoder:
    """Bytes of ids: the tokens' bytes are gathered from one buffer."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if tokens else self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids."""
        out = []
        for k in range(0, len(ids), 64):
            part = np.frombuffer(b"".join(ids[k : k + 64]), "<u4")
            n = self.length[part]
            ends = np.cumsum(n)
            at = np.arange(int(n.sum())) + np.repeat(self.start[part] - (ends - n), n)
            ends = np.concatenate([[0], ends])[np.cumsum([0, *(len(i) >> 2 for i in ids[k : k + 64])])]
            text = self.bytes[at].tobytes()
            out += [text[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_LOADED: dict[tuple, tuple[Encoder, Decoder]] = {}


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One of each to a Python process; the caches then serve all its tasks."""
    if (path, pattern) not in _LOADED:
        ranks = read_ranks(path)
        _LOADED[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Columns: key, n_tokens long, ids binary (little-endian unsigned 32-bit integers)
    and, if asked for, decoded binary: the ids turned back into bytes. path must lead
    to the rank file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, back = codec(path, pattern)
        for part in slices(batches, 1, _TEXTS):
            ids = to.encode_all(part.column(1).to_pylist())
            columns = [part.column(0), pa.array([len(i) >> 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            columns += [pa.array(back.decode_all(ids), pa.binary())] * decoded
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select(key, text_of(text).alias(text)).mapInArrow(run, f"`{key}` {kind_of(docs, key)}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Columns: key, decoded binary. Null ids decode to empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = codec(path, pattern)[1]
        for part in slices(batches, 1, _TEXTS):
            done = back.decode_all([i or b"" for i in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.binary())], names=[key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind_of(encoded, key)}, decoded binary")
