"""Exact token counts at every prefix by dynamic programming.

For a byte-pair encoder the encoding of a stretch, cut after any of its tokens, is the
encoding of what stands before the cut. So one token to a prefix describes all
encodings: last[i] is the last token of the encoding of the first i units, and
count[i] = count[i - units of last[i]] + 1. A token t that ends at i is the last one
if it stands alone, or if encoding last[i - units of t] followed by t gives these two
back; adjacent pairs decide alone, and the verdicts are kept.

In this kind of vocabulary a word's last unit carries an end mark, so that a word has
two such rows: of unmarked prefixes, which longer words go through, and of marked
ones, which are the counts of the truncated word. Words are independent, so that the
count of a text's prefix is the sum over its words.

prefix_table() stores the counts: of the prefix that ends at each stretch between spaces,
or of every prefix. How many tokens a prefix has, and which is the longest one that fits
a budget, are answered from there for any number of budgets, without a second encoding:
only the stretch in which a budget ends is looked into. The longest prefix may end inside
a word. Positions are code points.

Special strings are found first, and prefixes that end in one are counted with it as plain
text. The normal form is walked once (plain_inside), so that an unspaced text takes time in
proportion to its length, in whatever form it is written.

Null text counts as empty. Other columns aren't looked at, whatever their names. Each input row gives one output row, repeated rows too.
Empty tables give empty results. Nothing is shuffled. Memory: a slice of texts of a few
MB, and caches that are bounded in bytes.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.bpe import Recent
from seqframe.llm.common import kind_of, slices, text_of

_CACHE_BYTES = 128 << 20  # of each of two caches, about
_VERDICTS = 400_000  # entries after which the cache of verdicts is emptied
_TEXTS = 4 << 20  # bytes of texts that are counted together
_SPELLED = 16  # letters of the longest word that the split pattern spells out, at least


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of this kind: visible
    Latin-1 characters stand for themselves, the others for 256, 257 and so on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def _literal(word: str) -> bool:
    """Whether a word is one that the split pattern spells out: signs with letters behind them."""
    return word[0] in "'<" and any(c.isalpha() for c in word)


def _kind(c: str) -> str:
    """Letters and signs go together with their like; numbers and space don't (empty)."""
    kind = unicodedata.category(c)[0]
    return "L" if kind == "L" else "" if kind == "N" or c.isspace() else "S"


@cache
def composing() -> frozenset[str]:
    """Characters that may compose with, or be sorted among, what stands before them."""
    second = {chr(int(parts[1], 16)) for c in range(0x110000) if len(parts := unicodedata.decomposition(chr(c)).split()) == 2 and parts[0][0] != "<"}
    return frozenset(second | {chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


class PrefixCounter:
    """Counts by a tokenizers file: BPE with an end-of-word mark over byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.letters = byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.split_of: dict[str, tuple[str, str]] = {}
        for a, b in merges:
            self.split_of.setdefault(a + b, (a, b))
        whole, bare = self.mark, len(self.mark)
        #: Tokens by units: those that end in the mark, and the others.
        self.marked = {t[:-bare] for t in model["vocab"] if t.endswith(whole) and len(t) > bare}
        self.plain = {t for t in model["vocab"] if not t.endswith(whole)}
        self.most = max(map(len, self.marked | self.plain))
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        #: Tokens of stretches between spaces, and of words.
        self.known, self.words = (Recent(_CACHE_BYTES, lambda n: 0) for _ in range(2))
        self.verdicts: dict[tuple[str, str], bool] = {}

    def encode(self, units: list[str]) -> list[str]:
        """Merges, lowest rank first; for pairs of tokens, which are short."""
        parts, rank = list(units), self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def units(self, token: str) -> list[str]:
        bare = token.removesuffix(self.mark)
        return [*bare[:-1], bare[-1] + token[len(bare) :]]

    def stays(self, a: str, b: str) -> bool:
        """Whether the encoding of a's and b's units is a, b; alone (a empty): is b."""
        if (got := self.verdicts.get((a, b))) is None:
            got = self.encode((self.units(a) if a else []) + self.units(b)) == ([a, b] if a else [b])
            if len(self.verdicts) > _VERDICTS:
                self.verdicts.clear()
            self.verdicts[a, b] = got
        return got

    def _last(self, word: str, i: int, last: list[str], mark: str) -> str:
        tokens = self.marked if mark else self.plain
        for n in range(min(i, self.most), 0, -1):
            t = word[i - n : i]
            if t in tokens:
                t += mark
                if self.stays(last[i - n], t):
                    return t
        raise ValueError(f"no token ends at {word[:i]!r}")

    def row(self, word: str, upto: int) -> tuple[list[str], list[int]]:
        """last and count of the unmarked prefixes of 0 to upto units."""
        last, count = [""], [0]
        for i in range(1, upto + 1):
            t = self._last(word, i, last, "")
            last.append(t)
            count.append(count[i - len(t)] + 1)
        return last, count

    def word_count(self, word: str) -> int:
        """Tokens of a whole word of byte letters."""
        if word in self.marked and self.stays("", word + self.mark):
            return 1
        last, count = self.row(word, len(word) - 1)
        return count[len(word) - len(self._last(word, len(word), last, self.mark)) + len(self.mark)] + 1

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of 0, 1, ... units, as a word of its own."""
        last, count = self.row(word, len(word))
        return [0] + [count[i - len(self._last(word, i, last, self.mark)) + len(self.mark)] + 1 for i in range(1, len(word) + 1)]

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def spelled(self, word: str) -> str:
        letters = self.letters
        return "".join([letters[b] for b in word.encode()])

    def words_of(self, text: str) -> list[str]:
        """Words of text without special tokens, in byte letters."""
        return [self.spelled(w) for w in self.split.findall(self.normal(text))]

    def parts_of(self, text: str) -> tuple[int, list[str]]:
        """Number of special tokens in text, and the words around them."""
        if self.find_special and "<" in text and (hits := self.find_special.findall(text)):
            return len(hits), [w for part in self.find_special.split(text) for w in self.words_of(part)]
        return 0, self.words_of(text)

    def _count_words(self, words: list[str]) -> dict[str, int]:
        return {w: self.word_count(w) for w in words}

    def _count_stretches(self, texts: list[str]) -> dict[str, int]:
        parts = {t: self.parts_of(t) for t in texts}
        one = self.words.found({w for _, words in parts.values() for w in words}, self._count_words).__getitem__
        return {t: n + sum(map(one, words)) for t, (n, words) in parts.items()}

    def stretch(self, text: str) -> int:
        """Tokens of text between spaces."""
        return self._count_stretches([text])[text]

    def stretches(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """For each text where its stretches end, and the tokens of the prefixes that end there."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        count = self.known.found(set().union(*cut), self._count_stretches).__getitem__
        return [([x - 1 for x in accumulate([len(c) + 1 for c in parts])], list(accumulate(map(count, parts)))) for parts in cut]

    def inside(self, text: str) -> list[int]:
        """Tokens of the prefixes of 0, 1, ... code points of a stretch between spaces. A prefix
        that ends within a special string has it as plain text, behind the part before."""
        out, done, start = [0], 0, 0
        for m in self.find_special.finditer(text) if self.find_special and "<" in text else ():
            part = self.plain_inside(text[start : m.end() - 1])
            out += [done + n for n in part[1:]]
            done += part[m.start() - start] + 1
            out.append(done)
            start = m.end()
        return out + [done + n for n in self.plain_inside(text[start:])[1:]]

    def plain_inside(self, text: str) -> list[int]:
        """The same without special strings. The normal form is walked once: it is made of clusters of
        code points, none of which composes with what stands before it. Prefixes that end
        between clusters are prefixes of the normal form; of one that ends within a cluster only the
        end is another, and goes on from the row of the word before it."""
        plain = self.normal(text)
        counts, words = self._prefixes(plain)
        if len(plain) == len(text) and unicodedata.is_normalized("NFC", text):
            return counts
        follows, starts, out = composing(), [m.start() for m in words], [0]
        rows: dict[int, tuple[str, list[str], list[int]]] = {}
        at, done = 0, 0  # of the text and of its normal form
        while at < len(text):
            end = at + 1
            while end < len(text) and text[end] in follows:
                end += 1
            for i in range(at + 1, end):
                tail, k = self.normal(text[at:i]), bisect_left(starts, done) - 1  # the word that begins before
                spelled_out = next((j for j in range(bisect_left(starts, done - _SPELLED), k + 1) if words[j][0][0] in "'<"), None)
                if spelled_out is not None:  # a word of the pattern may end here
                    out.append(counts[starts[spelled_out]] + self._loose(plain[starts[spelled_out] : done] + tail))
                    continue
                more = 0
                if k >= 0 and words[k].end() >= done and not _literal(words[k][0]):
                    kind = _kind(words[k][0][0])
                    while more < len(tail) and kind and _kind(tail[more]) == kind:
                        more += 1
                if not more:
                    out.append(counts[done] + self._loose(tail))
                    continue
                if k not in rows:
                    spelled = self.spelled(words[k][0])
                    rows[k] = spelled, *self.row(spelled, len(spelled))
                before = len(words[k][0][: done - starts[k]].encode())
                out.append(counts[starts[k]] + self._extended(*rows[k], before, self.spelled(tail[:more])) + self._loose(tail[more:]))
            done += len(self.normal(text[at:end]))
            out.append(counts[done])
            at = end
        return out

    def _prefixes(self, plain: str) -> tuple[list[int], list]:
        """Tokens of each prefix of a normal form, and its words."""
        out, words = [0], list(self.split.finditer(plain))
        for m in words:
            w, done = m[0], out[-1]
            out += [done] * (m.start() + 1 - len(out))
            if _literal(w):  # shortened, it is several words
                out += [done + self._loose(w[:i]) for i in range(1, len(w) + 1)]
            else:
                counts = self.prefix_counts(self.spelled(w))
                out += [done + counts[e] for e in accumulate([len(c.encode()) for c in w])]
        return out + [out[-1]] * (len(plain) + 1 - len(out)), words

    def _loose(self, text: str) -> int:
        """Tokens of a short normal text in which special strings are plain text."""
        return sum(self.word_count(self.spelled(w)) for w in self.split.findall(text))

    def _extended(self, word: str, last: list[str], count: list[int], upto: int, more: str) -> int:
        """Tokens of the word of the first `upto` units of another one, whose row is given, and more."""
        first = max(0, upto - self.most)
        text, last, count = word[first:upto] + more, last[first : upto + 1], count[first : upto + 1]
        for i in range(upto - first + 1, len(text)):
            t = self._last(text, i, last, "")
            last.append(t)
            count.append(count[i - len(t)] + 1)
        return count[len(text) - len(self._last(text, len(text), last, self.mark)) + len(self.mark)] + 1

    def fits(self, text: str, ends: list[int], counts: list[int], budget: int) -> int:
        """Code points of the longest prefix of text with at most `budget` tokens, from what
        stretches() says of it. A token has at most `most` units, so that not
        more of a long stretch than that need be looked at."""
        at = int(np.searchsorted(counts, budget, side="right"))
        if at == len(ends):
            return len(text)
        start, before = (ends[at - 1] + 1, counts[at - 1]) if at else (0, 0)
        inside = self.inside(text[start : min(ends[at], start + (budget - before + 1) * self.most * 4)])
        found = max(i for i, n in enumerate(inside) if before + n <= budget)
        return start + found if found or not at else start

    def count(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the code points of its longest prefix that fits the budget."""
        ends, counts = self.stretches([text])[0]
        return counts[-1], self.fits(text, ends, counts, budget)

    def every(self, text: str, ends: list[int], counts: list[int]) -> np.ndarray:
        """Tokens of every prefix of 0, 1, ... code points."""
        out = np.zeros(len(text) + 1, "<u4")
        start, before = 0, 0
        for end, n in zip(ends, counts, strict=True):
            out[start : end + 1] = np.array(self.inside(text[start:end])) + before
            start, before = end + 1, n
        return out


_LOADED: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One to a Python process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def prefix_table(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", budgets: tuple[int, ...] = (), every: bool = False) -> DataFrame:
    """Columns: key, n_bytes long (UTF-8), n_tokens long, ends, counts binary: little-endian
    unsigned 32-bit integers, where each stretch between spaces ends and how many tokens
    the prefix up to there has (with every: of every prefix of 0, 1, ... code points, ends
    then counts up); fits array<long>: for each budget the code points of the longest
    prefix that has no more tokens. path must lead to the vocabulary file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for part in slices(batches, 1, _TEXTS):
            texts = part.column(1).to_pylist()
            found = c.stretches(texts)
            fits = [[c.fits(t, *f, b) for b in budgets] for t, f in zip(texts, found, strict=True)]
            total = [n[-1] for _, n in found]
            if every:
                found = [(range(len(t) + 1), c.every(t, *f)) for t, f in zip(texts, found, strict=True)]
            packed = [[np.array(x[k], "<u4").tobytes() for x in found] for k in (0, 1)]
            sizes = [len(t.encode()) for t in texts]
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(total, pa.int64()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()), pa.array(fits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_tokens", "ends", "counts", "fits"])

    return docs.select(key, text_of(text).alias(text)).mapInArrow(run, f"`{key}` {kind_of(docs, key)}, n_bytes long, n_tokens long, ends binary, counts binary, fits array<long>")


def count_tokens(docs: DataFrame, path: str, *, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: key, n_bytes, n_tokens, over_limit boolean (more tokens than budget),
    fit_chars long (the longest prefix that fits the budget), from prefix_table()."""
    table = prefix_table(docs, path, key=key, text=text, budgets=(budget,))
    return table.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), F.col("fits")[0].alias("fit_chars"))
