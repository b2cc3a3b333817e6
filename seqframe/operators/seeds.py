"""One pass over a text for any number of motifs.

Exact: an Aho-Corasick automaton over all motifs. Within an edit budget: of budget + 1 pieces
of a motif one is unchanged wherever it occurs, so that the pieces of all motifs are grams
of one table, by length; a polynomial hash of every place of the text is looked up there, and
each hit is a motif and a diagonal. Those are counted out by the halves of the pieces, of which
most must be there too, and what is left is verified by Myers' bit vectors, thousands of motifs and
places at a time, a machine word for 64 letters of a motif.
"""

from __future__ import annotations

import numpy as np

_WORD = 64
_LANES = 1 << 15  # motifs at places that are verified together
_DENSE = 1 << 22  # entries of a letter table that is looked up directly
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ONE = np.uint64(1)


class Text:
    """Reads one after the other in one array of code points, each followed by a 0."""

    def __init__(self, seqs: list[str]):
        self.joined = "\0".join([*seqs, ""])
        self.codes = np.frombuffer(self.joined.encode(), np.uint8) if self.joined.isascii() else np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(s) + 1 for s in seqs], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.ends = self.starts + sizes - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def places(self, motif: str) -> np.ndarray:
        """Every start of a string, overlapping ones too."""
        at, found = self.joined.find(motif), []
        while at >= 0:
            found.append(at)
            at = self.joined.find(motif, at + 1)
        return np.array(found, np.int64)


class Automaton:
    """All motifs in one Aho-Corasick automaton. Motifs that are spelled alike share a state."""

    def __init__(self, motifs: list[str]):
        from ahocorasick import Automaton as Machine

        by: dict[str, list[int]] = {}
        for k, m in enumerate(motifs):
            by.setdefault(m, []).append(k)
        self.owners = list(by.values())
        self.length = np.array([len(m) for m in by], np.int64)
        self.same = max(map(len, self.owners), default=0)
        self.machine = Machine()
        for k, m in enumerate(by):
            self.machine.add_word(m, k)
        if by:
            self.machine.make_automaton()

    def find(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Motif and start of every occurrence, overlapping ones too."""
        if not self.owners:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hits = np.fromiter((x for hit in self.machine.iter(text.joined) for x in hit), np.int64).reshape(-1, 2)
        start = hits[:, 0] + 1 - self.length[hits[:, 1]]
        if self.same == 1:
            return np.array([o[0] for o in self.owners], np.int64)[hits[:, 1]], start
        many = np.array([len(o) for o in self.owners])
        first, n = np.cumsum(many) - many, many[hits[:, 1]]
        which = np.repeat(first[hits[:, 1]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.concatenate([np.array(o, np.int64) for o in self.owners])[which], np.repeat(start, n)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """The powers 0 to n of a base, modulo 2 ** 64."""
    return np.cumprod(np.concatenate([[_ONE], np.full(n, base, np.uint64)]), dtype=np.uint64)


class Grams:
    """The pieces of one length of all motifs, by hash."""

    def __init__(self, size: int, codes: np.ndarray, motif: np.ndarray, offset: np.ndarray):
        self.size = size
        value = (codes.astype(np.uint64) * _powers(size - 1, _BASE)).sum(axis=1, dtype=np.uint64)
        order = np.argsort(value, kind="stable")
        self.motif, self.offset = motif[order], offset[order]
        self.known, self.first, self.many = np.unique(value[order], return_index=True, return_counts=True)
        self.shift = np.uint64(_WORD - max(16, int(4 * len(self.known)).bit_length()))
        self.cell = np.zeros(1 << int(np.uint64(_WORD) - self.shift), bool)
        self.cell[self._place(self.known)] = True

    def _place(self, value: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (value * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def hits(self, prefix: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Motif and diagonal of each place that has a known hash. prefix: sums of code times
        power; back: the inverse powers."""
        n = len(prefix) - self.size
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            value = (prefix[self.size :] - prefix[:n]) * back[:n]
        at = np.flatnonzero(self.cell[self._place(value)])
        value = value[at]
        slot = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
        good = self.known[slot] == value
        at, slot = at[good], slot[good]
        n = self.many[slot]
        which = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.motif[which], np.repeat(at, n) - self.offset[which]


class Letters:
    """Bit masks of the places of each letter in each motif, by 64 letters."""

    def __init__(self, codes: list[np.ndarray]):
        size = np.array([len(c) for c in codes], np.int64)
        motif = np.repeat(np.arange(len(codes)), size)
        letter = np.concatenate([*codes, np.empty(0, np.int64)]).astype(np.int64)
        place = np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size)
        self.words = int(-(-size.max(initial=1) // _WORD))
        self.alphabet = np.unique(letter)
        self.width = len(self.alphabet) + 1  # the last one is for all others
        key = motif * self.width + np.searchsorted(self.alphabet, letter)
        self.keys, row = np.unique(key, return_inverse=True)
        masks = np.zeros((self.words, len(self.keys) + 1), np.uint64)  # the last one is empty
        np.bitwise_or.at(masks, (place // _WORD, row), _ONE << (place % _WORD).astype(np.uint64))
        self.masks = masks
        self.direct = None
        if len(codes) * self.width <= _DENSE:
            self.direct = np.full(len(codes) * self.width, len(self.keys), np.int32)
            self.direct[self.keys] = np.arange(len(self.keys), dtype=np.int32)

    def coded(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the letters of a text, the same for motifs spelled backwards."""
        if not len(self.alphabet):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet)).astype(np.int64)

    def of(self, motif: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """A row of masks to each word."""
        key = motif * self.width + letter
        if self.direct is not None:
            return self.masks[:, self.direct[key]]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.masks[:, np.where(self.keys[at] == key, at, len(self.keys))]


class Lanes:
    """Myers' bit vectors for many motifs, one step of a letter for each. anywhere: the
    text may be left out up to any letter (else it counts from its first one)."""

    def __init__(self, size: np.ndarray, words: int, anywhere: bool):
        n = len(size)
        self.up = [np.full(n, ~np.uint64(0)) for _ in range(words)]
        self.down = [np.zeros(n, np.uint64) for _ in range(words)]
        self.score = size.astype(np.int64)
        self.last, self.bit = (size - 1) // _WORD, ((size - 1) % _WORD).astype(np.uint64)
        self.single = words == 1
        self.rising = np.zeros(n, np.uint64) if anywhere else np.ones(n, np.uint64)
        self.none = np.zeros(n, np.uint64)

    def step(self, masks: np.ndarray) -> None:
        """masks: of the next letter, a row to each word."""
        rise, fall = self.rising, self.none
        for w in range(len(self.up)):
            up, down, same = self.up[w], self.down[w], masks[w]
            xv = same | down
            if w:
                same = same | fall
            xh = (((same & up) + up) ^ up) | same
            plus, minus = down | ~(xh | up), up & xh
            change = ((plus >> self.bit) & _ONE).astype(np.int64) - ((minus >> self.bit) & _ONE).astype(np.int64)
            self.score += change if self.single else np.where(self.last == w, change, 0)
            top = np.uint64(_WORD - 1)
            risen, fallen = plus >> top, minus >> top
            plus, minus = (plus << _ONE) | rise, (minus << _ONE) | fall
            self.up[w], self.down[w] = minus | ~(xv | plus), plus & xv
            rise, fall = risen, fallen


class Budgeted:
    """The best places of motifs within their edit budgets."""

    def __init__(self, motifs: list[str], budgets: list[int]):
        codes = [np.frombuffer(m.encode("utf-32-le"), np.uint32) for m in motifs]
        order = sorted((k for k in range(len(motifs)) if len(motifs[k]) > budgets[k]), key=lambda k: len(motifs[k]))
        #: Motifs that any place fits, if only by their budget: no piece is sure to be there.
        self.loose = [k for k in range(len(motifs)) if len(motifs[k]) <= budgets[k]]
        self.name = np.array(order, np.int64)
        codes = [codes[k] for k in order]
        self.size, self.budget = np.array([len(c) for c in codes], np.int64), np.array([budgets[k] for k in order], np.int64)
        self.forward, self.backward = Letters(codes), Letters([c[::-1] for c in codes])
        pieces: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        most = 2 * int(self.budget.max(initial=0)) + 2
        self.halves, self.value = np.zeros((len(codes), most + 1), np.int64), np.zeros((len(codes), most), np.uint64)
        powers = _powers(int(self.size.max(initial=0)), _BASE)
        for i, (c, k) in enumerate(zip(codes, self.budget.tolist(), strict=True)):
            cuts = [len(c) * j // (k + 1) for j in range(k + 2)]
            for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                pieces.setdefault(b - a, []).append((c[a:b], i, a))
                self.halves[i, 2 * j : 2 * j + 3] = a, (a + b) // 2, b
            sums = np.concatenate([[np.uint64(0)], np.cumsum(c * powers[: len(c)], dtype=np.uint64)])
            cuts = self.halves[i, : 2 * k + 3]
            with np.errstate(over="ignore"):
                self.value[i, : 2 * k + 2] = sums[cuts[1:]] - sums[cuts[:-1]]  # times the power of where it begins
        self.powers = powers
        self.grams = [Grams(n, np.stack([p for p, _, _ in some]), np.array([i for _, i, _ in some]), np.array([a for _, _, a in some])) for n, some in sorted(pieces.items())]

    def _seeds(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Different motifs and diagonals, by motif."""
        n = len(text.codes)
        back = _powers(n, _BACK)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(text.codes.astype(np.uint64) * _powers(n, _BASE)[:n], dtype=np.uint64)])
        found = []
        for g in self.grams:
            motif, diagonal = g.hits(prefix, back)
            for k in range(0, len(motif), _LANES):
                m, d = motif[k : k + _LANES], diagonal[k : k + _LANES]
                good = self._likely(m, d, prefix, back)
                found.append((m[good], d[good]))
        motif, diagonal = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        low, width = int(self.size.max(initial=0)), n + 2 * int(self.size.max(initial=0)) + 1
        key = np.sort(motif * width + diagonal + low)
        key = key[np.diff(key, prepend=-1) != 0]
        return key // width, key % width - low

    def _likely(self, motif: np.ndarray, diagonal: np.ndarray, prefix: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Where enough half pieces are unchanged, no further off than the budget k: as k edits
        change no more than k of 2 * k + 2 halves, k + 2 of them are there."""
        out, n = np.ones(len(motif), bool), len(prefix) - 1
        budget = self.budget[motif]
        for k in np.unique(budget[budget > 0]).tolist():
            lanes = np.flatnonzero(budget == k)
            m, d = motif[lanes], diagonal[lanes]
            there = np.zeros(len(lanes), np.int64)
            for j in range(2 * k + 2):
                start, size = self.halves[m, j], self.halves[m, j + 1] - self.halves[m, j]
                found = size == 0
                with np.errstate(over="ignore"):
                    want = self.value[m, j]
                    for shift in range(-k, k + 1):
                        at = np.clip(d + start + shift, 0, n - size)
                        found |= (prefix[at + size] - prefix[at]) * back[at] * self.powers[start] == want
                there += found
            out[lanes] = there >= k + 2
        return out

    def find(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Motif, owner, start, end and distance of the places with the least distance of each
        motif in each read, if within its budget: one to each end, with the earliest start."""
        motif, diagonal = self._seeds(text)
        letters = self.forward.coded(text.codes)
        ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(0, len(motif), _LANES):
            ends.append(self._ends(text, letters, motif[k : k + _LANES], diagonal[k : k + _LANES]))
        motif, end, distance = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*ends)) if ends else (np.empty(0, np.int64),) * 3
        order = np.lexsort((distance, end, motif))
        motif, end, distance = motif[order], end[order], distance[order]
        new = (np.diff(motif, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)
        motif, end, distance = motif[new], end[new], distance[new]
        owner = text.owner(end - 1)
        pair = motif * len(text.starts) + owner  # ascends, as ends do within a motif
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        least = np.minimum.reduceat(distance, first) if len(first) else distance
        best = distance == np.repeat(least, np.diff(np.append(first, len(pair))))
        motif, end, distance, owner = motif[best], end[best], distance[best], owner[best]
        start = np.empty(len(motif), np.int64)
        for k in range(0, len(motif), _LANES):
            some = slice(k, k + _LANES)
            start[some] = end[some] - self._reach(letters, motif[some], end[some], distance[some], (end - text.starts[owner])[some])
        base = text.starts[owner]
        return self.name[motif], owner, start - base, end - base, distance

    def _ends(self, text: Text, letters: np.ndarray, motif: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Motifs, ends and distances within the budget, around diagonals."""
        size, budget = self.size[motif], self.budget[motif]
        low, high = np.maximum(diagonal - budget, 0), diagonal + size + budget
        border = text.ends[text.owner(low)] < high  # windows of more than one read
        mixed, n = bool(border.any()), len(text.codes)
        lanes, out = Lanes(size, self.forward.words, True), []
        for j in range(int((high - low).max(initial=0))):
            here = low + j
            active = here < np.minimum(high, n)
            letter = letters[np.minimum(here, n - 1)]
            lanes.step(self.forward.of(motif, letter))
            if mixed:  # behind a border between reads all starts anew
                stop = np.flatnonzero(border & (text.codes[np.minimum(here, n - 1)] == 0))
                for w in range(self.forward.words):
                    lanes.up[w][stop], lanes.down[w][stop] = ~np.uint64(0), 0
                lanes.score[stop] = size[stop]
                active[stop] = False
            good = np.flatnonzero((lanes.score <= budget) & active)
            if len(good):
                out.append((motif[good], here[good] + 1, lanes.score[good]))
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def _reach(self, letters: np.ndarray, motif: np.ndarray, end: np.ndarray, distance: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The most letters before the end that have that distance to the motif; the read has `room` there."""
        size = self.size[motif]
        lanes, best = Lanes(size, self.backward.words, False), np.zeros(len(motif), np.int64)
        for j in range(1, int((size + distance).max(initial=0)) + 1):
            lanes.step(self.backward.of(motif, letters[np.maximum(end - j, 0)]))
            best[(lanes.score == distance) & (j <= room)] = j
        return best
