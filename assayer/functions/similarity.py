"""Common runs and subsequences of two texts, for Arrow stages.

A suffix automaton of one text (linear time, links and lengths in arrays) is walked by the
other: the walk's longest match is the longest common run. Taking that run out and doing the same to what is
left and right of it gives the blocks of Ratcliff and Obershelp. Where only a bound is asked for, a
bit-parallel longest common subsequence does: one addition over len(a) bits for each character.
"""

from __future__ import annotations

import difflib
from collections import Counter
from functools import cached_property

import numpy as np

from . import grams as G


class Automaton:
    """The suffix automaton of a text: `longest` gives its longest run in common with another text."""

    def __init__(self, text: str):
        arcs, link, size, first = [{}], [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            own = len(arcs)
            arcs.append({})
            link.append(0)
            size.append(size[last] + 1)
            first.append(at)
            p = last
            while p >= 0 and c not in arcs[p]:
                arcs[p][c] = own
                p = link[p]
            if p >= 0:
                q = arcs[p][c]
                if size[p] + 1 == size[q]:
                    link[own] = q
                else:
                    twin = len(arcs)
                    arcs.append(dict(arcs[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    first.append(first[q])
                    while p >= 0 and arcs[p].get(c) == q:
                        arcs[p][c] = twin
                        p = link[p]
                    link[q] = link[own] = twin
            last = own
        self.arcs, self.link, self.size, self.first = arcs, link, size, first

    def longest(self, other: str) -> tuple[int, int, int]:
        """(start in `other`, start in the automaton's text, length): the first of the longest runs in `other`, and there the first in the text."""
        arcs, link, size, first = self.arcs, self.link, self.size, self.first
        state = n = 0
        best = (0, 0, 0)
        for i, c in enumerate(other):
            to = arcs[state].get(c)
            if to is None:
                while state >= 0 and c not in arcs[state]:
                    state = link[state]
                if state < 0:
                    state = n = 0
                    continue
                n, to = size[state], arcs[state][c]
            state, n = to, n + 1
            if n > best[2]:
                best = (i - n + 1, first[state] - n + 1, n)
        return best


def common_run(a: str, b: str) -> int:
    """Length of the longest run of characters that two texts have in common."""
    short, long = sorted((a, b), key=len)
    return Automaton(short).longest(long)[2]


def blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Matching blocks (start in a, start in b, length): the longest run, then the same before and after it."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        i, j, n = Automaton(b[blo:bhi]).longest(a[alo:ahi])
        if n:
            i, j = i + alo, j + blo
            out.append((i, j, n))
            todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return sorted(out)


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio without junk."""
    return 2.0 * sum(n for _, _, n in blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


def places(text: str) -> dict[str, int]:
    """For each character the bits of where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def subsequence(n: int, at: dict[str, int], b: str, least: int = 0) -> int:
    """Length of the longest common subsequence of b and a text of n characters at `at`; anything below `least` if that can't be reached."""
    full = v = (1 << n) - 1
    for i, c in enumerate(b):
        if m := at.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
        if least and i % 256 == 255 and n - v.bit_count() + len(b) - i - 1 < least:
            break
    return n - v.bit_count()


class Near:
    """Whether the ratio of a key and a text reaches `least`: by length, by common subsequence, then by the ratio itself.

    The characters that match form a common subsequence, so the ratio is at most twice its length over both lengths.
    """

    def __init__(self, least: float):
        self.least, self.key, self.at = least, None, {}

    def __call__(self, key: str, text: str) -> bool:
        both = len(key) + len(text)
        if 2.0 * min(len(key), len(text)) < self.least * both:
            return False
        if key == text:
            return True
        if key != self.key:
            self.key, self.at = key, places(key)
        need = self.least * both / 2.0
        if subsequence(len(key), self.at, text, int(need)) < need - 1e-9:
            return False
        return difflib.SequenceMatcher(None, key, text).ratio() >= self.least


def most_blocks(text: str) -> int | None:
    """How many matching blocks difflib can find with a text as its second sequence; None where it says nothing about that.

    In a text of 200 characters and more difflib starts no block at a character of more than 1 % of them. Each block so has
    one of the other, rarer places, but for one that begins at the start of both texts.
    """
    if len(text) < 200:
        return None
    return 1 + sum(n for n in Counter(text).values() if n <= len(text) // 100 + 1)


def subsequences(text: np.ndarray, others: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of `others` (code points, filled up with -1) may have a common subsequence of length `least` with a text.

    The bit-parallel subsequence, for all rows at once, over words of 64 bits of the text. Rows that can't reach
    `least` any more are dropped on the way.
    """
    words = -(-len(text) // 64)
    alphabet, ranks = np.unique(text, return_inverse=True)
    at = np.zeros((len(alphabet) + 1, words), np.uint64)
    place = np.arange(len(text))
    np.bitwise_or.at(at, (ranks, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    codes = np.searchsorted(alphabet, others)
    codes[codes == len(alphabet)] = 0
    codes[alphabet[codes] != others] = len(alphabet)
    live = np.arange(len(others))
    v = np.full((words, len(others)), np.iinfo(np.uint64).max, np.uint64)
    for i in range(others.shape[1]):
        masks = at[codes[live, i]].T
        carry = np.zeros(len(live), np.uint64)
        for w in range(words):
            u = v[w] & masks[w]
            total = v[w] + u
            more = total + carry
            carry = ((total < u) | (more < total)).astype(np.uint64)
            v[w] = more | (v[w] ^ u)
        if i % 16 == 15 or i == others.shape[1] - 1:
            # bits that are cleared are matches so far; beyond the text no bit is ever cleared
            matched = np.bitwise_count(~v).sum(axis=0, dtype=np.int64)
            fine = matched + np.maximum(0, lengths[live] - i - 1) >= least[live]
            if not fine.all():
                live, v = live[fine], v[:, fine]
            if not len(live):
                break
    return live


def bands(keys: np.ndarray, lengths: np.ndarray, codes: np.ndarray, n: np.ndarray, none: int, ratio: float, few: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of all pairs that may have a common subsequence of ratio / 2 of their characters together.

    `keys` has a column for each key and no more rows than the shortest has characters, `codes` a row for each text, filled up with
    `none`. Bit p of a word stands for place start + p of the text; zeros that leave the band are counted. Of a key's first i characters
    at most as many may be unmatched as of the whole key. When no more than `few` pairs are left, the rest is not looked at.
    """
    one, half = np.uint64(1), ratio / 2
    up = max(0, int(np.floor(lengths.max() - half * (lengths.max() + n.min()) + 1e-6)))
    down = max(0, int(np.floor(n.max() - half * (lengths.min() + n.max()) + 1e-6)))
    words = -(-(up + down + 1) // 64)
    by = min(32, 64 * words - up - down)
    shape, text = (len(lengths), len(n)), np.arange(len(n))
    padded = np.full((up + codes.shape[1] + 64 * words + len(keys) + by, len(n)), none, np.int64)
    padded[up : up + codes.shape[1]] = codes.T
    at = np.zeros((words, none + 1, len(n)), np.uint64)
    for p in range(64 * words):
        at[p // 64, padded[p], text] |= one << np.uint64(p % 64)
    at[:, none] = 0
    v = np.full((words, *shape), np.iinfo(np.uint64).max, np.uint64)
    m, u = np.empty(shape, np.uint64), np.empty(shape, np.uint64)
    gone = np.zeros(shape, np.int16 if len(keys) < 1 << 14 else np.int64)
    unmatched = (1 - half) * lengths[:, None] - half * n[None, :] + 1e-6
    for i in range(len(keys)):
        if i and i % by == 0:
            gone += np.bitwise_count(~v[0] & np.uint64((1 << by) - 1))
            right, left = np.uint64(by), np.uint64(64 - by)
            for w in range(words):
                for x in (at[w], v[w]):
                    x >>= right
                if w + 1 < words:
                    at[w] |= at[w + 1] << left
                    v[w] |= v[w + 1] << left
            v[-1] |= np.uint64((1 << by) - 1) << left
            for p in range(64 * words - by, 64 * words):
                at[-1, padded[i + p], text] |= one << np.uint64(p % 64)
            at[-1, none] = 0
        more = None
        for w in range(words):
            at[w].take(keys[i], axis=0, out=m, mode="clip")
            np.bitwise_and(v[w], m, out=m)
            np.add(v[w], m, out=u)
            if w + 1 < words or more is not None:
                over = u < m
                if more is not None:
                    u += more
                    over |= u < more
                more = over
            np.bitwise_xor(v[w], m, out=v[w])
            v[w] |= u
        if i + 1 == len(keys) or (i % 16 == 15 and 2 * i > len(keys)):
            matched = gone + np.bitwise_count(~v).sum(axis=0, dtype=np.int64)
            fine = matched + unmatched >= i + 1
            if np.count_nonzero(fine) <= few or i + 1 == len(keys):
                return np.nonzero(fine)
    return np.nonzero(np.ones(shape, bool))


class Block:
    """Texts, in which those are looked for whose ratio with a given text reaches `ratio`.

    Of a key and a text with S characters together at least ratio S / 2 must match, in blocks that leave at most
    (1 - ratio) S characters out, so in at most (1 - ratio) S + 1 of them, and in no more than most_blocks(text). A block of m
    characters has m - n + 1 n-grams. Where this asks for many long grams, they are counted; else single characters
    are, and then the common subsequence of those that are left.

    near() does so for many texts at once, in tiles of texts and keys of like lengths. Where many grams are asked for, texts are
    rows of zeros and ones by a hash of their grams, so a matrix product says how many places two rows share at most; a collision
    only raises that. Else the bit-parallel subsequence runs for all pairs of a tile: a character matched at i of the key and j of the
    text leaves |i - j| others out, so the pairs' matches lie in a band of some (1 - ratio) S bits, which moves along with i.
    """

    GRAMS = (8, 5)
    #: Grams of the matrix product, the least share of a text that must be in common, places for each character, how many times as many a second look has, and the least and most places.
    GRAM, STRONG, WIDE, FINE, FEWEST, MOST = 5, 0.2, 2.5, 16, 1024, 1 << 14
    #: Texts and keys of a tile, how much their lengths differ, words of a band at most, pairs that are decided one by one, and pairs that get a second look at once.
    TEXTS, KEYS, APART, WORDS, FEW, PAIRS = 64, 256, 4, 4, 8, 1024

    def __init__(self, texts: list[str], ratio: float):
        self.texts, self.ratio = sorted(texts, key=len), ratio
        self.known = set(self.texts)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        parts = [G.points(t) for t in self.texts]
        self.codes, self.starts = np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(self.lengths)])
        self.alphabet, self.ranks = np.unique(self.codes, return_inverse=True)
        self.rows: dict[int, tuple[np.ndarray, ...]] = {}

    @cached_property
    def indexes(self) -> dict[int, G.Index]:
        return {n: G.Index(self.texts, n) for n in self.GRAMS}

    @cached_property
    def characters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By character the texts that have it, how often, and where each character's texts begin."""
        many = max(1, len(self.texts))
        pair, times = np.unique(self.ranks * many + np.repeat(np.arange(len(self.texts)), self.lengths), return_counts=True)
        return pair % many, times, np.searchsorted(pair // many, np.arange(len(self.alphabet) + 1))

    def has_near(self, text: str) -> bool:
        reaches = Near(self.ratio)
        return any(reaches(self.texts[k], text) for k in self.candidates(text).tolist())

    def near(self, texts: list[str]) -> np.ndarray:
        """has_near() of each text."""
        out, r = np.array([t in self.known for t in texts], bool), self.ratio
        counted, banded = [], []
        for i in sorted(np.flatnonzero(~out).tolist(), key=lambda i: len(texts[i])):
            n = len(texts[i])
            first, last = self._close(n, n)
            if not n or first >= last:
                continue
            most = most_blocks(texts[i])
            if most is not None and r / (2 - r) * n - (self.GRAM - 1) * most >= self.STRONG * n:
                counted.append((i, most))
            elif (1 - r) * 2 / r * n + 2 * self.APART <= 64 * self.WORDS:
                banded.append(i)
            else:
                out[i] = self.has_near(texts[i])
        for k in range(0, len(counted), self.KEYS):
            self._counted(texts, counted[k : k + self.KEYS], out)
        while banded:
            n = len(texts[banded[0]])
            k = next((k for k, i in enumerate(banded) if k == self.TEXTS or len(texts[i]) > n + self.APART), len(banded))
            self._banded(texts, banded[:k], out)
            banded = banded[k:]
        return out

    def _close(self, least: int, most: int) -> tuple[int, int]:
        """Places between which keys have lengths that can reach the ratio with texts of these lengths."""
        r = self.ratio
        return tuple(np.searchsorted(self.lengths, [int(np.floor(least * r / (2 - r))), int(np.ceil(most * (2 - r) / r)) + 1]).tolist())

    def _decide(self, texts: list[str], pairs: np.ndarray, out: np.ndarray) -> None:
        """Decides pairs of a key and a text one by one."""
        reaches = Near(self.ratio)
        for k, i in pairs.tolist():
            out[i] = out[i] or reaches(self.texts[k], texts[i])

    def _bits(self, codes: np.ndarray, lengths: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text a row of zeros and ones, the same over FINE times as many places in words of 64 bits, its number of ones there, and how many grams it has."""
        n, own, many = self.GRAM, np.repeat(np.arange(len(lengths)), lengths), max(0, len(codes) - self.GRAM + 1)
        gram = np.zeros(many, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + many].astype(np.uint64)
        gram ^= gram >> np.uint64(31)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        fits = own[:many] == own[n - 1 :] if many else np.zeros(0, bool)
        own, place = own[:many][fits], (gram[fits] >> np.uint64(36)).astype(np.int64) % (self.FINE * places)
        out, fine = np.zeros((len(lengths), places), np.float32), np.zeros((len(lengths), self.FINE * places // 64), np.uint64)
        out[own, place % places] = 1
        np.bitwise_or.at(fine, (own, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        return out, fine, np.bitwise_count(fine).sum(axis=1, dtype=np.int64), np.maximum(0, lengths - n + 1)

    def _counted(self, texts: list[str], own: list[tuple[int, int]], out: np.ndarray) -> None:
        """Pairs that share enough grams, by a matrix product."""
        parts = [G.points(texts[i]) for i, _ in own]
        n, most = np.array([len(p) for p in parts]), np.array([m for _, m in own])
        first, last = self._close(int(n.min()), int(n.max()))
        half, index, codes = self.ratio / 2, np.array([i for i, _ in own]), np.concatenate(parts)
        while first < last:
            places = self.FEWEST
            while places < self.MOST and places < self.WIDE * self.lengths[first]:
                places *= 2
            group = slice(*np.searchsorted(self.lengths, [places / 2 / self.WIDE if places > self.FEWEST else 0, places / self.WIDE if places < self.MOST else np.inf], "right"))
            if places not in self.rows:
                self.rows[places] = self._bits(self.codes[self.starts[group.start] : self.starts[group.stop]], self.lengths[group], places)
            rows, second, held, grams = self.rows[places]
            end = min(last, group.stop)
            at = slice(first - group.start, end - group.start)
            asked, asked_second, mine, there = self._bits(codes, n, places)
            need = half * n - (self.GRAM - 1) * most  # and half of the key's characters
            short = half * self.lengths[first:end]
            shared = asked @ rows[at].T
            # what a text doesn't share are at most its grams less those that both must have
            shared -= (asked.sum(axis=1) - there + need).astype(np.float32)[:, None]
            row, key = np.nonzero(shared >= (short - 0.05).astype(np.float32))
            kept = 2.0 * np.minimum(n[row], self.lengths[first + key]) >= self.ratio * (n[row] + self.lengths[first + key])
            row, key = row[kept], key[kept]
            for a in range(0, len(row), self.PAIRS):
                i, k = row[a : a + self.PAIRS], key[a : a + self.PAIRS]
                both = np.bitwise_count(asked_second[i] & second[at][k]).sum(axis=1, dtype=np.int64)
                least = need[i] + short[k] - 1e-6 - np.minimum(there[i] - mine[i], grams[at][k] - held[at][k])
                for j, k in zip(i[both >= least].tolist(), (k[both >= least] + first).tolist(), strict=True):
                    if not out[index[j]] and self._enough(parts[j], k, float(need[j] + half * self.lengths[k])):
                        self._decide(texts, np.array([[k, index[j]]]), out)
            first = end

    def _enough(self, codes: np.ndarray, key: int, need: float) -> bool:
        """Whether a text and a key share so many grams, repeats included."""
        other, n = self.codes[self.starts[key] : self.starts[key + 1]], self.GRAM
        known, ranks = np.unique(np.concatenate([codes, other]), return_inverse=True)
        gram = G.numbers(ranks, len(known), n)
        a, b = (dict(zip(*(x.tolist() for x in np.unique(g, return_counts=True)), strict=True)) for g in (gram[: max(0, len(codes) - n + 1)], gram[len(codes) :]))
        return sum(min(times, b.get(g, 0)) for g, times in a.items()) >= need - 1e-6

    def _banded(self, texts: list[str], own: list[int], out: np.ndarray) -> None:
        """Pairs whose common subsequence is long enough, by bands of bits."""
        parts = [G.points(texts[i]) for i in own]
        n = np.array([len(p) for p in parts])
        codes = np.full((len(own), int(n.max())), -1, np.int64)
        codes[np.repeat(np.arange(len(own)), n), G.ranges(np.zeros(len(own), np.int64), n)] = np.concatenate(parts)
        alphabet = np.unique(codes[codes >= 0])
        codes = np.where(codes < 0, len(alphabet), np.searchsorted(alphabet, codes))
        rank = np.searchsorted(alphabet, self.alphabet)
        rank[(rank == len(alphabet)) | (alphabet[np.minimum(rank, len(alphabet) - 1)] != self.alphabet)] = len(alphabet)
        first, last = self._close(int(n[0]), int(n[-1]))
        index = np.array(own)
        while first < last:
            end = min(last, first + self.KEYS, int(np.searchsorted(self.lengths, self.lengths[first] + self.APART, "right")))
            lengths = self.lengths[first:end]
            steps = int(lengths[0])
            keys = rank[self.ranks[self.starts[first:end][None, :] + np.arange(steps)[:, None]]]
            key, row = bands(keys, lengths, codes, n, len(alphabet), self.ratio, self.FEW)
            fine = 2.0 * np.minimum(n[row], lengths[key]) >= self.ratio * (n[row] + lengths[key])
            self._decide(texts, np.stack([key[fine] + first, index[row[fine]]], axis=1), out)
            first = end

    def candidates(self, text: str) -> np.ndarray:
        """Places of all texts that can reach the ratio."""
        n, r = len(text), self.ratio
        close = np.arange(*self._close(n, n))
        close = close[2.0 * np.minimum(n, self.lengths[close]) >= r * (n + self.lengths[close])]
        if not len(close):
            return close
        both = n + self.lengths[close]
        matches = r * both / 2 - 1e-9
        blocks = (1 - r) * both + 1
        if (most := most_blocks(text)) is not None:
            blocks = np.minimum(blocks, most)
        codes = G.points(text)
        for size in self.GRAMS:
            need = matches - (size - 1) * blocks
            if need.min() >= max(1, 0.1 * n):
                return close[self.indexes[size].shared(codes, repeated=True)[close] >= need]
        close, matches = self._common(codes, close, matches)
        if not len(close):
            return close
        wide = int(self.lengths[close].max())
        others = np.full((len(close), wide), -1, np.int64)
        lengths = self.lengths[close]
        others[np.repeat(np.arange(len(close)), lengths), G.ranges(np.zeros(len(close), np.int64), lengths)] = self.codes[G.ranges(self.starts[close], self.starts[close] + lengths)]
        return close[subsequences(codes, others, lengths, matches)]

    def _common(self, codes: np.ndarray, close: np.ndarray, matches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What has enough characters in common, order aside."""
        shared = np.zeros(len(self.texts), np.int64)
        having, often, offsets = self.characters
        for c, times in zip(*np.unique(codes, return_counts=True), strict=True):
            k = int(np.searchsorted(self.alphabet, c))
            if k < len(self.alphabet) and self.alphabet[k] == c:
                at = slice(offsets[k], offsets[k + 1])
                shared[having[at]] += np.minimum(times, often[at])
        fine = shared[close] >= matches
        return close[fine], matches[fine]
