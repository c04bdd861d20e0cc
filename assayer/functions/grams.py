"""Character n-grams of texts as whole numbers, for Arrow stages. Equal numbers mean equal grams: nothing is hashed.

A gram's number is built up character by character, from ranks in the alphabet. Before it could pass 62 bits, the
prefixes so far are numbered anew by their rank among those that occur.
"""

from __future__ import annotations

import numpy as np

#: Numbers of grams stay below.
MOST = 1 << 62


def points(text: str | None) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The whole numbers of all half-open ranges, one range after another."""
    n = last - first
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)


def numbers(ranks: np.ndarray, base: int, n: int, levels: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A number for each n-gram of `ranks`, which are below `base`; `levels` receives the prefixes that were numbered anew."""
    many = max(0, len(ranks) - n + 1)
    key, most = ranks[:many], base
    for k in range(1, n):
        if most > MOST // max(1, base):
            known, key = np.unique(key, return_inverse=True)
            most = max(1, len(known))
            if levels is not None:
                levels[k] = known
        key = key * base + ranks[k : k + many]
        most *= base
    return key


def repeats(text: str | None, ns: list[int]) -> list[tuple[int, int, int]]:
    """For each n how many n-grams a text has, how many distinct ones, and how often the most frequent one occurs."""
    known, ranks = np.unique(points(text), return_inverse=True)
    out = []
    for n in ns:
        times = np.unique(numbers(ranks, len(known), n), return_counts=True)[1]
        out.append((max(0, len(ranks) - n + 1), len(times), int(times.max(initial=0))))
    return out


def overlap(a: str, b: str, n: int) -> float:
    """Share of the distinct n-grams of a that b has; 0 if a has none."""
    known, ranks = np.unique(points(a + b), return_inverse=True)
    key = numbers(ranks, len(known), n)
    own, other = np.unique(key[: max(0, len(a) - n + 1)]), np.unique(key[len(a) :])
    return len(np.intersect1d(own, other, assume_unique=True)) / len(own) if len(own) else 0.0


class Index:
    """The n-grams of some texts, and how often each text has them."""

    def __init__(self, texts: list[str], n: int):
        parts = [points(t) for t in texts]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.n, self.many, self.levels = n, len(texts), {}
        self.alphabet = np.unique(flat)
        key = numbers(np.searchsorted(self.alphabet, flat), len(self.alphabet), n, self.levels)
        fits = own[: len(key)] == own[n - 1 :]
        self.keys, gram = np.unique(key[fits], return_inverse=True)
        pair, self.times = np.unique(gram * max(1, self.many) + own[: len(key)][fits], return_counts=True)
        self.texts = pair % max(1, self.many)
        self.offsets = np.searchsorted(pair // max(1, self.many), np.arange(len(self.keys) + 1))
        #: How many distinct grams each text has.
        self.sizes = np.bincount(self.texts, minlength=self.many)

    def shared(self, codes: np.ndarray, repeated: bool = False) -> np.ndarray:
        """How many distinct grams (or grams with repeats) a text with these code points shares with each text."""
        n, base, many = self.n, len(self.alphabet), max(0, len(codes) - self.n + 1)
        if not len(self.keys) or not many:
            return np.zeros(self.many, np.int64)
        ranks, there = _found(self.alphabet, codes)
        good = np.lib.stride_tricks.sliding_window_view(there, n).all(axis=1) if not there.all() else np.ones(many, bool)
        key = ranks[:many]
        for k in range(1, n):
            if k in self.levels:
                key, fits = _found(self.levels[k], key)
                good &= fits
            key = key * base + ranks[k : k + many]
        gram, times = np.unique(key[good], return_counts=True)
        gram, fits = _found(self.keys, gram)
        gram, times = gram[fits], times[fits]
        first, last = self.offsets[gram], self.offsets[gram + 1]
        at = ranges(first, last)
        if not repeated:
            return np.bincount(self.texts[at], minlength=self.many)
        both = np.minimum(np.repeat(times, last - first), self.times[at])
        return np.bincount(self.texts[at], both, self.many).astype(np.int64)


def _found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in an ascending array, and whether they are there (else the place is 0)."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    there = known[at] == values
    at[~there] = 0
    return at, there
