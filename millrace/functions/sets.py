"""Sets of character n-grams as sorted 64-bit hashes, and signatures that near sets share."""

from __future__ import annotations

from bisect import bisect_right
from math import floor

import numpy as np
import pandas as pd

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, which is one to one."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def gram_set(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the distinct character n-grams; a shorter text is its own gram."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.full(max(1, len(c) - n + 1), min(len(c), n), np.uint64)
    for k in range(min(n, len(c))):
        h = mixed((h + c[k : k + len(h)]) * _C + np.uint64(k + 1))
    return np.unique(h)


class Signatures:
    """Hashes of which two sets share one at least if their Jaccard similarity is over the threshold.

    Such sets differ in fewer than (m + n) * (1 - t) / (1 + t) elements, so of more parts than that, into which the space of hashes is
    cut, one at least is the same in both. Parts go by sizes: a set of an interval meets those of its own and of the one below; the
    sizes of a near pair are never further apart.
    """

    def __init__(self, threshold: float):
        self.threshold, self.bounds = threshold, [1]

    def interval(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(floor(self.bounds[-1] / self.threshold + 1e-9) + 1)
        return bisect_right(self.bounds, size) - 1

    def most(self, k: int) -> int:
        """The largest size of an interval."""
        while len(self.bounds) < k + 2:
            self.interval(self.bounds[-1])
        return self.bounds[k + 1] - 1

    def of(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures as a member of the set's own interval, and of the next one."""
        k = self.interval(len(items))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(items ^ _C))))
        return self._parts(items, sums, k), self._parts(items, sums, k + 1)

    def _parts(self, items: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
        parts = floor(2 * self.most(k) * (1 - self.threshold) / (1 + self.threshold) + 1e-6) + 1
        ends = np.arange(1, parts, dtype=np.uint64) * np.uint64((2**64 - 1) // parts)
        at = np.concatenate(([0], np.searchsorted(items, ends), [len(items)]))
        places = np.arange(parts, dtype=np.uint64) + (np.uint64(k) << np.uint64(32))
        return mixed((sums[at[1:]] - sums[at[:-1]]) ^ mixed(places + _B)).view(np.int64)


def signed(n: int, threshold: float):
    """A function of a batch of texts: set size, and the two kinds of signatures; none for a missing text."""
    kinds = Signatures(threshold)

    def sign(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            items = None if t is None else gram_set(t, n)
            rows.append((0, [], []) if items is None else (len(items), *kinds.of(items)))
        return pd.DataFrame(rows, columns=["m", "own", "next"])

    return sign


def confirmed(n: int, threshold: float):
    """A function of a group's pairs (a, b) and texts (node, t): the pairs over the threshold, with their similarity."""

    def confirm(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        sets = {k: gram_set(t, n) for k, t in zip(texts["node"], texts["t"], strict=True)}
        found = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-6:
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                found.append((a, b, shared / (len(x) + len(y) - shared)))
        out = pd.DataFrame(found, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})
        return out[out["similarity"] > threshold]

    return confirm
