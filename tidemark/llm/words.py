"""Words and word shingles of texts, as numpy arrays; used inside Arrow functions."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
K = 5  # words in a shingle
_MULT = np.uint64(0x9E3779B97F4A7C15)


MOST_IDS = 100_000  # a worker keeps them from task to task, some 170 bytes each


class WordIds(dict):
    """64-bit ids of words, remembered; emptied when it holds more than MOST_IDS words."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_IDS:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


IDS = WordIds()


def word_ids(text: str | None) -> np.ndarray:
    """Ids of the words of a text: runs of letters and digits, compared without case."""
    words = WORD.findall(text.casefold()) if text else ()
    return np.fromiter(map(IDS.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of k words, one per start position."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _MULT + ids[j : j + n]
    return mix(h)


def common_words(a: np.ndarray, a_times: np.ndarray, b: np.ndarray, b_times: np.ndarray) -> int:
    """Words two texts have in common, wherever they stand; a and b are their distinct ids in order."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(a_times[i], b_times[j]).sum())


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Word edit distance (insert, delete, replace) of a and b if it is at most limit, else None.

    Furthest-reaching diagonals: work grows with the square of the distance, not with the lengths' product.
    """
    if limit < 0 or abs(len(a) - len(b)) > limit:
        return None
    x, y = a.tolist(), b.tolist()
    n, m = len(x), len(y)

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and x[i] == y[i + d]:
            i += 1
        return i

    reach = {0: slide(0, 0)}
    goal = m - n
    for e in range(limit + 1):
        if reach.get(goal, -1) >= n:
            return e
        nxt = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
            if 0 <= i and i <= n and i + d <= m and i + d >= 0:
                nxt[d] = slide(i, d)
            elif i > n and 0 <= n + d <= m:
                nxt[d] = n
            elif i + d > m and 0 <= m - d <= n:
                nxt[d] = m - d
        reach = nxt
    return None
