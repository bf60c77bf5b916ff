"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_MEMORY = 150_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _STEP
        return x ^ (x >> np.uint64(32))


class Shingler:
    """sets(texts): each text's distinct shingles of k words, hashed, ascending. A-Z counts as a-z; words are what
    stands between characters of [\\x20\\x09-\\x0D]; fewer than k words are one shingle, no word is none."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode().lower().split() for t in texts]
        missing = set().union(*split).difference(self.known) if split else ()
        digest = xxhash.xxh3_64_intdigest
        self.known.update((w, digest(w) >> 1) for w in missing)
        get = self.known.__getitem__
        out = [self._set(np.array(list(map(get, words)), dtype=np.int64).view(np.uint64)) for words in split]
        if len(self.known) > _MEMORY:
            self.known.clear()
        return out

    def _set(self, words: np.ndarray) -> np.ndarray:
        n = min(self.k, len(words))
        if not n:
            return words
        with np.errstate(over="ignore"):
            h = words[: len(words) - n + 1] + np.uint64(n)
            for i in range(1, n):
                h = h * _STEP + words[i : len(words) - n + 1 + i]
        return np.unique(mix(h))
