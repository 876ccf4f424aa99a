"""Word hashes and shingle sets of texts, computed in batches inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd 64-bit factors, one per word of a shingle, and the two of the 64-bit finalizer.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
FINAL = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
KEPT_WORDS = 500_000


class WordHashes(dict):
    """64-bit hashes of words, computed once per word while it stays in memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * FINAL[0]
    x = (x ^ (x >> np.uint64(33))) * FINAL[1]
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z in lower case; null text has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; fewer words make one shingle, none an empty set."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mixed((hashes * FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = hashes[:n - width + 1] * FACTORS[0]
    for k in range(1, width):
        total = total + hashes[k:n - width + 1 + k] * FACTORS[k]
    return np.unique(mixed(total + np.uint64(width)))


def set_key(values: np.ndarray) -> int:
    """A 64-bit key of a set, as a signed number."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), seed=len(values)))))
