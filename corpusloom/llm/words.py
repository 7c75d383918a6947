"""Words and five-word shingles as 64-bit hashes, for the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from corpusloom.llm.common import Kept, values_of

_PRIME = np.uint64(0x100000001B3 * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Word hashes are kept from document to document."""

    def __init__(self, words: int = 5, most: int = 150_000):
        self.words, self.known = words, Kept(most)

    def word_hashes(self, text: bytes) -> np.ndarray:
        """One hash for each run without [\\x20\\x09-\\x0D], A-Z lower-cased."""
        found = text.lower().split()
        fresh = self.known.missing(set(found))
        self.known.now.update({w: xxhash.xxh64_intdigest(w) for w in fresh})
        return np.fromiter(map(self.known.now.__getitem__, found), np.uint64, len(found))

    def words_of(self, texts: pa.Array) -> list[np.ndarray]:
        """word_hashes of each text of a string array; Arrow numbers the distinct words, only those are hashed."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        numbered = split.flatten().dictionary_encode()
        found = values_of(numbered.dictionary)
        table = np.fromiter(self.known.fetch(found, lambda fresh: [*map(xxhash.xxh64_intdigest, fresh)]), np.uint64, len(found))
        which = numbered.indices.to_numpy()
        word = np.fromiter((w != b"" for w in found), bool, len(found))[which]  # white space at an end leaves an empty string
        at = np.concatenate(([0], np.cumsum(word)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        hashes = table[which[word]]
        return [hashes[a:b] for a, b in zip(at, at[1:], strict=False)]

    def shingles(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and how often each stands; a text of fewer words is one shingle, without words none."""
        return self.shingles_of(self.word_hashes(text))

    def shingles_of(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """shingles of a text's word hashes."""
        if not len(w):
            return w, np.zeros(0)
        size = min(self.words, len(w))
        n = len(w) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * _PRIME + w[k : k + n]
        found, counts = np.unique(mix(h), return_counts=True)
        return found, counts.astype(float)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater weights; 0 where either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    return least / (float(a[1].sum() + b[1].sum()) - least)
