"""Words and shingles of whole texts as 64-bit fingerprints, in bulk."""

from __future__ import annotations

import numpy as np
import xxhash

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct word shingles of texts: A-Z in lower case, words parted by ASCII white space."""

    def __init__(self, width: int = 3):
        self.width = width

    def words(self, text: str | None) -> list[bytes]:
        # On bytes, lower() and split() know ASCII only.
        return (text or "").encode("utf-8", "surrogatepass").lower().split()

    def shingles(self, text: str | None) -> np.ndarray:
        """The set as sorted fingerprints; fewer words than the width make one shingle, no words make none."""
        words = self.words(text)
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        width = min(self.width, len(words))
        # The number of words goes in, so a short sequence never equals a longer one's part.
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = mix((out + A) * B ^ h[i : len(h) - width + 1 + i])
        return np.unique(out)
