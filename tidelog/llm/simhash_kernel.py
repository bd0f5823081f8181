"""Fingerprint kernel of the SimHash operator: plain numpy, one text at a time."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash

SEED = 42
#: Set bits of each byte value, one row per value.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LANES = np.arange(8) * 256


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 of every ``width``-word shingle, repeats included.

    A-Z are lower-cased and words are runs without ASCII white space; a text of fewer words gives one
    shingle, its whole word sequence, and a text without words gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))  # of each word, joined by spaces
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """A 64-bit SimHash as a signed integer: a bit is 1 if it is set in over half the shingle hashes."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8) + LANES  # how often each byte value occurs in each of the 8 bytes
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view(np.int64)[0])
