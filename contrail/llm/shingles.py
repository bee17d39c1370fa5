"""Distinct word shingles as 64-bit hashes, shared by the near-duplicate operators.

Two different shingles of a document agree in their 64-bit hashes with odds of about 1 in 10^11 for 20,000 words.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return text.encode().lower().split()


def shingles(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Each text's shingle hashes in order, repeats included. Fewer words than width: one shingle; none: none."""
    split = [words(t) for t in texts]
    flat = list(chain.from_iterable(split))
    hashed = pd.util.hash_array(np.array(flat, object), categorize=False) if flat else np.zeros(0, np.uint64)
    full = max(0, len(hashed) - width + 1)
    every = np.full(full, width, np.uint64)
    for i in range(width):
        every = every * _FACTOR + hashed[i : i + full]
    every = mix64(every)  # of all positions, also across documents
    out, at = [], 0
    for doc in split:
        n = len(doc)
        if n >= width:
            out.append(every[at : at + n - width + 1])
        else:
            h = np.full(min(n, 1), n, np.uint64)
            for w in hashed[at : at + n]:
                h = h * _FACTOR + w
            out.append(mix64(h))
        at += n
    return out
