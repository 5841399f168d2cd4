"""Hashes of the character n-grams of a text, piece by piece so that any length fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_K = np.uint64(0x9E3779B97F4A7C15)
#: Characters hashed at once.
PIECE = 1 << 18


def gram_hashes(text: str, orders: Sequence[int]) -> Iterator[np.ndarray]:
    """64-bit hashes of each order's n-grams (with repeats) of the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    top = max(orders)
    for at in range(0, max(1, len(codes)), PIECE):
        x = codes[at : at + PIECE + top - 1].astype(np.uint64) + np.uint64(1)
        own = min(PIECE, len(codes) - at)
        h = x * _K
        for n in range(1, top + 1):
            if n > 1:
                if len(x) < n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[n - 1 :] * _K
            if n in orders:
                g = (h[:own] + np.uint64(n)) * np.uint64(0x94D049BB133111EB)
                yield g ^ (g >> np.uint64(32))
