"""Sets of word shingles as sorted arrays of 64-bit hashes.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z count
as a-z. A text with fewer than `size` words has its whole word sequence as its one shingle, a text without words none.
"""

from __future__ import annotations

import numpy as np

from webloom.llm.batches import chunks, concatenated, mix, powers, word_hashes

SIZE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def hashed_shingles(raw: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending within a text, and their offsets per text."""
    found, offsets = [np.empty(0, np.uint64)], [0]
    for first, last in chunks(raw):
        buffer, begin = concatenated(raw[first:last])
        buffer = _LOWER[buffer]
        starts, _, words = word_hashes(buffer, ~_SPACE[buffer])
        # A power of an odd number per place in the shingle, so that order counts.
        place = powers(0xD6E8FEB86659FD93, size + 1)
        n = max(0, len(words) - size + 1)
        full = np.full(n, np.uint64(size))
        for k in range(size):
            full += words[k : k + n] * place[k + 1]
        full = mix(full)
        bounds = np.searchsorted(starts, begin)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                own = np.unique(full[a : b - size + 1])
            elif b > a:
                own = mix(np.array([b - a + (words[a:b] * place[1 : b - a + 1]).sum(dtype=np.uint64)], np.uint64))
            else:
                own = full[:0]
            found.append(own)
            offsets.append(offsets[-1] + len(own))
    return np.concatenate(found), np.array(offsets, np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
