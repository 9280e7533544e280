"""Hashed byte n-grams of words, over many texts at a time."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slabs, text_bytes

_GAP = 32


def _letters() -> np.ndarray:
    """Digits, a-z and every byte of a non-ASCII character stay; all else is a gap between words."""
    table = np.full(256, _GAP, np.uint8)
    for low, high in ((48, 58), (97, 123), (128, 256)):
        table[low:high] = np.arange(low, high)
    return table


def word_ngrams(texts: pa.Array, sizes: tuple[int, ...], buckets: int) -> Iterator[list[np.ndarray]]:
    """For each text, one array per size of the buckets (1 to ``buckets`` - 1) of its n-grams, in order; 0 is no n-gram.

    Texts are lower-cased. An n-gram lies within a word and the gaps on either side of it, so it may begin or end with a gap but
    holds none inside. ``buckets`` is a power of two.
    """
    data, offsets = text_bytes(pc.utf8_lower(texts))
    table, mask = _letters(), np.uint32(buckets - 1)
    for begin, end in slabs(offsets):
        part = offsets[begin:end + 1] - offsets[begin]
        # A gap before each text and at the end
        chars = np.append(np.insert(table[data[offsets[begin]:offsets[end]]], part[:-1], _GAP), np.uint8(_GAP))
        places = part + np.arange(len(part))
        gap = chars == _GAP
        wide = chars.astype(np.uint32)
        found = []
        for size in sizes:
            count = len(chars) - size + 1
            if count <= 0:
                found.append(np.zeros(len(chars), np.uint32))
                continue
            value = np.full(count, size, np.uint32)
            inside = np.zeros(count, bool)
            for j in range(size):
                value *= np.uint32(0x01000193)
                value ^= wide[j:j + count]
                if 0 < j < size - 1:
                    inside |= gap[j:j + count]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            value ^= value >> np.uint32(13)
            value &= mask
            np.maximum(value, 1, out=value)
            value[inside] = 0
            if size == 2:
                value[gap[:count] & gap[1:count + 1]] = 0
            found.append(np.concatenate([value, np.zeros(size - 1, np.uint32)]))
        for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
            yield [values[a:b] for values in found]
