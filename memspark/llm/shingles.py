"""Hashes of the word shingles of a text, for all near-duplicate operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash

SEED = 42
_CHUNK = 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, a part of the text at a time."""
    text, start, kept, any_ = text.lower(), 0, [], False
    while start < len(text):
        end = start + _CHUNK
        if end < len(text):
            end = m.start() if (m := _SPACE.search(text, end)) else len(text)
        words = kept + text[start:end].split()
        start = end
        if len(words) < shingle:
            kept = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
        parts = map(joined.__getitem__, map(slice, starts.tolist(), ends[shingle - 1 :].tolist()))
        yield np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(starts))
        kept, any_ = words[-(shingle - 1) :], True
    if kept and not any_:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
