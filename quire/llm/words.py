"""Tokens of a whole Arrow batch at once, as numpy arrays: places and 64-bit hashes, no Python object per token."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE, WORD, MARK = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Kinds of bytes: ASCII white space alone ends a word.
BLANKS = np.full(256, WORD, np.uint8)
BLANKS[[9, 10, 11, 12, 13, 32]] = SPACE
#: Kinds of bytes: runs of letters, digits and non-ASCII characters, and runs of other characters.
RUNS = np.full(256, MARK, np.uint8)
RUNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORD
RUNS[[9, 10, 11, 12, 13, 32]] = SPACE

ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Tokens of more bytes are hashed one by one.
LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Tokens:
    """Tokens of all texts in order. ``start`` and ``end`` are byte places in ``data``; text k has tokens bounds[k]..bounds[k+1],
    and its bytes begin at offsets[k]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each token's bytes: eight bytes a round, tokens that are at their end drop out."""
        return hashed(self.data, self.start, self.end)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    h = mix(size.astype(np.uint64) * ONE + TWO)
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(held[:8].view(np.uint64), (len(data) + 1,), (1,))
    live = np.flatnonzero(size <= LONG)
    k = 0
    while len(live):
        left = size[live] - k
        word = eights[start[live] + k]
        short = left < 8
        word[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix((h[live] ^ word) * ONE + TWO)
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def tokenize(texts: pa.Array, kinds: np.ndarray, lower: bool = True) -> Tokens:
    """``texts``: a string array without nulls. Tokens are the longest runs of bytes of one kind but SPACE; none spans two texts."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held and len(offsets) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    if lower:
        data = LOWER[data]
    kind = kinds[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    places = np.flatnonzero(edge)
    start, end = places[:-1], places[1:]
    kept = kind[start] != SPACE
    start, end = start[kept], end[kept]
    return Tokens(data, offsets, start, end, np.searchsorted(start, offsets))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; 0 where there are none."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some])
    return out


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> list[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes together, so that a batch of long texts needs no more memory."""
    sizes = np.diff(np.frombuffer(batch.column("text").cast(pa.large_string()).buffers()[1], np.int64)[: batch.num_rows + 1]) if batch.num_rows else []
    out, first, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > most:
            out.append(batch.slice(first, k - first))
            first, total = k, 0
        total += n
    if first < batch.num_rows:
        out.append(batch.slice(first))
    return out
