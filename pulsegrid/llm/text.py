"""Vectorised word hashing over Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, in UTF-8. A word's
hash is a polynomial over random per-byte values modulo 2^64, passed through a
64-bit finaliser; two different words of ordinary length share a hash with
probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = TABLE.copy()
LOWER[65:91] = TABLE[97:123]
SLOTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", BASE), ("down", BASE_INV)):
            steps = np.full(size, U(base))
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most ``limit`` bytes of text, or one longer text: first row, last row, bytes, offsets."""
    col = batch.column(column)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = pc.fill_null(col, "")
    if len(col) == 0:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, len(col))
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """The words of a chunk of texts: byte spans, document of each, and hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        n = len(data)
        self.data, self.offs, self.docs = data, offs, len(offs) - 1
        if n == 0:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(self.docs + 1, np.int64)
            return
        inside = WORD_BYTE[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[offs[:-1][offs[:-1] < n]] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offs, "left")
        self.hash = spans(data, self.start, self.end, LOWER if lower else TABLE)

    def shingles(self, k: int) -> Iterator[np.ndarray]:
        """For each document the sorted distinct hashes of its k-word shingles; shorter ones give their whole sequence."""
        n = len(self.hash)
        if n >= k:
            rolled = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                rolled += self.hash[j : n - k + 1 + j] * SLOTS[j]
            rolled = mix(rolled)
        for d in range(self.docs):
            a, b = self.first[d], self.first[d + 1]
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                yield mix((self.hash[a:b] * SLOTS[: b - a]).sum(keepdims=True) + SLOTS[k + b - a : k + b - a + 1])
            else:
                yield np.zeros(0, np.uint64)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """A hash of each byte span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> array from uint64 arrays."""
    offs = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offs[1:])
    flat = signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
