"""Groups of sorted Arrow batches, one at a time and without a JVM call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal non-null integer ``keys``, as a table; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def by_key(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """Deal ``df`` by ``keys``, sort by keys and ``order``, and map its batches."""
    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys``: many short runs at a time, or one that is longer than the limits."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    last: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        at = 0
        each = batch.nbytes / batch.num_rows
        for cut in np.flatnonzero(change).tolist():
            if n + cut - at >= rows or held_bytes + (cut - at) * each >= size:
                yield pa.Table.from_batches([*held, batch.slice(at, cut - at)]).combine_chunks()
                held, n, held_bytes, at = [], 0, 0, cut
        held.append(batch.slice(at))
        n, held_bytes = n + batch.num_rows - at, held_bytes + (batch.num_rows - at) * each
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
