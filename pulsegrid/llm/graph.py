"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.runtime import Scratch


FEW = 100_000
"""Links that one task unites in memory; more are united by star steps over all tasks."""


def united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row reachable from each of ``n`` rows by the links a-b."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def unite_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = united(at[: len(u)], at[len(u) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], names=["node", "root"])


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (u, v); root is the smallest node reachable.

    Up to ``FEW`` links are united by one task. For more, large-star and small-star
    steps alternate until the link table stops changing. Minima are aggregated before the shuffle and joined back, so a node with very
    many links is split by the adaptive skew join instead of meeting in one task.
    """
    hi, lo = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = scratch.write(links.filter("u <> v").select(hi, lo).distinct(), "edges")
    if edges.count() <= FEW:
        return scratch.write(edges.coalesce(1).mapInArrow(unite_batches, "node long, root long"), "roots")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if seen == before or seen[0] == 0:
            break
        before = seen
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
