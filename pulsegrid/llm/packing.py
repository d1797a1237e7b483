"""Operator 10: conflict-constrained best-fit packing.

Items are dealt into shards of bounded size by a hash; a shard's items are placed
longest first. Its open bins stand ordered by residual space, each with a bitmap of the
sources and one of the duplicate clusters it holds. The search starts at the successor
of the item's length and goes on until the tightest bin that holds neither the item's
source nor its cluster is found; if there is none, a new bin opens. Since no bin crosses
shards, no conflict can either.

Bins stand in one list for each set of frequent sources and clusters that they hold, so
that bins which a frequent one rules out are not walked past: an item looks for its
successor in the lists without it, and the tightest of those is its bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.batches import by_key, runs
from pulsegrid.runtime import Scratch

SHARD = 65_536
"""Items in a shard on average."""
FREQUENT = 8
"""Sources and clusters of a shard, its most frequent ones, by which lists of bins are told apart."""


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each item, in the order given; items that share a bin differ in source and in cluster.

    A source or cluster of None conflicts with nothing.
    """
    seen = Counter(("source", s) for s in sources if s is not None) + Counter(("cluster", c) for c in clusters if c is not None)
    repeated = [k for k, n in seen.most_common() if n > 1]
    often = {k: 1 << i for i, k in enumerate(repeated[:FREQUENT])}
    source_bit = {k[1]: 1 << i for i, k in enumerate(k for k in repeated if k[0] == "source")}
    cluster_bit = {k[1]: 1 << i for i, k in enumerate(k for k in repeated if k[0] == "cluster")}
    lists: dict[int, list[tuple[int, int]]] = {}
    source_map: list[int] = []
    cluster_map: list[int] = []
    often_map: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        mask = often.get(("source", source), 0) | often.get(("cluster", cluster), 0)
        best, where = None, (0, 0)
        for held, bins in lists.items():
            if held & mask:
                continue
            at = bisect_left(bins, (length, -1))
            while at < len(bins) and (best is None or bins[at] < best):
                number = bins[at][1]
                if not source_map[number] & s and not cluster_map[number] & c:
                    best, where = bins[at], (held, at)
                    break
                at += 1
        if best:
            room, number = best
            del lists[where[0]][where[1]]
            source_map[number] |= s
            cluster_map[number] |= c
            often_map[number] |= mask
        else:
            room, number = capacity, len(source_map)
            source_map.append(s)
            cluster_map.append(c)
            often_map.append(mask)
        out.append(number)
        if room - length > 0:
            insort(lists.setdefault(often_map[number], []), (room - length, number))
    return out


def pack_batches(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            lengths = group.column("length").to_pylist()
            order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
            sources, clusters = group.column("source").to_pylist(), group.column("cluster").to_pylist()
            placed = best_fit([lengths[i] for i in order], [sources[i] for i in order], [clusters[i] for i in order], capacity)
            bins = [0] * len(lengths)
            for i, number in zip(order, placed, strict=True):
                bins[i] = number
            batch = group.select(["shard", "doc_id", "part", "length"]).append_column("bin", pa.array(bins, pa.int64())).combine_chunks()
            yield from batch.to_batches()

    return run


def pack(spark: SparkSession, items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pack items into bins: one row (doc_id, part, length, shard, bin) for each part of each item.

    ``items`` needs doc_id, length, source and cluster; other columns are ignored. An
    item longer than ``capacity`` is cut into full parts, which fill a bin each, and a
    rest, none dropped; the parts may lie in several shards. A null source or cluster
    conflicts with nothing. A null or negative length counts as 0, and an item of length 0
    gets one part. (shard, bin) names a bin; the sum of its lengths is at most
    ``capacity``. Ties fall to the smaller doc_id; rows of one doc_id, or without one, are
    items of their own. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "packing")
    length = F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).cast("long")
    items = scratch.write(items.select("doc_id", length.alias("length"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster")), "items")
    shards = max(1, -(-items.count() // SHARD))
    last = F.greatest(F.ceil(F.col("length") / capacity), F.lit(1)) - 1
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = parts.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("part") * capacity))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)))
    return by_key(parts, ["shard"], ["doc_id", "part", "source", "cluster"], pack_batches(capacity), "shard long, doc_id long, part long, length long, bin long")
