"""Operator 8: exact duplicates, screened by static binary-fuse filters.

A snapshot of rows already accepted is immutable: its distinct digests are dealt into
buckets of bounded size by hash, with one 8-bit binary-fuse filter for each bucket. An
incoming batch is first grouped by digest on its own; one digest of each of its groups
is screened by the filters, and only positives join the snapshot's exact buckets, where
the texts are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.batches import by_key, runs
from pulsegrid.llm.screen import screened
from pulsegrid.llm.text import U, mix
from pulsegrid.runtime import Scratch

BUCKET_KEYS = 50_000
SPACES = r"[\x20\x09-\x0D]+"


def normalised(column: str):
    """A text with each run of space characters replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), SPACES, " ")


class BinaryFuse:
    """A three-way binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, and the three cells of each key in consecutive segments."""
        h = mix(keys + U(seed) * U(0x9E3779B97F4A7C15))
        first = ((h >> U(32)) * U(count * segment)) >> U(32)
        mask = U(segment - 1)
        second = (first + U(segment)) ^ ((h >> U(18)) & mask)
        third = (first + U(2 * segment)) ^ (h & mask)
        return h, np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def fingerprint(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> U(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        keys = np.unique(keys)
        n = max(len(keys), 2)
        segment = min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        count = max(1, int(np.ceil(n * factor / segment)) - 2)
        for seed in range(1, 1000):
            if seed % 20 == 0:
                count += 1
            h, at = cls.slots(keys, seed, segment, count)
            size = (count + 2) * segment
            degree = np.bincount(at.ravel(), minlength=size)
            owner = np.zeros(size, np.int64)
            for row in at:
                np.bitwise_xor.at(owner, row, np.arange(len(keys)))
            live = np.ones(len(keys), bool)
            layers: list[tuple[np.ndarray, np.ndarray]] = []
            single = np.flatnonzero(degree == 1)
            while len(single):
                single = single[degree[single] == 1]
                taken, where = np.unique(owner[single], return_index=True)
                layers.append((taken, single[where]))
                live[taken] = False
                for row in at[:, taken]:
                    np.subtract.at(degree, row, 1)
                    np.bitwise_xor.at(owner, row, taken)
                touched = np.unique(at[:, taken].ravel())
                single = touched[degree[touched] == 1]
            if not live.any():
                cells = np.zeros(size, np.uint8)
                for taken, cell in reversed(layers):
                    spots = at[:, taken]
                    cells[cell] = 0
                    cells[cell] = cls.fingerprint(h[taken]) ^ cells[spots[0]] ^ cells[spots[1]] ^ cells[spots[2]]
                return cls(seed, segment, count, cells)
        raise RuntimeError("no seed peels the keys")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h, at = self.slots(keys, self.seed, self.segment, self.count)
        return self.fingerprint(h) == self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]


def build_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["bucket"]):
        made = BinaryFuse.build(group.column("key").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in (([group.column("bucket")[0].as_py()], pa.int64()), ([made.seed], pa.int64()), ([made.segment], pa.int64()), ([made.count], pa.int64()), ([made.cells.tobytes()], pa.binary()))],
            names=["bucket", "seed", "segment", "count", "cells"],
        )


def screen_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket follow its filter, the row with cells; those the filter knows pass."""
    made, bucket = None, None
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        cells = batch.column("cells")
        keys = batch.column("key").to_numpy().view(np.uint64)
        keep = np.zeros(batch.num_rows, bool)
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if bucket != buckets[a]:
                made, bucket = None, buckets[a]
            if cells[a].is_valid:
                made = BinaryFuse(*(batch.column(c)[a].as_py() for c in ("seed", "segment", "count")), np.frombuffer(cells[a].as_py(), np.uint8))
                a += 1
            if made is not None and a < b:
                keep[a:b] = made.contains(keys[a:b])
        yield batch.filter(pa.array(keep)).select(["digest"])


class Snapshot:
    """Distinct digests of accepted rows, in exact buckets with a filter each."""

    def __init__(self, scratch: Scratch, keys: DataFrame):
        groups = keys.groupBy("digest").agg(F.min("doc_id").alias("s_id"), F.count("*").alias("s_size"))
        self.groups = scratch.write(groups, "snapshot")
        self.buckets = max(1, -(-self.groups.count() // BUCKET_KEYS))
        dealt = self.groups.select(self.bucket(), F.xxhash64("digest", F.lit(2)).alias("key"))
        built = by_key(dealt, ["bucket"], [], build_batches, "bucket long, seed long, segment long, count long, cells binary", self.buckets)
        self.filters = scratch.write(built, "filters")

    def bucket(self):
        return F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(self.buckets)).alias("bucket")

    def screen(self, groups: DataFrame) -> DataFrame:
        """The digests that may be in the snapshot."""
        rows = groups.select(self.bucket(), F.xxhash64("digest", F.lit(2)).alias("key"), "digest", *(F.lit(None).cast("long").alias(c) for c in ("seed", "segment", "count")), F.lit(None).cast("binary").alias("cells"), F.lit(1).alias("turn"))
        made = self.filters.select("bucket", F.lit(0).cast("long").alias("key"), F.lit(None).cast("binary").alias("digest"), "seed", "segment", "count", "cells", F.lit(0).alias("turn"))
        return by_key(made.union(rows), ["bucket"], ["turn"], screen_batches, "digest binary", self.buckets)


def exact_duplicates(spark: SparkSession, docs: DataFrame, snapshot_upto: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and text_hash, the xxhash64 of its text.

    Texts are equal when identical after runs of space characters become one space; a
    null text counts as empty. Of equal texts the row with the smallest doc_id stays.
    Rows with a doc_id of at most ``snapshot_upto`` form the snapshot and the others
    the incoming batch; by default the middle of the id range divides them, and the
    result is the same for any value. Only doc_id and text are read. Rows of one doc_id
    are rows of their own, which stay or go together where their texts are equal. A row
    without doc_id counts in its group and stays only if no row of the group has one; the
    group's keep_id is null then. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "exact")
    docs = docs.select("doc_id", "text")
    keys = scratch.write(docs.select("doc_id", F.unhex(F.sha2(normalised("text"), 256)).alias("digest"), F.xxhash64("text").alias("text_hash")), "keys")
    if snapshot_upto is None:
        lo, hi = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
        snapshot_upto = 0 if lo is None else lo + (hi - lo) // 2
    old = F.col("doc_id") <= snapshot_upto
    snapshot = Snapshot(scratch, keys.filter(old))
    fresh = scratch.write(keys.filter(~old | F.col("doc_id").isNull()).groupBy("digest").agg(F.min("doc_id").alias("n_id"), F.count("*").alias("n_size")), "incoming")
    positive = snapshot.screen(fresh)
    pairs = scratch.write(positive.join(snapshot.groups, "digest").join(fresh, "digest"), "positives")
    wanted = pairs.select("digest", F.col("s_id").alias("id")).union(pairs.select("digest", "n_id")).distinct()
    maybe, _ = screened(docs, (F.col("doc_id"),), wanted, (F.col("id"),))
    texts = maybe.select("doc_id", normalised("text").alias("t")).withColumn("hash", F.unhex(F.sha2("t", 256)))
    texts = texts.join(wanted, (F.col("hash") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").groupBy("hash", "doc_id").agg(F.first("t").alias("t"))
    texts = scratch.write(texts, "texts")
    of = lambda c: texts.select(F.col("hash").alias("digest"), F.col("doc_id").alias(c), F.col("t").alias(f"{c}_text"))
    s_side, n_side = of("s_id"), of("n_id")
    both = pairs.join(s_side.withColumnsRenamed({"s_id": "s"}), "digest").filter("s_id = s").join(n_side.withColumnsRenamed({"n_id": "n"}), "digest").filter("n_id <=> n")
    equal = both.filter("n_id_text = s_id_text").select("digest", F.lit(True).alias("equal"))
    groups = snapshot.groups.join(fresh, "digest", "full").join(equal, "digest", "left")
    groups = scratch.write(groups, "groups")
    scratch.drop(texts, pairs)
    found = keys.join(groups, "digest")
    mine = F.when(F.col("equal"), F.col("s_id")).when(old, F.col("s_id")).otherwise(F.col("n_id"))
    size = F.when(F.col("equal"), F.col("s_size") + F.col("n_size")).when(old, F.col("s_size")).otherwise(F.col("n_size"))
    return found.select("doc_id", mine.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(mine).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "text_hash")
