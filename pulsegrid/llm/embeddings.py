"""Operator 3: near-duplicate embeddings by sorted projection passes.

In each pass a vector gets the signs of random projections, concatenated into one key;
vectors of a label are sorted by that key and compared with a bounded window of
neighbours, those that share its first bits: as many bits as keep the window within
``RUN`` vectors. How many that takes is measured for each label, so crowded labels use
longer prefixes and more passes, and vectors of one prefix are dealt to one task, so no
window is cut. Passes carry 16-bit copies of the vectors with a bound of their error;
pairs that this leaves open are verified on the vectors themselves. The pairs of all
passes are united into components. The window bounds only what the passes compare: links
are then counted exactly, by comparing all members of a component in blocks, so a group
larger than the window loses none.

A pair at the threshold shares the prefix in no pass with a chance below ``MISS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.batches import by_key, groups_of, runs
from pulsegrid.llm.graph import components, united
from pulsegrid.runtime import Scratch

RUN = 512
MISS = 1e-7
BITS = 62
BLOCK = 1024
CLOSE = 1e-9
"""Products of matrices this near to the threshold are computed again pair by pair."""


def agreement(cosine: float) -> float:
    """The chance that a projection has the same sign for two vectors at ``cosine``."""
    return 1 - math.acos(cosine) / math.pi


@lru_cache(64)
def planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([20240301, number, dim]).standard_normal((dim, BITS))


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of one with the same row of the other."""
    return np.einsum("ij,ij->i", x, y)


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of one link with which of the other; the same as ``cosines`` says of each pair."""
    product = x @ y.T
    near = product >= cosine
    a, b = np.nonzero(np.abs(product - cosine) < CLOSE)
    near[a, b] = cosines(x[a], y[b]) >= cosine
    return near


def vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as doubles with a digest; dim is 0 for the others."""
    for batch in batches:
        labels = batch.column("label").to_pylist()
        dims, raw, digests = [], [], []
        for value, label in zip(batch.column("embedding"), labels, strict=True):
            x = None
            if value.is_valid and label is not None and value.values.null_count == 0 and len(value.values):
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                norm = np.sqrt((x * x).sum())
                if not np.isfinite(norm) or norm == 0:
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(x).all() and top > 0 else None
            dims.append(0 if x is None else len(x))
            raw.append(b"" if x is None else x.tobytes())
            digests.append(hashlib.blake2b(raw[-1], digest_size=16).digest())
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "d1", "d2", "vec"])


def keys_of(x: np.ndarray, number: int) -> np.ndarray:
    return ((x @ planes(number, x.shape[1]) > 0) * (1 << np.arange(BITS - 1, -1, -1))).sum(1)


def first_key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of pass 0, to measure how crowded they are."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows = batch.filter(pa.array(dims == dim))
            x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("dim"), pa.array(keys_of(x, 0))], names=["label", "dim", "key"])


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and pass of its label: key, its first bits, and the unit vector in 16 bits a number with its scale."""
    for batch in batches:
        dims, passes = batch.column("dim").to_numpy(), batch.column("passes").to_numpy()
        for dim in np.unique(dims):
            for number in range(int(passes[dims == dim].max())):
                rows = batch.filter(pa.array((dims == dim) & (passes > number)))
                x = unit_rows(rows.column("vec").to_pylist())
                key = keys_of(x, number)
                scale = np.abs(x).max(1) / 32767
                small = np.rint(x / scale[:, None]).astype(np.int16)
                prefix = key >> (BITS - rows.column("bits").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), number)), rows.column("label"), rows.column("dim"), pa.array(prefix), pa.array(key), rows.column("vec_id"), pa.array(scale), pa.array([r.tobytes() for r in small], pa.binary())], names=["pass", "label", "dim", "prefix", "key", "vec_id", "scale", "small"])


def windows(keys: np.ndarray, bits: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of sorted keys to compare in full: of one prefix, longer where more than RUN share it.

    Where more than RUN keys are equal, spans of RUN that overlap by half.
    """
    if len(keys) <= RUN:
        yield 0, len(keys)
    elif bits >= BITS:
        for at in range(0, len(keys) - RUN // 2, RUN // 2):
            yield at, min(at + RUN, len(keys))
    else:
        cut = int(np.searchsorted(keys, ((int(keys[0]) >> (BITS - bits - 1)) + 1) << (BITS - bits - 1)))
        for lo, hi in ((0, cut), (cut, len(keys))):
            if lo < hi:
                yield from ((lo + a, lo + b) for a, b in windows(keys[lo:hi], bits + 1))


def window_batches(cosine: float):
    """Links between neighbours: those that are sure, as a star for each group in a window, and open ones with sure false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["pass", "label", "dim", "prefix"]):
            group = [table.column(c).to_numpy() for c in ("pass", "label", "dim", "prefix")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in group], axis=0)) + 1
            ids, keys, scale, raw = (table.column(c).to_numpy() for c in ("vec_id", "key", "scale", "small"))
            us, vs, sure = [], [], []
            cuts = [0, *change.tolist(), table.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                for a, b in windows(keys[lo:hi]):
                    if b - a < 2:
                        continue
                    own = ids[lo + a : lo + b]
                    x = np.frombuffer(b"".join(raw[lo + a : lo + b]), np.int16).reshape(b - a, -1).astype(np.float64) * scale[lo + a : lo + b, None]
                    error = 1e-9 + (math.sqrt(x.shape[1]) + 1) / 32767
                    product = np.triu(x @ x.T, 1)
                    u, v = np.nonzero(product >= cosine - error)
                    safe = product[u, v] >= cosine + error
                    low = united(u[safe], v[safe], len(own))
                    tied = np.flatnonzero(low != np.arange(len(own)))
                    open_ = ~safe & (low[u] != low[v])
                    us += [own[tied], own[u[open_]]]
                    vs += [own[low[tied]], own[v[open_]]]
                    sure += [np.ones(len(tied), bool), np.zeros(int(open_.sum()), bool)]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, sure)], names=["u", "v", "sure"])

    return run


def verified_batches(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = cosines(*(unit_rows(batch.column(c).to_pylist()) for c in ("vu", "vv"))) >= cosine
                yield batch.select(["u", "v"]).filter(pa.array(good))

    return run


def count_batches(cosine: float):
    """Links of each member of a block with the members of the paired block, weighted by how many copies they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["root", "a", "b"]):
            a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
            block, ids, copies = (group.column(c).to_numpy() for c in ("block", "vec_id", "copies"))
            x = unit_rows(group.column("vec").to_pylist())
            left = np.flatnonzero(block == a)
            right = left if a == b else np.flatnonzero(block == b)
            near = linked(x[left], x[right], cosine)
            if a == b:
                np.fill_diagonal(near, False)
                rows, links = left, near @ copies[right]
            else:
                rows, links = np.concatenate([left, right]), np.concatenate([near @ copies[right], copies[left] @ near])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(links.astype(np.int64))], names=["vec_id", "links"])

    return run


def near_embeddings(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` needs vec_id, embedding (an array of numbers) and label; other columns
    are ignored. Vectors link when their labels are equal and not null, their lengths
    are equal and their cosine in double precision is at least ``cosine``. A vector that
    is null, empty, zero or holds a null or non-finite component links with nothing:
    it has 0 links and is its own component. Equal vectors count as links of each other.
    An empty table gives an empty result.
    """
    scratch = Scratch(spark, "embeddings")
    all_ = scratch.write(vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(vector_batches, "vec_id long, label long, dim long, d1 long, d2 long, vec binary"), "vectors")
    same = ["label", "dim", "d1", "d2"]
    classes = all_.filter("dim > 0").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    members = scratch.write(all_.select("vec_id", *same).join(classes, same, "left").select("vec_id", "label", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"), (F.col("dim") > 0).alias("usable")), "members")
    reps = members.filter("usable and vec_id = rep").select("vec_id", "copies").dropDuplicates(["vec_id"])
    reps = scratch.write(all_.drop("d1", "d2").filter("dim > 0").dropDuplicates(["vec_id"]).join(reps, "vec_id"), "reps")
    found = members.select("vec_id", "rep", "copies")
    first = scratch.write(reps.select("label", "dim", "vec").mapInArrow(first_key_batches, "label long, dim long, key long"), "first")
    longest = F.explode(F.sequence(F.lit(0), F.lit(BITS), F.lit(2)))
    crowds = first.withColumn("bits", longest).groupBy("label", "dim", "bits", F.expr(f"shiftright(key, {BITS} - bits)").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    crowds = crowds.groupBy("label", "dim", "bits").agg(F.max("n").alias("n"))
    bits = crowds.groupBy("label", "dim").agg(F.coalesce(F.min(F.when(F.col("n") <= RUN, F.col("bits"))), F.lit(BITS)).cast("long").alias("bits"))
    number = F.ceil(F.lit(math.log(MISS)) / F.log1p(-F.pow(F.lit(agreement(cosine)), F.col("bits"))))
    bits = bits.withColumn("passes", F.when(F.col("bits") == 0, 1).otherwise(number).cast("long"))
    keyed = reps.select("vec_id", "label", "dim", "vec").join(bits, ["label", "dim"]).mapInArrow(key_batches, "pass long, label long, dim long, prefix long, key long, vec_id long, scale double, small binary")
    order = ["pass", "label", "dim", "prefix"]
    pairs = by_key(keyed, order, ["key", "vec_id"], window_batches(cosine), "u long, v long, sure boolean").distinct()
    pairs = scratch.write(pairs, "pairs")
    of = lambda c: reps.select(F.col("vec_id").alias(c), F.col("vec").alias(f"v{c}"))
    open_ = pairs.filter("not sure").join(of("u"), "u").join(of("v"), "v").select("u", "v", "vu", "vv").mapInArrow(verified_batches(cosine), "u long, v long")
    roots = scratch.write(components(scratch, pairs.filter("sure").select("u", "v").union(open_)), "roots")
    scratch.drop(first, pairs)
    blocks = roots.groupBy("root").count().select("root", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    dealt = reps.join(roots, reps.vec_id == roots.node).join(blocks, "root")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "vec_id", "copies", "vec")
    counts = by_key(dealt, ["root", "a", "b"], [], count_batches(cosine), "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("links"))
    per = roots.select(F.col("node").alias("rep"), "root").join(counts.select(F.col("vec_id").alias("rep"), "links"), "rep", "left")
    per = scratch.write(per, "links")
    out = found.join(per, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
