"""Operator 1: near-duplicate documents by HyperMinHash sketches.

A document's shingles are dealt over 128 buckets by the top hash bits; each bucket
keeps its smallest remainder as a 16-bit register, 6 bits of leading-zero count and
10 bits of mantissa. Five registers make a band, and equal bands propose pairs. A
collision-corrected estimate from the registers drops most false proposals, and the
rest are confirmed on the full shingle sets.

Equal sets are collapsed first, so a group of copies counts as one member. The members
of a band's group are compared by their registers inside one task, in groups of at most
``BLOCK`` or of short sets that come to ``SHINGLES``; a task hands on only the members that have a likely partner, never pairs. Those
are compared once more beside their shingle sets, and a task returns links that join
components, less than one for each member. A larger group is first compared with its
smallest member, which is linear; those in one component with the most of the group then
need no comparison among themselves, and the rest are dealt in pairs of blocks, so that
every two members of different components meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.batches import groups_of
from pulsegrid.llm.graph import components
from pulsegrid.llm.screen import screened
from pulsegrid.llm.text import U, Words, chunks, long_lists, mix
from pulsegrid.runtime import Scratch

BUCKET_BITS = 7
MANTISSA = 10
BUCKETS = 1 << BUCKET_BITS
BAND, MISS = 5, 8e-6
"""Registers in a band, and the chance that a pair at the threshold shares no band."""
BLOCK, SHINGLES = 1024, 1 << 22
"""Members, and shingles of theirs, compared in one task at a time, or in pairs of blocks of about as many."""
ERRORS = 4.44
"""Pairs estimated more than this many standard errors of the registers below the threshold are dropped."""


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row of BUCKETS uint16 per sorted set; 0 is an empty bucket."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    sizes = np.array([len(x) for x in sets], np.int64)
    if sizes.sum() == 0:
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = (flat >> U(64 - BUCKET_BITS)).astype(np.int64)
    cell = row * BUCKETS + bucket
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    rest = flat[first] << U(BUCKET_BITS)
    zeros = 53 - np.frexp((rest >> U(11)).astype(np.float64))[1]
    zeros = np.minimum(zeros, 61)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA)
    out.reshape(-1)[cell[first]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def bands_needed(percent: int) -> int:
    """Bands after which a pair of ``percent`` similarity shares one with probability 1 - MISS."""
    return int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** BAND)))) if percent < 100 else 1


def band_registers(number: int) -> np.ndarray:
    """The registers of each band, from permutations in turn, so that every register is in as many bands as another."""
    rng = np.random.default_rng(20240302)
    whole = BUCKETS // BAND
    drawn = [rng.permutation(BUCKETS)[: whole * BAND].reshape(whole, BAND) for _ in range(-(-number // whole))]
    return np.concatenate(drawn)[:number]


def bands(regs: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each row and band, and whether the band holds a shingle."""
    chosen = band_registers(number)
    keys = np.zeros((len(regs), number), np.uint64) + mix(np.arange(1, number + 1, dtype=np.uint64))
    for i in range(BAND):
        keys = mix(keys + regs[:, chosen[:, i]])
    return keys, (regs[:, chosen] != 0).any(2)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal ones among the registers that either row uses."""
    return ((a == b) & (a != 0)).sum(1) / np.maximum(((a | b) != 0).sum(1), 1)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less the matches that different shingles are expected to make."""
    same = ((a == b) & (a != 0)).sum(1)
    used = ((a != 0) | (b != 0)).sum(1)
    z = np.arange(0, 40)
    fa, fb = (-np.expm1(-np.maximum(n, 1)[:, None] / BUCKETS * 2.0 ** -z) for n in (na, nb))
    pa_, pb_ = (f[:, :-1] - f[:, 1:] for f in (fa, fb))
    chance = (pa_ * pb_).sum(1) / 2.0**MANTISSA
    expected = np.minimum(chance * BUCKETS, np.maximum(used - same, 0) * 2.0**-MANTISSA)
    return (same - expected) / np.maximum(used, 1)


def rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Registers of a binary column, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch_batches(k: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offs in chunks(batch, "text"):
                sets = list(Words(data, offs, lower=True).shingles(k))
                regs = registers(sets)
                keys, held = bands(regs, number)
                digest = np.frombuffer(b"".join(map(digest_of, sets)), np.int64).reshape(-1, 2)
                columns = [batch.column(c).slice(at, to - at) for c in ("uid", "doc_id", "text_hash")]
                columns += [pa.array([len(x) for x in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary()), long_lists([x[h] for x, h in zip(keys, held, strict=True)])]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "text_hash", "n", "d1", "d2", "regs", "bands"])

    return run


def set_batches(k: int):
    """Digest and shingles of each text; of equal sets in a task one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, data, offs in chunks(batch, "text"):
                fresh = []
                for x in Words(data, offs, lower=True).shingles(k):
                    if (key := digest_of(x)) not in seen:
                        seen.add(key)
                        fresh.append((key, x))
                digest = np.frombuffer(b"".join(f[0] for f in fresh), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), long_lists([f[1] for f in fresh])], names=["d1", "d2", "shingles"])

    return run


class Block:
    """Members of one or more groups, in order of group, and what a comparison needs of them."""

    def __init__(self, table: pa.Table, percent: int, number: int):
        self.rep, self.n, self.label, self.side = (table.column(c).to_numpy() for c in ("rep", "n", "label", "side"))
        keys = [table.column(c).to_numpy() for c in ("b", "i", "j")]
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(self.rep)]])
        self.end = np.repeat(starts[1:], np.diff(starts))
        self.b, self.across = keys[0], keys[1] != keys[2]
        self.regs = rows_of(table.column("regs"))
        self.keys, self.held = bands(self.regs, number)
        self.percent = percent
        self.least = percent / 100 - ERRORS * (percent * (100 - percent) / BUCKETS) ** 0.5 / 100

    def likely(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of a group that may link: of unlike labels and fit sizes, likely by their registers.

        A pair comes up in the first band only that it shares, and in the pair of blocks of its sides.
        """
        for step in range(1, int((self.end - np.arange(len(self.end))).max(initial=1))):
            a = np.flatnonzero(np.arange(len(self.end)) + step < self.end)
            c = a + step
            n, m = self.n[a], self.n[c]
            fit = (self.label[a] != self.label[c]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (~self.across[a] | (self.side[a] != self.side[c]))
            a, c = a[fit], c[fit]
            for x, y in zip(np.array_split(a, len(a) // 4096 + 1), np.array_split(c, len(a) // 4096 + 1)):
                good = agreeing(self.regs[x], self.regs[y]) >= self.least
                x, y = x[good], y[good]
                shared = (self.keys[x] == self.keys[y]) & self.held[x] & self.held[y]
                good = self.keys[x, shared.argmax(1)] == self.b[x].view(np.uint64)
                x, y = x[good], y[good]
                good = estimate(self.regs[x], self.regs[y], self.n[x], self.n[y]) >= self.least
                yield x[good], y[good]


def hopeful_batches(percent: int, number: int):
    """The members that have a likely partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["b", "i", "j"]):
            good = np.zeros(table.num_rows, bool)
            for x, y in Block(table, percent, number).likely():
                good[x] = good[y] = True
            yield from table.select(["b", "i", "j", "side", "rep"]).filter(pa.array(good)).combine_chunks().to_batches()

    return run


def link_batches(percent: int, number: int):
    """Links between members of unlike labels, of which none joins what earlier ones of the group join already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, ["b", "i", "j"]):
            block = Block(table, percent, number)
            found = list(block.likely())
            x, y = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            lists = table.column("shingles").combine_chunks()
            offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            _, root = np.unique(block.label, return_inverse=True)
            us, vs = [], []
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            for at in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
                if not len(at):
                    continue
                a = x[at[0]]
                mine = flat[offs[a] : offs[a + 1]]
                for c in y[at]:
                    if root[a] == root[c]:
                        continue
                    theirs = flat[offs[c] : offs[c + 1]]
                    both = np.searchsorted(mine, theirs)
                    same = int((mine[np.minimum(both, len(mine) - 1)] == theirs).sum())
                    if 100 * same >= percent * (len(mine) + len(theirs) - same):
                        us.append(block.rep[a])
                        vs.append(block.rep[c])
                        root[root == root[c]] = root[a]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def star_batches(percent: int):
    """Rows (u, v) of a member and its leader that may link, by their registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = percent / 100 - ERRORS * (percent * (100 - percent) / BUCKETS) ** 0.5 / 100
        for batch in batches:
            n, m = batch.column("nu").to_numpy(), batch.column("nv").to_numpy()
            good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            good &= estimate(rows_of(batch.column("ru")), rows_of(batch.column("rv")), n, m) >= least
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and text_hash, the xxhash64 of its text.

    ``docs`` needs doc_id and text; other columns, whatever their names, are ignored.
    Links need 100 * intersection >= ``percent`` * union of distinct ``words``-word
    shingles, words lower-cased in A-Z. A text of fewer words is one shingle; a null,
    empty or blank text has none, links with nothing and is kept. component_id is the
    smallest doc_id of the component. Rows of one doc_id are documents of their own, each
    kept if the id is the component's; a row without doc_id links like others and is kept
    only if no row of its component has one. An empty table gives an empty result.
    """
    scratch, number = Scratch(spark, "minhash"), bands_needed(percent)
    texts = docs.select("doc_id", "text")
    numbered = texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")  # fixed by writing the sketch
    sketch = scratch.write(numbered.mapInArrow(sketch_batches(words, number), "uid long, doc_id long, text_hash long, n long, d1 long, d2 long, regs binary, bands array<long>"), "sketch")
    same = ["d1", "d2", "n"]
    classes = sketch.filter("n > 0").groupBy(*same).agg(F.min("uid").alias("rep"), F.min("doc_id").alias("low"))
    members = scratch.write(sketch.select("uid", "doc_id", "text_hash", *same).join(classes, same, "left").select("uid", "doc_id", "text_hash", *same, F.coalesce("rep", "uid").alias("rep"), F.coalesce("low", "doc_id").alias("low")), "members")
    reps = members.filter("uid = rep and n > 0").select("rep", "n", "d1", "d2", "low")
    weight = 1 / F.lit(BLOCK) + F.col("n") / SHINGLES
    slots = sketch.join(reps.select(F.col("rep").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("rep"), weight.alias("weight"), F.explode("bands").alias("b"))
    groups = slots.groupBy("b").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("total"), F.min("rep").alias("lead")).filter("size > 1")
    slots = scratch.write(slots.join(groups.select("b", "lead", (F.col("total") > 1).alias("large")), "b"), "slots")
    known = scratch.write(sketch.select(F.col("uid").alias("rep"), "n", "regs").join(slots.select("rep").distinct(), "rep", "left_semi"), "known")
    scratch.drop(sketch)

    def sets_of(chosen: DataFrame) -> DataFrame:
        """(rep, shingles) of the classes in ``chosen``, from the texts of their smallest doc_id."""
        chosen = scratch.write(reps.join(chosen.distinct(), "rep", "left_semi"), "chosen")
        maybe, _ = screened(texts, (F.col("doc_id"),), chosen, (F.col("low"),))
        theirs = maybe.join(chosen.select("low").distinct(), F.col("doc_id").eqNullSafe(F.col("low")), "left_semi")
        return scratch.write(theirs.select("text").mapInArrow(set_batches(words), "d1 long, d2 long, shingles array<long>").join(chosen.select("rep", "d1", "d2"), ["d1", "d2"]).select("rep", "shingles"), "sets")

    none = F.lit(0).cast("long")
    blocks = slots.filter("not large").select("b", none.alias("i"), none.alias("j"), none.alias("side"), "rep")
    found = []
    large = slots.filter("large")
    labels = known.select("rep", F.col("rep").alias("label"))
    if not large.isEmpty():
        # linear in a group: each member beside the smallest one
        stars = large.filter("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct()
        of = lambda c: known.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
        likely = scratch.write(stars.join(of("u"), "u").join(of("v"), "v").mapInArrow(star_batches(percent), "u long, v long"), "likely")
        sets = sets_of(likely.select(F.col("u").alias("rep")).union(likely.select("v")))
        both = likely.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv")), "v")
        common = F.size(F.array_intersect("su", "sv")).cast("long")
        links = scratch.write(both.select("u", "v", common.alias("c"), (F.size("su") + F.size("sv")).alias("t")).filter(f"100 * c >= {percent} * (t - c)").select("u", "v"), "stars")
        found.append(links)
        scratch.drop(likely, sets)
        labels = scratch.write(labels.drop("label").join(components(scratch, links).select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("label")), "labels")
        # a group's largest component and the rest of it, each in blocks; none of two blocks of the former
        held = scratch.write(large.select("b", "rep", "weight").join(labels, "rep"), "large")
        sums = held.groupBy("b", "label").agg(F.sum("weight").alias("w"))
        top = sums.groupBy("b").agg(F.max_by("label", F.struct("w", "label")).alias("top"), F.max("w").alias("most"), F.sum("w").alias("all"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        parts = top.select("b", "top", F.ceil("most").alias("nd"), F.ceil(F.col("all") - F.col("most") + 1e-9).alias("no"))
        dealt = held.join(parts, "b").withColumn("first", F.when(F.col("label") == F.col("top"), 0).otherwise(F.col("nd")).cast("long"))
        spread = F.when(F.col("label") == F.col("top"), F.col("nd")).otherwise(F.col("no"))
        dealt = dealt.withColumn("side", F.col("first") + F.pmod(F.xxhash64("rep"), spread))
        other = F.sequence(F.when(F.col("label") == F.col("top"), F.col("nd")).otherwise(0).cast("long"), (F.col("nd") + F.col("no") - 1).cast("long"))
        dealt = dealt.withColumn("other", F.explode(other))
        blocks = blocks.union(dealt.select("b", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep"))

    full = known.join(labels, "rep")
    together = lambda df: df.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")
    hopeful = scratch.write(together(blocks.join(full, "rep")).mapInArrow(hopeful_batches(percent, number), "b long, i long, j long, side long, rep long"), "hopeful")
    scratch.drop(slots)
    sets = sets_of(hopeful.select("rep"))
    links = together(hopeful.join(full, "rep").join(sets, "rep")).mapInArrow(link_batches(percent, number), "u long, v long")
    found.append(scratch.write(links, "links"))
    scratch.drop(sets, hopeful, known)
    links = found[0] if len(found) == 1 else found[0].union(found[1])
    roots = components(scratch, links).select(F.col("node").alias("rep"), "root")
    least = reps.select("rep", "low").join(roots, "rep").groupBy("root").agg(F.min("low").alias("least"))
    final = scratch.write(roots.join(least, "root").select("rep", "least"), "final")
    out = members.join(final, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "low").alias("component_id"), "text_hash")
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
