"""Operator 5: stupid-backoff language-model scores over n-gram count tables.

The counts come from the corpus itself. Texts are gathered into blocks of a few
megabytes; a block's distinct n-grams, as 64-bit hashes with their counts, are dealt
over hash partitions, each of which sums its part of the count table and joins the sums
back to the blocks that asked. There the n-grams of every document look up their
counts, and a document's scores are summed. Rows are packed arrays, so that an n-gram
costs about eight bytes on its way to its partition and about one back.

Counts leave out the document that is scored: an n-gram is known if some other document
holds it. A score is log(count / context count), or, where the n-gram is unknown, that
of the next shorter one plus log(0.4).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.batches import by_key, runs
from pulsegrid.llm.text import SLOTS, U, Words, chunks, mix
from pulsegrid.runtime import Scratch

BACKOFF = 0.4
UNSEEN = 0.5
"""The count of a word that no other document holds."""
BLOCK_BYTES = 4 << 20
PART_GRAMS = 4_000_000
PART_BLOCKS = 2
"""Blocks scored by a task."""


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def loosen(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype)


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of whole texts: (block, part = -1, ids, offs, blob, n_words)."""
    task, n = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    data: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        text, size = np.concatenate(data), np.concatenate(sizes)
        words = Words(text, np.concatenate([[0], np.cumsum(size)]))
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + n], pa.int64()), pa.array([-1], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([size.tobytes()], pa.binary()), pa.array([squeeze(text)], pa.binary()), pa.array([len(words.hash)], pa.int64())],
            names=["block", "part", "ids", "sizes", "blob", "n_words"],
        )

    held = 0
    for batch in batches:
        for at, to, text, offs in chunks(batch, "text", 1 << 20):
            ids.append(batch.column("doc_id").slice(at, to - at).to_numpy(zero_copy_only=False).astype(np.int64))
            sizes.append(np.diff(offs))
            data.append(text)
            held += len(text)
            if held >= BLOCK_BYTES:
                yield row()
                n, held, ids, sizes, data = n + 1, 0, [], [], []
    if ids:
        yield row()


class Grams:
    """All n-grams of a block's documents up to an order."""

    def __init__(self, sizes: bytes, blob: bytes, order: int):
        size = np.frombuffer(sizes, np.int64)
        self.words = Words(loosen(blob, np.uint8), np.concatenate([[0], np.cumsum(size)]), lower=True)
        n = len(self.words.hash)
        self.hashes: list[np.ndarray] = []
        self.valid: list[np.ndarray] = []
        for k in range(1, order + 1):
            h = np.zeros(n, np.uint64)
            ok = np.zeros(n, bool)
            if n >= k:
                for j in range(k):
                    h[k - 1 :] += self.words.hash[j : n - k + 1 + j] * SLOTS[j]
                ok[k - 1 :] = self.words.doc[k - 1 :] == self.words.doc[: n - k + 1]
            self.hashes.append(mix(h + U(k)))
            self.valid.append(ok)
        flat = np.concatenate([h[v] for h, v in zip(self.hashes, self.valid, strict=True)])
        self.distinct, inverse, self.counts = np.unique(flat, return_inverse=True, return_counts=True)
        self.slot: list[np.ndarray] = []
        at = 0
        for v in self.valid:
            slot = np.full(n, -1)
            slot[v] = inverse[at : at + v.sum()]
            at += v.sum()
            self.slot.append(slot)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each hash; partitions are ranges, so sorted hashes give sorted partitions."""
    return (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def request_batches(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "blob"))):
                grams = Grams(sizes, blob, order)
                cuts = np.searchsorted(part_of(grams.distinct, parts), np.arange(parts + 1))
                used = np.flatnonzero(np.diff(cuts))
                for some in np.array_split(used, max(1, len(used) // 64)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block)), pa.array([grams.distinct[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()), pa.array([squeeze(grams.counts[cuts[p] : cuts[p + 1]].astype(np.uint32)) for p in some], pa.binary())],
                        names=["part", "block", "hashes", "counts"],
                    )

    return run


def answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum a partition's counts and give each block the sums of its n-grams, in its order."""
    for group in runs(batches, ["part"]):
        hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        counts = np.concatenate([loosen(x, np.uint32) for x in group.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(inverse, counts).astype(np.uint64)[inverse]
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        blobs = [squeeze(x) for x in np.split(sums, cuts)]
        table = group.select(["block", "part"]).append_column("sums", pa.array(blobs, pa.binary())).combine_chunks()
        yield from table.to_batches()


def score_batches(order: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["block"]):
            rows = group.to_pydict()
            if rows["part"][0] != -1:
                raise ValueError("a block's counts came without its texts")
            grams = Grams(rows["sizes"][0], rows["blob"][0], order)
            ids = np.frombuffer(rows["ids"][0], np.int64)
            sums = np.concatenate([np.zeros(0, np.uint64), *(loosen(x, np.uint64) for x in rows["sums"][1:])]).astype(np.int64)
            if len(sums) != len(grams.distinct):
                raise ValueError("a block got other counts than it asked for")
            doc, width = grams.words.doc, max(len(sums), 1)
            others = []
            for slot, ok in zip(grams.slot, grams.valid, strict=True):
                known = np.zeros(len(doc), np.int64)
                key = doc[ok] * width + slot[ok]
                _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
                known[ok] = sums[slot[ok]] - own[inverse]
                others.append(known)
            length = np.bincount(doc, minlength=len(ids))
            rest = np.maximum(total - length, 1)[doc]
            score = np.log(np.maximum(others[0], UNSEEN)) - np.log(rest)
            for k in range(1, order):
                context = np.concatenate([[0], others[k - 1][:-1]])
                found = grams.valid[k] & (others[k] > 0)
                score = np.where(grams.valid[k], score + math.log(BACKOFF), score)
                score[found] = np.log(others[k][found] / context[found])
            sums_by_doc = np.bincount(doc, score, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(length.astype(np.int64)), pa.array(sums_by_doc)], names=["doc_id", "n_words", "log_score"])

    return run


def backoff_scores(spark: SparkSession, docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural log, summed over words), mean_log_score.

    Words are runs of bytes other than space and 0x09-0x0D, lower-cased in A-Z. N-grams
    do not cross documents; a document's first words are scored by the longest n-gram
    they have. A null, empty or blank text has 0 words, score 0 and a null mean. ``docs``
    needs doc_id and text, other columns are ignored; a row without doc_id is left out
    and does not count, repeated rows are documents of their own. An empty table gives an
    empty result.
    """
    scratch = Scratch(spark, "ngrams")
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    blocks = scratch.write(docs.mapInArrow(block_batches, "block long, part int, ids binary, sizes binary, blob binary, n_words long"), "blocks")
    total, number = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(8, -(-total * order // PART_GRAMS))
    asked = blocks.select("block", "sizes", "blob").mapInArrow(request_batches(order, parts), "part int, block long, hashes binary, counts binary")
    sums = by_key(asked, ["part"], ["block"], answer_batches, "block long, part int, sums binary", parts)
    empty = F.lit(None).cast("binary")
    both = blocks.select("block", "part", "ids", "sizes", "blob", empty.alias("sums")).union(sums.select("block", "part", empty.alias("ids"), empty.alias("sizes"), empty.alias("blob"), "sums"))
    scored = by_key(both, ["block"], ["part"], score_batches(order, total), "doc_id long, n_words long, log_score double", max(8, -(-number // PART_BLOCKS)))
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
