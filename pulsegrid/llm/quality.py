"""Operator 2: quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades, and ordered
thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - score). The expected
grade ranks texts, and the tail probability P(grade >= k) selects them.

Features of a text are present or absent: its lower-cased letter runs, the shapes of
its words (capital, small, digit and symbol runs) and, in tenths, the shares of plain
words, of words equal to the one before and of distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.text import LOWER, TABLE, U, Words, chunks, mix, spans
from pulsegrid.runtime import importable

BITS = 18
SAMPLE = 16_000
"""Labelled rows the model is fitted on at most, those with the smallest hash of their id."""
MIN_Z = 4.0
"""A feature has a weight only if its texts' grades differ from the other texts' by so many standard errors at some cut."""
MIN_DOCS = 3

KIND = np.zeros(256, np.uint8)
for _range, _kind in ((range(97, 123), ord("x")), (range(65, 91), ord("X")), (range(48, 58), ord("0")), (range(128, 256), ord("x"))):
    KIND[list(_range)] = _kind
for _b in range(33, 127):
    if not KIND[_b]:
        KIND[_b] = _b
LETTER = np.isin(KIND, [ord("x"), ord("X")])
#: Shapes of words as ordinary prose has them.
PLAIN = ["x", "Xx", "X", "x.", "x,", "Xx.", "Xx,", "X.", "X,", "0", "0.", "0,"]


def shape_hashes(words: Words) -> np.ndarray:
    """A hash of each word's shape, runs of one kind written once."""
    n = len(words.data)
    kinds = KIND[words.data]
    keep = np.ones(n, bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[words.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return spans(kinds[keep], at[words.start], at[words.end], TABLE)


PLAIN_HASHES = None


def plain_hashes() -> np.ndarray:
    global PLAIN_HASHES
    if PLAIN_HASHES is None:
        data = np.frombuffer("".join(PLAIN).encode(), np.uint8)
        ends = np.cumsum([len(p) for p in PLAIN])
        PLAIN_HASHES = np.unique(spans(data, ends - [len(p) for p in PLAIN], ends, TABLE))
    return PLAIN_HASHES


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once, in document order."""
    words = Words(data, offs)
    docs = words.docs
    mask = U((1 << BITS) - 1)
    rows, cols = [], []
    if len(words.start):
        letters = LETTER[data]
        before = np.concatenate([[False], letters[:-1]])
        before[offs[:-1][offs[:-1] < len(data)]] = False
        after = np.concatenate([letters[1:], [False]])
        after[offs[1:][offs[1:] > 0] - 1] = False
        start, end = np.flatnonzero(letters & ~before), np.flatnonzero(letters & ~after) + 1
        rows.append(np.searchsorted(offs, start, "right") - 1)
        cols.append(spans(data, start, end, LOWER) & mask)
        shapes = shape_hashes(words)
        rows.append(words.doc)
        cols.append(mix(shapes ^ U(1)) & mask)
        total = np.maximum(np.bincount(words.doc, minlength=docs), 1)
        plain = np.bincount(words.doc[np.isin(shapes, plain_hashes())], minlength=docs)
        again = np.bincount(words.doc[1:][(words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=docs)
        distinct = np.bincount((np.unique((words.doc.astype(np.uint64) << U(40)) | (words.hash >> U(24))) >> U(40)).astype(np.int64), minlength=docs)
        for tag, share in ((11, plain / total), (12, again / total), (13, distinct / total)):
            rows.append(np.arange(docs))
            cols.append(mix(np.ceil(share * 10).astype(np.uint64) + U(tag * 1000)) & mask)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique((np.concatenate(rows).astype(np.int64) << BITS) | np.concatenate(cols).astype(np.int64))
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, col = features(data, offs)
        return np.bincount(row, self.weights[col], minlength=len(offs) - 1)


def screen(rows: list[np.ndarray], counts: np.ndarray, grades: np.ndarray, levels: int) -> np.ndarray:
    """For each feature the largest z-score, over the cuts, of the share of low grades among its texts."""
    best, n = np.zeros(len(counts)), max(len(rows), 1)
    for cut in range(levels - 1):
        low = grades <= cut
        seen = np.bincount(np.concatenate([r for r, x in zip(rows, low) if x] or [np.zeros(0, np.int64)]), minlength=len(counts))
        p = low.mean() if len(low) else 0.0
        spread = np.sqrt(np.maximum(counts * p * (1 - p) * (1 - counts / n), 1e-9))
        best = np.maximum(best, np.abs(seen - counts * p) / spread)
    return best


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, rounds: int = 300, l2: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam over all rows; thresholds stay ordered as sums of exponentials."""
    size = 1 << BITS
    counts = np.bincount(np.concatenate(rows) if rows else np.zeros(0, np.int64), minlength=size)
    used = np.flatnonzero((counts >= MIN_DOCS) & (screen(rows, counts, grades, levels) >= MIN_Z))
    slot = np.full(size, -1)
    slot[used] = np.arange(len(used))
    col = np.concatenate([slot[r] for r in rows]) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row, col = row[col >= 0], col[col >= 0]
    n, k = max(len(rows), 1), levels - 1
    share = np.array([(np.sum(grades <= j) + 1) / (len(grades) + 2) for j in range(k)])
    first = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, cuts = p[: len(used)], np.concatenate([[p[len(used)]], p[len(used)] + np.cumsum(np.exp(p[len(used) + 1 :]))])
        s = np.bincount(row, w[col], minlength=len(rows)) if len(rows) else np.zeros(0)
        below = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None, :], -60, 60)))
        edge = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], 1)
        slope = edge * (1 - edge)
        at = np.arange(len(s))
        prob = np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-12)
        hi, lo = slope[at, grades + 1] / prob, slope[at, grades] / prob
        g_s = (hi - lo) / n
        g_cut = np.array([(-hi[grades == j].sum() + lo[grades == j + 1].sum()) / n for j in range(k)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, g_s[row], minlength=len(used)) + l2 * w, [tail[0]], tail[1:] * np.exp(p[len(used) + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(size)
    weights[used] = p[: len(used)]
    return OrdinalModel(weights, np.concatenate([[p[len(used)]], p[len(used)] + np.cumsum(np.exp(p[len(used) + 1 :]))]))


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offs in chunks(batch, "text"):
            row, col = features(data, offs)
            cuts = np.searchsorted(row, np.arange(to - at + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(col, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("grade").slice(at, to - at), lists], names=["grade", "features"])


def train(spark: SparkSession, docs: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rated rows (doc_id, grade in 0..levels-1), those with the smallest hash of doc_id.

    With no usable ratings the model keeps everything: every tail probability is near 1.
    """
    importable(spark)
    rated = ratings.filter(F.col("grade").between(0, levels - 1)).select("doc_id", F.col("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` small rows
    got = texts.mapInArrow(feature_batches, "grade int, features array<int>").toArrow()
    if got.num_rows == 0:
        return OrdinalModel(np.zeros(1 << BITS), np.full(levels - 1, -50.0) + np.arange(levels - 1))
    rows = [x.values.to_numpy() for x in got.column("features")]
    order = np.lexsort((np.array([r.sum() for r in rows]), np.array([len(r) for r in rows])))
    return fit([rows[i] for i in order], got.column("grade").to_numpy()[order], levels)


def score_batches(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offs in chunks(batch, "text"):
                tails = model.tails(model.score(data, offs))
                columns = [batch.column(i).slice(at, to - at) for i in range(batch.num_columns)]
                columns += [pa.array(tails.sum(1)), pa.array(tails[:, -1])]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "expected_grade", "tail_probability"])

    return run


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` (with a text column) with expected_grade and tail_probability, P(grade is the highest), added.

    Columns of those names that ``docs`` has already are replaced. A null or empty text
    has no features and gets the score of the thresholds alone.
    """
    importable(docs.sparkSession)
    docs = docs.drop("expected_grade", "tail_probability")
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    return docs.mapInArrow(score_batches(model), schema)


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from quality and toxic marks: 0 of low quality, 1 sound but toxic, 2 sound; no grade without quality."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) != 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_probability and kept (tail probability of the highest grade at least ``least``)."""
    model = train(spark, docs, grades(labels), 3)
    return score(docs, model).withColumn("kept", F.col("tail_probability") >= least)
