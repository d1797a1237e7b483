"""Operator 6: passages repeated across documents, by sparse suffix arrays.

Only suffixes at content-selected positions are retained: of every 26 consecutive
25-word sequences, the one with the smallest hash (a minimiser). Any 50 words in a row
hold one, so two documents that share 50 words both retain a suffix inside them that
begins with the same 25 words. The retained suffixes are dealt by those first 25 words,
which keeps each interval of the suffix array that matters in one task, and sorted there
by the words that follow. Neighbours are compared for the length of their common prefix,
and for each extension to the left by 0 to 25 words the suffixes that agree on it and on
as many words to the right as make 50 are one run; all of a run but its smallest doc_id
repeat. A longer match goes on over the next retained suffixes, and stretches that
overlap are joined.

Words that go round in a short period make a suffix for each period, with the same words
on both sides. Those of a text that follow each other within 50 words are one row with the
distance to the last of them: they have the same holders, and their stretches join.

Where more than ``CROWD`` suffixes begin with the same 25 words, they are dealt anew
by all 50 words that they stand in, one row for each, so that no common line meets in one
task; the smallest doc_id of each is found by a partial aggregation and a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.batches import groups_of
from pulsegrid.llm.screen import screened
from pulsegrid.llm.text import SLOTS, U, Words, chunks, mix, signed
from pulsegrid.runtime import Scratch, importable

LEAST = 50
GRAM = 25
SIDE = LEAST - GRAM
CROWD = 1 << 16
SPANS = "_repeated_spans"
EXTENT = 13
"""Bits of a packed suffix below its extent: 6 each for the words to its left and right, and 1 if it is crowded."""
POSITION = 32
"""Bits below its position, so that an extent has 19; longer ones are split."""


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, of which there is at least one."""
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        out += hashes[j : len(out) + j] * SLOTS[j]
    return mix(out)


def minimisers(grams: np.ndarray) -> np.ndarray:
    """For each run of SIDE + 1 grams the position of the smallest, the first of equal ones."""
    best, width = np.arange(len(grams)), 1
    while width < SIDE + 1:
        step = min(width, SIDE + 1 - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        width += step
    return best


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Retained suffixes of a chunk's texts: gram, first word in the chunk, words before and after that their runs of LEAST words reach, words to the last equal one."""
    none = np.zeros(0, np.int64)
    if len(words.hash) < LEAST:
        return none.astype(np.uint64), none, none, none, none
    grams = rolled(words.hash, GRAM)
    inside = np.flatnonzero(words.doc[: len(words.doc) - LEAST + 1] == words.doc[LEAST - 1 :])
    at = minimisers(grams)[inside]
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    first = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(words.doc[inside], prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    before, after = place - inside[first], inside[last] + SIDE - place
    # three grams hold all words that a suffix reaches
    reach = ((words.doc[place] << 12) | (before << 6) | after).astype(np.uint64)
    alike = mix(grams[place - before] * SLOTS[0] + grams[place] * SLOTS[1] + grams[place + after] * SLOTS[2] + reach * SLOTS[3])
    kept, extent = periods(alike, place)
    return grams[place[kept]], place[kept], before[kept], after[kept], extent


def periods(alike: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes that are ``alike`` and follow each other within LEAST words, the first, and the words from it to the last."""
    order = np.argsort(alike, kind="stable")
    alike, place = alike[order], place[order]
    block = place >> (POSITION - EXTENT)
    first = np.flatnonzero(np.concatenate([[True], (alike[1:] != alike[:-1]) | (np.diff(place) > LEAST) | (block[1:] != block[:-1])]))
    last = np.append(first[1:], len(place)) - 1
    by = np.argsort(order[first])
    return order[first][by], (place[last] - place[first])[by]


def packed(place: np.ndarray, before: np.ndarray, after: np.ndarray, extent: np.ndarray) -> np.ndarray:
    return (place << POSITION) | (extent << EXTENT) | (before << 7) | (after << 1)


def extents(suffix: np.ndarray) -> np.ndarray:
    return (suffix >> EXTENT) & ((1 << (POSITION - EXTENT)) - 1)


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
        for at, _, data, offs in chunks(batch, "text"):
            words = Words(data, offs)
            gram, place, before, after, extent = anchors(words)
            doc = words.doc[place]
            yield pa.RecordBatch.from_arrays([pa.array(signed(gram)), pa.array(ids[at + doc]), pa.array(marks[at + doc]), pa.array(packed(place - words.first[doc], before, after, extent))], names=["gram", "doc_id", "mark", "suffix"])


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted suffixes with the 32-bit hashes of the words on both sides, nearest first; of crowded ones a row for each LEAST words."""
    for batch in batches:
        lists = batch.column("suffixes")
        for at, to, data, offs in chunks(batch, "text"):
            words = Words(data, offs)
            part = lists.slice(at, to - at)
            flat = part.flatten().to_numpy()
            row = np.repeat(np.arange(to - at), np.diff(part.offsets.to_numpy()))
            place = (flat >> POSITION) + words.first[row]
            before, after, crowded = (flat >> 7) & 63, (flat >> 1) & 63, (flat & 1) == 1
            key = np.zeros(len(flat), np.uint64)
            for j in range(GRAM):
                key += words.hash[place + j] * SLOTS[j]
            key = mix(key)
            short = np.append((words.hash >> U(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
            near = np.arange(SIDE)
            left = np.where(near < before[:, None], place[:, None] - 1 - near, -1)
            right = np.where(near < after[:, None], place[:, None] + GRAM + near, -1)
            sides = short[np.concatenate([left, right], 1)]
            calm = np.flatnonzero(~crowded)
            yield context_rows(batch, at + row[calm], key[calm], flat[calm], pa.array([sides[i].tobytes() for i in calm], pa.binary()))
            busy = np.flatnonzero(crowded)
            if len(busy):
                runs = after[busy] + before[busy] - SIDE + 1
                of = np.repeat(busy, runs)
                start = place[of] - before[of] + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
                whole = np.zeros(len(of), np.uint64)
                for j in range(LEAST):
                    whole += words.hash[start + j] * SLOTS[j]
                yield context_rows(batch, at + row[of], mix(whole), packed(start - words.first[row[of]], 0, 0, extents(flat[of])), pa.nulls(len(of), pa.binary()))


def context_rows(batch: pa.RecordBatch, rows: np.ndarray, key: np.ndarray, suffix: np.ndarray, sides: pa.Array) -> pa.RecordBatch:
    ids = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "mark")]
    return pa.RecordBatch.from_arrays([pa.array(signed(key)), *ids, pa.array(suffix), sides], names=["key", "doc_id", "mark", "suffix", "sides"])


def neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words that a document of smaller doc_id holds, from suffixes with equal first words."""
    weights = mix(np.arange(1, SIDE + 1, dtype=np.uint64)) | U(1)
    for table in groups_of(batches, ["key"]):
        key, doc, suffix = (table.column(c).to_numpy() for c in ("key", "doc_id", "suffix"))
        sides = np.frombuffer(b"".join(table.column("sides").to_pylist()), np.uint32).reshape(-1, 2 * SIDE)
        order = np.lexsort([*(sides[:, i] for i in range(2 * SIDE - 1, SIDE - 1, -1)), key])
        key, doc, suffix, sides, marks = key[order], doc[order], suffix[order], sides[order], table.column("mark").to_numpy()[order]
        place, before, after, extent = suffix >> POSITION, (suffix >> 7) & 63, (suffix >> 1) & 63, extents(suffix)
        unlike = sides[1:, SIDE:] != sides[:-1, SIDE:]
        common = np.where(unlike.any(1), unlike.argmax(1), SIDE)
        common[key[1:] != key[:-1]] = -1
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((place, doc))] = np.arange(len(doc))
        left = np.zeros(len(doc), np.uint64)
        rows, holders, lefts = [], [], []
        for back in range(SIDE + 1):
            if back:
                left = left + sides[:, back - 1] * weights[back - 1]
            run = np.concatenate([[0], np.cumsum(common < SIDE - back)]).astype(np.uint64)
            held = np.flatnonzero((before >= back) & (after >= SIDE - back))
            both = mix(left[held] + mix(run[held] + U(1)))
            by = np.lexsort((rank[held], both))
            held, both = held[by], both[by]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(held) else held
            holder = np.repeat(held[first], np.diff(np.append(first, len(held))))
            later = doc[held] > doc[holder]
            rows.append(held[later])
            holders.append(doc[holder[later]])
            lefts.append(np.full(int(later.sum()), back))
        rows, holders, lefts = (np.concatenate(x) for x in (rows, holders, lefts))
        if not len(rows):
            continue
        by = np.lexsort((lefts, holders, rows))
        rows, holders, lefts = rows[by], holders[by], lefts[by]
        cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (holders[1:] != holders[:-1])]))
        last = np.append(cut[1:], len(rows)) - 1
        at = rows[cut]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(marks[at]), pa.array(holders[cut]), pa.array(place[at] - lefts[last]), pa.array(place[at] + extent[at] - lefts[cut] + LEAST)], names=["doc_id", "mark", "earlier_doc_id", "start_word", "end_word"])


def repeated_passages(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Stretches of words that stand in passages of at least 50 words which an earlier document (of smaller doc_id) holds too.

    Rows (doc_id, mark, earlier_doc_id, start_word, end_word): the words of doc_id's text,
    end exclusive, and the xxhash64 of that text. Words are runs of bytes other than space
    and 0x09-0x0D; runs of 25 of them are compared by a 64-bit hash, and those beside by 32
    bits for each word. Every word of a 50-word sequence which an earlier document holds is in a
    row, each sequence with its holder of smallest doc_id. ``docs`` needs doc_id and text;
    other columns are ignored. Rows of one doc_id are parts of one document, which do not
    repeat each other. A row without doc_id has no rows and holds nothing, nor has a null,
    empty or shorter text. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(spark, "suffixes")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).filter("doc_id is not null and text is not null")
    kept = scratch.write(docs.mapInArrow(anchor_batches, "gram long, doc_id long, mark long, suffix long"), "suffixes")
    shared = kept.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi")
    shared = shared.select("gram", (F.col("n") > CROWD).cast("long").alias("crowded"))
    wanted = kept.join(shared, "gram").groupBy("doc_id", "mark").agg(F.collect_set(F.col("suffix") + F.col("crowded")).alias("suffixes"))
    wanted = scratch.write(wanted, "wanted")
    same = (F.col("doc_id"), F.col("mark"))
    maybe, _ = screened(docs, same, wanted, same)
    # dealt evenly, whatever files hold the common passages
    texts = maybe.repartition("doc_id", "mark").join(wanted, ["doc_id", "mark"])
    contexts = scratch.write(texts.mapInArrow(context_batches, "key long, doc_id long, mark long, suffix long, sides binary"), "contexts")
    scratch.drop(kept, wanted)
    shape = "doc_id long, mark long, earlier_doc_id long, start_word long, end_word long"
    near = contexts.filter("sides is not null").repartition("key").sortWithinPartitions("key").mapInArrow(neighbour_batches, shape)
    start, extent = F.shiftright("suffix", POSITION), F.shiftright("suffix", EXTENT).bitwiseAND((1 << (POSITION - EXTENT)) - 1)
    runs = contexts.filter("sides is null").select("key", "doc_id", "mark", start.alias("start_word"), (start + extent + LEAST).alias("end_word"))
    holders = runs.groupBy("key").agg(F.min("doc_id").alias("earlier_doc_id"), F.max("doc_id").alias("hi")).filter("earlier_doc_id < hi").drop("hi")
    crowd = runs.join(holders, "key").filter("doc_id > earlier_doc_id").select("doc_id", "mark", "earlier_doc_id", "start_word", "end_word")
    one = W.partitionBy("doc_id", "mark", "earlier_doc_id").orderBy("start_word", "end_word")
    found = near.union(crowd).withColumn("reach", F.max("end_word").over(one.rowsBetween(W.unboundedPreceding, -1)))
    found = found.withColumn("stretch", F.sum(F.when(F.col("start_word") <= F.col("reach"), 0).otherwise(1)).over(one.rowsBetween(W.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "mark", "earlier_doc_id", "stretch").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    found = scratch.write(found.drop("stretch"), "passages")
    scratch.drop(contexts)
    return found


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans of words; what is left on both sides of a cut is joined as it stands."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for row, spans in enumerate(batch.column(SPANS).to_pylist()):
            if spans and texts[row]:
                raw, out, at = texts[row].encode(), [], 0
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for first, end in sorted((s["start_word"], s["end_word"]) for s in spans):
                    if words.start[first] > at:
                        out.append(raw[at : words.start[first]])
                    at = max(at, words.end[end - 1])
                out.append(raw[at:])
                texts[row] = b"".join(out).decode()
        i = batch.schema.get_field_index("text")
        yield batch.set_column(i, "text", pa.array(texts, batch.schema.field(i).type)).select([n for n in batch.schema.names if n != SPANS])


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every passage that an earlier document holds cut from its text; the first holder keeps it.

    All columns and rows stay, one without doc_id as it is; a text that is cut whole
    becomes what space was around it.
    """
    scratch = Scratch(spark, "cut")
    found = repeated_passages(spark, docs, scratch)
    spans = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans")).toDF("_of", "_mark", SPANS)
    importable(spark)
    schema = T.StructType(docs.schema.fields)
    same = (docs["doc_id"], F.xxhash64(docs["text"]))
    maybe, rest = screened(docs, same, found, (F.col("doc_id"), F.col("mark")))
    cut = maybe.join(spans, (F.col("doc_id") == F.col("_of")) & (F.xxhash64("text") == F.col("_mark")), "left").drop("_of", "_mark").mapInArrow(cut_batches, schema)
    return cut.union(rest)
