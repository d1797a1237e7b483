"""Operator 7: token counts by Arrow functions that return lengths only.

Texts are encoded in groups of about the same number of bytes. A long text is cut
where an ASCII letter is followed by a space and another ASCII letter: the byte-level
pre-tokeniser always starts a piece there, so the parts' counts add up to the whole's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.runtime import importable

GROUP_BYTES = 1 << 20
LONG_CHARS = 1 << 14
SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_counters: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked_vocabulary(spec: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if the file is a plain byte-level BPE whose merges are in id order; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    chars, special = byte_characters(), {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    joined = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if None in joined or joined != sorted(joined) or len(joined) + 256 != len(vocab) or joined[0] < 256:
        return None
    return {bytes(chars[c] for c in k): v for k, v in vocab.items()}


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function giving token counts of a list of texts, and whether long texts may be cut."""
    if path not in _counters:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
        else:
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            ranks = ranked_vocabulary(spec)
            whole = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in spec.get("added_tokens", []))
            if ranks and whole:
                import tiktoken

                added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
                fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)
                _counters[path] = (lambda texts: [len(fast.encode(x, allowed_special="all")) for x in texts]), True
            else:
                from tokenizers import Tokenizer

                model = Tokenizer.from_file(path)
                model.no_truncation()
                model.no_padding()
                _counters[path] = (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), False
    return _counters[path]


def pieces(text: str) -> list[str]:
    """Parts of a text of at least LONG_CHARS characters, cut at safe boundaries only."""
    if len(text) <= LONG_CHARS:
        return [text]
    out, at = [], 0
    while len(text) - at > LONG_CHARS:
        cut = SAFE_CUT.search(text, at + LONG_CHARS)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = counter(path)
        for batch in batches:
            sizes, tokens = [0] * batch.num_rows, [0] * batch.num_rows
            parts: list[str] = []
            rows: list[int] = []
            held = 0

            def flush() -> None:
                for row, n in zip(rows, count(parts), strict=True):
                    tokens[row] += n
                parts.clear()
                rows.clear()

            for row, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                sizes[row] = len(text.encode())
                cuts = pieces(text) if cut else [text]
                for part in cuts:
                    parts.append(part)
                    rows.append(row)
                    held += sizes[row] if len(cuts) == 1 else len(part.encode())
                    if held >= GROUP_BYTES:
                        flush()
                        held = 0
            if parts:
                flush()
            others = [c for c in batch.schema.names if c != "text"]
            columns = [*(batch.column(c) for c in others), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``docs`` needs text and the kept columns, which have none of these names; others are
    ignored, and a null text counts as empty, with 0 tokens. ``path`` is a tokenizer
    file every executor can read. Repeated rows stay; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    kept = docs.select(*keep, F.col("text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return kept.mapInArrow(count_batches(path), schema).withColumn("over_limit", F.col("n_tokens") > limit)
