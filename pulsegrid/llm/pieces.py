"""Operator 4: exact SentencePiece BPE encoding by backtracking, and decoding.

An Aho-Corasick automaton gives, for every position, the vocabulary pieces that start
there. Encoding takes the longest piece whose pair with the previous one survives
re-merging; where none fits it marks the position as failed in a bitfield and goes
back. Since two pieces either stand side by side after merging or don't, whatever
surrounds them, the result equals that of merging best pair first.

No piece has the space mark after another character, so text is encoded by chunks,
each a run of space marks with the characters after it, and short chunks are cached. Runs
of two or more marks hold pieces of equal score, where the order of merging counts;
such chunks are merged directly. A newline that is in no piece ends a chunk too.

Decoding takes the ids alone: their pieces side by side, bytes of byte pieces as UTF-8.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.runtime import importable

MARK = "▁"
CACHE, CACHED_CHARS = 400_000, 64
"""Chunks, and pairs of pieces, kept at most, and the length of those that are kept."""
CHUNK = re.compile(" +[^ ]*")
NORMAL, BYTE = 1, 6

_codecs: dict[str, "Codec"] = {}


class Codec:
    """Encoder and decoder for one SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: a BPE model with byte fallback and identity normalisation is needed")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.text: list[str | int | None] = []
        for i, p in enumerate(proto.pieces):
            piece = p.piece
            if p.type == NORMAL:
                self.score[piece], self.id[piece] = p.score, i
                self.text.append(piece)
            elif p.type == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                self.text.append(int(piece[3:5], 16))
            else:
                self.text.append(None)
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError(f"{path}: a piece has the space mark inside")
        self.lines = 10 in self.byte_id and not any("\n" in p for p in self.score)
        self.find = ahocorasick.Automaton()
        for piece in self.score:
            self.find.add_word(piece, piece)
        self.find.make_automaton()
        self.whole: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, str] = {}
        self.shown = {str(i): p.replace(MARK, " ") for i, p in enumerate(self.text) if isinstance(p, str)}

    def merge(self, text: str) -> list[str]:
        """Best pair first, leftmost of equals."""
        parts, score = list(text), self.score
        pairs = [score.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(pairs):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = score.get(parts[at - 1] + parts[at])

    def is_whole(self, piece: str) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merge(piece) == [piece]
        return known

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > CACHE:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        n = len(text)
        at: list[list[str]] = [[c] for c in text]
        for end, piece in self.find.iter(text):
            if len(piece) > 1 and self.is_whole(piece):
                at[end + 1 - len(piece)].append(piece)
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        left: list[int] = []
        pos = 0
        options = len(at[0]) - 1 if n else -1
        while pos < n:
            piece = None
            while options >= 0:
                piece = at[pos][options]
                options -= 1
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                piece = None
            if piece is not None:
                out.append(piece)
                left.append(options)
                pos += len(piece)
                options = len(at[pos]) - 1 if pos < n else -1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
                options = left.pop()
        return out

    def ids(self, chunk: str) -> list[int]:
        """Ids of one chunk, in which spaces are already marks."""
        pieces = self.merge(chunk) if chunk.startswith(MARK * 2) and len(chunk) < 64 else self.backtrack(chunk) if not chunk.startswith(MARK * 2) else self.run(chunk)
        out: list[int] = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            else:
                out.extend(self.byte_id[b] for b in p.encode())
        return out

    def run(self, chunk: str) -> list[str]:
        """A long chunk that starts with several marks, merged with a heap."""
        import heapq

        parts: list[str | None] = list(chunk)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(chunk, chunk[1:])) if (s := self.score.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < len(parts) and (s := self.score.get(parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[after[a]]))
        return [p for p in parts if p is not None]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of byte pieces as UTF-8, marks as spaces, without the first space."""
        out = self.surface(ids)
        return out.removeprefix(" ")

    def surface(self, ids: list[int]) -> str:
        raw = bytearray()
        for i in ids:
            piece = self.text[i]
            if isinstance(piece, int):
                raw.append(piece)
            elif piece is not None:
                raw += piece.replace(MARK, " ").encode()
        return raw.decode("utf-8", "replace")

    def decode_joined(self, joined: str) -> str:
        """The same for comma-joined ids."""
        if not joined:
            return ""
        ids = joined.split(",")
        try:
            return "".join(map(self.shown.__getitem__, ids)).removeprefix(" ")
        except KeyError:  # a byte or control piece
            return self.decode([int(i) for i in ids])

    def look(self, key: str) -> str:
        """The comma-joined ids of a chunk: of its key as it is after a space or newline, else with a space in front."""
        known = self.cache.get(key)
        if known is None:
            plain = key if key[:1] in (" ", "\n") else " " + key
            marked = plain.replace(" ", MARK)
            ids = [self.byte_id[10], *self.ids(marked[1:])] if key[:1] == "\n" else self.ids(marked)
            known = ",".join(map(str, ids))
            if len(key) <= CACHED_CHARS:
                self.cache[key] = known
        return known

    def encode_joined(self, text: str) -> str:
        """Comma-joined ids of a text."""
        if not text:
            return ""
        if len(self.cache) > CACHE:
            self.cache.clear()
        if MARK in text:
            text = text.replace(MARK, " ")
        spaced = text.replace("\n", " \n") if self.lines else text
        if "  " in spaced or spaced[0] in " \n" or spaced[-1] == " ":
            parts = CHUNK.findall(" " + text)
        else:
            parts = spaced.split(" ")
        return ",".join([self.cache.get(p) or self.look(p) for p in parts])

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(",")] if joined else []


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def digest_batches(path: str, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            counts, ids, texts = [], [], []
            for value in batch.column("text"):
                joined = model.encode_joined(value.as_py() or "")
                counts.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(model.decode_joined(joined).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_batches(path: str, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            ids = [model.encode(value.as_py() or "") for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    return run


def decode_batches(path: str, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            texts = [model.decode(value.as_py() or []) for value in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(texts, pa.string())], names=[id_column, "text"])

    return run


def encode(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, ids array<int>) of every row of ``docs``; a null or empty text has no ids. Other columns are ignored."""
    importable(docs.sparkSession)
    return docs.select(id_column, "text").mapInArrow(encode_batches(path, id_column), f"{id_column} {dict(docs.dtypes)[id_column]}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Rows (id, text) of rows (id, ids); null ids give the empty text."""
    importable(encoded.sparkSession)
    return encoded.select(id_column, "ids").mapInArrow(decode_batches(path, id_column), f"{id_column} {dict(encoded.dtypes)[id_column]}, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Encode each text, then decode its ids: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens, and the digest of the empty string for both.
    Repeated rows stay; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    return docs.select(id_column, "text").mapInArrow(digest_batches(path, id_column), f"{id_column} {dict(docs.dtypes)[id_column]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
