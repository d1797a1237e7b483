"""Operator 9: WARC archives as a PySpark Python data source.

``spark.read.format("warc")`` plans one partition for each run of files, takes filters
on record_type, record_id, target_uri, payload_digest and refers_to before a payload
is touched, reads each record's headers first, and seeks past payloads that no filter
lets through or that aren't asked for (option ``payload`` = ``false``).
``df.write.format("warc")`` writes one file for each task. ``.warc.gz`` files, a gzip
member for each record, can be read as well.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from pulsegrid.runtime import Scratch, importable
from pulsegrid.sources.files import file_system

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, content_length long, payload binary"
#: WARC header names by column.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
PUSHED = {"record_id", "record_type", "target_uri", "payload_digest", "refers_to"}
BATCH_BYTES = 8 << 20
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(row: dict) -> bytes:
    kind = row["record_type"]
    payload = row["payload"] if kind != "revisit" and row["payload"] is not None else b""
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if (value := row.get(column)) is not None:
            value = f"sha1:{value}" if column == "payload_digest" else f"<{value}>" if column in ("record_id", "refers_to") else value
            lines.append(f"{header}: {clean(str(value))}")
    lines.append("WARC-Date: 2024-01-01T00:00:00Z")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {SAME_PAYLOAD}")
    lines.append("Content-Type: text/html; charset=utf-8")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_records(stream, wanted, payloads: bool) -> Iterator[dict]:
    """Records of an open file; ``wanted`` judges the headers, and other payloads are skipped."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:
                headers[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        length = int(headers.get("content-length", 0))
        row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
        row["content_length"] = length
        row["payload"] = None
        good = wanted(row)
        if good and payloads:
            body = stream.read(length)
            if len(body) < length:
                raise ValueError("a WARC record ends early")
            row["payload"] = body
        else:
            stream.seek(length, 1)
        if good:
            yield row


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.per_task = int(options.get("bytesPerTask", 64 << 20))
        self.filters: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PUSHED and isinstance(f, EqualTo):
                self.filters.append((column, frozenset([f.value])))
            elif column in PUSHED and isinstance(f, In):
                self.filters.append((column, frozenset(f.value)))
            elif column in PUSHED and isinstance(f, IsNotNull):
                self.filters.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path)]
        groups: list[list[str]] = []
        held = 0
        for f in sorted(found, key=lambda f: f.path):
            if not groups or held + f.size > self.per_task:
                groups.append([])
                held = 0
            groups[-1].append(f.path)
            held += f.size
        return [Files(g) for g in groups]

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (values is None or row[c] in values) for c, values in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        types = {"payload_length": pa.int64(), "content_length": pa.int64(), "payload": pa.binary()}
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        schema = pa.schema([(c, types.get(c, pa.string())) for c in columns])
        rows: list[dict] = []
        held = 0
        for path in partition.paths if partition else []:
            with system.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for row in read_records(Lines(stream), self.wanted, self.payloads):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Lines:
    """Buffered lines, reads and forward seeks over any binary file."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.held, self.at = raw, size, b"", 0

    def fill(self) -> bool:
        more = self.raw.read(self.size)
        self.held, self.at = self.held[self.at :] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self.fill():
                end = len(self.held) - 1
                break
        out = self.held[self.at : end + 1]
        self.at = end + 1
        return out

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            need = n - (len(self.held) - self.at)
            more = self.raw.read(max(self.size, need))
            if not more:
                break
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def seek(self, n: int, _: int) -> None:
        here = len(self.held) - self.at
        if n <= here:
            self.at += n
        else:
            self.held, self.at = b"", 0
            self.raw.seek(n - here, 1)


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for each task, under a name of its own; it counts only once committed."""
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        out = f"{base}/_{self.job}-{uuid.uuid4().hex}.tmp"
        n = 0
        try:
            with system.open_output_stream(out) as stream:
                for batch in iterator:
                    for row in batch.to_pylist():
                        stream.write(record_bytes(row))
                        n += 1
        except BaseException:
            system.delete_file(out)
            raise
        if not n:
            system.delete_file(out)
        return Written(out if n else None)

    def commit(self, messages: list[Written]) -> None:
        system, base = file_system(self.path)
        if self.overwrite:
            from pyarrow import fs

            for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.path.endswith((".warc", ".warc.gz")):
                    system.delete_file(f.path)
        for i, m in enumerate(x for x in messages if x is not None and x.path):
            system.move(m.path, f"{base}/{self.job}-{i:05d}.warc")
        self.clear()

    def abort(self, messages: list[Written]) -> None:
        self.clear()

    def clear(self) -> None:
        """Delete what attempts of this job have left that do not count."""
        from pyarrow import fs

        system, base = file_system(self.path)
        for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                system.delete_file(f.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known and let Spark offer it filters."""
    importable(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the digest and length of their payloads."""
    for batch in batches:
        payloads = [(x.as_py() or "").encode() for x in batch.column("html")]
        columns = [*batch.columns, pa.array([base32_sha1(p) for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "digest", "length"])


def payload_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths and digests of the payloads read back, next to what the headers say."""
    for batch in batches:
        payloads = [x.as_py() for x in batch.column("payload")]
        revisit = [x.as_py() == "revisit" for x in batch.column("record_type")]
        sizes = [h if r else len(p) for p, r, h in zip(payloads, revisit, batch.column("payload_length").to_pylist())]
        said = batch.column("payload_digest").to_pylist()
        digests = [h if r else base32_sha1(p) for p, r, h in zip(payloads, revisit, said)]
        if digests != said:
            raise ValueError("a payload differs from its digest")
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("record_type"), batch.column("refers_to"), pa.array(sizes, pa.int64()), pa.array(digests)], names=["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])


def to_records(scratch: Scratch, pages: DataFrame, least: int = 0) -> DataFrame:
    """A WARC record for each page: of equal payloads of at least ``least`` bytes the largest page_id is the response."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digested = pages.mapInArrow(digest_batches, "page_id long, url string, html string, digest string, length long")
    keys = pages.select("page_id", "html").mapInArrow(digest_batches, "page_id long, html string, digest string, length long").select("page_id", "digest", "length")
    groups = keys.filter(F.col("length") >= least).groupBy("digest", "length").agg(F.max("page_id").alias("origin"), F.count("*").alias("n")).filter("n > 1")
    groups = scratch.write(groups.drop("n"), "groups")
    marked = digested.join(groups, ["digest", "length"], "left").withColumn("origin", F.when(~F.col("origin").eqNullSafe(F.col("page_id")), F.col("origin")))
    name = "urn:pulsegrid:page:"
    return marked.select(
        F.concat(F.lit(name), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.when(F.col("origin").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.concat(F.lit(name), F.col("origin")).alias("refers_to"),
        F.when(F.col("origin").isNull(), F.col("length")).otherwise(F.lit(0)).cast("long").alias("content_length"),
        F.when(F.col("origin").isNull(), F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("payload"),
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as WARC files in the shared folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.
    ``pages`` needs page_id, url and html, other columns are ignored. A null html is an
    empty payload, and a null url leaves its header out. Payloads are compared by SHA-1
    and length. Rows of one page_id are records of their own; those of the largest page_id
    of a group are all responses. A row without page_id is a revisit where another row of
    its group has one, and else a response. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "warc")
    register(spark)
    path = scratch.path("archive")
    to_records(scratch, pages, least).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    read = read.filter(F.col("record_type").isin("response", "revisit"))
    rows = read.mapInArrow(payload_batches, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
