"""A compact binary export of metrics: a version byte and compressed JSON lines.

The same bytes can be read and written as a Spark data source, ``metrics_file``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pulsegrid.errors import BinaryFormatError, ExportFileError
from pulsegrid.plans.definitions import Kind
from pulsegrid.runtime import importable
from pulsegrid.sources.files import file_system, files_in

VERSION = 1
FIELDS = ("name", "type", "value", "tags", "timestamp")
SCHEMA = "name string, type string, value double, tags map<string,string>, timestamp long"
KINDS = {k.value for k in Kind}


def encoded(points: Iterable[dict]) -> Iterator[bytes]:
    """Bytes of points with the five fields, piece by piece."""
    yield bytes([VERSION])
    squeeze = zlib.compressobj()
    for n, p in enumerate(points):
        line = json.dumps({f: p[f] for f in FIELDS}, sort_keys=True)
        yield squeeze.compress(("\n" + line if n else line).encode())
    yield squeeze.flush()


def encode(points: Iterable[dict]) -> bytes:
    return b"".join(encoded(points))


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def valid(point, strict: bool = False) -> bool:
    """Whether a point has the five fields with their types; ``strict`` wants integer values."""
    if not isinstance(point, dict) or any(f not in point for f in FIELDS):
        return False
    value = isinstance(point["value"], int) and not isinstance(point["value"], bool) if strict else is_number(point["value"])
    stamp = isinstance(point["timestamp"], int) and not isinstance(point["timestamp"], bool)
    return isinstance(point["name"], str) and value and isinstance(point["tags"], dict) and stamp and isinstance(point["type"], str) and point["type"] in KINDS


def parse(data: bytes, strict: bool = False) -> list[dict]:
    """The points; BinaryFormatError "invalid_format" for another version or malformed points, "corrupt" for damaged bytes."""
    if not data or data[0] != VERSION:
        raise BinaryFormatError("invalid_format")
    try:
        points = [json.loads(line) for line in zlib.decompress(data[1:]).decode().split("\n") if line]
    except (zlib.error, ValueError):
        raise BinaryFormatError("corrupt") from None
    if not all(valid(p, strict) for p in points):
        raise BinaryFormatError("invalid_format")
    return points


def points_of(history: DataFrame) -> DataFrame:
    """The exported points of a history: all but summaries."""
    return history.filter(history["type"] != Kind.SUMMARY.value).select(*FIELDS)


def file_name(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d%H%M%S") + "-metrics.mbf"


def export(history: DataFrame, out_dir: str | None = None, now: datetime | None = None) -> bytes | str:
    """The bytes of a history, or the path of the new file with them in ``out_dir``.

    Points come to the driver partition by partition; a history of very many series is
    better written with ``df.write.format("metrics_file")``, a file for each task.
    """
    points = (r.asDict() for r in points_of(history).orderBy("timestamp", "name", "type").toLocalIterator())
    if out_dir is None:
        return encode(points)
    system, base = file_system(out_dir)
    path = f"{base.rstrip('/')}/{file_name(now)}"
    try:
        if system.get_file_info(base).type.name != "Directory":
            raise OSError("no such folder")
        if system.get_file_info(path).type.name != "NotFound":
            raise OSError("the file exists")
        with system.open_output_stream(path) as file:
            for piece in encoded(points):
                file.write(piece)
    except OSError as e:
        raise ExportFileError(e.strerror or str(e), path, "write") from e
    return path


class Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("strict", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [Part(p) for p, _ in files_in(self.path, ".mbf")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition is None:
            return
        with file_system(self.path)[0].open_input_stream(partition.path) as file:
            for p in parse(file.read(), self.strict):
                yield p["name"], p["type"], float(p["value"]), p["tags"], p["timestamp"]


class Done(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class Writer(DataSourceWriter):
    """One file for each task, under a name that counts only once committed."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Done:
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        out, n = f"{base}/{uuid.uuid4().hex}.tmp", 0

        def points() -> Iterator[dict]:
            nonlocal n
            for row in iterator:
                n += 1
                yield row.asDict()

        try:
            with system.open_output_stream(out) as file:
                for piece in encoded(points()):
                    file.write(piece)
        except BaseException:
            system.delete_file(out)
            raise
        if not n:
            system.delete_file(out)
        return Done(out if n else None)

    def commit(self, messages) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, m.path.removesuffix(".tmp") + "-metrics.mbf")

    def abort(self, messages) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class MetricsFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metrics_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(MetricsFile)
