"""The event log as bytes: a version byte and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from pulsegrid.errors import BinaryFormatError

VERSION = 1
FIELDS = ("name", "measurements", "tags", "group", "timestamp", "session", "seq")


def to_binary(log: DataFrame) -> bytes:
    """The bytes of a log, which holds a few hundred rows, in order of time and arrival."""
    rows = log.orderBy("timestamp", "seq").collect()
    return bytes([VERSION]) + "\n".join(json.dumps({f: r[f] for f in FIELDS}, sort_keys=True) for r in rows).encode()


def parse(data: bytes) -> list[dict]:
    """The rows; BinaryFormatError "invalid_binary_format" for anything else."""
    try:
        if data[:1] != bytes([VERSION]):
            raise ValueError
        rows = [json.loads(line) for line in data[1:].decode().split("\n") if line]
        if not all(isinstance(r, dict) and set(r) == set(FIELDS) for r in rows):
            raise ValueError
    except ValueError:
        raise BinaryFormatError("invalid_binary_format") from None
    return rows
