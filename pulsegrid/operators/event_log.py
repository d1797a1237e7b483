"""The bounded event log and the correction of a clock that was set late."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import fields_of, seconds
from pulsegrid.operators.state import lenient
from pulsegrid.plans.definitions import LoggedEvent

LOG_SIZE = 500
PRE_SYNC_SIZE = 100
COLUMNS = ("name", "measurements", "tags", "group", "timestamp", "session", "seq")


@runtime_checkable
class Clock(Protocol):
    """A clock that may not be set yet."""

    def synchronized(self) -> bool: ...


def new_session() -> str:
    """The id of one run."""
    return str(uuid.uuid4())


def log_rows(events: DataFrame, logged: Sequence[LoggedEvent], session: str) -> DataFrame:
    """Events as log rows: allowed tags without nulls, transformed measurements, whole seconds.

    One scan serves all definitions; an event without a name here has no row, and a value
    that a transformation fails on is null.
    """
    known, tags_known = (fields_of(events.schema[c].dataType) for c in ("measurements", "metadata"))
    name = F.col("event_name")
    with lenient(events.sparkSession):
        cases = [F.when(name == e.event, F.struct(e.measured(F.col("measurements"), known).alias("measurements"), e.tag_map(F.col("metadata"), tags_known).alias("tags"), F.lit(e.group).alias("group"))) for e in logged]
        if not cases:
            cases = [F.lit(None).cast("struct<measurements:map<string,double>,tags:map<string,string>,group:string>")]
        wanted = events.filter(name.isin(*[e.event for e in logged])) if logged else events.limit(0)
        made = F.explode(F.array_compact(F.array(*cases))) if len(cases) > 1 else cases[0]
        rows = wanted.select(name.alias("name"), made.alias("e"), seconds(F.col("ts")).alias("timestamp"), "seq")
        return rows.select("name", "e.measurements", "e.tags", "e.group", "timestamp", F.lit(session).alias("session"), "seq")


def last_by_arrival(log: DataFrame, size: int = LOG_SIZE) -> DataFrame:
    """The ``size`` rows that arrived last; a top-n, so each task hands on ``size`` rows at most."""
    return log.orderBy(F.col("seq").desc()).limit(size)


def listed(log: DataFrame, from_: int = 0, to: int | None = None, now: int | None = None) -> DataFrame:
    """Rows of [from, to] by time, in order of arrival within a second; ``to`` is now by default, which hides later ones."""
    high = to if to is not None else int(time.time()) if now is None else now
    return log.filter(F.col("timestamp").between(from_, high)).orderBy("timestamp", "seq")


def corrected(log: DataFrame, sync_second: int, adjustment: int) -> DataFrame:
    """Rows from before the clock was set, moved by the adjustment; those after ``sync_second`` already have its time."""
    moved = F.when(F.lit(sync_second) < F.col("timestamp"), F.col("timestamp")).otherwise(F.col("timestamp") + adjustment)
    return log.withColumn("timestamp", moved)


def synchronized_log(log: DataFrame, sync_seq: int, start_second: int, sync_second: int, size: int = LOG_SIZE, buffer: int = PRE_SYNC_SIZE) -> DataFrame:
    """The log of a run whose clock was set at arrival ``sync_seq``.

    Earlier rows wait in a buffer of ``buffer`` rows; when the clock is set the buffer
    is corrected by sync - start and joins the log before the later rows.
    """
    waiting = last_by_arrival(log.filter(F.col("seq") < sync_seq), buffer)
    moved = corrected(waiting, sync_second, sync_second - start_second)
    return last_by_arrival(moved.unionByName(log.filter(F.col("seq") >= sync_seq)), size)
