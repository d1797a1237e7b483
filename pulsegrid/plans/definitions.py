"""Metric and event definitions, compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.functions.columns import as_map, entries, parse_name, take_present

Fields = tuple[str, ...] | None
"""Field names of a struct, None for a map."""


class Kind(str, Enum):
    """The four kinds of metric."""

    COUNTER = "counter"
    LAST_VALUE = "last_value"
    SUM = "sum"
    SUMMARY = "summary"


#: Seconds of the time units.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def by_python(f: Callable, kind: str) -> Callable[..., Column]:
    """A Python function of plain values as a function of columns, run in Arrow batches; null where it raises."""

    def guarded(*values):
        try:
            return f(*values)
        except Exception:
            return None

    return F.udf(guarded, kind, useArrow=True)


@dataclass(frozen=True)
class Metric:
    """A metric over an event.

    ``measurement`` is a key of the measurements, or a function of the measurements
    column, or of measurements and metadata. ``tag_values`` maps the metadata column to a
    new map before ``tags`` picks its keys; ``keep`` decides on the metadata column;
    ``scale`` converts units. With ``python`` these are functions of dicts and plain
    values instead. Where a function fails on an event, this metric skips it.
    """

    event_name: str
    kind: Kind
    measurement: str | Callable | None = None
    name: str | None = None
    tags: tuple[str, ...] = ()
    tag_values: Callable | None = None
    keep: Callable | None = None
    scale: float | None = None
    functions_of: int = 1
    python: bool = False

    @property
    def event(self) -> str:
        return parse_name(self.event_name)

    @property
    def full_name(self) -> str:
        """The given name, or the event's with the measurement's key."""
        if self.name:
            return parse_name(self.name)
        return f"{self.event}.{self.measurement}" if isinstance(self.measurement, str) else self.event

    def value(self, measurements: Column, metadata: Column, known: Fields = None, tags_known: Fields = None) -> Column:
        if self.kind is Kind.COUNTER:
            return F.lit(1.0)
        if callable(self.measurement):
            given = ((measurements, known), (metadata, tags_known))[: self.functions_of]
            if self.python:
                got = by_python(self.measurement, "double")(*(as_map(c, k) for c, k in given))
            else:
                got = self.measurement(*(c for c, _ in given))
        elif known is not None and self.measurement not in known:
            got = F.lit(None)
        else:
            got = measurements[self.measurement]
        return (got * self.scale if self.scale is not None else got).cast("double")

    def tag_entries(self, metadata: Column, known: Fields = None) -> Column:
        if not self.tag_values:
            return entries(metadata, self.tags, known)
        if self.python:
            return entries(by_python(self.tag_values, "map<string,string>")(as_map(metadata, known)), self.tags)
        return entries(self.tag_values(metadata), self.tags)

    def kept(self, metadata: Column, known: Fields = None) -> Column:
        if not self.keep:
            return F.lit(True)
        return F.coalesce(by_python(self.keep, "boolean")(as_map(metadata, known)) if self.python else self.keep(metadata), F.lit(False))


@dataclass(frozen=True)
class LoggedEvent:
    """An event for the log: ``tags`` are an allow-list, ``measurement_values`` transforms (key, value) columns.

    ``measurements_values`` is accepted as another name of ``measurement_values``.
    ``translate`` does the same by a Python function of (key, value), batch by batch; a
    value that it fails on becomes null.
    """

    event_name: str
    tags: tuple[str, ...] = ()
    measurement_values: Callable[[Column, Column], Column] | None = None
    measurements_values: Callable[[Column, Column], Column] | None = None
    translate: Callable[[str, float], float] | None = None
    group: str = "default"

    @property
    def event(self) -> str:
        return parse_name(self.event_name)

    def tag_map(self, metadata: Column, known: Fields = None) -> Column:
        return take_present(metadata, self.tags, known)

    def measured(self, measurements: Column, known: Fields = None) -> Column:
        measurements = as_map(measurements, known)
        if self.translate:
            f = self.translate

            def one(k, v):
                try:
                    return f(k, v)
                except Exception:
                    return None

            return by_python(lambda m: None if m is None else {k: one(k, v) for k, v in m.items()}, "map<string,double>")(measurements)
        change = self.measurement_values or self.measurements_values
        return F.transform_values(measurements, change) if change else measurements


@dataclass(frozen=True)
class Retention:
    """How many snapshots each tier keeps; 0 keeps none."""

    day: int = 60
    hour: int = 48
    minute: int = 120
    second: int = 120

    def items(self) -> list[tuple[str, int, int]]:
        """(tier, seconds, capacity), coarsest first."""
        return [("day", 86400, self.day), ("hour", 3600, self.hour), ("minute", 60, self.minute), ("second", 1, self.second)]


@dataclass(frozen=True)
class Config:
    """An engine instance: its metrics, logged events, retention, where it persists, and the seconds between snapshots of a started one."""

    metrics: tuple[Metric, ...] = ()
    events: tuple[LoggedEvent, ...] = ()
    instance: str = "pulsegrid"
    persistence_dir: str = "/data"
    retention: Retention = field(default_factory=Retention)
    event_log_size: int = 500
    session: str | None = None
    autosave_interval: int | None = None
    snapshot_interval: int = 1
