"""Incremental reports: what is new since the last poll."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from pulsegrid.operators.event_log import listed
from pulsegrid.plans.range_query import in_range


@dataclass(frozen=True)
class Cursor:
    """Where the next event and metric reports start; None before the first."""

    events_next: int | None = None
    metrics_next: int | None = None


def latest_events(log: DataFrame, cursor: Cursor, now: int) -> tuple[DataFrame, Cursor]:
    """Log rows of [cursor or 0, now], and the cursor after them."""
    return listed(log, cursor.events_next or 0, now), replace(cursor, events_next=now + 1)


def latest_metrics(history: DataFrame, cursor: Cursor, now: int) -> tuple[DataFrame, Cursor]:
    """History of [cursor or 0, now], all kinds, summaries as accumulated; and the cursor after it."""
    return in_range(history, cursor.metrics_next or 0, now).orderBy("timestamp", "name", "type", "tags_key"), replace(cursor, metrics_next=now + 1)
