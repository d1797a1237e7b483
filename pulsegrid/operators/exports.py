"""Exports of a series: CSV lines, values, a chart."""

from __future__ import annotations

import json
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import UnsupportedMetricError
from pulsegrid.functions.chart import line_chart
from pulsegrid.functions.columns import number_text
from pulsegrid.plans.definitions import Kind
from pulsegrid.plans.range_query import metrics, series

CSV_HEADER = ("timestamp", "name", "type", "value")
PLOT_HEIGHT = 12


def plain(type) -> None:
    if type in (Kind.SUMMARY, Kind.SUMMARY.value):
        raise UnsupportedMetricError("summary")


def csv_rows(points: DataFrame, name: str, tag_names: tuple[str, ...] = ()) -> DataFrame:
    """(timestamp, line) for each point; a missing tag is empty, nothing is quoted."""
    tags = [F.coalesce(F.col("tags")[t], F.lit("")) for t in tag_names]
    cells = [F.col("timestamp").cast("string"), F.lit(name), F.col("type"), F.coalesce(number_text(F.col("value")), F.lit("")), *tags]
    return points.select("timestamp", F.concat_ws(",", *cells).alias("line"))


def csv(history: DataFrame, name: str, type, tags: dict | None = None, headers: bool = True, iodevice: IO[str] | None = None, **options) -> str | None:
    """The CSV text, or None after writing each line to ``iodevice``; a whole summary isn't supported."""
    plain(type)
    names = tuple(tags or {})
    rows = csv_rows(metrics(history, name, type, tags, **options), name, names)
    lines = [",".join((*CSV_HEADER, *names))] if headers else []
    lines += [r["line"] for r in rows.orderBy("timestamp").collect()]  # at most the kept ticks
    if iodevice is None:
        return "\n".join(lines)
    for line in lines:
        iodevice.write(line + "\n")
    return None


def values(history: DataFrame, name: str, type, tags: dict | None = None, **options) -> list:
    """The series as a list."""
    return [r["value"] for r in series(history, name, type, tags, **options).collect()]


def plot(history: DataFrame, name: str, type, tags: dict | None = None, **options) -> str:
    """A coloured heading and the chart of a series; ValueError("No data") if it is empty."""
    plain(type)
    chart = line_chart(values(history, name, type, tags, **options), height=PLOT_HEIGHT)
    return f"\t\t\x1b[33mMetric Name: {name}\x1b[0m, \x1b[36mTags: {json.dumps(tags or {}, sort_keys=True)}\x1b[0m\n\n{chart}"
