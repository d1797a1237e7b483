"""Range queries over history: options, exact series match, summary projections."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import key_of, parse_name
from pulsegrid.operators.state import CALCULATED_FIELDS, calculate
from pulsegrid.plans.definitions import UNITS, Kind

DEFAULT_LAST = 180


def bounds(from_: int | None = None, to: int | None = None, last: int | tuple[int, str] | None = None, now: int | None = None) -> tuple[int, int | None]:
    """(from, to) of a query's options: ``from_`` beats ``last``, which is 180 s by default; ``to`` counts only beside ``from_``."""
    if from_ is not None:
        return from_, to
    now = int(time.time()) if now is None else now
    n, unit = last if isinstance(last, tuple) else (DEFAULT_LAST if last is None else last, "second")
    return now - n * UNITS[unit], None


def in_range(history: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Rows with low <= timestamp, and <= high if given; both bounds reach the scan."""
    rows = history.filter(F.col("timestamp") >= low)
    return rows if high is None else rows.filter(F.col("timestamp") <= high)


def metrics(
    history: DataFrame,
    name: str,
    type: str | Kind | tuple[str, str],
    tags: dict[str, str | None] | None = None,
    from_: int | None = None,
    to: int | None = None,
    last: int | tuple[int, str] | None = None,
    now: int | None = None,
) -> DataFrame:
    """The points of one series, unordered: name, type, tags, tags_key, timestamp, value.

    Tags must be equal as a whole, so none selects the untagged series only. A summary's
    value is a struct of min, max, average and std_dev; type ("summary", field) gives one
    field as a number, null for an unknown field.
    """
    kind, field = (type[0], type[1]) if isinstance(type, tuple) else (type, None)
    kind = Kind(kind).value
    rows = in_range(history, *bounds(from_, to, last, now)).filter((F.col("name") == parse_name(name)) & (F.col("type") == kind) & (F.col("tags_key") == key_of(tags or {})))
    if kind != Kind.SUMMARY.value:
        value = F.col("value")
    elif field is None:
        value = calculate(F.col("summary"))
    else:
        value = calculate(F.col("summary"))[field] if field in CALCULATED_FIELDS else F.lit(None).cast("double")
    return rows.select("name", "type", "tags", "tags_key", "timestamp", value.alias("value"))


def series(history: DataFrame, name: str, type: str | Kind | tuple[str, str], tags: dict | None = None, **options) -> DataFrame:
    """The values of a series in order of time."""
    return metrics(history, name, type, tags, **options).orderBy("timestamp").select("value")
