"""The current-state table: one pass over telemetry for all metrics.

Metrics of one event with the same tags and condition share a row and an aggregation;
their kinds come apart after it. Only the aggregates that the kinds need are computed,
all of them by hash aggregation with map-side partial sums.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import ENTRIES, fields_of, from_accumulated, key_of, number_text, seconds, tags_key
from pulsegrid.plans.definitions import Kind, Metric

log = logging.getLogger(__name__)
SUMMARY_FIELDS = ("min", "max", "accumulated", "accumulated_sqrd", "reports")
CALCULATED_FIELDS = ("min", "max", "average", "std_dev")
#: What each kind keeps of its values.
NEEDS = {Kind.COUNTER: {"n"}, Kind.SUM: {"n", "total"}, Kind.LAST_VALUE: {"n", "last"}, Kind.SUMMARY: {"n", "total", "squares", "lo", "hi"}}
PARTS = {"n": "long", "total": "double", "squares": "double", "lo": "double", "hi": "double", "last": "struct<seq:long,value:double>"}


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions built inside give null where they would fail on a row, so that one metric's failure stays its own."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


class Reading:
    """How a metric reads the events of a table."""

    def __init__(self, events: DataFrame):
        self.known, self.tags_known = (fields_of(events.schema[c].dataType) for c in ("measurements", "metadata"))

    def value(self, m: Metric) -> Column:
        return m.value(F.col("measurements"), F.col("metadata"), self.known, self.tags_known)

    def tags(self, m: Metric) -> Column:
        made = m.tag_entries(F.col("metadata"), self.tags_known)
        return made if m.tag_values or self.tags_known is not None else F.coalesce(made, F.array().cast(ENTRIES))

    def kept(self, m: Metric) -> Column:
        kept = m.kept(F.col("metadata"), self.tags_known)
        return kept & self.tags(m).isNotNull() if m.tag_values else kept

    def taken(self, m: Metric) -> Column:
        return (F.col("event_name") == m.event) & self.kept(m)


def usable(events: DataFrame, metric: Metric) -> bool:
    """Whether a metric's functions fit the events; one that doesn't is logged and left out, the others go on."""
    if not (callable(metric.measurement) or metric.keep or metric.tag_values):
        return True
    read = Reading(events)
    try:
        events.select(read.taken(metric), read.value(metric), read.tags(metric))
    except (AnalysisException, TypeError, ValueError) as e:
        log.warning("metric %s is left out: %s", metric.full_name, e)
        return False
    return True


def metric_rows(events: DataFrame, metrics: Sequence[Metric], *extra: Column) -> DataFrame:
    """One row (name, type, tags, value, seq, second) for each event and metric that takes it.

    A null measurement is skipped, and so is an event whose ``keep`` isn't true, or on
    which a function of the metric fails. The tags are sorted entries, which unlike maps
    can be grouped, joined and sorted. Event names are dotted without empty segments.
    """
    with lenient(events.sparkSession):
        read = Reading(events)
        metrics = [m for m in metrics if usable(events, m)]
        wanted = events.filter(F.col("event_name").isin(*sorted({m.event for m in metrics}))) if metrics else events.limit(0)
        taken = [F.when(read.taken(m) & read.value(m).isNotNull(), F.struct(F.lit(m.full_name).alias("name"), F.lit(m.kind.value).alias("type"), read.tags(m).alias("tags"), read.value(m).alias("value"))) for m in metrics]
        taken = taken or [F.lit(None).cast(f"struct<name:string,type:string,tags:{ENTRIES},value:double>")]
        second = seconds(F.col("ts")).alias("second")
        if len(taken) == 1:
            rows = wanted.select(taken[0].alias("m"), "seq", second, *extra).filter("m is not null")
        else:
            rows = wanted.select(F.explode(F.array_compact(F.array(*taken))).alias("m"), "seq", second, *extra)
        return rows.select("m.name", "m.type", "m.tags", "m.value", "seq", "second", *(c for c in rows.columns if c not in ("m", "seq", "second")))


def accumulated(events: DataFrame, metrics: Sequence[Metric], *keys: str) -> DataFrame:
    """Aggregates by (name, type, tags) and the columns ``keys`` that merge: n, total, squares, lo, hi, last (seq, value)."""
    with lenient(events.sparkSession):
        read = Reading(events)
        sets: dict[tuple, list[Metric]] = {}
        for m in metrics:
            if usable(events, m):
                sets.setdefault((m.event, m.tags, m.tag_values, m.keep, m.python), []).append(m)
        groups = [sorted(g, key=lambda m: list(Kind).index(m.kind)) for g in sets.values()]
        if not groups:
            return events.limit(0).select(F.lit("").alias("name"), F.lit("").alias("type"), F.array().cast(ENTRIES).alias("tags"), *keys, *(F.lit(None).cast(t).alias(p) for p, t in PARTS.items()))
        width = max(map(len, groups))
        nothing = F.lit(None).cast("double")
        rows = [
            F.when(read.taken(g[0]), F.struct(F.lit(i).alias("g"), read.tags(g[0]).alias("tags"), *((read.value(g[j]) if j < len(g) else nothing).alias(f"v{j}") for j in range(width))))
            for i, g in enumerate(groups)
        ]
        wanted = events.filter(F.col("event_name").isin(*sorted({g[0].event for g in groups})))
        if len(groups) == 1:
            m = groups[0][0]
            wanted = wanted.filter(read.kept(m))
            rows = wanted.select(F.lit(0).alias("g"), read.tags(m).alias("tags"), *(read.value(x).alias(f"v{j}") for j, x in enumerate(groups[0])), "seq", *keys)
        else:
            rows = wanted.select(F.explode(F.array_compact(F.array(*rows))).alias("m"), "seq", *keys).select("m.*", "seq", *keys)
    aggregates = []
    for j in range(width):
        kinds = {g[j].kind for g in groups if j < len(g)}
        v, need = F.col(f"v{j}"), set().union(*(NEEDS[k] for k in kinds))
        made = {"n": F.count(v), "total": F.sum(v), "squares": F.sum(v * v), "lo": F.min(v), "hi": F.max(v), "last": F.max_by(v, F.when(v.isNotNull(), F.col("seq")))}
        aggregates += [c.alias(f"{p}{j}") for p, c in made.items() if p in need]
        if "last" in need:
            aggregates.append(F.max(F.when(v.isNotNull(), F.col("seq"))).alias(f"seq{j}"))
    acc = rows.groupBy("g", "tags", *keys).agg(*aggregates)

    def part(m: Metric, j: int) -> Column:
        has = NEEDS[m.kind]
        given = {p: F.col(f"{p}{j}") for p in has if p != "last"}
        if "last" in has:
            given["last"] = F.struct(F.col(f"seq{j}").alias("seq"), F.col(f"last{j}").alias("value"))
        return F.struct(F.lit(m.full_name).alias("name"), F.lit(m.kind.value).alias("type"), *(given.get(p, F.lit(None)).cast(t).alias(p) for p, t in PARTS.items()))

    each = [F.array(*(part(m, j) for j, m in enumerate(g))) for g in groups]
    apart = each[0] if len(each) == 1 else F.coalesce(*(F.when(F.col("g") == i, e) for i, e in enumerate(each)))
    return acc.select("tags", *keys, F.explode(apart).alias("m")).filter("m.n > 0").select("m.name", "m.type", "tags", *keys, *(f"m.{p}" for p in PARTS))


def finished(acc: DataFrame, *keys: str) -> DataFrame:
    """The state columns of accumulated rows."""
    number = F.when(F.col("type") == Kind.COUNTER.value, F.col("n").cast("double")).when(F.col("type") == Kind.SUM.value, F.col("total")).when(F.col("type") == Kind.LAST_VALUE.value, F.col("last.value"))
    summary = F.when(F.col("type") == Kind.SUMMARY.value, F.struct(F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("total").alias("accumulated"), F.col("squares").alias("accumulated_sqrd"), F.col("n").alias("reports")))
    tags = F.map_from_entries("tags")
    return acc.select("name", "type", tags.alias("tags"), tags_key(tags).alias("tags_key"), number.alias("value"), summary.alias("summary"), *keys)


def current_state(events: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """name, type, tags, tags_key, value, summary of every series."""
    return finished(accumulated(events, metrics))


def merge_state(old: DataFrame, new: DataFrame, newer_last: bool = True) -> DataFrame:
    """Two state tables as one: counters and sums add up, summaries merge field by field, the newer last value wins."""
    both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1 if newer_last else -1)))
    s = F.col("summary")
    merged = both.groupBy("name", "type", "tags_key").agg(
        F.first("tags").alias("tags"),
        F.sum("value").alias("total"),
        F.max(F.struct("turn", "value")).alias("last"),
        F.min(s["min"]).alias("min"),
        F.max(s["max"]).alias("max"),
        F.sum(s["accumulated"]).alias("accumulated"),
        F.sum(s["accumulated_sqrd"]).alias("accumulated_sqrd"),
        F.sum(s["reports"]).alias("reports"),
    )
    value = F.when(F.col("type") == Kind.LAST_VALUE.value, F.col("last.value")).when(F.col("type") != Kind.SUMMARY.value, F.col("total"))
    summary = F.when(F.col("type") == Kind.SUMMARY.value, F.struct(*SUMMARY_FIELDS))
    return merged.select("name", "type", "tags", "tags_key", value.alias("value"), summary.alias("summary"))


def calculate(summary: Column) -> Column:
    """min, max, average and std_dev of an accumulated summary."""
    n, total, squares = summary["reports"], summary["accumulated"], summary["accumulated_sqrd"]
    return F.when(summary.isNotNull(), F.struct(summary["min"].alias("min"), summary["max"].alias("max"), (total / n).alias("average"), from_accumulated(n, total, squares).alias("std_dev")))


def summary_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Calculated summaries straight from metric rows, with a numerically stable deviation; 0 for one report."""
    return rows.groupBy(*keys).agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("average"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_dev"),
        F.count(F.lit(1)).alias("reports"),
    )


def by_name(state: DataFrame, name: str) -> DataFrame:
    """The entries of one metric name; an unknown name gives none."""
    return state.filter(F.col("name") == name)


def remove(state: DataFrame, name: str, kind: Kind, tags: dict[str, str | None]) -> DataFrame:
    """The state without one entry."""
    gone = (F.col("name") == name) & (F.col("type") == kind.value) & (F.col("tags_key") == key_of(tags))
    return state.filter(~gone)


def prune(spark: SparkSession, state: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """The entries whose name, type and tag keys a definition has."""
    known = [(m.full_name, m.kind.value, sorted(m.tags)) for m in metrics]
    if not known:
        return state.limit(0)
    defined = spark.createDataFrame(known, "name string, type string, tag_keys array<string>")  # a row for each definition
    keyed = state.withColumn("tag_keys", F.array_sort(F.map_keys("tags")))
    return keyed.join(F.broadcast(defined), ["name", "type", "tag_keys"], "left_semi").select(*state.columns)


def info(state: DataFrame) -> DataFrame:
    """One row for each (name, tags) with a column for each kind; summaries as text."""
    c = calculate(F.col("summary"))
    shown = F.when(F.col("type") == Kind.SUMMARY.value, F.format_string("min=%.2f max=%.2f average=%.2f std_dev=%.2f", c["min"], c["max"], c["average"], c["std_dev"])).otherwise(number_text(F.round("value", 2)))
    return state.groupBy("name", "tags_key").pivot("type", [k.value for k in Kind]).agg(F.first(shown))
