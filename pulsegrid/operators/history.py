"""Round-robin history: tiers, retention and snapshots.

A snapshot goes into the coarsest tier that is due. Its tier follows from its second
and the latest accepted second before it, so windows replace the sequential buffers.

Which ticks stay depends on the clock alone. So the kept ticks are found first, at
most the sum of the capacities; every event is then added to the first kept tick at or
after it, aggregated by series and tick before and after one shuffle, and the sums run
over the few ticks at which each series changes. No event meets more than one tick.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.columns import seconds
from pulsegrid.operators.state import accumulated, finished, metric_rows
from pulsegrid.plans.definitions import Metric, Retention

ARRIVAL_BLOCK = 1 << 16


def next_boundary(second: Column, step: int) -> Column:
    """The first multiple of ``step`` after a second."""
    return (F.floor(second / step) + 1) * step


def latest_before(rows: DataFrame) -> DataFrame:
    """``rows`` (seq, second) with ``prior``: the largest second from 0 on that arrived earlier, or null.

    A running maximum in arrival order: within blocks of seq, plus the maximum of the
    blocks before, so that only one row for each block meets in one task.
    """
    block = F.floor(F.col("seq") / ARRIVAL_BLOCK)
    valid = F.when(F.col("second") >= 0, F.col("second"))
    blocked = rows.withColumn("block", block)
    tops = blocked.groupBy("block").agg(F.max(valid).alias("top"))
    carried = tops.select("block", F.max("top").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = F.max(valid).over(W.partitionBy("block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return blocked.withColumn("inside", inside).join(carried, "block").withColumn("prior", F.greatest("inside", "carried")).drop("block", "inside", "carried")


def tier_of(second: Column, prior: Column) -> Column:
    """The tier of a second accepted after ``prior``; null if it isn't accepted: negative, or not after it."""
    changed = lambda step: F.floor(second / step) != F.floor(prior / step)
    tier = F.when(prior.isNull() | changed(86400), "day").when(changed(3600), "hour").when(changed(60), "minute").otherwise("second")
    return F.when((second >= 0) & (prior.isNull() | (second > prior)), tier)


def assign_tiers(rows: DataFrame) -> DataFrame:
    """The accepted rows of (seq, second, ...) with their tier; late and repeated seconds are dropped."""
    return latest_before(rows).withColumn("tier", tier_of(F.col("second"), F.col("prior"))).filter("tier is not null").drop("prior")


def retain(tiered: DataFrame, policy: Retention = Retention()) -> DataFrame:
    """The latest rows of each tier, as many as it holds."""
    held = F.coalesce(*(F.when(F.col("tier") == t, F.lit(cap)) for t, _, cap in policy.items()))
    most = max(cap for _, _, cap in policy.items())
    ranked = tiered.withColumn("rank", F.row_number().over(W.partitionBy("tier").orderBy(F.col("second").desc())))
    return ranked.filter(F.col("rank") <= most).filter(F.col("rank") <= held).drop("rank")


def kept_ticks(lo: int, hi: int, policy: Retention = Retention()) -> list[tuple[int, str]]:
    """(second, tier) of the ticks kept of one tick a second from ``lo`` to ``hi``.

    Looks only at the multiples of each tier's step that can still be there.
    """
    if hi < lo or hi < 0:
        return []
    lo = max(lo, 0)
    kept: dict[int, str] = {}
    coarser = None
    for tier, step, capacity in policy.items():
        first = lo - lo % step + (step if lo % step else 0)
        found: list[int] = []
        at = hi - hi % step
        while at >= first and len(found) < capacity:
            if at != lo and (coarser is None or at % coarser):
                found.append(at)
            at -= step
        if tier == "day" and len(found) < capacity:
            found.append(lo)
        kept |= {s: tier for s in found}
        coarser = step
    return sorted(kept.items())


def next_ticks(kept: list[tuple[int, str]], last: int | None, lo: int, hi: int, policy: Retention = Retention()) -> list[tuple[int, str]]:
    """The ticks kept after one tick a second went on to ``hi``: from ``lo`` if there were none, else from ``last``.

    A clock that stands or goes back adds none.
    """
    if last is None:
        return kept_ticks(lo, hi, policy)
    new = [(s, t) for s, t in kept_ticks(last, hi, policy) if s > last]
    room = {tier: capacity for tier, _, capacity in policy.items()}
    out = []
    for second, tier in sorted({*kept, *new}, reverse=True):
        if room.get(tier, 0) > 0:
            room[tier] -= 1
            out.append((second, tier))
    return out[::-1]


def ticks_of(spark: SparkSession, lo: int | None, hi: int | None, policy: Retention = Retention()) -> DataFrame:
    """The kept ticks of a span as a table of at most the sum of the capacities."""
    rows = [] if lo is None else kept_ticks(lo, hi, policy)
    return spark.createDataFrame(rows, "second long, tier string")


def taken_span(events: DataFrame, metrics: Sequence[Metric]) -> tuple[int | None, int | None]:
    """The first and last second of the events that some metric takes."""
    return tuple(metric_rows(events, metrics).agg(F.min("second"), F.max("second")).first())


def state_before(state: DataFrame, tick: int) -> DataFrame:
    """State rows as aggregates that were there before everything in ``tick``."""
    s = F.col("summary")
    reports = F.coalesce(s["reports"], F.when(F.col("type") == "counter", F.col("value").cast("long")), F.lit(1))
    last = F.struct(F.lit(-1).cast("long").alias("seq"), F.col("value").alias("value"))
    return state.select("name", "type", F.array_sort(F.map_entries("tags")).alias("tags"), F.lit(tick).cast("long").alias("tick"), reports.alias("n"), F.coalesce(s["accumulated"], "value").alias("total"), s["accumulated_sqrd"].alias("squares"), s["min"].alias("lo"), s["max"].alias("hi"), last.alias("last"))


def snapshots_at(spark: SparkSession, events: DataFrame, metrics: Sequence[Metric], ticks: Sequence[tuple[int, str]], before: DataFrame | None = None) -> DataFrame:
    """State columns with timestamp and tier at the given ticks, in order; each series from its first event on.

    A tick holds every event of no later second, and the state ``before``. Events go to
    the first tick at or after them and are aggregated there; running sums follow from one
    more shuffle by series, and a row for each change is repeated over the ticks up to the
    next one, so no series is joined with the ticks.
    """
    first, last = (ticks[0][0], ticks[-1][0]) if ticks else (0, -1)
    kept = spark.createDataFrame([([{"second": s, "tier": t} for s, t in ticks],)], "ticks array<struct<second:long,tier:string>>")  # one row of at most a few hundred ticks
    seconds_of = kept.select(F.col("ticks.second").alias("all"))
    # one row for each hour of the span: its kept ticks and the first one after it
    hours = spark.range(first // 3600, last // 3600 + 1).withColumnRenamed("id", "hour").crossJoin(F.broadcast(seconds_of))
    later = F.filter("all", lambda t: t >= F.col("hour") * 3600)
    upto = F.size(F.filter(later, lambda t: t < (F.col("hour") + 1) * 3600)) + 1
    hours = hours.select("hour", F.slice(later, 1, upto).alias("next"))
    at = F.when(F.size("next") == 1, F.col("next")[0]).otherwise(F.try_element_at(F.filter("next", lambda t: t >= F.col("second")), F.lit(1)))
    second = F.greatest(seconds(F.col("ts")), F.lit(first).cast("long"))
    aimed = events.withColumn("second", second).withColumn("hour", F.floor(F.col("second") / 3600)).join(hours, "hour").withColumn("tick", at).filter("tick is not null")
    sums = accumulated(aimed, metrics, "tick")
    if before is not None and ticks:
        sums = sums.unionByName(state_before(before, first))
    series = W.partitionBy("name", "type", "tags").orderBy("tick")
    run = series.rowsBetween(W.unboundedPreceding, 0)
    acc = sums.select("name", "type", "tags", "tick", F.lead("tick").over(series).alias("until"), *(f(c).over(run).alias(c) for c, f in (("n", F.sum), ("total", F.sum), ("squares", F.sum), ("lo", F.min), ("hi", F.max), ("last", F.max))))
    acc = acc.filter("until is null or until > tick").crossJoin(F.broadcast(kept))
    place = lambda c: F.array_position(F.col("ticks.second"), F.col(c))
    stay = F.coalesce(place("until"), F.size("ticks") + 1) - place("tick")
    acc = acc.withColumn("t", F.explode(F.slice("ticks", place("tick").cast("int"), stay.cast("int"))))
    return finished(acc.select("name", "type", "tags", "n", "total", "squares", "lo", "hi", "last", F.col("t.second").alias("timestamp"), "t.tier"), "timestamp", "tier")


def snapshots(spark: SparkSession, events: DataFrame, metrics: Sequence[Metric], policy: Retention = Retention(), span: tuple[int, int] | None = None) -> DataFrame:
    """The kept history: state columns with timestamp and tier; each series appears in every tick from its first event on.

    A tick at second s holds every event whose whole second is at most s. Ticks run once
    a second over ``span``, by default from the first to the last event taken.
    """
    lo, hi = taken_span(events, metrics) if span is None else span
    return snapshots_at(spark, events, metrics, [] if lo is None else kept_ticks(lo, hi, policy))
