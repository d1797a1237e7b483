"""The registered queries of the telemetry engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import clean_name, seconds
from pulsegrid.operators import event_log, exports, reports
from pulsegrid.operators import history as hist
from pulsegrid.operators import state as st
from pulsegrid.plans import range_query
from pulsegrid.plans.definitions import Kind, LoggedEvent, Metric, Retention
from pulsegrid.sources import metrics_file
from pulsegrid.sources.telemetry import source_events, source_lineitem, stream_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 1706572800
"""2024-01-30 00:00:00 UTC, a moment in the last day of the events."""
BY_TYPE = ("event_type",)
CENTS = "value_cents"
EVENT = "app.event"

# the events table in whole seconds, cents and tag keys
EV = """ev AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS s, user_id, event_type, value,
        round(value * 100) AS cents, regexp_extract(props, '[0-9]+') AS k,
        '{"event_type":"' || event_type || '"}' AS tags_key FROM events)"""
# the kept ticks of one tick a second between the first and the last event
TICKS = """ticks AS (SELECT s AS tick, tier FROM (
        SELECT s, tier, row_number() OVER (PARTITION BY tier ORDER BY s DESC) AS r FROM (
            SELECT s, CASE WHEN p IS NULL OR s // 86400 <> p // 86400 THEN 'day' WHEN s // 3600 <> p // 3600 THEN 'hour'
                           WHEN s // 60 <> p // 60 THEN 'minute' ELSE 'second' END AS tier
            FROM (SELECT s, CASE WHEN s > (SELECT min(s) FROM ev) THEN s - 1 END AS p
                  FROM (SELECT unnest(range((SELECT min(s) FROM ev), (SELECT max(s) FROM ev) + 1)) AS s))))
        WHERE r <= CASE tier WHEN 'day' THEN 60 WHEN 'hour' THEN 48 ELSE 120 END)"""
HISTORY = f"""{EV}, {TICKS}, hist AS (
        SELECT tick AS timestamp, tier, event_type, tags_key, count(*) AS n, sum(cents) AS total, arg_max(value, seq) AS last_value,
               min(value) AS lo, max(value) AS hi, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS dev
        FROM ticks JOIN ev ON s <= tick GROUP BY ALL)"""


def metric(kind: Kind, measurement=None, tags=BY_TYPE, name=None, **more) -> Metric:
    return Metric(EVENT, kind, measurement, name or f"m.{kind.value}", tags, **more)


COUNTER = metric(Kind.COUNTER)
LAST = metric(Kind.LAST_VALUE, "value")
SUM = metric(Kind.SUM, CENTS)
SUMMARY = metric(Kind.SUMMARY, "value")
ALL_KINDS = (COUNTER, LAST, SUM, SUMMARY)


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def state_of(spark: SparkSession, sf_dir: str, *metrics: Metric) -> DataFrame:
    return st.current_state(source_events(spark, sf_dir), metrics)


def history_of(spark: SparkSession, sf_dir: str, *metrics: Metric) -> DataFrame:
    return hist.snapshots(spark, source_events(spark, sf_dir), metrics)


def tag(name: str = "event_type"):
    return F.col("tags")[name].alias(name)


def whole(column: str, name: str):
    return F.col(column).cast("long").alias(name)


# current state


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counter_by_type(spark, sf_dir):
    return state_of(spark, sf_dir, COUNTER).select(tag(), whole("value", "n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' AND user_id % 2 = 0 GROUP BY event_type")
def counter_with_keep(spark, sf_dir):
    keep = lambda m: (m["event_type"] != "view") & (m["user_id"].cast("long") % 2 == 0)
    return state_of(spark, sf_dir, metric(Kind.COUNTER, keep=keep)).select(tag(), whole("value", "n"))


@query("SELECT event_type, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type")
def last_value_by_type(spark, sf_dir):
    return state_of(spark, sf_dir, LAST).select(tag(), F.col("value").alias("last_value"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id")
def last_value_by_user(spark, sf_dir):
    return state_of(spark, sf_dir, metric(Kind.LAST_VALUE, "value", ("user_id",))).select(tag("user_id"), F.col("value").alias("last_value"))


@query("SELECT event_type, CAST(sum(round(value * 100)) AS BIGINT) AS total FROM events GROUP BY event_type")
def sum_cents_by_type(spark, sf_dir):
    return state_of(spark, sf_dir, SUM).select(tag(), whole("value", "total"))


@query("SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def sum_lineitem_by_flag(spark, sf_dir):
    m = Metric("shop.line", Kind.SUM, "quantity", tags=("returnflag", "linestatus"))
    return st.current_state(source_lineitem(spark, sf_dir), [m]).select(tag("returnflag"), tag("linestatus"), whole("value", "quantity"))


SUMMARY_SQL = """SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 6) AS average,
        round(coalesce(stddev_samp(value), 0), 6) AS std_dev, count(*) AS reports FROM events GROUP BY event_type"""


@query(SUMMARY_SQL)
def summary_by_type(spark, sf_dir):
    rows = st.metric_rows(source_events(spark, sf_dir), [SUMMARY]).withColumn("event_type", F.map_from_entries("tags")["event_type"])
    return st.summary_of(rows, "event_type").withColumns({c: F.round(c, 6) for c in ("average", "std_dev")})


@query("SELECT event_id AS seq, value AS min, value AS max, value AS average, CAST(0 AS DOUBLE) AS std_dev FROM events")
def summary_single_report(spark, sf_dir):
    rows = st.metric_rows(source_events(spark, sf_dir), [metric(Kind.SUMMARY, "value", ())])
    return st.summary_of(rows, "seq").drop("reports")


@query(SUMMARY_SQL)
def summary_merge_partials(spark, sf_dir):
    events = source_events(spark, sf_dir)
    halves = [st.current_state(events.filter(f"seq % 2 = {i}"), [SUMMARY]) for i in (0, 1)]
    merged = st.merge_state(*halves).withColumn("c", st.calculate(F.col("summary")))
    return merged.select(tag(), "c.min", "c.max", F.round("c.average", 6).alias("average"), F.round("c.std_dev", 6).alias("std_dev"), F.col("summary.reports").alias("reports"))


@query("SELECT event_type, CAST(sum(round(value * 100) + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS BIGINT) AS total FROM events GROUP BY event_type")
def measurement_fn(spark, sf_dir):
    m = metric(Kind.SUM, lambda values, metadata: values[CENTS] + metadata["k"].cast("double"), functions_of=2)
    return state_of(spark, sf_dir, m).select(tag(), whole("value", "total"))


@query("SELECT event_type, CAST(sum(CASE WHEN event_id % 3 <> 0 THEN round(value * 100) END) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def measurement_null_skipped(spark, sf_dir):
    events = source_events(spark, sf_dir)
    events = events.withColumn("measurements", F.when(F.col("seq") % 3 != 0, F.col("measurements")))
    state = st.current_state(events, [SUM, COUNTER])
    pivoted = state.groupBy(tag()).pivot("type", ["sum", "counter"]).agg(F.first("value"))
    return pivoted.select("event_type", whole("sum", "total"), whole("counter", "n"))


@query("SELECT event_type, round(max(value * 0.001), 9) AS kilo FROM events GROUP BY event_type")
def unit_convert(spark, sf_dir):
    m = metric(Kind.SUMMARY, "value", scale=0.001)
    return state_of(spark, sf_dir, m).select(tag(), F.round("summary.max", 9).alias("kilo"))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN '{\"event_type\":\"' || event_type || '\",\"k\":null}' ELSE '{\"event_type\":\"' || event_type || '\",\"k\":\"odd\"}' END AS tags_key, count(*) AS n FROM events GROUP BY 1")
def tags_take(spark, sf_dir):
    change = lambda m: F.create_map(F.lit("event_type"), m["event_type"], F.lit("k"), F.when(m["user_id"].cast("long") % 2 != 0, "odd"), F.lit("user_id"), m["user_id"])
    return state_of(spark, sf_dir, metric(Kind.COUNTER, tags=("event_type", "k", "absent"), tag_values=change)).select("tags_key", whole("value", "n"))


@query("SELECT CASE WHEN user_id % 2 = 0 THEN '{}' ELSE '{\"k\":\"odd\"}' END AS tags_key, count(*) AS n FROM events GROUP BY 1")
def event_tags_drop_nil(spark, sf_dir):
    events = source_events(spark, sf_dir)
    user = F.col("metadata")["user_id"].cast("long")
    events = events.withColumn("metadata", F.create_map(F.lit("k"), F.when(user % 2 != 0, "odd"), F.lit("z"), F.lit("z")))
    rows = event_log.log_rows(events, [LoggedEvent(EVENT, tags=("k",))], "s")
    return rows.groupBy(st.tags_key(F.col("tags")).alias("tags_key")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, value + 1 AS value, round(value * 100) * 2 AS value_cents FROM events")
def measurement_transform(spark, sf_dir):
    change = lambda key, value: F.when(key == "value", value + 1).otherwise(value * 2)
    rows = event_log.log_rows(source_events(spark, sf_dir), [LoggedEvent(EVENT, measurement_values=change)], "s")
    return rows.select("seq", F.col("measurements")["value"].alias("value"), F.col("measurements")["value_cents"].alias("value_cents"))


@query("SELECT 'app.event.' || event_type AS name, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def dispatch_by_name(spark, sf_dir):
    defs = [Metric(f".app..event.{t}", Kind.COUNTER) for t in ("click", "view")]
    return st.current_state(source_events(spark, sf_dir, by_type=True), defs).select("name", whole("value", "n"))


@query("SELECT DISTINCT 'app.event' AS name FROM events")
def name_parse(spark, sf_dir):
    return source_events(spark, sf_dir).select(clean_name(F.concat(F.lit("."), F.replace("event_name", F.lit("."), F.lit("..")))).alias("name")).distinct()


PIVOT_SQL = """SELECT event_type, CAST(count(*) AS DOUBLE) AS counter, arg_max(value, event_id) AS last_value, sum(round(value * 100)) AS sum FROM events GROUP BY event_type"""


@query(PIVOT_SQL)
def state_pivot(spark, sf_dir):
    state = state_of(spark, sf_dir, COUNTER, LAST, SUM)
    return state.groupBy(tag()).pivot("type", ["counter", "last_value", "sum"]).agg(F.first("value"))


@query("SELECT 'm.counter' AS name, event_type, count(*) AS n FROM events GROUP BY event_type")
def state_prune(spark, sf_dir):
    state = state_of(spark, sf_dir, COUNTER, metric(Kind.COUNTER, tags=(), name="m.gone"), metric(Kind.COUNTER, tags=("user_id",)))
    return st.prune(spark, state, [COUNTER]).select("name", tag(), whole("value", "n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type")
def state_remove(spark, sf_dir):
    return st.remove(state_of(spark, sf_dir, COUNTER), "m.counter", Kind.COUNTER, {"event_type": "click"}).select(tag(), whole("value", "n"))


@query("SELECT 'sum' AS type, event_type, CAST(sum(round(value * 100)) AS BIGINT) AS total FROM events GROUP BY event_type")
def state_by_name(spark, sf_dir):
    return st.by_name(state_of(spark, sf_dir, COUNTER, SUM), "m.sum").select("type", tag(), whole("value", "total"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS total, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type")
def state_merge(spark, sf_dir):
    events = source_events(spark, sf_dir)
    cut = events.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    halves = [st.current_state(events.filter(F.col("seq") <= cut), [COUNTER, LAST, SUM]), st.current_state(events.filter(F.col("seq") > cut), [COUNTER, LAST, SUM])]
    pivoted = st.merge_state(*halves).groupBy(tag()).pivot("type", ["counter", "last_value", "sum"]).agg(F.first("value"))
    return pivoted.select("event_type", whole("counter", "n"), whole("sum", "total"), "last_value")


# tiers and history

TIER_SQL = """WITH a AS (SELECT seq, s, max(CASE WHEN s >= 0 THEN s END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ({})) 
        SELECT seq, s AS second, CASE WHEN p IS NULL OR s // 86400 <> p // 86400 THEN 'day' WHEN s // 3600 <> p // 3600 THEN 'hour'
               WHEN s // 60 <> p // 60 THEN 'minute' ELSE 'second' END AS tier FROM a WHERE s >= 0 AND (p IS NULL OR s > p)"""


@query(TIER_SQL.format("SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events"))
def tier_assign(spark, sf_dir):
    rows = source_events(spark, sf_dir).select("seq", seconds(F.col("ts")).alias("second"))
    return hist.assign_tiers(rows).select("seq", "second", "tier")


@query(TIER_SQL.format("SELECT event_id AS seq, CASE WHEN event_id % 13 = 0 THEN -1 ELSE CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 7 = 0 THEN 9000 ELSE 0 END END AS s FROM events"))
def tier_assign_out_of_order(spark, sf_dir):
    second = seconds(F.col("ts")) - F.when(F.col("seq") % 7 == 0, 9000).otherwise(0)
    rows = source_events(spark, sf_dir).select("seq", F.when(F.col("seq") % 13 == 0, -1).otherwise(second).cast("long").alias("second"))
    return hist.assign_tiers(rows).select("seq", "second", "tier")


@query(f"WITH {EV}, {TICKS} SELECT tick, tier FROM ticks")
def retained_ticks(spark, sf_dir):
    lo, hi = source_events(spark, sf_dir).agg(F.min(seconds(F.col("ts"))), F.max(seconds(F.col("ts")))).first()
    return hist.ticks_of(spark, lo, hi).select(F.col("second").alias("tick"), "tier")


@query(
    """WITH a AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events GROUP BY 1), b AS (SELECT s, lag(s) OVER (ORDER BY s) AS p FROM a),
        c AS (SELECT s, CASE WHEN p IS NULL OR s // 86400 <> p // 86400 THEN 'day' WHEN s // 3600 <> p // 3600 THEN 'hour' WHEN s // 60 <> p // 60 THEN 'minute' ELSE 'second' END AS tier FROM b)
        SELECT s AS second, tier FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY s DESC) AS r FROM c) WHERE r <= CASE tier WHEN 'day' THEN 5 WHEN 'hour' THEN 7 WHEN 'minute' THEN 11 ELSE 13 END"""
)
def retention_custom(spark, sf_dir):
    rows = source_events(spark, sf_dir).select("seq", seconds(F.col("ts")).alias("second"))
    return hist.retain(hist.assign_tiers(rows), Retention(5, 7, 11, 13)).select("second", "tier")


@query(
    f"""WITH {HISTORY} SELECT timestamp, tier, event_type, n, CAST(total AS BIGINT) AS total, last_value, lo, hi, round(mean, 6) AS average, round(dev, 4) AS std_dev FROM hist"""
)
def history_snapshot(spark, sf_dir):
    points = history_of(spark, sf_dir, *ALL_KINDS).withColumn("event_type", tag())
    of = lambda kind, column: F.max(F.when(F.col("type") == kind.value, F.col(column)))
    wide = points.groupBy("timestamp", "tier", "event_type").agg(
        of(Kind.COUNTER, "value").cast("long").alias("n"),
        of(Kind.SUM, "value").cast("long").alias("total"),
        of(Kind.LAST_VALUE, "value").alias("last_value"),
        of(Kind.SUMMARY, "summary").alias("s"),
    )
    c = st.calculate(F.col("s"))
    return wide.select("timestamp", "tier", "event_type", "n", "total", "last_value", c["min"].alias("lo"), c["max"].alias("hi"), F.round(c["average"], 6).alias("average"), F.round(c["std_dev"], 4).alias("std_dev"))


def points(name: str, where: str, tail: str = "event_type = 'click'") -> str:
    return f"WITH {HISTORY} SELECT timestamp, CAST({name} AS BIGINT) AS value FROM hist WHERE {tail} AND {where}"


def series_query(spark, sf_dir, **options):
    history = history_of(spark, sf_dir, COUNTER)
    return range_query.metrics(history, "m.counter", Kind.COUNTER, {"event_type": "click"}, now=NOW, **options).select("timestamp", whole("value", "value"))


@query(points("n", f"timestamp BETWEEN {NOW - 864000} AND {NOW - 86400}"))
def history_range(spark, sf_dir):
    return series_query(spark, sf_dir, from_=NOW - 864000, to=NOW - 86400)


@query(points("n", f"timestamp >= {NOW - 172800}"))
def history_from(spark, sf_dir):
    return series_query(spark, sf_dir, from_=NOW - 172800, last=5)


@query(points("n", f"timestamp >= {NOW - 7200}"))
def history_last_units(spark, sf_dir):
    return series_query(spark, sf_dir, last=(2, "hour"))


@query(points("n", f"timestamp >= {NOW - 180}"))
def history_default_last(spark, sf_dir):
    return series_query(spark, sf_dir)


@query(points("n", f"timestamp >= {NOW - 3 * 86400}"))
def history_to_ignored(spark, sf_dir):
    return series_query(spark, sf_dir, to=NOW - 86400, last=(3, "day"))


@query(points("n", "timestamp >= 0", "event_type = 'signup'"))
def history_exact_tags(spark, sf_dir):
    history = history_of(spark, sf_dir, COUNTER, metric(Kind.COUNTER, tags=()))
    return range_query.metrics(history, "m.counter", Kind.COUNTER, {"event_type": "signup"}, from_=0).select("timestamp", whole("value", "value"))


@query(f"WITH {HISTORY} SELECT timestamp, CAST(sum(n) AS BIGINT) AS value FROM hist GROUP BY timestamp")
def history_untagged(spark, sf_dir):
    history = history_of(spark, sf_dir, COUNTER, metric(Kind.COUNTER, tags=()))
    return range_query.metrics(history, "m.counter", Kind.COUNTER, {}, from_=0).select("timestamp", whole("value", "value"))


@query(f"WITH {HISTORY} SELECT timestamp, round(mean, 6) AS value FROM hist WHERE event_type = 'view'")
def summary_field_series(spark, sf_dir):
    history = history_of(spark, sf_dir, SUMMARY)
    return range_query.metrics(history, "m.summary", ("summary", "average"), {"event_type": "view"}, from_=0).select("timestamp", F.round("value", 6).alias("value"))


@query(f"WITH {HISTORY} SELECT timestamp, CAST(NULL AS DOUBLE) AS value FROM hist WHERE event_type = 'view'")
def summary_unknown_field(spark, sf_dir):
    history = history_of(spark, sf_dir, SUMMARY)
    return range_query.metrics(history, "m.summary", ("summary", "median"), {"event_type": "view"}, from_=0).select("timestamp", "value")


@query(f"WITH {HISTORY} SELECT timestamp, lo AS min, hi AS max, round(mean, 6) AS average, round(dev, 4) AS std_dev FROM hist WHERE event_type = 'purchase'")
def summary_series(spark, sf_dir):
    history = history_of(spark, sf_dir, SUMMARY)
    rows = range_query.metrics(history, "m.summary", Kind.SUMMARY, {"event_type": "purchase"}, from_=0)
    return rows.select("timestamp", "value.min", "value.max", F.round("value.average", 6).alias("average"), F.round("value.std_dev", 4).alias("std_dev"))


@query(f"WITH {HISTORY} SELECT last_value AS value FROM hist WHERE event_type = 'error' AND timestamp >= {NOW - 86400}")
def series_values(spark, sf_dir):
    return range_query.series(history_of(spark, sf_dir, LAST), "m.last_value", "last_value", {"event_type": "error"}, last=(1, "day"), now=NOW)


# event log

LOGGED = [LoggedEvent(EVENT, tags=("event_type",))]
LOG_SQL = f"WITH {EV}, log AS (SELECT * FROM ev ORDER BY seq DESC LIMIT 500) "


def event_rows(spark, sf_dir) -> DataFrame:
    return event_log.log_rows(source_events(spark, sf_dir), LOGGED, "session-1")


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.col("tags")["event_type"].alias("event_type"), F.col("group").alias("grp"), "timestamp", "session", "seq", F.col("measurements")["value"].alias("value"))


LOG_COLUMNS = "'app.event' AS name, event_type, 'default' AS grp, s AS timestamp, 'session-1' AS session, seq, value"


@query(LOG_SQL + f"SELECT {LOG_COLUMNS} FROM log")
def event_log_last500(spark, sf_dir):
    return shown(event_log.last_by_arrival(event_rows(spark, sf_dir)))


@query(LOG_SQL + f"SELECT {LOG_COLUMNS} FROM log WHERE s BETWEEN {NOW - 86400} AND {NOW - 3600}")
def event_log_range(spark, sf_dir):
    return shown(event_log.listed(event_log.last_by_arrival(event_rows(spark, sf_dir)), NOW - 86400, NOW - 3600))


@query(LOG_SQL + f"SELECT {LOG_COLUMNS} FROM log WHERE s BETWEEN 0 AND {NOW - 43200}")
def event_log_future_hidden(spark, sf_dir):
    return shown(event_log.listed(event_log.last_by_arrival(event_rows(spark, sf_dir)), now=NOW - 43200))


SYNC = (900, 1000, 1705000000)
"""Arrival at which the clock is set, and the seconds it then goes from and to."""


@query(
    f"""WITH {EV}, pre AS (SELECT * FROM ev WHERE seq < {SYNC[0]} ORDER BY seq DESC LIMIT 100),
        both_ AS (SELECT seq, event_type, CASE WHEN {SYNC[2]} < s THEN s ELSE s + {SYNC[2] - SYNC[1]} END AS timestamp FROM pre
                  UNION ALL SELECT seq, event_type, s FROM ev WHERE seq >= {SYNC[0]})
        SELECT * FROM both_ ORDER BY seq DESC LIMIT 5000"""
)
def clock_corrected_log(spark, sf_dir):
    rows = event_log.synchronized_log(event_rows(spark, sf_dir), *SYNC, size=5000)
    return rows.select("seq", F.col("tags")["event_type"].alias("event_type"), "timestamp")


# incremental reports

POLLS = (NOW - 43200, NOW + 86400)


@query(LOG_SQL + f"SELECT {LOG_COLUMNS} FROM log WHERE s BETWEEN 0 AND {POLLS[0]}")
def latest_events_poll1(spark, sf_dir):
    return shown(reports.latest_events(event_log.last_by_arrival(event_rows(spark, sf_dir)), reports.Cursor(), POLLS[0])[0])


@query(LOG_SQL + f"SELECT {LOG_COLUMNS} FROM log WHERE s BETWEEN {POLLS[0] + 1} AND {POLLS[1]}")
def latest_events_poll2(spark, sf_dir):
    log = event_log.last_by_arrival(event_rows(spark, sf_dir))
    cursor = reports.latest_events(log, reports.Cursor(), POLLS[0])[1]
    return shown(reports.latest_events(log, cursor, POLLS[1])[0])


def report_sql(low: int, high: int) -> str:
    return f"""WITH {HISTORY} SELECT 'm.counter' AS name, 'counter' AS type, tags_key, timestamp, CAST(n AS DOUBLE) AS value, CAST(NULL AS BIGINT) AS reports FROM hist WHERE timestamp BETWEEN {low} AND {high}
        UNION ALL SELECT 'm.summary', 'summary', tags_key, timestamp, NULL, n FROM hist WHERE timestamp BETWEEN {low} AND {high}"""


def report(rows: DataFrame) -> DataFrame:
    return rows.select("name", "type", "tags_key", "timestamp", "value", F.col("summary.reports").alias("reports"))


@query(report_sql(0, POLLS[0]))
def latest_metrics_poll1(spark, sf_dir):
    return report(reports.latest_metrics(history_of(spark, sf_dir, COUNTER, SUMMARY), reports.Cursor(), POLLS[0])[0])


@query(report_sql(POLLS[0] + 1, POLLS[1]))
def latest_metrics_poll2(spark, sf_dir):
    history = history_of(spark, sf_dir, COUNTER, SUMMARY)
    cursor = reports.latest_metrics(history.limit(0), reports.Cursor(), POLLS[0])[1]
    return report(reports.latest_metrics(history, cursor, POLLS[1])[0])


# exports


@query(f"WITH {HISTORY} SELECT concat_ws(',', timestamp, 'm.counter', 'counter', n) AS line FROM (SELECT timestamp, sum(n)::BIGINT AS n FROM hist GROUP BY 1)")
def csv_no_header(spark, sf_dir):
    history = history_of(spark, sf_dir, metric(Kind.COUNTER, tags=()))
    return exports.csv_rows(range_query.metrics(history, "m.counter", "counter", {}, from_=0), "m.counter").select("line")


@query(f"WITH {HISTORY} SELECT 'timestamp,name,type,value' AS line UNION ALL SELECT concat_ws(',', timestamp, 'm.counter', 'counter', n) FROM (SELECT timestamp, sum(n)::BIGINT AS n FROM hist GROUP BY 1)")
def csv_lines(spark, sf_dir):
    header = spark.createDataFrame([(",".join(exports.CSV_HEADER),)], "line string")
    return header.union(csv_no_header(spark, sf_dir))


@query(f"WITH {HISTORY} SELECT concat_ws(',', timestamp, 'm.sum', 'sum', CAST(total AS BIGINT), event_type, '') AS line FROM hist WHERE event_type = 'click'")
def csv_tagged(spark, sf_dir):
    history = history_of(spark, sf_dir, SUM)
    rows = range_query.metrics(history, "m.sum", "sum", {"event_type": "click"}, from_=0)
    return exports.csv_rows(rows, "m.sum", ("event_type", "extra")).select("line")


@query(f"WITH {HISTORY} SELECT 'm.counter' AS name, 'counter' AS type, timestamp, event_type, CAST(n AS DOUBLE) AS value FROM hist")
def mbf_roundtrip(spark, sf_dir):
    from pulsegrid.runtime import Scratch

    metrics_file.register(spark)
    path = Scratch(spark, "export").path("mbf")
    metrics_file.points_of(history_of(spark, sf_dir, COUNTER, SUMMARY)).write.format("metrics_file").mode("append").save(path)
    return spark.read.format("metrics_file").load(path).select("name", "type", "timestamp", tag(), "value")


@query(None)
def mbf_reject_invalid(spark, sf_dir):
    """What parsing says of damaged and malformed exports."""
    good = {"name": "a", "type": "counter", "value": 1, "tags": {}, "timestamp": 1}
    bad = [{"name": "a"}, good | {"timestamp": ""}, good | {"name": 123}, good | {"type": "another_type"}, good | {"tags": []}, good | {"value": "a value"}]
    cases = {f"field {i}": bytes([1]) + metrics_file.zlib.compress(metrics_file.json.dumps(p).encode()) for i, p in enumerate(bad)}
    cases |= {"bytes": bytes([1, 4]), "version": bytes([64, 2, 3, 4]), "good": metrics_file.encode([good])}
    out = []
    for name, data in cases.items():
        try:
            out.append((name, f"{len(metrics_file.parse(data))} points"))
        except metrics_file.BinaryFormatError as e:
            out.append((name, e.reason))
    return spark.createDataFrame(out, "input string, outcome string")


@query(None)
def ascii_plot(spark, sf_dir):
    text = exports.plot(history_of(spark, sf_dir, SUMMARY), "m.summary", ("summary", "average"), {"event_type": "view"}, last=(1, "day"), now=NOW)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "row int, text string")


# streams


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counter(spark, sf_dir):
    from pulsegrid.streaming.continuous import drain, streaming_state

    return drain(spark, streaming_state(stream_events(spark, sf_dir), [COUNTER])).select(tag(), whole("value", "n"))


@query("SELECT event_type, arg_max(value, event_id) AS last_value FROM events GROUP BY event_type")
def stream_last_value(spark, sf_dir):
    from pulsegrid.streaming.continuous import drain, streaming_state

    return drain(spark, streaming_state(stream_events(spark, sf_dir), [LAST])).select(tag(), F.col("value").alias("last_value"))


def in_batches(spark, sf_dir, scratch, n: int) -> DataFrame:
    """The events as a stream of ``n`` micro-batches: all of them, in order of time, a folder of files for each."""
    from pulsegrid.sources.telemetry import EVENTS, from_events

    events, path = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"), scratch.path("arrivals")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * i / n for i in range(n)] if lo else []
    for low, high in zip(cuts, [*cuts[1:], None]):
        some = events.filter(F.col("ts") >= low)
        (some if high is None else some.filter(F.col("ts") < high)).coalesce(1).write.mode("append").parquet(path)
    return from_events(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path))


@query(f"WITH {HISTORY} SELECT timestamp, event_type, n FROM hist")
def stream_history(spark, sf_dir):
    from pulsegrid.plans.definitions import Config
    from pulsegrid.plans.engine import Engine
    from pulsegrid.runtime import Scratch
    from pulsegrid.streaming.continuous import feed

    scratch = Scratch(spark, "stream")
    engine = Engine(spark, Config(metrics=(COUNTER,), persistence_dir=scratch.path("engine")))
    feed(engine, in_batches(spark, sf_dir, scratch, 4), scratch.path("checkpoint"), every=None).awaitTermination()
    return engine.history.select("timestamp", tag(), whole("value", "n"))


# an engine's own life: persistence, reports and exports


def engine_of(spark, *metrics, **more):
    from pulsegrid.plans.definitions import Config
    from pulsegrid.plans.engine import Engine
    from pulsegrid.runtime import Scratch

    return Engine(spark, Config(metrics=metrics, events=tuple(LOGGED), persistence_dir=Scratch(spark, "engine").path("data"), session="session-1", **more))


def restarted(spark, sf_dir, *metrics):
    """An engine that took half of the events, was saved and started again, and then took the rest."""
    from pulsegrid.plans.engine import Engine

    events = source_events(spark, sf_dir)
    cut = events.agg(F.expr("percentile_approx(unix_micros(CAST(ts AS TIMESTAMP)), 0.5)")).first()[0] or 0
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= cut
    first = engine_of(spark, *metrics)
    first.ingest(events.filter(early), batch_id=0)
    first.stop()
    second = Engine(spark, first.config)
    second.ingest(events.filter(early), batch_id=0)  # a replay, which counts once
    second.ingest(events.filter(~early), batch_id=1)
    second.save()
    return Engine(spark, first.config)


@query(f"WITH {HISTORY} SELECT timestamp, tier, event_type, CAST(n AS DOUBLE) AS counter, last_value, CAST(total AS DOUBLE) AS sum FROM hist")
def engine_restarted_history(spark, sf_dir):
    history = restarted(spark, sf_dir, COUNTER, LAST, SUM).history
    return history.groupBy("timestamp", "tier", tag()).pivot("type", ["counter", "last_value", "sum"]).agg(F.first("value"))


@query("SELECT 'm.counter' AS name, event_type, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS BIGINT) AS reports FROM events GROUP BY ALL UNION ALL SELECT 'm.summary', event_type, NULL, count(*) FROM events GROUP BY ALL")
def engine_restarted_state(spark, sf_dir):
    return restarted(spark, sf_dir, COUNTER, SUMMARY).state.select("name", tag(), "value", F.col("summary.reports").alias("reports"))


@query(LOG_SQL + f"SELECT {LOG_COLUMNS} FROM log")
def engine_restarted_log(spark, sf_dir):
    from pulsegrid.plans.engine import Engine

    engine = engine_of(spark)
    engine.ingest(source_events(spark, sf_dir))
    engine.save()
    return shown(Engine(spark, engine.config).list_events(to=NOW + 10**6))


@query("""SELECT 'm.counter' AS name, '{"event_type":"' || event_type || '"}' AS tags_key, CAST(count(*) AS VARCHAR) AS counter, CAST(CAST(sum(round(value * 100)) AS BIGINT) AS VARCHAR) AS sum
        FROM events GROUP BY event_type""")
def state_info(spark, sf_dir):
    state = state_of(spark, sf_dir, COUNTER, metric(Kind.SUM, CENTS, name="m.counter"))
    return st.info(state).select("name", "tags_key", "counter", "sum")


@query(LOG_SQL + "SELECT seq, s AS timestamp, value FROM log")
def log_binary_roundtrip(spark, sf_dir):
    from pulsegrid.sources import log_file

    rows = log_file.parse(log_file.to_binary(event_log.last_by_arrival(event_rows(spark, sf_dir))))
    return spark.createDataFrame([(r["seq"], r["timestamp"], r["measurements"]["value"]) for r in rows], "seq long, timestamp long, value double")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(user_id AS BIGINT)) AS BIGINT) AS total FROM events WHERE user_id % 10 <> 0 GROUP BY event_type")
def failing_function_isolated(spark, sf_dir):
    """A measurement that fails on some events skips those; the metrics beside it go on."""
    broken = metric(Kind.SUM, lambda values, tags: F.when(tags["user_id"].cast("long") % 10 != 0, tags["user_id"]).otherwise("none").cast("long").cast("double"), functions_of=2)
    keep = lambda m: m["user_id"].cast("long") % 10 != 0
    pivoted = state_of(spark, sf_dir, broken, metric(Kind.COUNTER, keep=keep)).groupBy(tag()).pivot("type", ["counter", "sum"]).agg(F.first("value"))
    return pivoted.select("event_type", whole("counter", "n"), whole("sum", "total"))


@query("SELECT event_type, CAST(sum(round(value * 100) + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS BIGINT) AS total FROM events WHERE user_id % 7 <> 0 GROUP BY event_type")
def measurement_python(spark, sf_dir):
    def total(values, tags):
        return values[CENTS] + float(tags["k"]) if int(tags["user_id"]) % 7 else 1 / 0

    return state_of(spark, sf_dir, metric(Kind.SUM, total, functions_of=2, python=True)).select(tag(), whole("value", "total"))


@query(SQL["clock_corrected_log"])
def engine_clock_set_late(spark, sf_dir):
    """An engine whose clock becomes right after its first events."""
    from pulsegrid.plans.definitions import Config
    from pulsegrid.plans.engine import Engine
    from pulsegrid.runtime import Scratch

    class Late:
        right = False

        def synchronized(self):
            return self.right

    clock, events = Late(), source_events(spark, sf_dir)
    engine = Engine(spark, Config(events=tuple(LOGGED), persistence_dir=Scratch(spark, "engine").path("data"), event_log_size=5000), clock)
    engine.clock.started, engine.clock.now = SYNC[1], lambda: SYNC[2]
    engine.ingest(events.filter(F.col("seq") < SYNC[0]))
    clock.right = engine.synchronized or True
    engine.ingest(events.filter(F.col("seq") >= SYNC[0]))
    engine.clock.stop()
    return engine.events.select("seq", F.col("tags")["event_type"].alias("event_type"), "timestamp")


@query(SQL["csv_lines"])
def csv_text(spark, sf_dir):
    text = exports.csv(history_of(spark, sf_dir, metric(Kind.COUNTER, tags=())), "m.counter", "counter", {}, from_=0)
    return spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query(SQL["csv_no_header"])
def csv_to_device(spark, sf_dir):
    import io

    out = io.StringIO()
    exports.csv(history_of(spark, sf_dir, metric(Kind.COUNTER, tags=())), "m.counter", "counter", {}, headers=False, iodevice=out, from_=0)
    return spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")


@query(f"WITH {HISTORY} SELECT CAST(row_number() OVER (ORDER BY timestamp) AS BIGINT) AS row, round(mean, 6) AS value FROM hist WHERE event_type = 'view'")
def series_list(spark, sf_dir):
    found = exports.values(history_of(spark, sf_dir, SUMMARY), "m.summary", ("summary", "average"), {"event_type": "view"}, from_=0)
    return spark.createDataFrame([(i + 1, round(v, 6)) for i, v in enumerate(found)], "row long, value double")


@query(SQL["mbf_roundtrip"])
def mbf_export_file(spark, sf_dir):
    from pulsegrid.runtime import Scratch, make_folder

    metrics_file.register(spark)
    folder = Scratch(spark, "export").path("mbf")
    make_folder(spark, folder)
    path = metrics_file.export(history_of(spark, sf_dir, COUNTER, SUMMARY), folder)
    return spark.read.format("metrics_file").load(path).select("name", "type", "timestamp", tag(), "value")
