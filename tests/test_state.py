import math
from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.operators import history as h
from pulsegrid.operators import state as st
from pulsegrid.plans import range_query as rq
from pulsegrid.plans.definitions import Kind, LoggedEvent, Metric
from pulsegrid.sources.telemetry import TELEMETRY


def events(spark, *rows):
    """Rows (second, name, measurements, metadata)."""
    data = [(i, datetime(1970, 1, 1, 0, s // 60, s % 60), n, m, t) for i, (s, n, m, t) in enumerate(rows)]
    return spark.createDataFrame(data, TELEMETRY)


def state(spark, rows, *metrics):
    return {(r.name, r.type, r.tags_key): r for r in st.current_state(events(spark, *rows), metrics).collect()}


def test_four_kinds(spark):
    rows = [(1, "a.b", {"v": 100.0}, {}), (2, "a.b", {"v": 400.0}, {}), (3, "a.b", None, {}), (3, "other", {"v": 9.0}, {})]
    got = state(spark, rows, *(Metric("a.b", k, "v", "a") for k in Kind))
    assert got["a", "counter", "{}"].value == 3
    assert got["a", "last_value", "{}"].value == 400 and got["a", "sum", "{}"].value == 500
    assert got["a", "summary", "{}"].summary.asDict() == {"min": 100, "max": 400, "accumulated": 500, "accumulated_sqrd": 170000, "reports": 2}


def test_calculated_summary(spark):
    df = st.current_state(events(spark, (1, "a", {"v": 100.0}, {}), (1, "a", {"v": 400.0}, {}), (1, "b", {"v": 0.1}, {})), [Metric("a", Kind.SUMMARY, "v"), Metric("b", Kind.SUMMARY, "v")])
    got = {r.name: r.c for r in df.select("name", st.calculate(F.col("summary")).alias("c")).collect()}
    assert got["a.v"].average == 250 and math.isclose(got["a.v"].std_dev, 212.13203435596427)
    assert got["b.v"].std_dev == 0


def test_tags_keep_null_and_drop_missing(spark):
    rows = [(1, "a", {}, {"t": None, "z": "1"}), (1, "a", {}, {"z": "1"}), (1, "a", {}, {"t": 'q"\\', "u": "2"})]
    got = state(spark, rows, Metric("a", Kind.COUNTER, tags=("u", "t")))
    assert set(k[2] for k in got) == {'{"t":null}', "{}", '{"t":"q\\"\\\\","u":"2"}'}


def test_keep_null_is_false_and_two_argument_measurement(spark):
    rows = [(1, "a", {"v": 1.0}, {"k": "2"}), (1, "a", {"v": 1.0}, {})]
    m = Metric("a", Kind.SUM, lambda v, d: v["v"] + d["k"].cast("double"), keep=lambda d: d["k"] == "2", functions_of=2)
    assert state(spark, rows, m)["a", "sum", "{}"].value == 3


def test_remove_prune_lookup_and_info(spark):
    df = st.current_state(events(spark, (1, "a", {"v": 1000.0}, {"t": "x"})), [Metric("a", k, "v", "a", ("t",)) for k in Kind])
    assert st.remove(df, "a", Kind.SUM, {"t": "x"}).count() == 3
    assert st.prune(spark, df, [Metric("a", Kind.SUM, "v", "a", ("t",)), Metric("a", Kind.COUNTER, "v", "a")]).count() == 1
    assert st.prune(spark, df, []).count() == 0
    assert st.by_name(df, "never.seen").count() == 0
    row = st.info(df).first()
    assert row.counter == "1" and "average=1000.00" in row.summary


def test_merge_equals_whole(spark):
    rows = [(i, "a", {"v": float(i * i % 7)}, {"t": str(i % 2)}) for i in range(20)]
    ms = [Metric("a", k, "v", "a", ("t",)) for k in Kind]
    whole = {(r.type, r.tags_key): (r.value, r.summary) for r in st.current_state(events(spark, *rows), ms).collect()}
    two = st.merge_state(st.current_state(events(spark, *rows[:9]), ms), st.current_state(events(spark, *rows[9:]), ms))
    assert {(r.type, r.tags_key): (r.value, r.summary) for r in two.collect()} == whole


def test_snapshots_carry_forward(spark):
    rows = [(1, "a", {"v": 1.0}, {}), (3, "a", {"v": 5.0}, {}), (5, "b", {"v": 7.0}, {})]
    df = h.snapshots(spark, events(spark, *rows), [Metric("a", Kind.COUNTER, "v", "a"), Metric("a", Kind.LAST_VALUE, "v", "a"), Metric("b", Kind.SUM, "v", "b")])
    got = {(r.name, r.type, r.timestamp): r.value for r in df.collect()}
    assert [got["a", "counter", s] for s in (1, 2, 3, 4, 5)] == [1, 1, 2, 2, 2]
    assert [got["a", "last_value", s] for s in (2, 3, 5)] == [1, 5, 5]
    assert got["b", "sum", 5] == 7 and ("b", "sum", 4) not in got
    assert h.snapshots(spark, events(spark), [Metric("a", Kind.COUNTER)]).count() == 0


def test_query_options():
    assert rq.bounds(now=1000) == (820, None)
    assert rq.bounds(last=5, now=1000) == (995, None)
    assert rq.bounds(last=(2, "minute"), to=7, now=1000) == (880, None)
    assert rq.bounds(from_=3, to=9, last=1, now=1000) == (3, 9)


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [(i, "a", {"v": 1.0}, {}) for i in range(1, 5)]
    path = str(tmp_path / "history")
    h.snapshots(spark, events(spark, *rows), [Metric("a", Kind.COUNTER, name="a")]).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = rq.metrics(spark.read.parquet(path), "a", "counter", {}, from_=2, to=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("GreaterThanOrEqual(timestamp,2)", "LessThanOrEqual(timestamp,3)", "EqualTo(name,a)", "EqualTo(tags_key"))
    assert sorted(r.timestamp for r in df.collect()) == [2, 3]


def test_both_names_of_the_transform():
    assert LoggedEvent("a", measurements_values=lambda k, v: v).measurements_values


def test_functions_that_fail_skip_their_metric_only(spark):
    rows = [(1, "a", {"v": 1.0}, {"k": "2"}), (2, "a", {"v": 1.0}, {"k": "x"}), (3, "a", {"v": 4.0}, None)]
    cast = Metric("a", Kind.SUM, lambda v, d: d["k"].cast("int").cast("double"), "cast", functions_of=2)
    plain = Metric("a", Kind.SUM, lambda v, d: 10 / float(d["k"]), "plain", functions_of=2, python=True)
    kept = Metric("a", Kind.COUNTER, name="kept", keep=lambda d: int(d["k"]) > 1, python=True)
    tagged = Metric("a", Kind.COUNTER, name="tagged", tags=("t",), tag_values=lambda d: {"t": d["k"] * 2, "u": "z"}, python=True)
    got = state(spark, rows, cast, plain, kept, tagged, Metric("a", Kind.COUNTER, name="n"))
    values = {k[0] + k[2]: r.value for k, r in got.items()}
    assert values == {"cast{}": 2, "plain{}": 5, "kept{}": 1, "n{}": 3, 'tagged{"t":"22"}': 1, 'tagged{"t":"xx"}': 1}


def test_plan_reads_only_what_is_asked_and_never_sorts(spark, small):
    from pulsegrid.sources.telemetry import source_events

    for metric, schema in ((Metric("app.event", Kind.COUNTER, tags=("event_type",)), "struct<event_type:string>"), (Metric("app.event", Kind.LAST_VALUE, "value", tags=("user_id",)), "struct<event_id:bigint,user_id:bigint,value:double>")):
        plan = st.current_state(source_events(spark, small), [metric])._jdf.queryExecution().executedPlan().toString()
        assert f"ReadSchema: {schema}\n" in plan and plan.count("HashAggregate") == 2 and "Sort" not in plan
    plan = st.current_state(source_events(spark, small, by_type=False), [Metric("app.event", k, "value", "m", ("event_type",)) for k in Kind])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan and plan.count("Generate") == 1
