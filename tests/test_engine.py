import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.errors import BinaryFormatError, DataLoadError, ExportFileError, PersistenceError, UnsupportedMetricError
from pulsegrid.operators import event_log, exports
from pulsegrid.plans.definitions import Config, Kind, LoggedEvent, Metric
from pulsegrid.plans.engine import HISTORY, LOG, Engine
from pulsegrid.sources import metrics_file as mf
from tests.test_state import events

EMPTY = "struct<min:double,max:double,accumulated:double,accumulated_sqrd:double,reports:long>"


def history(spark, *rows):
    """Points (timestamp, value, tags) of a last value."""
    from pulsegrid.functions.columns import key_of

    data = [("csv.test", "last_value", t, key_of(t), float(v), None, s, "second") for s, v, t in rows]
    return spark.createDataFrame(data, HISTORY)


PLAIN = [(1, 10, {}), (2, 13, {}), (4, 15, {}), (8, 16, {})]


def test_csv(spark):
    df = history(spark, *PLAIN)
    lines = "1,csv.test,last_value,10\n2,csv.test,last_value,13\n4,csv.test,last_value,15\n8,csv.test,last_value,16"
    assert exports.csv(df, "csv.test", "last_value", from_=0) == "timestamp,name,type,value\n" + lines
    assert exports.csv(df, "csv.test", "last_value", headers=False, from_=0) == lines
    out = io.StringIO()
    assert exports.csv(df, "csv.test", "last_value", headers=False, iodevice=out, from_=0) is None
    assert out.getvalue() == lines + "\n"
    tagged = history(spark, (1, 10, {"extra": "info"}))
    assert exports.csv(tagged, "csv.test", "last_value", {"extra": "info"}, from_=0) == "timestamp,name,type,value,extra\n1,csv.test,last_value,10,info"
    with pytest.raises(UnsupportedMetricError):
        exports.csv(df, "csv.test", "summary")
    with pytest.raises(UnsupportedMetricError):
        exports.plot(df, "csv.test", Kind.SUMMARY)
    assert exports.values(df, "csv.test", "last_value", from_=2, to=4) == [13, 15]
    assert "Metric Name: csv.test" in exports.plot(df, "csv.test", "last_value", from_=0)


def test_binary_format(spark, tmp_path):
    good = {"name": "test.m", "type": "counter", "value": 1, "tags": {}, "timestamp": 1}
    assert mf.parse(mf.encode([good])) == [good]
    bad = [{k: v for k, v in good.items() if k != "tags"}, good | {"timestamp": ""}, good | {"name": 123}, good | {"type": "another_type"}, good | {"tags": []}, good | {"value": "a value"}]
    for point in bad:
        with pytest.raises(BinaryFormatError) as e:
            mf.parse(bytes([1]) + mf.zlib.compress(mf.json.dumps(point).encode()))
        assert e.value.reason == "invalid_format"
    with pytest.raises(BinaryFormatError) as e:
        mf.parse(bytes([1, 4]))
    assert e.value.reason == "corrupt"
    with pytest.raises(BinaryFormatError):
        mf.parse(mf.encode([good | {"value": 1.5}]), strict=True)
    now = datetime(2024, 2, 3, 4, 5, 6)
    path = mf.export(history(spark, *PLAIN), str(tmp_path), now)
    assert path.endswith("20240203040506-metrics.mbf")
    with open(path, "rb") as file:
        assert [p["value"] for p in mf.parse(file.read())] == [10, 13, 15, 16]
    with pytest.raises(ExportFileError):
        mf.export(history(spark, *PLAIN), str(tmp_path), now)
    with pytest.raises(ExportFileError):
        mf.export(history(spark, *PLAIN), str(tmp_path / "none"), now)


def log(spark, *seconds):
    return spark.createDataFrame([("e", {}, {}, "default", s, "s", i) for i, s in enumerate(seconds)], LOG)


def test_event_log(spark):
    rows = log(spark, 1, 50, 55, 99, 100)
    seen = lambda **o: [r.timestamp for r in event_log.listed(rows, **o).collect()]
    assert seen(from_=50, to=99) == [50, 55, 99] and seen(to=50) == [1, 50] and seen(from_=2, now=60) == [50, 55]
    assert sorted(r.seq for r in event_log.last_by_arrival(rows, 2).collect()) == [3, 4]
    tied = event_log.listed(log(spark, 5, 3, 5, 3), now=9).collect()
    assert [r.seq for r in tied] == [1, 3, 0, 2]


def test_clock(spark):
    class Late:
        def synchronized(self):
            return False

    assert isinstance(Late(), event_log.Clock)
    rows = log(spark, 10, 11, 12, 5000, 5001)
    got = event_log.synchronized_log(rows, 4, 9, 4009, buffer=3).orderBy("seq").collect()
    assert [(r.seq, r.timestamp) for r in got] == [(1, 4011), (2, 4012), (3, 5000), (4, 5001)]


def test_clock_monitor(spark, tmp_path):
    from pulsegrid.operators.clock import ClockMonitor
    from pulsegrid.plans.definitions import Config

    class Set:
        right = False

        def synchronized(self):
            return self.right

    at, told = [100], []
    monitor = ClockMonitor(clock := Set(), lambda: at[0])
    monitor.register(lambda *x: told.append(x))
    assert not monitor.poll() and told == []
    clock.right, at[0] = True, 5000
    assert monitor.poll() and monitor.poll() and told == [(5000, 4900)]
    monitor.register(lambda *x: told.append(x))
    assert told[1] == (5000, 0)
    clock.right = False
    engine = Engine(spark, Config(events=(LoggedEvent("a", translate=lambda k, v: v + 1),), persistence_dir=str(tmp_path)), clock)
    engine.clock.started, engine.clock.now = 10, lambda: 1010
    engine.ingest(events(spark, (11, "a", {"v": 1.0}, {}), (12, "a", None, {})))
    assert engine.list_events(now=5000).count() == 0
    clock.right = True
    assert engine.synchronized
    assert [(r.timestamp, r.measurements) for r in engine.list_events(now=5000).collect()] == [(1011, {"v": 2.0}), (1012, None)]


def test_log_binary(spark):
    from pulsegrid.sources import log_file

    data = log_file.to_binary(log(spark, 5, 3))
    assert [r["timestamp"] for r in log_file.parse(data)] == [3, 5]
    assert log_file.parse(bytes([1])) == []
    for bad in (b"", b"\x02", b"\x01{", b"\x01[1]", b"\x01\xff"):
        with pytest.raises(BinaryFormatError):
            log_file.parse(bad)


def test_engine_life(spark, tmp_path):
    metrics = (Metric("a", Kind.COUNTER, name="a.count"), Metric("a", Kind.SUMMARY, "v", "a.v"))
    config = Config(metrics, (LoggedEvent("a", ("t",)),), persistence_dir=str(tmp_path), session="run")
    engine = Engine(spark, config)
    assert engine.synchronized and engine.metrics == metrics
    engine.ingest(events(spark, (1, "a", {"v": 1.0}, {"t": "x"}), (2, "a", {"v": 3.0}, {"t": None})), batch_id=0)
    engine.ingest(events(spark, (9, "a", {"v": 3.0}, {})), batch_id=0)
    assert engine.series("a.count", "counter", from_=0) == [1, 2]
    assert engine.series("a.v", ("summary", "average"), from_=0) == [1, 2]
    first = [r.tags for r in engine.latest_events(now=1).collect()]
    assert first == [{"t": "x"}] and [r.timestamp for r in engine.latest_events(now=5).collect()] == [2]
    assert engine.latest_metrics(now=5).count() == 4 and engine.latest_metrics(now=9).count() == 0
    assert list(engine.save()) == ["history", "metrics_table", "event_log"]
    again = Engine(spark, config)
    again.ingest(events(spark, (5, "a", {"v": 8.0}, {})))
    assert again.series("a.count", "counter", from_=0) == [1, 2, 2, 2, 3]
    assert again.list_events(now=10).count() == 3
    again.clear_events()
    assert again.list_events(now=10).count() == 0
    assert Engine(spark, Config((), persistence_dir=str(tmp_path))).state.count() == 0
    again.remove("a.count", Kind.COUNTER, {})
    assert again.info().count() == 1


def test_damaged_files(spark, tmp_path):
    config = Config(persistence_dir=str(tmp_path))
    folder = tmp_path / "pulsegrid" / "history"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"@\x02\x03\x04")
    engine = Engine(spark, config)
    assert engine.history.count() == 0
    with pytest.raises(DataLoadError) as e:
        engine.read(str(folder), HISTORY)
    assert e.value.reason == "corrupt"
    other = str(tmp_path / "other")
    spark.sql("SELECT 1 AS a, 7 AS format_version").write.parquet(other)
    with pytest.raises(DataLoadError) as e:
        engine.read(other, HISTORY)
    assert e.value.reason == "unsupported_version"


def test_first_format(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([(["vm", "memory"], "counter", 3, {"t": "x"}, 61, 1)], "name array<string>, type string, value long, tags map<string,string>, timestamp long, format_version int").write.parquet(path)
    row = Engine(spark, Config(persistence_dir=str(tmp_path))).read(path, HISTORY).first()
    assert (row.name, row.value, row.tags_key, row.tier) == ("vm.memory", 3.0, '{"t":"x"}', "day")


def test_autosave(spark, tmp_path):
    engine = Engine(spark, Config(persistence_dir=str(tmp_path), autosave_interval=3600))
    assert engine.timer.interval == 3600
    engine.stop()
    assert (tmp_path / "pulsegrid" / "v1" / "metrics_table").exists()
    assert Engine(spark, Config(persistence_dir=str(tmp_path), autosave_interval=0)).timer is None


def points(engine):
    return {(r.name, r.type, r.tags_key, r.timestamp): (r.value, r.summary, r.tier) for r in engine.history.collect()}


def test_batches_and_restarts_equal_one_batch(spark, tmp_path):
    """Gaps, a second split over two batches, a batch without events, a replay, a restart and a failed batch."""
    rows = [(1, "a", {"v": 1.0}, {"t": "x"}), (4, "a", {"v": 2.0}, {"t": "x"}), (4, "a", {"v": 5.0}, {"t": "y"}), (9, "a", {"v": 3.0}, {"t": "x"}), (75, "a", {"v": 7.0}, {})]
    metrics = tuple(Metric("a", k, "v", "a", ("t",)) for k in Kind)
    make = lambda name: Engine(spark, Config(metrics, (LoggedEvent("a"),), instance=name, persistence_dir=str(tmp_path), session="s"))
    whole = events(spark, *rows)
    one = make("one")
    one.ingest(whole)
    want = points(one)
    assert len({k[3] for k in want}) == 75 and {v[2] for v in want.values()} == {"day", "minute", "second"}
    many = make("many")
    many.ingest(whole.filter("seq < 2"), 0)
    many.ingest(whole.filter("seq = 2"), 1)
    many.ingest(whole.limit(0), 2)
    many.save()
    many = make("many")
    assert many.batch_id == 2 and many.last_tick == 4
    many.ingest(whole.filter("seq = 2"), 1)
    broken = whole.filter("seq = 3").withColumn("seq", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        many.ingest(broken, 3)
    many.ingest(whole.filter("seq = 3"), 3)
    many.tick(30)
    many.tick(20)
    many.ingest(whole.filter("seq = 4"), 4)
    assert points(many) == want
    assert {r.seq for r in many.events.collect()} == set(range(5))
    state = lambda e: {(r.type, r.tags_key): (r.value, r.summary) for r in e.state.collect()}
    assert state(many) == state(one)
    late = events(spark, (2, "a", {"v": 1.0}, {"t": "x"}))
    many.ingest(late, 5)
    assert many.series("a", "counter", {"t": "x"}, from_=74) == [3, 4] and many.last_tick == 75


def test_save_counts_once_whole(spark, tmp_path, monkeypatch):
    config = Config((Metric("a", Kind.COUNTER, name="a"),), persistence_dir=str(tmp_path))
    engine = Engine(spark, config)
    engine.ingest(events(spark, (1, "a", {}, {})), 0)
    engine.save()
    engine.ingest(events(spark, (2, "a", {}, {})), 1)
    monkeypatch.setattr("pulsegrid.plans.engine.write_text", lambda *x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.save()
    again = Engine(spark, config)
    assert again.batch_id == 0 and again.state.first().value == 1
    monkeypatch.undo()
    again.ingest(events(spark, (2, "a", {}, {})), 1)
    again.save()
    assert Engine(spark, config).state.first().value == 2
    assert [p.name for p in (tmp_path / "pulsegrid").iterdir() if not p.name.startswith(".")] == ["v2"]


def test_instance_folder(spark, tmp_path):
    Engine(spark, Config(instance="new", persistence_dir=str(tmp_path / "deep")))
    assert (tmp_path / "deep" / "new").is_dir()
    (tmp_path / "file").write_text("x")
    with pytest.raises(PersistenceError):
        Engine(spark, Config(persistence_dir=str(tmp_path / "file")))


def test_engine_polls_its_clock_and_takes_snapshots(spark, tmp_path):
    import time

    class Set:
        right = False

        def synchronized(self):
            return self.right

    engine = Engine(spark, Config((Metric("a", Kind.COUNTER, name="a"),), (LoggedEvent("a"),), persistence_dir=str(tmp_path)), clock := Set())
    engine.ingest(events(spark, (1, "a", {}, {})))
    clock.right = True
    until = time.time() + 30
    while engine.events.isEmpty() and time.time() < until:
        time.sleep(0.5)
    assert engine.events.count() == 1
    engine.start()
    while engine.last_tick == 1 and time.time() < until:
        time.sleep(0.5)
    engine.stop()
    assert engine.last_tick > 10**9 and engine.series("a", "counter", from_=10**9)[-1] == 1
