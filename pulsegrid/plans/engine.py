"""One engine instance: definitions, state, history, log, reports, exports and persistence."""

from __future__ import annotations

import json
import logging
import re
import threading
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.errors import DataLoadError
from pulsegrid.operators import event_log, exports, reports
from pulsegrid.operators import history as hist
from pulsegrid.operators import state as st
from pulsegrid.operators.clock import ClockMonitor
from pulsegrid.plans import range_query
from pulsegrid.plans.definitions import Config
from pulsegrid.runtime import Scratch, delete, exists, make_folder, names_in, write_text
from pulsegrid.sources import log_file, metrics_file
from pulsegrid.sources.telemetry import TELEMETRY

log = logging.getLogger(__name__)
FORMAT_VERSION = 2
MARK = "committed.json"
TABLES = ("history", "metrics_table", "event_log")
HISTORY = "name string, type string, tags map<string,string>, tags_key string, value double, summary struct<min:double,max:double,accumulated:double,accumulated_sqrd:double,reports:long>, timestamp long, tier string"
STATE = "name string, type string, tags map<string,string>, tags_key string, value double, summary struct<min:double,max:double,accumulated:double,accumulated_sqrd:double,reports:long>"
LOG = "name string, measurements map<string,double>, tags map<string,string>, `group` string, timestamp long, session string, seq long"
SCHEMAS = {"history": HISTORY, "metrics_table": STATE, "event_log": LOG}


def migrate_v1(rows: DataFrame) -> DataFrame:
    """History of format 1, whose names are lists of segments, in today's columns; its tiers are assigned anew."""
    from pulsegrid.functions.columns import name_of, tags_key

    named = rows.withColumn("name", name_of(F.col("name"))).withColumn("tags_key", tags_key(F.col("tags")))
    ticks = named.select(F.col("timestamp").alias("seq"), F.col("timestamp").alias("second")).distinct()
    tiers = hist.assign_tiers(ticks).select(F.col("second").alias("timestamp"), "tier")
    summary = F.lit(None).cast("struct<min:double,max:double,accumulated:double,accumulated_sqrd:double,reports:long>")
    value = F.col("value").cast("double")
    return named.join(F.broadcast(tiers), "timestamp").select("name", "type", "tags", "tags_key", value.alias("value"), summary.alias("summary"), "timestamp", "tier")  # a row for each kept tick


class Engine:
    """Holds the three tables; ``ingest`` adds a batch of telemetry to them, ``tick`` goes on without events.

    The state restored from ``persistence_dir``/``instance`` counts on; entries without
    a definition are pruned. Snapshots are taken once a second of the clock, whether or not
    events came: from the last one on to the last event, or to ``now``. Events of the last
    snapshot's second still count in it, older ones from it on. A batch whose ``batch_id``
    isn't newer than the last is skipped; the id is saved with the tables, so that a replay
    after a restart doesn't count twice either, and set after the work, so that a batch that
    failed can be tried again.

    ``start`` takes snapshots by the wall clock on a thread of its own until ``stop``.
    """

    def __init__(self, spark: SparkSession, config: Config, clock: event_log.Clock | None = None):
        self.spark, self.config = spark, config
        self.lock = threading.RLock()
        self.clock = ClockMonitor(clock, lock=self.lock)
        self.scratch = Scratch(spark, "engine")
        self.session = config.session or event_log.new_session()
        self.path = f"{config.persistence_dir.rstrip('/')}/{config.instance}"
        make_folder(spark, self.path)
        self.waiting = spark.createDataFrame([], LOG)
        self.cursor = reports.Cursor()
        self.version, about = self.committed()
        self.batch_id = about.get("batch_id", -1)
        self.state = st.prune(spark, self.load("metrics_table"), config.metrics)
        self.history = self.load("history")
        self.events = event_log.last_by_arrival(self.load("event_log"), config.event_log_size)
        self.ticks = sorted(tuple(r) for r in self.history.select("timestamp", "tier").distinct().collect())  # the kept ones, a few hundred
        self.last_tick = about.get("last_tick", self.ticks[-1][0] if self.ticks else None)
        self.clock.register(self.synchronize)
        self.clock.start()
        self.timer: threading.Timer | None = None
        self.ticker: threading.Timer | None = None
        self.schedule()

    @property
    def metrics(self) -> Sequence:
        """The configured metrics."""
        return self.config.metrics

    @property
    def synchronized(self) -> bool:
        """Whether the clock is right; asks it if it wasn't."""
        return self.clock.poll()

    def committed(self) -> tuple[int, dict]:
        """The newest whole version and what it says of itself; (0, {}) if there is none."""
        numbers = [int(n[1:]) for n in names_in(self.spark, self.path) if re.fullmatch(r"v\d+", n) and exists(self.spark, f"{self.path}/{n}/{MARK}")]
        if not numbers:
            return 0, {}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/v{max(numbers)}/{MARK}").collect())  # a line
        return max(numbers), json.loads(text)

    def load(self, table: str) -> DataFrame:
        """A saved table, or an empty one if there is none or it can't be read."""
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        path = f"{self.path}/v{self.version}/{table}" if self.version else f"{self.path}/{table}"
        if not exists(self.spark, path):
            return empty
        try:
            return self.read(path, SCHEMAS[table])
        except DataLoadError as e:
            log.warning("%s starts empty: %s", table, e)
            return empty

    def read(self, path: str, schema: str) -> DataFrame:
        """A saved table of this or the first format; DataLoadError "corrupt" or "unsupported_version" otherwise."""
        try:
            found = self.spark.read.parquet(path)
            versions = {r[0] for r in found.select("format_version").distinct().limit(3).collect()}
        except Exception as e:
            raise DataLoadError("corrupt") from e
        if not versions <= {1, FORMAT_VERSION}:
            raise DataLoadError("unsupported_version")
        if versions == {1}:
            return migrate_v1(found.drop("format_version"))
        wanted = self.spark.createDataFrame([], schema).columns
        if not set(wanted) <= set(found.columns):
            raise DataLoadError("corrupt")
        return found.select(*wanted)

    def ingest(self, telemetry: DataFrame, batch_id: int | None = None, now: int | None = None) -> None:
        """Add a batch: its state is merged, its snapshots follow the kept ones, its events join the log."""
        with self.lock:
            if batch_id is not None and batch_id <= self.batch_id:
                return
            lo, hi = hist.taken_span(telemetry, self.config.metrics)
            history, ticks, end = self.continued(telemetry, lo, max((x for x in (hi, now) if x is not None), default=None))
            state = self.scratch.write(st.merge_state(self.state, st.current_state(telemetry, self.config.metrics)), "state")
            rows, ready = event_log.log_rows(telemetry, self.config.events, self.session), self.synchronized
            log_, size = (self.events, self.config.event_log_size) if ready else (self.waiting, event_log.PRE_SYNC_SIZE)
            log_ = self.scratch.write(event_log.last_by_arrival(log_.unionByName(rows), size), "log")
            self.scratch.drop(self.state, self.history, self.events if ready else self.waiting)
            self.state, self.history, self.ticks, self.last_tick = state, history, ticks, end
            if ready:
                self.events = log_
            else:
                self.waiting = log_
            if batch_id is not None:
                self.batch_id = batch_id

    def tick(self, now: int | None = None) -> None:
        """Take the snapshots that are due up to ``now``, without events."""
        with self.lock:
            if self.last_tick is None and self.state.isEmpty():
                return
            now = int(time.time()) if now is None else now
            history, self.ticks, self.last_tick = self.continued(self.spark.createDataFrame([], TELEMETRY), now, now)
            self.scratch.drop(self.history)
            self.history = history

    def continued(self, telemetry: DataFrame, lo: int | None, end: int | None) -> tuple[DataFrame, list, int | None]:
        """History, kept ticks and last tick after one tick a second up to ``end``."""
        if end is None:
            return self.scratch.write(self.history, "history"), self.ticks, self.last_tick
        end = max(end, self.last_tick if self.last_tick is not None else end)
        ticks = hist.next_ticks(self.ticks, self.last_tick, lo if lo is not None else end, end, self.config.retention)
        fresh = [t for t in ticks if self.last_tick is None or t[0] >= self.last_tick]
        kept = self.spark.createDataFrame([(s,) for s, _ in ticks if not fresh or s < fresh[0][0]], "timestamp long")
        old = self.history.join(F.broadcast(kept), "timestamp", "left_semi").select(*self.history.columns)  # a few hundred ticks
        if fresh:
            new = hist.snapshots_at(self.spark, telemetry, self.config.metrics, fresh, self.state)
            old = old.unionByName(new.select(*self.history.columns))
        return self.scratch.write(old, "history"), ticks, end

    def remove(self, name: str, kind, tags: dict) -> None:
        self.state = st.remove(self.state, name, kind, tags)

    def info(self) -> DataFrame:
        return st.info(self.state)

    def query(self, name: str, type, tags: dict | None = None, **options) -> DataFrame:
        """Raw points of a series; how long it took to plan is logged."""
        began = time.monotonic()
        out = range_query.metrics(self.history, name, type, tags, **options)
        log.debug("metrics export of %s planned in %.3f s", name, time.monotonic() - began)
        return out

    def csv(self, name: str, type, tags: dict | None = None, **options):
        return exports.csv(self.history, name, type, tags, **options)

    def series(self, name: str, type, tags: dict | None = None, **options) -> list:
        return exports.values(self.history, name, type, tags, **options)

    def plot(self, name: str, type, tags: dict | None = None, **options) -> str:
        return exports.plot(self.history, name, type, tags, **options)

    def export(self, out_dir: str | None = None) -> bytes | str:
        return metrics_file.export(self.history, out_dir)

    def list_events(self, from_: int = 0, to: int | None = None, now: int | None = None) -> DataFrame:
        return event_log.listed(self.events, from_, to, now)

    def clear_events(self) -> None:
        """Empty the log and its file."""
        with self.lock:
            self.events = self.spark.createDataFrame([], LOG)
            self.save()

    def latest_events(self, now: int | None = None) -> DataFrame:
        rows, self.cursor = reports.latest_events(self.events, self.cursor, int(time.time()) if now is None else now)
        return rows

    def latest_metrics(self, now: int | None = None) -> DataFrame:
        rows, self.cursor = reports.latest_metrics(self.history, self.cursor, int(time.time()) if now is None else now)
        return rows

    def synchronize(self, sync_second: int, adjustment: int) -> None:
        """The clock is right: events that waited for it are corrected and join the log."""
        with self.lock:
            moved = event_log.corrected(self.waiting, sync_second, adjustment)
            self.events = event_log.last_by_arrival(self.events.unionByName(moved), self.config.event_log_size)
            self.waiting = self.spark.createDataFrame([], LOG)

    def events_binary(self, from_: int = 0, to: int | None = None) -> bytes:
        """The listed events as bytes."""
        return log_file.to_binary(self.list_events(from_, to))

    def save(self) -> dict[str, float]:
        """Write history, state and log, in that order, stopping at the first failure; seconds taken by table.

        They make a new version, which counts as a whole once its mark is written; older
        ones go then. The mark has the last batch and tick.
        """
        with self.lock:
            took, version = {}, self.version + 1
            base = f"{self.path}/v{version}"
            delete(self.spark, base)  # what a save that failed has left
            for table, df in zip(TABLES, (self.history, self.state, self.events), strict=True):
                began = time.monotonic()
                log.info("save of %s starts", table)
                try:
                    df.withColumn("format_version", F.lit(FORMAT_VERSION)).write.parquet(f"{base}/{table}")
                except Exception:
                    log.exception("save of %s failed", table)
                    raise
                took[table] = time.monotonic() - began
                log.info("save of %s took %.3f s", table, took[table])
            write_text(self.spark, f"{base}/{MARK}", json.dumps({"batch_id": self.batch_id, "last_tick": self.last_tick}))
            self.scratch.drop(self.history, self.state, self.events)
            self.history, self.state, self.events = (self.read(f"{base}/{t}", SCHEMAS[t]) for t in TABLES)
            for n in names_in(self.spark, self.path):
                if n != f"v{version}" and (re.fullmatch(r"v\d+", n) or n in TABLES):
                    delete(self.spark, f"{self.path}/{n}")
            self.version = version
            return took

    def schedule(self) -> None:
        """Save every ``autosave_interval`` seconds, if that is a positive number."""
        every = self.config.autosave_interval
        if isinstance(every, (int, float)) and not isinstance(every, bool) and every > 0:

            def turn() -> None:
                self.save()
                self.schedule()

            self.timer = threading.Timer(every, turn)
            self.timer.daemon = True
            self.timer.start()

    def start(self) -> None:
        """Take snapshots by the wall clock, every ``snapshot_interval`` seconds."""

        def turn() -> None:
            try:
                self.tick()
            finally:
                self.start()

        self.ticker = threading.Timer(self.config.snapshot_interval, turn)
        self.ticker.daemon = True
        self.ticker.start()

    def stop(self) -> None:
        """Stop the clock, the snapshots and saving by time, and save once more."""
        self.clock.stop()
        for timer in (self.timer, self.ticker):
            if timer:
                timer.cancel()
        self.save()
