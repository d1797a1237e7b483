"""Session settings and shared scratch tables that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.errors import PersistenceError

BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}
"""Settings of Arrow batches: Spark's default, and ours in its place."""
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(app: str = "pulsegrid", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when they share the driver's files.

    On a cluster without shared code ship the package with ``--py-files``. Batches for them
    are of 2,000 rows or 16 MB unless the session says otherwise: texts are long rows, of
    which the default of 10,000 holds much memory beside the heap. Workers give freed memory back.
    """
    for setting, (usual, ours) in BATCHES.items():
        if spark.conf.get(setting, usual) == usual:
            spark.conf.set(setting, ours)
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset.

    Our own is a temporary folder only where the executors are threads of this process;
    on a cluster it lies in the warehouse, which all machines reach.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        given = "file://" + tempfile.mkdtemp(prefix="pulsegrid-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.pulsegrid"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


_held: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Delete all scratch tables; done at exit where the session still runs. Results that read them must be used before."""
    while _held:
        spark, base = _held.pop()
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, base)
        except Exception:
            return  # the JVM is gone


class Scratch:
    """Intermediate tables written to the shared folder, which also cuts their lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/pulsegrid-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _held.append((spark, self.base))
        importable(spark)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and read it back; the copy knows its path for :meth:`drop`."""
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                delete(self.spark, path)


def located(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    system, target = located(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = located(spark, path)
    return system.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder if it isn't there; PersistenceError if that fails."""
    try:
        system, target = located(spark, path)
        made = system.mkdirs(target)
    except Exception as e:
        raise PersistenceError(path, str(e).splitlines()[0]) from e
    if not made:
        raise PersistenceError(path, "the folder can't be made")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    system, target = located(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written in one piece."""
    system, target = located(spark, path)
    out = system.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
