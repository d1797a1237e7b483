"""Telemetry from the driver's tables: seq, ts, event_name, measurements, metadata.

Measurements and metadata may be maps, or structs, of which only the fields that a
definition asks for are read from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TELEMETRY = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("measurements", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def from_events(events: DataFrame, by_type: bool = False) -> DataFrame:
    """The events table as telemetry; ``by_type`` gives each type an event name of its own."""
    name = F.concat(F.lit("app.event."), F.col("event_type")) if by_type else F.lit("app.event")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        name.alias("event_name"),
        F.struct("value", F.round(F.col("value") * 100).alias("value_cents")).alias("measurements"),
        F.struct("event_type", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("k")).alias("metadata"),
    )


def source_events(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), by_type)


def stream_events(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """The same as a stream over the table's files."""
    return from_events(spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir), by_type)


def source_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as day-granular telemetry; its arrival order is by ship date, order and line."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.lit("shop.line").alias("event_name"),
        F.struct(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")).alias("measurements"),
        F.struct(F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus")).alias("metadata"),
    )
