"""The table ``events`` read as captures: each user is a device, each row a sample and a firmware event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulegrid.schemas import EVENT_DEFS

#: Ids of the event types.
TYPE_IDS = {"click": 0x0101, "purchase": 0x0102, "error": 0x0110, "view": 0x0201, "signup": 0x0202}
DEFINITIONS = [
    ("CLICK_TO_PURCHASE", 0x0101, 0x0102, "shop", None, 0),
    ("VIEW_TO_SIGNUP", 0x0201, 0x0202, "account", "k", 0),
    ("ERROR", 0x0110, None, None, None, 0),
]
NANOS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_samples(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("user_id").cast("string").alias("capture_id"),
        F.col("event_id").alias("seq"),
        F.expr(NANOS).alias("t_ns"),
        F.round(F.col("value") * 1000).cast("int").alias("current_ua"),
        F.expr("3300000L - event_id % 17").alias("voltage_uv"),
    )


def as_events(rows: DataFrame) -> DataFrame:
    ids = F.create_map(*[F.lit(x) for pair in TYPE_IDS.items() for x in pair])
    return rows.select(
        F.col("user_id").cast("string").alias("capture_id"),
        F.col("event_id").alias("seq"),
        F.expr(NANOS).alias("t_ns"),
        ids[F.col("event_type")].alias("id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("value"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "events"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def event_defs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFINITIONS, EVENT_DEFS)


def gpio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The low 16 bits of a row's value number as a pin snapshot."""
    return events(spark, sf_dir).select("capture_id", "seq", "t_ns", ((F.col("value") * 517 + F.col("seq")) % 65536).cast("int").alias("state"))
