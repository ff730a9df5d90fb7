"""Captures as partitioned Parquet: samples sorted by time, summary levels beside them, and counts of what passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from joulegrid.operators.buckets import LEVELS_NS, rolled_up, summary_level
from joulegrid.operators.ordered import DAY_NS, slice_length
from joulegrid.shared import settle
from joulegrid.sinks.capture_writer import FILE_ROWS


def write_samples(samples: DataFrame, path: str, slice_ns: int = DAY_NS, salts: int | None = None) -> None:
    """Sorted by time within files, so that row groups have narrow time bounds; a capture spreads over its slices.

    Every slice is cut into ``salts`` stretches of its own tasks, by default so many that the fullest has about
    ``FILE_ROWS`` samples.
    """
    salts = salts or max(1, -(-slice_ns // slice_length(samples, ["capture_id"], rows=FILE_ROWS, most_ns=slice_ns)))
    sliced = samples.withColumn("slice", F.floor(F.col("t_ns") / F.lit(slice_ns))).withColumn("_salt", F.pmod(F.floor(F.col("t_ns") * F.lit(salts) / F.lit(slice_ns)), F.lit(salts)))
    ordered = sliced.repartition("capture_id", "slice", "_salt").sortWithinPartitions("capture_id", "slice", "t_ns", "seq").drop("_salt")
    ordered.write.partitionBy("capture_id", "slice").option("compression", "zstd").parquet(path)


def write_levels(samples: DataFrame, path: str, widths: tuple[int, ...] = LEVELS_NS) -> None:
    """The finest level from samples, each coarser one from the level before it."""
    level = None
    for width in sorted(widths):
        level = settle(summary_level(samples, width) if level is None or width % before else rolled_up(level, width))
        before = width
        level.write.partitionBy("capture_id").parquet(f"{path}/width={width}")


def read_levels(spark: SparkSession, path: str, widths: tuple[int, ...] = LEVELS_NS) -> dict[int, DataFrame]:
    return {w: spark.read.parquet(f"{path}/width={w}") for w in widths}


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and an observation of how many passed and their last time once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), F.max("t_ns").alias("last_ns")), seen
