"""Waveforms in buckets: min, max, mean and count by time, the two summary levels, and the choice between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joulegrid.operators.ordered import DAY_NS, HOUR_NS, numbered

#: Widths of the stored levels for fast captures; slower ones use hours and days.
LEVELS_NS = (10_000_000, 1_000_000_000)
SLOW_LEVELS_NS = (HOUR_NS, DAY_NS)
#: Buckets of a dense level that are made at once.
STRETCH = 1_000_000


def extremes(current: str = "current_ua") -> list:
    return [
        F.min(current).alias("min_ua"), F.max(current).alias("max_ua"), F.count(current).alias("count"),
        F.sum(F.col(current).cast("bigint")).alias("sum_ua"),
    ]


def with_mean(df: DataFrame) -> DataFrame:
    mean = F.when(F.col("count") > 0, F.round(F.col("sum_ua").cast("double") / F.col("count").cast("double"), 6))
    return df.withColumn("mean_ua", mean).drop("sum_ua")


def downsample(samples: DataFrame, n: int, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Exactly ``n`` buckets for every capture, of width ceil(span / n); an empty one has count 0 and null extremes.

    The span is each capture's own from its first sample to 1 ns past its last, or the given one.
    """
    spans = samples.groupBy("capture_id").agg(F.min("t_ns").alias("first"), (F.max("t_ns") + 1).alias("last"))
    start, end = F.lit(start_ns).cast("bigint"), F.lit(end_ns).cast("bigint")
    spans = spans.select("capture_id", F.coalesce(start, "first").alias("start"), F.coalesce(end, "last").alias("end"))
    spans = spans.where("end > start").withColumn("width", F.ceil((F.col("end") - F.col("start")) / F.lit(n)))
    whole = F.call_function("div", F.col("end") - F.col("start") + n - 1, F.lit(n).cast("bigint"))
    spans = spans.withColumn("width", whole)
    spine = spans.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("bucket", F.col("bucket").cast("bigint"))
    at = F.least(F.call_function("div", F.col("t_ns") - F.col("start"), F.col("width")), F.lit(n - 1).cast("bigint"))
    filled = samples.join(spans, "capture_id").where("t_ns >= start AND t_ns < end").groupBy("capture_id", at.alias("bucket")).agg(*extremes())
    out = spine.join(filled, ["capture_id", "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    return with_mean(out).select("capture_id", "bucket", (F.col("start") + F.col("bucket") * F.col("width")).alias("t_ns"), "min_ua", "max_ua", "mean_ua", "count")


def summary_level(samples: DataFrame, width_ns: int, dense: bool = False) -> DataFrame:
    """Buckets of a fixed width from time 0. Dense levels also have the empty buckets up to a capture's last one.

    ``sum_ua`` stays, so that levels can be rolled up without losing weights.
    """
    at = F.call_function("div", F.col("t_ns"), F.lit(width_ns).cast("bigint"))
    level = samples.groupBy("capture_id", at.alias("bucket")).agg(*extremes())
    if dense:
        ends = level.groupBy("capture_id").agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
        # A year of 10 ms buckets is beyond any array, so stretches of a million are dealt out first.
        stretch = lambda c: F.call_function("div", F.col(c), F.lit(STRETCH).cast("bigint"))
        parts = ends.select("capture_id", "_a", "_b", F.explode(F.sequence(stretch("_a"), stretch("_b"))).alias("_k")).repartition("capture_id", "_k")
        first, last = F.greatest("_a", F.col("_k") * STRETCH), F.least("_b", (F.col("_k") + 1) * STRETCH - 1)
        spine = parts.select("capture_id", F.explode(F.sequence(first, last)).alias("bucket"))
        level = spine.join(level, ["capture_id", "bucket"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    return level.withColumn("t_ns", F.col("bucket") * width_ns)


def rolled_up(level: DataFrame, width_ns: int) -> DataFrame:
    """A coarser level from a finer one whose width divides it."""
    at = F.call_function("div", F.col("t_ns"), F.lit(width_ns).cast("bigint"))
    sums = level.groupBy("capture_id", at.alias("bucket")).agg(F.min("min_ua").alias("min_ua"), F.max("max_ua").alias("max_ua"), F.sum("count").alias("count"), F.sum("sum_ua").alias("sum_ua"))
    return sums.withColumn("t_ns", F.col("bucket") * width_ns)


def bucket_range(level: DataFrame, width_ns: int, start_ns: int, end_ns: int) -> DataFrame:
    """Buckets of a level that overlap a half-open span, those that straddle its ends included."""
    return level.where((F.col("t_ns") + width_ns > start_ns) & (F.col("t_ns") < end_ns))


def coarsest(widths: tuple[int, ...], span_ns: int, n: int) -> int | None:
    """The widest stored level that still has ``n`` buckets in a span; None where samples must be read."""
    return max((w for w in widths if w * n <= span_ns), default=None)


def overview(samples: DataFrame, levels: dict[int, DataFrame], start_ns: int, end_ns: int, n: int) -> DataFrame:
    """``n`` buckets of a span, from the coarsest stored level that is fine enough, or from samples.

    A stored bucket counts where it begins, or in the first bucket if it begins before the span; counts and means keep
    their weights.
    """
    width = -(-(end_ns - start_ns) // n)
    level = coarsest(tuple(levels), end_ns - start_ns, n)
    source = bucket_range(levels[level], level, start_ns, end_ns) if level else samples.where((F.col("t_ns") >= start_ns) & (F.col("t_ns") < end_ns)).select("capture_id", "t_ns", F.col("current_ua").alias("min_ua"), F.col("current_ua").alias("max_ua"), F.lit(1).cast("bigint").alias("count"), F.col("current_ua").cast("bigint").alias("sum_ua"))
    at = F.greatest(F.least(F.call_function("div", F.col("t_ns") - start_ns, F.lit(width).cast("bigint")), F.lit(n - 1).cast("bigint")), F.lit(0).cast("bigint"))
    sums = source.groupBy("capture_id", at.alias("bucket")).agg(F.min("min_ua").alias("min_ua"), F.max("max_ua").alias("max_ua"), F.sum("count").alias("count"), F.sum("sum_ua").alias("sum_ua"))
    return with_mean(sums).withColumn("t_ns", F.lit(start_ns).cast("bigint") + F.col("bucket") * width)


def decimated(samples: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th sample of each capture in order, from the first; 0 counts as 1."""
    return numbered(samples, ("capture_id",), ("t_ns", "seq")).where(F.col("n") % max(1, every) == 0).drop("n")


def sparkline(buckets: DataFrame) -> DataFrame:
    """One line of text for each capture: eight heights of bucket maxima, a space where a bucket is empty."""
    high = F.max("max_ua").over(W.partitionBy("capture_id"))
    marks = "▁▂▃▄▅▆▇█"
    top = F.greatest(high, F.lit(1))
    step = F.least(F.greatest(F.floor(F.greatest("max_ua", F.lit(0)).cast("double") / top.cast("double") * F.lit(8.0)), F.lit(0)), F.lit(7)).cast("int")
    mark = F.when(F.col("count") == 0, " ").otherwise(F.substring(F.lit(marks), step + 1, F.lit(1)))
    drawn = buckets.withColumn("mark", mark)
    return drawn.groupBy("capture_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "mark"))), lambda x: x["mark"]), "").alias("line"))
