"""Neighbouring rows and running sums without one task for each key.

A capture may hold most rows, so a window over a whole capture would put them in one task. Both operators cut the order
into slices: windows run within a slice, a summary row of each slice is combined over slices, and both are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS
SECOND_NS, MILLI_NS = 1_000_000_000, 1_000_000
#: About so many rows of a key are in a slice at most.
SLICE_ROWS = 1_000_000


def slice_length(df: DataFrame, keys: Sequence[str], time: str = "t_ns", rows: int = SLICE_ROWS, most_ns: int = DAY_NS) -> int:
    """Nanoseconds in which a key has about ``rows`` rows at its fullest, at most ``most_ns``.

    At 50,000 samples a second that is 20 seconds. Counted over keys and hours; only where an hour holds more than that,
    over its seconds, and where a second does, over its milliseconds, so that a burst does not hide in a mean. One
    number reaches the driver each time.
    """
    held, coarser = df.select(*keys, F.col(time).alias("_t")), None
    for width in (HOUR_NS, SECOND_NS, MILLI_NS):
        at = F.floor(F.col("_t") / F.lit(width))
        counts = held.groupBy(*keys, at.alias("_at")).agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= rows or width == MILLI_NS:
            return min(most_ns, coarser or most_ns, max(1, width * rows // max(1, most)))
        coarser = max(1, width * rows // most)
        full = counts.where(F.col("n") > rows).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_at").alias("_of_at"))
        same = at == F.col("_of_at")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        held = held.join(full, same, "left_semi")
    return most_ns


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = (), slice_ns: int | None = None, name: str = "next") -> DataFrame:
    """``df`` with a struct of the following row's ``order`` and ``carry`` columns, null for a key's last row.

    The first column of ``order`` is a time; slices are ``slice_ns`` of it, by default as ``slice_length`` has it.
    (key, order) must be distinct.
    """
    fields = [*order, *carry]
    slice_ns = slice_ns or slice_length(df, keys, order[0])
    sliced = df.withColumn("_slice", F.floor(F.col(order[0]) / F.lit(slice_ns)))
    here = F.struct(*fields)
    inside = sliced.withColumn(name, F.lead(here).over(W.partitionBy(*keys, "_slice").orderBy(*order)))
    heads = sliced.groupBy(*keys, "_slice").agg(F.min(here).alias("_head"))
    following = heads.select(*keys, "_slice", F.lead("_head").over(W.partitionBy(*keys).orderBy("_slice")).alias("_after"))
    return (
        inside.join(following, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce(name, "_after"))
        .drop("_slice", "_after")
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, slice_ns: int | None = None) -> DataFrame:
    """``df`` with ``total``, the running sum of ``step`` in order, and ``low``, its running minimum with 0 at the start.

    ``low_before`` is the minimum over the preceding rows only. Slices are as in ``with_next``.
    """
    slice_ns = slice_ns or slice_length(df, keys, order[0])
    sliced = df.withColumn("_slice", F.floor(F.col(order[0]) / F.lit(slice_ns))).withColumn("_step", step)
    within = W.partitionBy(*keys, "_slice").orderBy(*order)
    upto, before = within.rowsBetween(W.unboundedPreceding, 0), within.rowsBetween(W.unboundedPreceding, -1)
    local = sliced.withColumn("_sum", F.sum("_step").over(upto)).withColumn("_low", F.min("_sum").over(upto)).withColumn("_low_before", F.min("_sum").over(before))
    ends = local.groupBy(*keys, "_slice").agg(F.sum("_step").alias("_all"), F.min("_sum").alias("_least"))
    past = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    base = ends.withColumn("_base", F.coalesce(F.sum("_all").over(past), F.lit(0))).withColumn("_deep", F.col("_base") + F.col("_least"))
    base = base.select(*keys, "_slice", "_base", F.least(F.lit(0), F.coalesce(F.min("_deep").over(past), F.lit(0))).alias("_floor"))
    joined = local.join(base, [*keys, "_slice"])
    return (
        joined.withColumn("total", F.col("_base") + F.col("_sum"))
        .withColumn("low", F.least("_floor", F.col("_base") + F.col("_low")))
        .withColumn("low_before", F.least("_floor", F.coalesce(F.col("_base") + F.col("_low_before"), F.lit(0))))
        .drop("_slice", "_step", "_sum", "_low", "_low_before", "_base", "_floor")
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_ns: int | None = None, name: str = "n") -> DataFrame:
    """``df`` with each row's number within its key, from 0."""
    return running(df, keys, order, F.lit(1), slice_ns).withColumn(name, F.col("total") - 1).drop("total", "low", "low_before")
