"""Starts and stops of defined events, paired like brackets: a stop closes the latest open start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.ordered import running, slice_length, with_next


def marks(events: DataFrame, defs: DataFrame) -> DataFrame:
    """Start and stop rows of scoped definitions, those with a stop id: name, step (+1 or -1), latency_ns.

    Definitions are the few that a firmware declares; their number is checked before they are broadcast.
    """
    scoped = defs.where("stop_id IS NOT NULL")
    latency = F.coalesce("latency_compensation_ns", F.lit(0)).alias("latency_ns")
    ids = scoped.select("name", F.col("start_id").alias("id"), F.lit(1).alias("step"), latency).unionByName(
        scoped.select("name", F.col("stop_id").alias("id"), F.lit(-1).alias("step"), latency)
    )
    return events.join(broadcast_if_small(ids), "id")


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A broadcast hint for a side of at most ``most`` rows; a larger one is joined as the planner sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def paired(events: DataFrame, defs: DataFrame, keys: tuple[str, ...] = ("capture_id",), slice_ns: int | None = None) -> DataFrame:
    """Every start, and every stop without one: status ``paired``, ``unterminated`` or ``orphaned``.

    With S the running sum of +1 for starts and -1 for stops, and m its running minimum (0 at first), a stop is an
    orphan if S falls below all sums before it. Of the others, a start and its stop have one level S - m in common, and
    a start is paired if the next row of its level is a stop. Pairs are found in the times as recorded; then both ends
    move by the latency and stop at 0. The value is the start's.
    """
    group = (*keys, "name")
    slice_ns = slice_ns or slice_length(events, keys)
    levels = running(marks(events, defs), group, ("t_ns", "seq"), F.col("step"), slice_ns)
    orphan = (F.col("step") == -1) & (F.col("total") < F.col("low_before"))
    levels = levels.withColumn("orphan", orphan).withColumn("level", F.col("total") - F.col("low") + F.when(F.col("step") == -1, 1).otherwise(0))
    rest = with_next(levels.where(~F.col("orphan")), (*group, "level"), ("t_ns", "seq"), ("step",), slice_ns, "stop").where("step = 1")
    is_paired = F.col("stop.step") == -1
    shift = lambda t: F.greatest(t - F.col("latency_ns"), F.lit(0).cast("bigint"))
    found = rest.select(
        *group, "seq", "value", F.when(is_paired, "paired").otherwise("unterminated").alias("status"),
        shift(F.col("t_ns")).alias("start_ns"), F.when(is_paired, shift(F.col("stop.t_ns"))).alias("end_ns"),
    )
    lost = levels.where("orphan").select(*group, "seq", "value", F.lit("orphaned").alias("status"), F.lit(None).cast("bigint").alias("start_ns"), shift(F.col("t_ns")).alias("end_ns"))
    return found.unionByName(lost)


def occurrences(events: DataFrame, defs: DataFrame, keys: tuple[str, ...] = ("capture_id",), slice_ns: int | None = None) -> DataFrame:
    """Paired intervals only."""
    return paired(events, defs, keys, slice_ns).where("status = 'paired'").drop("status")


def pairing_counts(pairs: DataFrame, keys: tuple[str, ...] = ("capture_id", "name")) -> DataFrame:
    return pairs.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("paired", "unterminated", "orphaned")))
