"""Missing data: jumps in time, jumps in sequence numbers, and what overlaps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.ordered import DAY_NS, with_next

#: Causes, by precedence.
CAUSES = ("device_overflow", "sequence_gap", "timestamp_jump", "host_overrun", "truncation")


def time_gaps(samples: DataFrame, rate_hz: float, periods: int = 3, slice_ns: int | None = None) -> DataFrame:
    """Gaps between consecutive samples further apart than ``periods`` nominal periods; every pair is checked.

    ``overflow_before`` and ``seq_gap_before`` of the later sample, where there, give the cause; else it is a jump. The
    estimate of lost samples is the distance in whole periods less one.
    """
    period = int(1e9 // rate_hz) if rate_hz else 1
    has = set(samples.columns)
    carry = [c for c in ("overflow_before", "seq_gap_before") if c in has]
    pairs = with_next(samples.select("capture_id", "seq", "t_ns", *carry), ("capture_id",), ("t_ns", "seq"), carry, slice_ns)
    delta = F.col("next.t_ns") - F.col("t_ns")
    cause = F.lit("timestamp_jump")
    if "seq_gap_before" in has:
        cause = F.when(F.col("next.seq_gap_before"), "sequence_gap").otherwise(cause)
    if "overflow_before" in has:
        cause = F.when(F.col("next.overflow_before"), "device_overflow").otherwise(cause)
    lost = F.greatest(F.floor(delta / F.lit(period)) - 1, F.lit(0))
    return pairs.where(delta > periods * period).select("capture_id", F.col("t_ns").alias("start_ns"), F.col("next.t_ns").alias("end_ns"), cause.alias("cause"), lost.alias("lost_estimate"))


def overlapping(gaps: DataFrame, spans: DataFrame, bin_ns: int = DAY_NS) -> DataFrame:
    """Gaps that overlap a span of their capture, each once. Spans and gaps are half-open; an open gap has no end.

    Joined by equality on time bins; an open gap is cut at the last span's end for that.
    """
    last = spans.groupBy("capture_id").agg(F.max("end_ns").alias("_last"))
    bins = lambda a, b: F.sequence(F.floor(a / F.lit(bin_ns)), F.floor(F.greatest(b - 1, a) / F.lit(bin_ns)))
    end = F.coalesce("end_ns", "_last")
    left = gaps.join(last, "capture_id").where(end > F.col("start_ns")).withColumn("_bin", F.explode(bins(F.col("start_ns"), end)))
    right = spans.where("end_ns > start_ns").select("capture_id", F.col("start_ns").alias("_from"), F.col("end_ns").alias("_to")).withColumn("_bin", F.explode(bins(F.col("_from"), F.col("_to"))))
    same = ["capture_id", "_bin"]
    hit = left.alias("g").join(right.alias("s"), (F.col("g.capture_id") == F.col("s.capture_id")) & (F.col("g._bin") == F.col("s._bin")) & (F.col("g.start_ns") < F.col("s._to")) & (end > F.col("s._from")), "left_semi")
    return hit.drop("_last", *same[1:]).distinct()


def gap_totals(gaps: DataFrame) -> DataFrame:
    """Number, total length and lost samples by capture, and the first five as text."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.struct("start_ns", "end_ns")))), 1, 5)
    from pyspark.sql import Window as W

    few = gaps.withColumn("_n", F.row_number().over(W.partitionBy("capture_id").orderBy("start_ns"))).where("_n <= 5")
    shown = few.groupBy("capture_id").agg(F.array_join(F.transform(first, lambda g: F.concat_ws("-", g["start_ns"].cast("string"), g["end_ns"].cast("string"))), ";").alias("first_gaps"))
    sums = gaps.groupBy("capture_id").agg(F.count("*").alias("gaps"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("missing_ns"), F.sum("lost_estimate").alias("lost_estimate"))
    return sums.join(shown, "capture_id").withColumn("not_shown", F.greatest(F.col("gaps") - 5, F.lit(0)))


def sequence_gaps(frames: DataFrame, keys: tuple[str, ...] = ("device",), modulus: int = 256, slice_rows: int = 1 << 20) -> DataFrame:
    """How often an accepted frame does not follow its predecessor's sequence number, by device, in arrival order."""
    pairs = with_next(frames.where("accepted"), keys, ("arrival",), ("seq",), slice_rows)
    gap = F.col("next.seq") != (F.col("seq") + 1) % modulus
    missing = F.pmod(F.col("next.seq") - F.col("seq") - 1, F.lit(modulus))
    return pairs.groupBy(*keys).agg(F.count("*").alias("accepted"), F.count_if(gap).alias("gaps"), F.sum(F.when(gap, missing).otherwise(0)).cast("bigint").alias("missing"))
