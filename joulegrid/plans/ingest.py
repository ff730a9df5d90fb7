"""What a device's bytes say, in capture time: the batch form of ``streaming.session``, table by table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.operators import gaps, timebase
from joulegrid.operators.ordered import running, with_next
from joulegrid.shared import settle
from joulegrid.sources import wire

ORDER = ("arrival", "record")
#: Arrivals of so many landed chunks are in a slice.
SLICE = wire.REGIONS << 10


@dataclass
class Ingested:
    """Tables with the columns of ``streaming.session.TABLES``."""

    samples: DataFrame
    events: DataFrame
    gpio: DataFrame
    sync: DataFrame
    gaps: DataFrame
    counts: DataFrame


def ingested(chunks: DataFrame, timer_hz: int, rate_hz: float) -> Ingested:
    """Tables out of (device, chunk, bytes) rows. Times count from a device's first sample; earlier ones are 0.

    Events, pins and sync rows are resolved against the last sample that arrived before them; before all samples they are
    of epoch 0. A device without samples has no origin, and rows of it are in no table.
    """
    decoded = settle(wire.frames(chunks))
    hz = F.lit(timer_hz).cast("bigint")
    raw = wire.samples(decoded)
    times = settle(timebase.unwrapped(raw, order=ORDER, slice_rows=SLICE))
    origin = times.groupBy("device").agg(F.min_by("full_ticks", F.struct(*ORDER)).alias("_origin"))

    def timed(rows: DataFrame) -> DataFrame:
        return rows.join(origin, "device").withColumn("t_ns", timebase.capture_time(F.col("full_ticks"), F.col("_origin"), hz)).withColumnRenamed("device", "capture_id")

    def resolved(rows: DataFrame, *columns: str) -> DataFrame:
        full = timebase.resolved(rows, times, order=ORDER, slice_rows=SLICE).drop("ticks")
        return timed(rows.join(full, ["device", *ORDER])).select("capture_id", *ORDER, "t_ns", *columns)

    samples = settle(timed(times).select("capture_id", *ORDER, "t_ns", "current_ua", "voltage_uv", "step", "overflow_before"))
    sync = wire.sync(decoded).withColumn("host_send_ns", F.col("host_time_ns"))
    in_order = samples.join(lost_before(decoded), ["capture_id", *ORDER], "left")
    # Order of arrival, not of time, tells which samples are neighbours.
    pairs = with_next(in_order, ("capture_id",), ORDER, ("t_ns", "overflow_before", "seq_gap_before"), SLICE)
    period = int(1e9 // rate_hz)
    delta = F.col("next.t_ns") - F.col("t_ns")
    cause = F.when(F.col("next.overflow_before"), gaps.CAUSES[0]).when(F.col("next.seq_gap_before"), gaps.CAUSES[1]).otherwise(gaps.CAUSES[2])
    found = pairs.where(delta > 3 * period).select("capture_id", F.col("next.arrival").alias("arrival"), "t_ns", F.col("next.t_ns").alias("end_ns"), cause.alias("cause"), F.greatest(F.floor(delta / F.lit(period)) - 1, F.lit(0)).alias("lost_estimate"))
    held = wire.counters(decoded)
    names = [c for c in held.columns if c != "device"]
    each = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(c).cast("bigint").alias("value")) for c in names])
    counts = held.select(F.col("device").alias("capture_id"), F.explode(each).alias("c")).select("capture_id", "c.*").where("value > 0")
    return Ingested(samples.drop("overflow_before"), resolved(wire.events(decoded), "id", "value"), resolved(wire.gpio(decoded), "state"), resolved(sync, "host_send_ns", F.col("full_ticks").alias("ticks")), found, counts)


def lost_before(decoded: DataFrame) -> DataFrame:
    """The first sample of each block before which, since the block before, a frame's number was missing."""
    accepted = decoded.where(F.col("status").isin("ok", "payload"))
    pairs = with_next(accepted, ("device",), ("arrival",), ("seq",), SLICE)
    jumps = pairs.where((F.col("next").isNotNull()) & (F.col("next.seq") != (F.col("seq") + 1) % 256)).select("device", F.col("next.arrival").alias("arrival"), F.lit(1).alias("jump"))
    counted = running(accepted.join(jumps, ["device", "arrival"], "left").fillna(0, ["jump"]), ("device",), ("arrival",), F.col("jump"), SLICE)
    # A frame without samples is no block: what it lost counts for the next that has some.
    blocks = counted.where((F.col("status") == "ok") & (F.col("type") == wire.TYPES["CURRENT_SAMPLES"]) & (F.substring("payload", 9, 2) != F.unhex(F.lit("0000")))).select("device", "arrival", "total")
    after = with_next(blocks, ("device",), ("arrival",), ("total",), SLICE).where(F.col("next.total") > F.col("total"))
    first = blocks.groupBy("device").agg(F.min_by("total", "arrival").alias("total"), F.min("arrival").alias("arrival")).where("total > 0").select("device", "arrival")
    marked = after.select("device", F.col("next.arrival").alias("arrival")).unionByName(first)
    return marked.select(F.col("device").alias("capture_id"), "arrival", F.lit(0).alias("record"), F.lit(True).alias("seq_gap_before"))
