"""What is known of whole captures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joulegrid.operators import buckets
from joulegrid.sources.capture_file import KINDS, register


def spans(samples: DataFrame) -> DataFrame:
    """First time, end (1 ns past the last), number and effective rate of each capture's samples; rate 0 below two."""
    length = F.col("last_ns") - F.col("first_ns")
    out = samples.groupBy("capture_id").agg(F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"), F.count("*").alias("samples"))
    rate = F.when((F.col("samples") > 1) & (length > 0), F.round((F.col("samples") - 1).cast("double") * 1e9 / length.cast("double"), 9)).otherwise(F.lit(0.0))
    return out.select("capture_id", "first_ns", (F.col("last_ns") + 1).alias("end_ns"), "samples", rate.alias("rate_hz"))


def capture_of(file: str = "capture_id") -> Column:
    """The capture's name out of that of one of its files, which ends in the number of a slice."""
    return F.regexp_extract(file, r"^(.*?)(--?[0-9]+)?$", 1)


def opened(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """A function that gives the rows of a kind of all capture files in a folder, by capture."""
    register(spark)
    return lambda kind: spark.read.format("powercapture").option("kind", kind).load(folder).withColumn("capture_id", capture_of())


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks, their rows and their bytes by capture and kind, kinds in the order of their codes; kinds without a name in hex."""
    names = F.create_map(*[F.lit(x) for name, code in KINDS.items() for x in (code, name)])
    named = chunks.withColumn("name", F.coalesce(names[F.col("kind")], F.format_string("0x%04X", "kind")))
    return named.groupBy("capture_id", F.col("kind").alias("code"), F.col("name").alias("kind")).agg(F.count("*").alias("chunks"), F.sum("records").alias("rows"), F.sum("plain").alias("plain"), F.sum("stored").alias("stored")).orderBy("capture_id", "code")


def overview_from_files(read: Callable[[str], DataFrame], start_ns: int, end_ns: int, n: int, widths: Sequence[int] = buckets.LEVELS_NS) -> DataFrame:
    """``n`` buckets of a span of every capture, from the stored summaries of its files where a level is fine enough.

    A bucket that two files share is in both in part; parts are merged by their weights. No samples are decoded then;
    without such a level they are read.
    """
    level = buckets.coarsest(tuple(widths), end_ns - start_ns, n)
    levels = {}
    if level:
        stored = read("summary").where(F.col("level_ns") == level)
        levels[level] = stored.withColumn("sum_ua", F.round(F.col("mean_ua") * F.col("count")).cast("bigint"))
    return buckets.overview(read("samples"), levels, start_ns, end_ns, n)


def info(samples: DataFrame, events: DataFrame, gaps: DataFrame, nominal_hz: float, gpio: DataFrame | None = None, report: DataFrame | None = None) -> DataFrame:
    """One row for each capture: counts, duration, rates, gaps, whether a voltage was measured, whether it is clean.

    Clean means no gap and, where ``report`` (as ``integrity`` gives it) is there, an undamaged file.
    """
    of_events = events.groupBy("capture_id").agg(F.count("*").alias("events"), F.countDistinct("id").alias("distinct_ids"))
    of_gaps = gaps.groupBy("capture_id").agg(F.count("*").alias("gaps"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("missing_ns"))
    measured = samples.groupBy("capture_id").agg((F.count("voltage_uv") > 0).alias("has_voltage"))
    out = spans(samples).join(measured, "capture_id").join(of_events, "capture_id", "left").join(of_gaps, "capture_id", "left")
    pins = gpio.groupBy("capture_id").agg(F.count("*").alias("gpio")) if gpio is not None else None
    out = out.join(pins, "capture_id", "left") if pins is not None else out.withColumn("gpio", F.lit(0).cast("bigint"))
    out = out.fillna(0, ["events", "distinct_ids", "gaps", "missing_ns", "gpio"])
    clean = F.col("gaps") == 0
    if report is not None:
        out = out.join(report.select("capture_id", F.col("is_clean").alias("_whole")), "capture_id", "left")
        clean = clean & F.coalesce("_whole", F.lit(False))
    length = F.round((F.col("end_ns") - 1 - F.col("first_ns")).cast("double") / 1e9, 9)
    return out.withColumn("duration_s", length).withColumn("is_clean", clean).withColumn("rate_ratio", F.round(F.col("rate_hz") / F.lit(nominal_hz), 6)).drop("_whole")


def integrity(captures: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row for each capture file: finalized, recovered, truncated_at, corrupt and unknown chunks, gaps, is_clean.

    Both are kinds of the capture-file source. Unknown chunks alone do not make a file unclean.
    """
    bad = chunks.groupBy("capture_id").agg(F.count_if(F.col("status") == "corrupt").alias("corrupt_chunks"), F.count_if(F.col("status") == "unknown").alias("unknown_chunks"))
    lost = lost_spans(captures, chunks).groupBy("capture_id").agg(F.count("*").alias("gaps"))
    out = captures.select("capture_id", "finalized", "recovered", "truncated_at").join(bad, "capture_id", "left").join(lost, "capture_id", "left")
    out = out.fillna(0, ["corrupt_chunks", "unknown_chunks", "gaps"])
    return out.withColumn("is_clean", F.col("finalized") & ~F.col("recovered") & F.col("truncated_at").isNull() & (F.col("corrupt_chunks") == 0) & (F.col("gaps") == 0))


def lost_spans(captures: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gaps by truncation: an open one from the last chunk's first time on, and one over each damaged chunk of samples."""
    last = chunks.groupBy("capture_id").agg(F.max_by("first_ns", "place").alias("start_ns"))
    cut = captures.where("truncated_at IS NOT NULL").join(last, "capture_id", "left")
    open_ = cut.select("capture_id", F.coalesce("start_ns", F.lit(0).cast("bigint")).alias("start_ns"), F.lit(None).cast("bigint").alias("end_ns"), F.lit("truncation").alias("cause"), F.lit(0).cast("bigint").alias("lost_estimate"))
    holes = chunks.where("status = 'corrupt' AND kind = 1 AND first_ns IS NOT NULL")
    return open_.unionByName(holes.select("capture_id", F.col("first_ns").alias("start_ns"), (F.col("last_ns") + 1).alias("end_ns"), F.lit("truncation").alias("cause"), F.col("records").alias("lost_estimate")))


def compression(uncompressed: str, stored: str):
    """Ratio of sizes, 1 where nothing was stored."""
    return F.when(F.col(stored) > 0, F.round(F.col(uncompressed).cast("double") / F.col(stored).cast("double"), 6)).otherwise(F.lit(1.0))
