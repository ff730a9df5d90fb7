"""Energy of event occurrences: an interval join of samples and occurrences, then statistics of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.distribution import describe
from joulegrid.operators.ordered import slice_length, with_next
from joulegrid.operators.pairing import broadcast_if_small, occurrences, paired, pairing_counts
from joulegrid.operators.regions import energy_uj, pair_terms, with_voltage
from joulegrid.shared import settle

OCCURRENCE = ("capture_id", "name", "seq")


def in_windows(samples: DataFrame, windows: DataFrame, widest_ns: int | None = None) -> DataFrame:
    """Every sample of every half-open window of its capture: rows of ``windows`` beside rows of ``samples``.

    The join is one of equality on time bins. A window's bins are as wide as itself, up to the next power of 4, so it
    touches two, and a sample meets few windows that it is not in; a sample stands once for each width that its capture
    has. Bins are no wider than ``widest_ns`` (by default as ``slice_length`` has it), so that a long window spreads over
    many tasks. Empty windows (end at or before start) match nothing.
    """
    widest_ns = widest_ns or slice_length(samples, ["capture_id"])
    length = (F.col("end_ns") - F.col("start_ns")).cast("double")
    width = F.least(F.pow(F.lit(4.0), F.ceil(F.log2(length) / 2)), F.lit(float(widest_ns))).cast("bigint")
    wide = windows.where("end_ns > start_ns").withColumn("_width", F.greatest(width, F.lit(1).cast("bigint")))
    bins = F.sequence(F.call_function("div", F.col("start_ns"), F.col("_width")), F.call_function("div", F.col("end_ns") - 1, F.col("_width")))
    spread = wide.withColumn("_bin", F.explode(bins))
    widths = wide.select("capture_id", "_width").distinct()
    binned = samples.drop("seq").join(widths, "capture_id").withColumn("_bin", F.call_function("div", F.col("t_ns"), F.col("_width")))
    same = ["capture_id", "_width", "_bin"]
    return spread.join(binned, same).where("t_ns >= start_ns AND t_ns < end_ns").drop("_bin", "_width")


def occurrence_energy(samples: DataFrame, found: DataFrame, method: str = "trapezoid", supply_uv: int | None = None, slice_ns: int | None = None) -> DataFrame:
    """samples, sum_i, max_ua and energy_uj of every occurrence; samples is 0 where none falls inside.

    Samples next to each other inside an occurrence are next to each other in the capture, so each sample carries the
    step to its next one, which counts if that is inside as well. An interval's last partial step is not integrated.
    """
    slice_ns = slice_ns or slice_length(samples, ["capture_id"])
    steps = with_next(with_voltage(samples, supply_uv), ("capture_id",), ("t_ns", "seq"), ("current_ua", "voltage_uv"), slice_ns)
    energy, _ = pair_terms(method)
    steps = steps.select("capture_id", "seq", "t_ns", "current_ua", F.col("next.t_ns").alias("next_ns"), energy.alias("step2"))
    joined = in_windows(steps, found.select(*OCCURRENCE, "start_ns", "end_ns"), slice_ns)
    inside = F.when(F.col("next_ns") < F.col("end_ns"), F.col("step2")).otherwise(F.lit(0).cast("decimal(38,0)"))
    sums = joined.groupBy(*OCCURRENCE).agg(F.count("*").alias("samples"), F.sum(F.col("current_ua").cast("bigint")).alias("sum_i"), F.max("current_ua").alias("max_ua"), F.sum(inside).alias("energy2"))
    return (
        found.join(sums, list(OCCURRENCE), "left")
        .withColumn("samples", F.coalesce("samples", F.lit(0).cast("bigint")))
        .withColumn("energy_uj", F.when(F.col("samples") > 0, energy_uj(F.col("energy2"))))
        .drop("energy2")
    )


def event_stats(samples: DataFrame, events: DataFrame, defs: DataFrame, span_ns: int | None = None, **options) -> DataFrame:
    """A row for each scoped definition, over all captures: occurrences, distributions of duration (ns) and energy (nJ).

    Mean and peak current are null where no occurrence holds a sample. The duty cycle is the durations' sum over
    ``span_ns``, by default the sum of all captures' spans; nested occurrences count each.
    """
    pairs = settle(paired(events, defs))  # read twice below, and much smaller than the samples
    measured = occurrence_energy(samples, pairs.where("status = 'paired'").drop("status"), **options)
    rows = settle(measured.select("name", "samples", "sum_i", "max_ua", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), F.round(F.col("energy_uj") * 1000).cast("bigint").alias("energy_nj")))
    currents = rows.groupBy("name").agg(
        F.round(F.sum("sum_i").cast("double") / F.sum(F.when(F.col("samples") > 0, F.col("samples"))).cast("double"), 6).alias("mean_ua"),
        F.max("max_ua").alias("peak_ua"), F.count_if(F.col("samples") == 0).alias("unsampled"), F.count_if(F.col("samples") == 1).alias("single_sample"),
    )
    both = F.array(*[F.struct(F.lit(what).alias("what"), F.col(what).alias("value")) for what in ("duration_ns", "energy_nj")])
    described = describe(rows.select("name", F.explode(both).alias("m")).select("name", "m.*"), ["name", "what"], "value", 0)
    figures = [c for c in described.columns if c not in ("name", "what")]
    of = [F.max(F.when(F.col("what") == what, F.col(c))).alias(f"{what}_{c}") for what in ("duration_ns", "energy_nj") for c in figures]
    stats = described.groupBy("name").agg(*of).join(currents, "name")
    counts = pairing_counts(pairs, ("name",)).withColumnRenamed("paired", "occurrences")
    # The spans of some thousand captures of a month are beyond a long.
    spans = samples.groupBy("capture_id").agg((F.max("t_ns") + 1 - F.min("t_ns")).cast("decimal(38,0)").alias("span")).agg(F.sum("span").alias("span_ns"))
    names = broadcast_if_small(defs.where("stop_id IS NOT NULL").select("name", "category", "value_units"))
    total = span_ns if span_ns is not None else spans.first()["span_ns"]
    joined = names.join(counts, "name", "left").join(stats, "name", "left")
    zero = [c for c in joined.columns if c not in ("name", "category", "value_units", "mean_ua", "peak_ua")]
    return joined.fillna(0, zero).withColumn("duty_cycle", F.round(F.col("duration_ns_total").cast("double") / F.lit(float(total or 1)), 9))


def top_events(stats: DataFrame, n: int = 10) -> DataFrame:
    """Definitions by total energy, largest first, ties by name."""
    return stats.orderBy(F.desc("energy_nj_total"), "name").limit(n)


def has_warnings() -> Column:
    return (F.col("unterminated") > 0) | (F.col("orphaned") > 0) | (F.col("unsampled") > 0)


__all__ = ["event_stats", "has_warnings", "in_windows", "occurrence_energy", "occurrences", "top_events"]
