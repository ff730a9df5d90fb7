"""Statistics of a time span: charge and energy, exact in integers until the last step.

Trapezoids sum (i0 v0 + i1 v1) dt, rectangles i0 v0 dt, as DECIMAL; energy becomes whole nanojoules and charge whole
picocoulombs by integer division, and only then DOUBLE. Results so do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.ordered import with_next
from joulegrid.schemas import DEFAULT_SUPPLY_UV

METHODS = ("trapezoid", "rectangular")
GAP_POLICIES = ("strict", "skip", "interpolate")


class IncompleteData(ValueError):
    """A span overlaps gaps and the policy is strict, or holds no samples."""


def big(c: Column, digits: int = 11) -> Column:
    return c.cast(f"decimal({digits},0)")


def with_voltage(samples: DataFrame, supply_uv: int | None = None, assumed_supply_uv: int = DEFAULT_SUPPLY_UV) -> DataFrame:
    """Voltage of every sample: an override, or the sample's own, or the assumed supply."""
    voltage = F.lit(supply_uv).cast("bigint") if supply_uv is not None else F.coalesce("voltage_uv", F.lit(assumed_supply_uv).cast("bigint"))
    return samples.withColumn("voltage_uv", voltage)


def power_uw(current: str = "current_ua", voltage: str = "voltage_uv") -> Column:
    """Microamperes times microvolts, as microwatts."""
    return (big(F.col(current)) * big(F.col(voltage))).cast("double") / F.lit(1e6)


def in_span(samples: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Rows of the half-open span; an open side is null."""
    if start_ns is not None:
        samples = samples.where(F.col("t_ns") >= start_ns)
    if end_ns is not None:
        samples = samples.where(F.col("t_ns") < end_ns)
    return samples


def pair_terms(method: str) -> tuple[Column, Column]:
    """Twice the energy and twice the charge from a row to its ``next``, in fA V ns and uA ns; zero without a next."""
    i0, v0, i1, v1 = F.col("current_ua"), F.col("voltage_uv"), F.col("next.current_ua"), F.col("next.voltage_uv")
    dt = big(F.greatest(F.col("next.t_ns") - F.col("t_ns"), F.lit(0)), 19)
    if method == "trapezoid":
        energy, charge = big(i0) * big(v0) + big(i1) * big(v1), big(i0) + big(i1)
    elif method == "rectangular":
        energy, charge = 2 * big(i0) * big(v0), 2 * big(i0)
    else:
        raise ValueError(f"method is one of {METHODS}")
    whole = lambda c: F.coalesce((c * dt).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return whole(energy), whole(charge)


def energy_uj(twice: Column) -> Column:
    return _scaled(twice, 2 * 10**12, 1000)


def charge_uc(twice: Column) -> Column:
    return _scaled(twice, 2 * 10**3, 10**6)


def _scaled(total: Column, divisor: int, rest: int) -> Column:
    """total div divisor as a whole number, then divided by ``rest`` in DOUBLE."""
    return F.call_function("div", total, F.lit(divisor).cast("decimal(38,0)")).cast("double") / F.lit(float(rest))


def measures(method: str) -> list[Column]:
    """Aggregates over rows with ``next``: counts, extremes, exact sums."""
    energy, charge = pair_terms(method)
    i, v = big(F.col("current_ua")), big(F.col("voltage_uv"))
    return [
        F.count("*").alias("samples"),
        F.min("current_ua").alias("min_ua"),
        F.max("current_ua").alias("max_ua"),
        F.sum(F.col("current_ua").cast("bigint")).alias("sum_i"),
        F.sum(i * i).alias("sum_ii"),
        F.sum("voltage_uv").alias("sum_v"),
        F.max(i * v).alias("peak"),
        F.sum(energy).alias("energy2"),
        F.sum(charge).alias("charge2"),
        F.min("t_ns").alias("first_ns"),
        F.max("t_ns").alias("last_ns"),
    ]


def finished(totals: DataFrame, keys: list[str], single_span_ns: int | None = None) -> DataFrame:
    """Statistics from the sums. A single sample's duration is the span's length (0 if the span is open)."""
    n = F.col("samples").cast("double")
    duration = F.when(F.col("samples") > 1, F.col("last_ns") - F.col("first_ns")).otherwise(F.lit(single_span_ns or 0))
    out = totals.withColumn("duration_s", duration.cast("double") / 1e9)
    out = out.withColumn("energy_uj", energy_uj(F.col("energy2"))).withColumn("charge_uc", charge_uc(F.col("charge2")))
    mean_power = F.when(F.col("duration_s") > 0, F.round(F.col("energy_uj") / F.col("duration_s"), 6))
    return out.select(
        *keys, "samples", "first_ns", "last_ns", "duration_s", "min_ua", "max_ua",
        F.round(F.col("sum_i").cast("double") / n, 6).alias("mean_ua"),
        F.round(F.sqrt(F.col("sum_ii").cast("double") / n), 4).alias("rms_ua"),
        F.round(F.col("sum_v").cast("double") / n, 4).alias("mean_uv"),
        "charge_uc", F.round(F.col("charge_uc") / 3.6e6, 9).alias("charge_mah"), "energy_uj",
        F.coalesce(mean_power, F.lit(0.0)).alias("mean_power_uw"),
        F.greatest(F.round(F.col("peak").cast("double") / 1e6, 3), F.lit(0.0)).alias("peak_power_uw"),
    )


def region_stats(
    samples: DataFrame, keys: tuple[str, ...] = ("capture_id",), start_ns: int | None = None, end_ns: int | None = None, method: str = "trapezoid",
    supply_uv: int | None = None, gaps: DataFrame | None = None, gap_policy: str = "strict", slice_ns: int | None = None,
) -> DataFrame:
    """Statistics of every capture over a span.

    With gaps given: strict raises if one overlaps the span, skip leaves out pairs of samples that lie across a gap,
    interpolate integrates linearly across. A capture without samples in the span has no row.
    """
    if gap_policy not in GAP_POLICIES:
        raise ValueError(f"gap_policy is one of {GAP_POLICIES}")
    chosen = in_span(with_voltage(samples, supply_uv), start_ns, end_ns)
    pairs = with_next(chosen, keys, ("t_ns", "seq"), ("current_ua", "voltage_uv"), slice_ns)
    if gaps is not None and gap_policy != "interpolate":
        within = gaps
        if start_ns is not None:
            within = within.where(F.coalesce("end_ns", F.lit(2**63 - 1)) > start_ns)
        if end_ns is not None:
            within = within.where(F.col("start_ns") < end_ns)
        if gap_policy == "strict":
            if not within.isEmpty():
                raise IncompleteData(f"{within.count()} gaps overlap the span")
        else:
            across = within.select(*keys, F.col("start_ns").alias("t_ns"), F.lit(True).alias("_gap")).distinct()
            pairs = pairs.join(across, [*keys, "t_ns"], "left").withColumn("next", F.when(F.col("_gap").isNull(), F.col("next"))).drop("_gap")
    span = end_ns - start_ns if start_ns is not None and end_ns is not None else None
    return finished(pairs.groupBy(*keys).agg(*measures(method)), list(keys), span)


def battery_hours(stats: DataFrame, capacity_mah: float = 220.0) -> DataFrame:
    """Hours that a battery lasts at the mean current; null where the mean is not positive."""
    mean_ma = F.col("mean_ua") / 1000
    return stats.withColumn("battery_hours", F.when(mean_ma > 0, F.round(F.lit(capacity_mah) / mean_ma, 6)))
