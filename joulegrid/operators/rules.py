"""Budgets: metrics of event statistics against limits and baselines. What cannot be measured fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.pairing import broadcast_if_small

#: Metric names and the column of event statistics (with its scale) that each reads.
METRICS = {
    "mean_energy_uj": ("energy_nj_mean", 1e-3, True), "p95_energy_uj": ("energy_nj_p95", 1e-3, True), "max_energy_uj": ("energy_nj_max", 1e-3, True),
    "total_energy_uj": ("energy_nj_total", 1e-3, True), "mean_duration_ns": ("duration_ns_mean", 1.0, False), "max_duration_ns": ("duration_ns_max", 1.0, False),
    "mean_current_ua": ("mean_ua", 1.0, False), "peak_current_ua": ("peak_ua", 1.0, False), "occurrences": ("occurrences", 1.0, False),
}


def metric_rows(stats: DataFrame) -> DataFrame:
    """(event, metric, value); null where nothing was measured. Only counts exist for events that never occurred."""
    measured = (F.col("occurrences") > 0) & (F.col("unsampled") < F.col("occurrences"))
    cells = []
    for metric, (column, scale, of_energy) in METRICS.items():
        known = F.lit(True) if metric == "occurrences" else measured if of_energy else F.col("occurrences") > 0
        cells.append(F.struct(F.lit(metric).alias("metric"), F.when(known, F.round(F.col(column).cast("double") * scale, 6)).alias("value")))
    return stats.select(F.col("name").alias("event"), "occurrences", "unsampled", "unterminated", "orphaned", F.explode(F.array(*cells)).alias("m")).select("event", "occurrences", "unsampled", "unterminated", "orphaned", "m.metric", "m.value")


def warnings() -> Column:
    said = [F.when(F.col(c) > 0, F.format_string("%d " + c, F.col(c))) for c in ("unterminated", "orphaned", "unsampled")]
    return F.array_join(F.filter(F.array(*said), lambda x: x.isNotNull()), ", ")


def evaluate(rules: DataFrame, stats: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Every rule with its outcome: passed, over_budget, under_budget, unknown_event, never_occurred, unmeasurable.

    Statistics are read more than once, so they should be stored ones. ``baseline`` is statistics of another run; change_percent compares with it and is null where it has 0 or nothing.
    """
    values = metric_rows(stats)
    known = broadcast_if_small(stats.select(F.col("name").alias("event"), F.lit(True).alias("declared")))
    out = rules.join(known, "event", "left").join(values, ["event", "metric"], "left")
    if baseline is not None:
        out = out.join(metric_rows(baseline).select("event", "metric", F.col("value").alias("baseline")), ["event", "metric"], "left")
    else:
        out = out.withColumn("baseline", F.lit(None).cast("double"))
    holds = F.when(F.col("comparison") == "<=", F.col("value") <= F.col("limit")).when(F.col("comparison") == ">=", F.col("value") >= F.col("limit"))
    passed = F.coalesce(holds, F.lit(False))
    outcome = (
        F.when(F.col("declared").isNull(), "unknown_event").when(passed, "passed").when(F.col("occurrences") == 0, "never_occurred")
        .when(F.col("value").isNull(), "unmeasurable").when(F.col("comparison") == "<=", "over_budget").otherwise("under_budget")
    )
    change = F.when(F.col("baseline") != 0, F.round((F.col("value") - F.col("baseline")) / F.col("baseline") * 100, 4))
    return out.select("event", "metric", "comparison", "limit", "value", "baseline", (passed & F.col("declared").isNotNull()).alias("passed"), outcome.alias("outcome"), change.alias("change_percent"), F.coalesce(warnings(), F.lit("")).alias("warnings"))


def regression_rules(stats: DataFrame, baseline: DataFrame, tolerance_percent: float, metric: str = "mean_energy_uj") -> DataFrame:
    """A rule for every event in both: the metric may be at most its baseline and the tolerance more."""
    before = metric_rows(baseline).where((F.col("metric") == metric) & F.col("value").isNotNull())
    now = stats.select(F.col("name").alias("event"))
    return before.join(now, "event").select("event", "metric", F.lit("<=").alias("comparison"), F.round(F.col("value") * (1 + tolerance_percent / 100), 6).alias("limit"))


def report(results: DataFrame) -> DataFrame:
    """One row: how many rules, how many failed, whether all passed. No rules is not a pass."""
    n = F.count("*")
    return results.agg(n.alias("rules"), F.count_if(~F.col("passed")).alias("failures"), (F.coalesce(F.bool_and("passed"), F.lit(False)) & (n > 0)).alias("all_passed"))
