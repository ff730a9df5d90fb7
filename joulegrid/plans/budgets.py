"""Budgets from options, judged over whole captures, and reports of the outcome."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulegrid.functions.units import duration_ns, quantity, tolerance_percent
from joulegrid.operators.rules import evaluate, regression_rules
from joulegrid.schemas import RULES

#: Options, the metric that each limits and how its text is read.
LIMITS = {
    "max_energy": ("mean_energy_uj", lambda t: quantity(t, "J") * 1e6),
    "max_p95_energy": ("p95_energy_uj", lambda t: quantity(t, "J") * 1e6),
    "max_total_energy": ("total_energy_uj", lambda t: quantity(t, "J") * 1e6),
    "max_mean_current": ("mean_current_ua", lambda t: quantity(t, "A") * 1e6),
    "max_peak_current": ("peak_current_ua", lambda t: quantity(t, "A") * 1e6),
    "max_duration": ("mean_duration_ns", lambda t: float(duration_ns(t))),
}


class NoRules(ValueError):
    """Nothing was asked for, which must not pass as success."""


def rules_from_options(spark: SparkSession, stats: DataFrame, events: list[str] | None = None, baseline: DataFrame | None = None, tolerance: str | None = None, min_occurrences: int | None = None, **limits: str) -> DataFrame:
    """Every limit for every named event, all declared ones if none is named; with a tolerance, one for each in the baseline."""
    chosen = stats.select(F.col("name").alias("event")) if not events else spark.createDataFrame([(e,) for e in events], "event string")
    asked = [(LIMITS[k][0], "<=", LIMITS[k][1](v)) for k, v in limits.items() if v is not None]
    if min_occurrences is not None:
        asked.append(("occurrences", ">=", float(min_occurrences)))
    out = spark.createDataFrame([], RULES)
    for metric, comparison, limit in asked:
        out = out.unionByName(chosen.select("event", F.lit(metric).alias("metric"), F.lit(comparison).alias("comparison"), F.lit(limit).alias("limit")))
    if tolerance is not None:
        if baseline is None:
            raise ValueError("a tolerance needs a baseline")
        out = out.unionByName(regression_rules(stats, baseline, tolerance_percent(tolerance)))
    elif not asked:
        raise NoRules("no limit and no tolerance was given")
    return out


def judged(rules: DataFrame, stats: DataFrame, baseline: DataFrame | None = None, most: int = 10_000) -> list[dict]:
    """Outcomes as rows on the driver: there is one for each rule, and their number is checked."""
    rows = evaluate(rules, stats, baseline).orderBy("event", "metric").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [r.asDict() for r in rows]


def passed(results: list[dict]) -> bool:
    return bool(results) and all(r["passed"] for r in results)


def as_text(results: list[dict]) -> str:
    lines = []
    for r in results:
        value = "not measured" if r["value"] is None else f"{r['value']:.3f}"
        change = "" if r["change_percent"] is None else f" ({r['change_percent']:+.1f} % of the baseline)"
        lines.append(f"{'PASS' if r['passed'] else 'FAIL'} {r['event']} {r['metric']} {value} {r['comparison']} {r['limit']:.3f}{change}" + (f" [{r['outcome']}]" if not r["passed"] else ""))
        lines += [f"     {r['warnings']}"] if r["warnings"] else []
    return "\n".join([*lines, f"{sum(not r['passed'] for r in results)} of {len(results)} failed"])


def as_json(results: list[dict]) -> str:
    return json.dumps({"passed": passed(results), "failures": sum(not r["passed"] for r in results), "results": results}, indent=2)


def as_junit(results: list[dict]) -> str:
    cases = []
    for r in results:
        name = f"name={quoteattr(r['event'] + ' ' + r['metric'])}"
        said = f"{r['value']} {r['comparison']} {r['limit']}"
        cases.append(f"  <testcase {name}/>" if r["passed"] else f"  <testcase {name}><failure message={quoteattr(r['outcome'] + ': ' + said)}/></testcase>")
    return "\n".join([f'<testsuite name="budgets" tests="{len(results)}" failures="{sum(not r["passed"] for r in results)}">', *cases, "</testsuite>"])


def exit_code(results: list[dict]) -> int:
    return 0 if passed(results) else 1


def write_baseline(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stored statistics, with the columns of ``like``; nothing is inferred."""
    return spark.read.schema(like.schema).json(path)
