"""Known answers of region statistics, distributions, buckets and gaps."""

import math
import random

import pytest
from pyspark.sql import functions as F

from joulegrid.operators import buckets, distribution, gaps, regions
from joulegrid.schemas import SAMPLES


def table(spark, rows):
    return spark.createDataFrame([("c", k, t, i, v) for k, (t, i, v) in enumerate(rows)], SAMPLES)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_flat_load(spark):
    df = spark.range(50_001).selectExpr("'c' AS capture_id", "id AS seq", "id * 20000 AS t_ns", "10000 AS current_ua", "3300000L AS voltage_uv")
    for slice_ns in (10**7, 10**12):
        r = one(regions.region_stats(df, slice_ns=slice_ns))
        assert (r["energy_uj"], r["charge_uc"], r["duration_s"]) == (33000.0, 10000.0, 1.0)


def test_ramp_and_methods(spark):
    df = table(spark, [(1000 * k, 100 * k, 1_000_000) for k in range(1001)])
    trapezoid = one(regions.region_stats(df))["energy_uj"]
    assert trapezoid == 50.0 and one(regions.region_stats(df, method="rectangular"))["energy_uj"] < trapezoid
    with pytest.raises(ValueError, match="method"):
        regions.region_stats(df, method="simpson")


def test_square_wave(spark):
    r = one(regions.region_stats(table(spark, [(k * 1000, 100_000 * (k % 2), 1_000_000) for k in range(4)])))
    assert r["mean_ua"] == 50_000 and r["rms_ua"] == pytest.approx(100_000 / math.sqrt(2), abs=1e-3)


def test_missing_voltage(spark):
    df = table(spark, [(1000 * k, 10_000, None) for k in range(1001)])
    assert one(regions.region_stats(df))["energy_uj"] == one(regions.region_stats(df, supply_uv=3_300_000))["energy_uj"] == 33.0


def test_parts_add_up(spark):
    r = random.Random(1)
    rows = [(1000 * k, r.randint(-5, 90_000), 3_300_000 - k % 17) for k in range(2001)]
    whole = one(regions.region_stats(table(spark, rows)))["energy_uj"]
    parts = sum(one(regions.region_stats(table(spark, p)))["energy_uj"] for p in (rows[:1001], rows[1000:]))
    assert whole == pytest.approx(parts, abs=2e-3)


def test_single_sample_and_empty(spark):
    df = table(spark, [(500, 1000, 1_000_000)])
    r = one(regions.region_stats(df, start_ns=0, end_ns=1000))
    assert (r["energy_uj"], r["duration_s"], r["samples"]) == (0.0, 1e-6, 1)
    assert regions.region_stats(df, start_ns=600, end_ns=700).count() == 0
    assert regions.region_stats(df.limit(0)).count() == 0


def test_negative_currents_and_large_steps(spark):
    r = one(regions.region_stats(table(spark, [(0, -2_000_000_000, 4_294_967_295), (10**18, 2_147_483_647, 4_294_967_295)])))
    assert r["min_ua"] == -2_000_000_000 and r["peak_power_uw"] > 0


def test_gap_policies(spark):
    step = 20_000
    rows = [(k * step, 10_000, 1_000_000) for k in range(10)] + [(10**8 + 9 * step + k * step, 10_000, 1_000_000) for k in range(10)]
    df = table(spark, rows)
    found = gaps.time_gaps(df, 50_000)
    g = one(found)
    assert (g["start_ns"], g["end_ns"], g["cause"]) == (9 * step, 10**8 + 9 * step, "timestamp_jump")
    with pytest.raises(regions.IncompleteData):
        regions.region_stats(df, gaps=found)
    skip = one(regions.region_stats(df, gaps=found, gap_policy="skip"))["energy_uj"]
    across = one(regions.region_stats(df, gaps=found, gap_policy="interpolate"))["energy_uj"]
    assert skip == pytest.approx(3.6) and across == pytest.approx(1003.6)
    assert one(regions.region_stats(df, gaps=found, start_ns=0, end_ns=5 * step))["samples"] == 5


def test_causes_by_precedence(spark):
    rows = [("c", 0, 0, False, False), ("c", 1, 10**9, True, True), ("c", 2, 2 * 10**9, False, True), ("c", 3, 3 * 10**9, False, False)]
    df = spark.createDataFrame(rows, "capture_id string, seq long, t_ns long, overflow_before boolean, seq_gap_before boolean")
    assert [r["cause"] for r in gaps.time_gaps(df, 1000).orderBy("start_ns").collect()] == ["device_overflow", "sequence_gap", "timestamp_jump"]


def test_percentiles_and_spread(spark):
    r = one(distribution.describe(spark.range(1, 101).withColumn("k", F.lit(1)), ["k"], "id"))
    assert (r["p50"], r["p95"], r["p99"]) == (50, 95, 99)
    r = one(distribution.describe(spark.range(500).withColumn("k", F.lit(1)), ["k"], "id"))
    assert (r["p95"], r["p99"]) == (474, 494)
    r = one(distribution.describe(spark.createDataFrame([(1, x) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "k int, x int"), ["k"], "x"))
    assert r["stddev"] == pytest.approx(math.sqrt(32 / 7), abs=1e-6)
    r = one(distribution.describe(spark.createDataFrame([(1, 3)], "k int, x int"), ["k"], "x"))
    assert (r["n"], r["stddev"], r["p99"]) == (1, 0.0, 3)
    r = one(distribution.describe(spark.createDataFrame([(1, None)], "k int, x int"), ["k"], "x"))
    assert tuple(r)[1:] == (0, 0.0, 0, 0, 0.0, 0, 0, 0, 0)


@pytest.mark.parametrize("n", [4, 37, 1000])
def test_extremes_survive_downsampling(spark, n):
    rows = [(k * 1000, 91_200 if k == 7777 else -500 if k == 33 else 3000, 1) for k in range(10_000)]
    got = buckets.downsample(table(spark, rows), n).collect()
    assert len(got) == n and sum(r["count"] for r in got) == 10_000
    assert max(r["max_ua"] for r in got if r["count"]) == 91_200 and min(r["min_ua"] for r in got if r["count"]) == -500


def test_levels_roll_up(spark):
    df = table(spark, [(k * 10**6, k % 997, 1) for k in range(5000)])
    fine = buckets.summary_level(df, 10**7)
    want = sorted(map(tuple, buckets.with_mean(buckets.summary_level(df, 10**9)).select("bucket", "min_ua", "max_ua", "mean_ua", "count").collect()))
    assert sorted(map(tuple, buckets.with_mean(buckets.rolled_up(fine, 10**9)).select("bucket", "min_ua", "max_ua", "mean_ua", "count").collect())) == want
    assert buckets.coarsest((10**7, 10**9), 10**10, 10) == 10**9 and buckets.coarsest((10**7, 10**9), 10**9, 1000) is None


def test_a_million_long_durations(spark):
    """Nanoseconds of about a day, a million of them: their squares' sum is far beyond a decimal times the count."""
    df = spark.range(1_000_000).selectExpr("1 AS k", "86400000000000L + (id * 7919) % 1000003 AS x")
    r = one(distribution.describe(df, ["k"], "x", 3))
    values = [86_400_000_000_000 + (k * 7919) % 1_000_003 for k in range(1_000_000)]
    n, total = len(values), sum(values)
    assert (r["n"], r["total"]) == (n, float(total))
    assert r["stddev"] == pytest.approx(math.sqrt((n * sum(v * v for v in values) - total * total) / (n * (n - 1))), rel=1e-8)
    assert r["p50"] == sorted(values)[n // 2 - 1]


def test_extreme_values(spark):
    df = spark.createDataFrame([("a", -(2**63)), ("a", 2**63 - 1), ("b", 5), (None, 1), (None, 4)], "k string, x long")
    got = {r["k"]: r for r in distribution.describe(df, ["k"], "x", 0).collect()}
    assert got["a"]["stddev"] == pytest.approx(2**64 / math.sqrt(2)) and got["b"]["stddev"] == 0.0 and (got[None]["n"], got[None]["p50"], got[None]["p99"]) == (2, 1, 4)


def test_ranks_with_a_heavy_tail(spark):
    """One value far off leaves the others no fewer stretches: no partition has more than a few times its share."""
    df = spark.range(200_000).selectExpr("1 AS k", "CAST(exp(sqrt(-2 * ln((id + 1) / 200001.0)) * cos(id)) * 1000000 AS BIGINT) AS x").union(spark.createDataFrame([(1, 10**15)], "k int, x long"))
    values = sorted(r["x"] for r in df.collect())
    r = one(distribution.percentiles(df, ["k"], "x"))
    assert (r["p50"], r["p95"], r["p99"]) == tuple(values[math.ceil(q * len(values)) - 1] for q in (0.5, 0.95, 0.99))
    sizes = [x["n"] for x in distribution.counted(df, ["k"], "x").repartitionByRange("k", "x").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
