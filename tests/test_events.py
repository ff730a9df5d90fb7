"""Pairing against a stack, occurrence energy, budgets, names and time."""

import math
import random
from fractions import Fraction
from itertools import accumulate

import duckdb
import pytest
from pyspark.sql import functions as F

from joulegrid import registry
from joulegrid.functions import units
from joulegrid.operators import names, occurrences, pairing, rules, timebase
from joulegrid.operators.ordered import numbered, running, with_next
from joulegrid.schemas import EVENT_DEFS, EVENTS, RULES, SAMPLES

DEFS = [("TX", 1, 2, "radio", None, 0), ("READ", 3, 4, None, None, 0), ("PING", 9, None, None, None, 0)]


def defs(spark, rows=DEFS):
    return spark.createDataFrame(rows, EVENT_DEFS)


def events(spark, rows):
    return spark.createDataFrame([("c", k, t, i, None) for k, (t, i) in enumerate(rows)], EVENTS)


def stacked(rows):
    out, open_ = [], {1: [], 3: []}
    for k, (t, i) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])):
        if i in open_:
            open_[i].append((k, t))
        elif i - 1 in open_:
            name = "TX" if i == 2 else "READ"
            if open_[i - 1]:
                s, begin = open_[i - 1].pop()
                out.append((name, s, "paired", begin, t))
            else:
                out.append((name, k, "orphaned", None, t))
    out += [("TX" if i == 1 else "READ", s, "unterminated", t, None) for i, held in open_.items() for s, t in held]
    return sorted(out, key=repr)


def test_pairing_equals_a_stack(spark):
    r = random.Random(7)
    for size in (0, 1, 5, 40, 400):
        rows = [(r.randint(0, size // 2 + 1) * 1000, r.choice([1, 2, 3, 4, 9])) for _ in range(size)]
        for slice_ns in (3000, 10**12):
            got = pairing.paired(events(spark, rows), defs(spark), slice_ns=slice_ns).select("name", "seq", "status", "start_ns", "end_ns").collect()
            assert sorted(map(tuple, got), key=repr) == stacked(rows)


def test_nested_and_latency(spark):
    nested = [(100, 1), (150, 1), (200, 2), (300, 2)]
    got = sorted((r["start_ns"], r["end_ns"]) for r in pairing.occurrences(events(spark, nested), defs(spark)).collect())
    assert got == [(100, 300), (150, 200)]
    for latency, want in ((10_000, (90_000, 190_000)), (-5000, (105_000, 205_000)), (10**9, (0, 0))):
        moved = pairing.occurrences(events(spark, [(100_000, 1), (200_000, 2)]), defs(spark, [("TX", 1, 2, None, None, latency)])).first()
        assert (moved["start_ns"], moved["end_ns"]) == want


def golden(spark):
    inside = "(t_ns >= 10000000 AND t_ns < 10950000) OR (t_ns >= 40000000 AND t_ns < 40950000) OR (t_ns >= 70000000 AND t_ns < 70950000)"
    samples = spark.range(5000).selectExpr("'c' AS capture_id", "id AS seq", "id * 20000 AS t_ns").selectExpr("*", f"IF({inside}, 78000, 3000) AS current_ua", "3300000L AS voltage_uv")
    marks = [x for t in (10, 40, 70) for x in ((t * 10**6, 1), (t * 10**6 + 950_000, 2))]
    return samples, events(spark, marks)


def test_golden_capture(spark):
    from joulegrid.operators.regions import region_stats

    samples, marks = golden(spark)
    assert round(region_stats(samples).first()["energy_uj"], 3) == 1702.602
    found = pairing.occurrences(marks, defs(spark))
    energies = [r["energy_uj"] for r in occurrences.occurrence_energy(samples, found, slice_ns=10**6).collect()]
    assert energies == [241.956] * 3
    stats = {r["name"]: r for r in occurrences.event_stats(samples, marks, defs(spark), slice_ns=10**6).collect()}
    assert stats["TX"]["occurrences"] == 3 and stats["TX"]["duration_ns_mean"] == 950_000 and stats["READ"]["occurrences"] == 0
    assert stats["READ"]["mean_ua"] is None and stats["TX"]["peak_ua"] == 78_000
    assert stats["TX"]["duty_cycle"] == pytest.approx(3 * 950_000 / 99_980_001)


def test_an_event_between_samples_is_unsampled(spark):
    samples = spark.createDataFrame([("c", k, 20_000 * k, 1000, 1) for k in range(5)], SAMPLES)
    marks = events(spark, [(30_001, 1), (30_002, 2)])
    r = occurrences.event_stats(samples, marks, defs(spark)).where("name = 'TX'").first()
    assert (r["occurrences"], r["unsampled"], r["energy_nj_n"]) == (1, 1, 0)


def test_rules_fail_closed(spark):
    samples, marks = golden(spark)
    stats = occurrences.event_stats(samples, marks, defs(spark), slice_ns=10**6)
    held = [("TX", "mean_energy_uj", "<=", 260.0), ("TX", "mean_energy_uj", "<=", 200.0), ("TX", "occurrences", ">=", 9.0), ("READ", "mean_energy_uj", "<=", 1e9), ("NONE", "mean_energy_uj", "<=", 1e9), ("READ", "peak_current_ua", "<=", 1e9)]
    got = rules.evaluate(spark.createDataFrame(held, RULES), stats)
    assert [r["outcome"] for r in sorted(got.collect(), key=lambda r: held.index((r["event"], r["metric"], r["comparison"], r["limit"])))] == ["passed", "over_budget", "under_budget", "never_occurred", "unknown_event", "never_occurred"]
    report = rules.report(got).first()
    assert (report["rules"], report["failures"], report["all_passed"]) == (6, 5, False)
    assert rules.report(got.limit(0)).first()["all_passed"] is False


def test_regression_and_change(spark):
    samples, marks = golden(spark)
    now = occurrences.event_stats(samples, marks, defs(spark), slice_ns=10**6)
    before = now.withColumn("energy_nj_mean", F.col("energy_nj_mean") * 0.9)
    made = rules.regression_rules(now, before, 5.0)
    assert made.count() == 1
    r = rules.evaluate(made, now, before).first()
    assert r["outcome"] == "over_budget" and r["change_percent"] == pytest.approx(100 / 9, abs=1e-2)


def test_definitions_are_checked(spark):
    for bad in ([("", 1, 2)], [("A", 0, 2)], [("A", 1, 2), ("A", 3, 4)], [("A", 1, 2), ("B", 2, 3)], [("A", 1, 1)]):
        with pytest.raises(names.InvalidDefinitions):
            names.validated(defs(spark, [(*b, None, None, 0) for b in bad]))
    assert names.validated(defs(spark)).count() == 3


def ticks(spark, values):
    return spark.createDataFrame([("d", k, v) for k, v in enumerate(values)], "device string, arrival long, ticks long")


def test_unwrapping(spark):
    got = timebase.unwrapped(ticks(spark, [0xFFFFFFFF, 0, 5]), slice_rows=2).orderBy("arrival").collect()
    assert [r["epoch"] for r in got] == [0, 1, 1]
    for bad, step in (([100, 50], "backwards"), ([0, 3 << 30], "implausible")):
        times = timebase.unwrapped(ticks(spark, bad))
        assert times.orderBy(F.desc("arrival")).first()["step"] == step
        with pytest.raises(timebase.TimeError):
            timebase.checked(times)


def test_resolving_takes_the_nearest_epoch(spark):
    samples = timebase.unwrapped(ticks(spark, [0xFFFFFF00, 0x100]))
    late = spark.createDataFrame([("d", 10, 0xFFFFFFF0), ("d", 11, 0x200)], "device string, arrival long, ticks long")
    got = [r["full_ticks"] for r in timebase.resolved(late, samples, slice_rows=4).orderBy("arrival").collect()]
    assert got == [0xFFFFFFF0, (1 << 32) + 0x200]


def test_clock_fit(spark):
    rows = [("c", 5_000_000 + 1000 * x, 5_000_000 + 1000 * x + (4_000_000 if k % 5 == 0 else 0), x) for k, x in enumerate(range(0, 40_000, 1000))]
    df = spark.createDataFrame(rows, "capture_id string, host_send_ns long, host_recv_ns long, device_ticks long")
    r = timebase.clock_fit(df).first()
    assert r["a"] == pytest.approx(1000) and r["b"] == pytest.approx(5e6) and r["residual_ns"] < 1
    assert timebase.clock_fit(df.limit(2)).count() == 0 and timebase.clock_fit(df.withColumn("device_ticks", F.lit(7).cast("long"))).count() == 0


def test_clock_fit_of_a_month_is_exact_to_a_part_of_a_nanosecond(spark):
    r = random.Random(8)
    start = 1_704_067_200_000_000_000
    sends = {c: [start + r.randrange(30 * 86_400 * 10**6) * 1000 + r.randrange(1000) for _ in range(70)] for c in "abcdefgh"}
    rows = [(c, t, t + 20_000 + r.randrange(50_000), t // 1000) for c, some in sends.items() for t in some]
    df = spark.createDataFrame(rows, "capture_id string, host_send_ns long, host_recv_ns long, device_ticks long")
    got = {x["capture_id"]: x for x in timebase.clock_fit(df).collect()}
    for c in sends:
        own = [x for x in rows if x[0] == c]
        limit = sorted(x[2] - x[1] for x in own)[len(own) // 5]
        kept = [(Fraction(x[3]), Fraction(x[1] + (x[2] - x[1]) // 2)) for x in own if x[2] - x[1] <= limit]
        mx, my = (sum(v) / len(kept) for v in zip(*kept, strict=True))
        a = sum((x - mx) * (y - my) for x, y in kept) / sum((x - mx) ** 2 for x, _ in kept)
        square = sum((y - my - a * (x - mx)) ** 2 for x, y in kept) / len(kept)
        assert got[c]["samples"] == len(kept) and got[c]["a"] == pytest.approx(float(a), rel=1e-15)
        assert got[c]["residual_ns"] == pytest.approx(math.sqrt(square), rel=1e-10)


def test_residuals_near_a_half_are_rounded_as_the_sql_rounds_them(spark, tmp_path):
    """The residual is 2,499.99958 ns; the doubles of the SQL make it 2,500.0023."""
    ids = (
        "670 647 913 899 869 1039 1137 212 425 1121 1801 2022 382 370 2356 45 1075 534 1283 1824 2177 1578 105 1645 255 2465 5645 2366 3240 3105 177 2926 716 "
        "224 1761 888 2867 4861 4505 4936 400 1482 104 1228 9 4738 1140 156 1785 401 484 1247 5909 509 1277 166 1128 116 2892 152 554 2934 1688 "
    )
    times = (
        "17174469732 16972536525 24199096118 24390810105 23498803660 26029225273 30773641293 5185024166 10540803724 29338153985 47231427844 52227914770 "
        "10595550820 9721364713 61260180333 663807762 28045322418 14519609965 31898271489 48106639934 53876680326 43272149227 2978487246 43675890464 6978034288 "
        "61740385424 141726378186 61242627219 83229084811 79168479625 4768961530 75520680496 18655134388 5959771154 45852784760 22968959083 73606194500 "
        "130412738192 115932508867 130063689495 9583886798 39477167945 2690038704 33539337523 110761814 120987834534 30627363487 3630065095 44990324891 "
        "10113653829 13300281298 30995204516 153247071634 14213316788 31759651908 4138462682 30686582511 2997833477 74346393264 3723798541 15110479257 "
        "76228642337 44793904269 "
    )
    running_sum = lambda first, steps: list(accumulate(map(int, steps.split()), initial=first))
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, us BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    rows = list(zip(running_sum(500_833, ids), running_sum(1_704_087_549_059_715, times), strict=True))
    con.executemany("INSERT INTO events SELECT a, b, make_timestamp(b), c, 'view', 1.0, '{}' FROM (SELECT ?::BIGINT AS a, ?::BIGINT AS b, ?::BIGINT AS c)", [(*r, c) for c in (1, 2) for r in rows[: len(rows) if c == 1 else 40]])
    con.execute(f"COPY (SELECT * EXCLUDE us FROM events) TO '{tmp_path}/events.parquet'")
    got = registry.QUERIES["clock_fit"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE_SQL["clock_fit"]).fetchall())
    assert {r["capture_id"]: r["residual_us"] for r in got}["1"] == 3.0


def test_ordered_helpers_do_not_depend_on_slices(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randint(0, 99), k, r.randint(-3, 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, s long, x int")
    for f in (lambda n: with_next(df, ["k"], ["t", "s"], ["x"], n), lambda n: running(df, ["k"], ["t", "s"], F.col("x"), n), lambda n: numbered(df, ["k"], ["t", "s"], n)):
        got = [sorted(map(str, f(n).select(*sorted(f(n).columns)).collect())) for n in (1, 7, 1000)]
        assert got[0] == got[1] == got[2]


def test_units():
    assert units.quantity("3.3 V", "V") == 3.3 and units.quantity("260uJ", "J") == pytest.approx(260e-6) and units.quantity("1_000mA", "A") == 1.0
    assert units.duration_ns("950us") == 950_000 and units.duration_ns("2") == 2 * 10**9 and units.tolerance_percent("5%") == 5.0
    for bad in ("1e3A", "", "A", "5 xA"):
        with pytest.raises(units.InvalidQuantity):
            units.quantity(bad, "A")
    with pytest.raises(units.InvalidQuantity):
        units.tolerance_percent("5")


def test_slices_of_bursts(spark):
    from joulegrid.operators.ordered import DAY_NS, HOUR_NS, slice_length

    even = spark.range(7200).selectExpr("'a' AS k", "id * 500000000 AS t_ns")
    assert slice_length(even, ["k"]) == DAY_NS and slice_length(even, ["k"], rows=720) == HOUR_NS // 10
    # All within a tenth of a second, and the same again an hour later for a key that is null.
    burst = even.union(spark.range(50_000).selectExpr("IF(id % 2 = 0, 'b', NULL)", f"IF(id % 2 = 0, 0, {HOUR_NS}) + id * 2000"))
    length = slice_length(burst, ["k"], rows=1000)
    most = burst.groupBy("k", F.floor(F.col("t_ns") / F.lit(length))).count().agg(F.max("count")).first()[0]
    assert 500 <= most <= 1100
    assert slice_length(burst.limit(0), ["k"]) == DAY_NS


def test_dense_levels_in_stretches(spark, monkeypatch):
    from joulegrid.operators import buckets

    samples = spark.createDataFrame([("c", 0, 25, 1, None), ("c", 1, 1234, 2, None), ("d", 0, 7, 3, None)], SAMPLES)
    whole = sorted(map(tuple, buckets.summary_level(samples, 10, dense=True).select("capture_id", "bucket", "t_ns", "count").collect()))
    assert len(whole) == 123 and whole[0] == ("c", 2, 20, 1) and whole[-1] == ("d", 0, 0, 1)
    monkeypatch.setattr(buckets, "STRETCH", 7)
    assert sorted(map(tuple, buckets.summary_level(samples, 10, dense=True).select("capture_id", "bucket", "t_ns", "count").collect())) == whole
