"""Registered queries over the given tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulegrid.functions import text, units
from joulegrid.operators import buckets, distribution, gaps, names, occurrences, pairing, regions, rules, timebase
from joulegrid.operators.ordered import DAY_NS, HOUR_NS
from joulegrid.plans import capture
from joulegrid.shared import settle
from joulegrid.sinks import export
from joulegrid.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The span of the window queries: 2024-01-08 to 2024-01-22.
FROM_NS, TO_NS = 1_704_672_000_000_000_000, 1_705_881_600_000_000_000
RATE_HZ = 1 / 3600

SAMPLES = """samples AS (
  SELECT CAST(user_id AS VARCHAR) AS capture_id, event_id AS seq, epoch_us(ts) * 1000 AS t_ns,
         CAST(round(value * 1000) AS INTEGER) AS current_ua, 3300000 - event_id % 17 AS voltage_uv
  FROM events)"""
EVENTS = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS capture_id, event_id AS seq, epoch_us(ts) * 1000 AS t_ns,
         CASE event_type WHEN 'click' THEN 257 WHEN 'purchase' THEN 258 WHEN 'error' THEN 272 WHEN 'view' THEN 513 WHEN 'signup' THEN 514 END AS id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS value
  FROM events)"""
DEFS = """defs(name, start_id, stop_id, category, value_units) AS (
  VALUES ('CLICK_TO_PURCHASE', 257, 258, 'shop', NULL), ('VIEW_TO_SIGNUP', 513, 514, 'account', 'k'), ('ERROR', 272, NULL, NULL, NULL))"""


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def region_sql(where: str = "", energy: str = "(i0*v0 + i1*v1) * dt", charge: str = "(i0 + i1) * dt", voltage: str = "voltage_uv", tail: str = "SELECT * FROM stats") -> str:
    return f"""WITH {SAMPLES}, chosen AS (SELECT capture_id, seq, t_ns, current_ua, {voltage} AS voltage_uv FROM samples {where}),
pairs AS (
  SELECT *, current_ua::HUGEINT AS i0, voltage_uv::HUGEINT AS v0,
         (lead(current_ua) OVER w)::HUGEINT AS i1, (lead(voltage_uv) OVER w)::HUGEINT AS v1,
         (lead(t_ns) OVER w - t_ns)::HUGEINT AS dt
  FROM chosen WINDOW w AS (PARTITION BY capture_id ORDER BY t_ns, seq)),
sums AS (
  SELECT capture_id, count(*) AS samples, min(t_ns) AS first_ns, max(t_ns) AS last_ns, min(current_ua) AS min_ua, max(current_ua) AS max_ua,
         sum(i0) AS si, sum(i0*i0) AS sii, sum(v0) AS sv, max(i0*v0) AS peak,
         sum(coalesce({energy}, 0)) AS e2, sum(coalesce({charge}, 0)) AS c2
  FROM pairs GROUP BY capture_id),
scaled AS (
  SELECT *, CASE WHEN samples > 1 THEN (last_ns - first_ns)::DOUBLE / 1e9 ELSE 0.0 END AS duration_s,
         (e2 // 2000000000000)::DOUBLE / 1000.0 AS energy_uj, (c2 // 2000)::DOUBLE / 1000000.0 AS charge_uc
  FROM sums),
stats AS (
  SELECT capture_id, samples, first_ns, last_ns, duration_s, min_ua, max_ua,
         round(si::DOUBLE / samples, 6) AS mean_ua, round(sqrt(sii::DOUBLE / samples), 4) AS rms_ua, round(sv::DOUBLE / samples, 4) AS mean_uv,
         charge_uc, round(charge_uc / 3600000.0, 9) AS charge_mah, energy_uj,
         CASE WHEN duration_s > 0 THEN round(energy_uj / duration_s, 6) ELSE 0.0 END AS mean_power_uw,
         greatest(round(peak::DOUBLE / 1e6, 3), 0.0) AS peak_power_uw
  FROM scaled)
{tail}"""


@registered(region_sql())
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_stats(tables.samples(spark, sf_dir))


@registered(region_sql(energy="2*i0*v0*dt", charge="2*i0*dt"))
def region_stats_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_stats(tables.samples(spark, sf_dir), method="rectangular")


# The span's length stands for the duration of a single sample.
@registered(region_sql(where=f"WHERE t_ns >= {FROM_NS} AND t_ns < {TO_NS}").replace("ELSE 0.0 END AS duration_s", f"ELSE {TO_NS - FROM_NS}::DOUBLE / 1e9 END AS duration_s"))
def region_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_stats(tables.samples(spark, sf_dir), start_ns=FROM_NS, end_ns=TO_NS)


@registered(region_sql(voltage="1800000"))
def region_supply_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_stats(tables.samples(spark, sf_dir), supply_uv=1_800_000)


@registered(region_sql(voltage="CASE WHEN seq % 3 = 0 THEN 3300000 ELSE voltage_uv END"))
def region_voltage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    partly = tables.samples(spark, sf_dir).withColumn("voltage_uv", F.when(F.col("seq") % 3 != 0, F.col("voltage_uv")))
    return regions.region_stats(partly)


@registered(region_sql(energy="CASE WHEN dt <= 10800000000000 THEN (i0*v0 + i1*v1) * dt END", charge="CASE WHEN dt <= 10800000000000 THEN (i0 + i1) * dt END"))
def region_skip_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.samples(spark, sf_dir)
    return regions.region_stats(samples, gaps=gaps.time_gaps(samples, RATE_HZ), gap_policy="skip")


@registered(region_sql(tail="SELECT capture_id, charge_uc, charge_mah FROM stats"))
def charge_mah(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_stats(tables.samples(spark, sf_dir)).select("capture_id", "charge_uc", "charge_mah")


@registered(region_sql(tail="SELECT capture_id, mean_ua, CASE WHEN mean_ua > 0 THEN round(220.0 / (mean_ua / 1000), 6) END AS battery_hours FROM stats"))
def battery_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.battery_hours(regions.region_stats(tables.samples(spark, sf_dir))).select("capture_id", "mean_ua", "battery_hours")


@registered(f"""WITH {SAMPLES} SELECT capture_id, seq, current_ua::HUGEINT * voltage_uv::HUGEINT / 1000000.0::DOUBLE AS power_uw FROM samples""")
def sample_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.samples(spark, sf_dir).select("capture_id", "seq", regions.power_uw().alias("power_uw"))


def distribution_sql(source: str, key: str, value: str) -> str:
    rank = lambda q: f"coalesce(max(CASE WHEN rn = greatest(CAST(ceil({q}::DOUBLE * cnt) AS BIGINT), 1) THEN x END), 0)"
    return f"""{source}, r AS (
  SELECT {key}, {value} AS x, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY {key}) AS cnt FROM d)
SELECT {key}, count(*) AS n, round(sum(x)::DOUBLE / count(*), 6) AS mean, min(x) AS min, max(x) AS max,
       CASE WHEN count(*) > 1 THEN round(sqrt((count(*)::HUGEINT * sum(x::HUGEINT * x) - sum(x::HUGEINT) * sum(x::HUGEINT))::DOUBLE / (count(*) * (count(*) - 1))::DOUBLE), 6) ELSE 0.0 END AS stddev,
       {rank(0.5)} AS p50, {rank(0.95)} AS p95, {rank(0.99)} AS p99, sum(x)::DOUBLE AS total
FROM r GROUP BY {key}"""


@registered(distribution_sql(f"WITH {EVENTS}, d AS (SELECT * FROM ev)", "id", "value"))
def distribution_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.describe(tables.events(spark, sf_dir), ["id"], "value")


@registered(distribution_sql("WITH d AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q FROM lineitem)", "l_returnflag", "q"))
def distribution_of_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))
    return distribution.describe(rows, ["l_returnflag"], "q")


@registered(f"""WITH {SAMPLES}, r AS (
  SELECT capture_id, current_ua, row_number() OVER (PARTITION BY capture_id ORDER BY current_ua) AS rn, count(*) OVER (PARTITION BY capture_id) AS n FROM samples)
SELECT capture_id, max(CASE WHEN rn = greatest(ceil(0.5::DOUBLE * n), 1) THEN current_ua END) AS p50,
       max(CASE WHEN rn = greatest(ceil(0.95::DOUBLE * n), 1) THEN current_ua END) AS p95,
       max(CASE WHEN rn = greatest(ceil(0.99::DOUBLE * n), 1) THEN current_ua END) AS p99
FROM r GROUP BY capture_id""")
def percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.percentiles(tables.samples(spark, sf_dir), ["capture_id"], "current_ua")


VARIATION = distribution_sql(f"WITH {EVENTS}, d AS (SELECT * FROM ev)", "id", "value")


@registered(f"SELECT id, CASE WHEN mean <> 0 THEN round(stddev / abs(mean), 6) END AS variation FROM ({VARIATION}) t")
def coefficient_of_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.describe(tables.events(spark, sf_dir), ["id"], "value").select("id", distribution.variation().alias("variation"))


# Brackets in SQL: a stop belongs to the latest start before it after which sums never fall below the start's own.
PAIRS = f"""WITH {SAMPLES}, {EVENTS}, {DEFS},
marks AS (
  SELECT d.name, e.*, CASE WHEN e.id = d.start_id THEN 1 ELSE -1 END AS step
  FROM ev e JOIN defs d ON d.stop_id IS NOT NULL AND e.id IN (d.start_id, d.stop_id)),
walk AS (SELECT *, sum(step) OVER (PARTITION BY capture_id, name ORDER BY t_ns, seq) AS total FROM marks),
low AS (
  SELECT *, least(0, min(total) OVER (PARTITION BY capture_id, name ORDER BY t_ns, seq)) AS m,
         least(0, coalesce(min(total) OVER (PARTITION BY capture_id, name ORDER BY t_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pm
  FROM walk),
kept AS (SELECT *, total - m + CASE WHEN step = -1 THEN 1 ELSE 0 END AS level FROM low WHERE NOT (step = -1 AND total < pm)),
nexts AS (SELECT *, lead(step) OVER w AS next_step, lead(t_ns) OVER w AS next_ns FROM kept WINDOW w AS (PARTITION BY capture_id, name, level ORDER BY t_ns, seq)),
pairs AS (
  SELECT capture_id, name, seq, value, CASE WHEN next_step = -1 THEN 'paired' ELSE 'unterminated' END AS status, t_ns AS start_ns, CASE WHEN next_step = -1 THEN next_ns END AS end_ns
  FROM nexts WHERE step = 1
  UNION ALL SELECT capture_id, name, seq, value, 'orphaned', NULL, t_ns FROM low WHERE step = -1 AND total < pm)"""


@registered(PAIRS + " SELECT * FROM pairs")
def pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.paired(tables.events(spark, sf_dir), tables.event_defs(spark))


@registered(PAIRS + """ SELECT capture_id, name, count(*) FILTER (status = 'paired') AS paired, count(*) FILTER (status = 'unterminated') AS unterminated,
count(*) FILTER (status = 'orphaned') AS orphaned FROM pairs GROUP BY capture_id, name""")
def orphans_unterminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pairing_counts(pairing.paired(tables.events(spark, sf_dir), tables.event_defs(spark)))


@registered(PAIRS + """ SELECT capture_id, name, seq, value, status, CASE WHEN start_ns IS NOT NULL THEN greatest(start_ns - 5000000000, 0) END AS start_ns, CASE WHEN end_ns IS NOT NULL THEN greatest(end_ns - 5000000000, 0) END AS end_ns FROM pairs""")
def latency_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.paired(tables.events(spark, sf_dir), tables.event_defs(spark).withColumn("latency_compensation_ns", F.lit(5_000_000_000).cast("bigint")))


OCCURRENCES = PAIRS + """,
steps AS (
  SELECT capture_id, t_ns, current_ua, lead(t_ns) OVER w AS next_ns,
         (current_ua::HUGEINT * voltage_uv + (lead(current_ua) OVER w)::HUGEINT * lead(voltage_uv) OVER w) * (lead(t_ns) OVER w - t_ns)::HUGEINT AS e2
  FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY t_ns, seq)),
occ AS (
  SELECT p.capture_id, p.name, p.seq, any_value(p.value) AS value, any_value(p.start_ns) AS start_ns, any_value(p.end_ns) AS end_ns,
         count(s.t_ns) AS samples, sum(s.current_ua) AS sum_i, max(s.current_ua) AS max_ua,
         CASE WHEN count(s.t_ns) > 0 THEN (sum(CASE WHEN s.next_ns < p.end_ns THEN s.e2 ELSE 0 END) // 2000000000000)::DOUBLE / 1000.0 END AS energy_uj
  FROM pairs p LEFT JOIN steps s ON s.capture_id = p.capture_id AND s.t_ns >= p.start_ns AND s.t_ns < p.end_ns
  WHERE p.status = 'paired' GROUP BY p.capture_id, p.name, p.seq)"""


@registered(OCCURRENCES + " SELECT capture_id, name, seq, value, start_ns, end_ns, samples, CAST(sum_i AS BIGINT) AS sum_i, max_ua, energy_uj FROM occ")
def occurrence_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.occurrences(tables.events(spark, sf_dir), tables.event_defs(spark))
    return occurrences.occurrence_energy(tables.samples(spark, sf_dir), found).select("capture_id", "name", "seq", "value", "start_ns", "end_ns", "samples", "sum_i", "max_ua", "energy_uj")


def nine(prefix: str, x: str) -> str:
    pick = lambda q: f"coalesce(max(CASE WHEN {prefix}_rn = greatest(CAST(ceil({q}::DOUBLE * {prefix}_cnt) AS BIGINT), 1) THEN {x} END), 0)"
    n = f"count({x})"
    return f"""{n} AS {prefix}_n, coalesce(round(sum({x})::DOUBLE / {n}, 0), 0.0) AS {prefix}_mean, coalesce(min({x}), 0) AS {prefix}_min, coalesce(max({x}), 0) AS {prefix}_max,
  CASE WHEN {n} > 1 THEN round(sqrt(({n}::HUGEINT * sum({x}::HUGEINT * {x}) - sum({x}::HUGEINT) * sum({x}::HUGEINT))::DOUBLE / ({n} * ({n} - 1))::DOUBLE), 0) ELSE 0.0 END AS {prefix}_stddev,
  {pick(0.5)} AS {prefix}_p50, {pick(0.95)} AS {prefix}_p95, {pick(0.99)} AS {prefix}_p99, coalesce(sum({x})::DOUBLE, 0.0) AS {prefix}_total"""


#: For statistics, starts come 1 ns after their row's sample and stops 1 ns before, so that some occurrences hold none.
BETWEEN = EVENTS.replace("epoch_us(ts) * 1000 AS t_ns", "epoch_us(ts) * 1000 + CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS t_ns")
STATS = OCCURRENCES.replace(EVENTS, BETWEEN) + f""",
meas AS (SELECT name, samples, sum_i, max_ua, end_ns - start_ns AS d, CAST(round(energy_uj * 1000) AS BIGINT) AS e FROM occ),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d) AS duration_ns_rn, row_number() OVER (PARTITION BY name ORDER BY e) AS energy_nj_rn, count(d) OVER (PARTITION BY name) AS duration_ns_cnt, count(e) OVER (PARTITION BY name) AS energy_nj_cnt FROM meas),
dist AS (SELECT name, {nine("duration_ns", "d")}, {nine("energy_nj", "e")},
  round(sum(sum_i)::DOUBLE / nullif(sum(samples), 0)::DOUBLE, 6) AS mean_ua, max(max_ua) AS peak_ua,
  count(*) FILTER (samples = 0) AS unsampled, count(*) FILTER (samples = 1) AS single_sample FROM numbered GROUP BY name),
counts AS (SELECT name, count(*) FILTER (status = 'paired') AS occurrences, count(*) FILTER (status = 'unterminated') AS unterminated, count(*) FILTER (status = 'orphaned') AS orphaned FROM pairs GROUP BY name),
span AS (SELECT sum(w) AS w FROM (SELECT max(t_ns) + 1 - min(t_ns) AS w FROM samples GROUP BY capture_id) t),
stats AS (SELECT d.category, d.value_units, c.*, x.* EXCLUDE (name), round(x.duration_ns_total::DOUBLE / (SELECT w::DOUBLE FROM span), 9) AS duty_cycle
  FROM defs d JOIN counts c USING (name) JOIN dist x USING (name) WHERE d.stop_id IS NOT NULL)"""


def _between(events: DataFrame) -> DataFrame:
    return events.withColumn("t_ns", F.col("t_ns") + F.when(F.col("id").isin(0x0101, 0x0201), 1).otherwise(-1))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.event_stats(tables.samples(spark, sf_dir), _between(tables.events(spark, sf_dir)), tables.event_defs(spark))


@registered(STATS + " SELECT * FROM stats")
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@registered(STATS + " SELECT name, occurrences, energy_nj_total FROM stats ORDER BY energy_nj_total DESC, name LIMIT 1")
def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.top_events(_stats(spark, sf_dir), 1).select("name", "occurrences", "energy_nj_total")


@registered(STATS + " SELECT name, duty_cycle, unterminated > 0 OR orphaned > 0 OR unsampled > 0 AS has_warnings FROM stats")
def duty_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("name", "duty_cycle", occurrences.has_warnings().alias("has_warnings"))


@registered(STATS + " SELECT name, mean_ua, peak_ua FROM stats")
def weighted_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("name", "mean_ua", "peak_ua")


GAPS = f"""WITH {SAMPLES}, {EVENTS}, nx AS (SELECT capture_id, t_ns, lead(t_ns) OVER w AS n, lead(seq) OVER w AS k FROM samples WINDOW w AS (PARTITION BY capture_id ORDER BY t_ns, seq)),
gaps AS (SELECT capture_id, t_ns AS start_ns, n AS end_ns, CASE WHEN k % 11 = 0 THEN 'device_overflow' WHEN k % 7 = 0 THEN 'sequence_gap' ELSE 'timestamp_jump' END AS cause, greatest((n - t_ns) // 3600000000000 - 1, 0) AS lost_estimate FROM nx WHERE n - t_ns > 10800000000000)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of samples of which some say that the device overflowed or that a frame was lost before them."""
    flagged = tables.samples(spark, sf_dir).withColumn("overflow_before", F.col("seq") % 11 == 0).withColumn("seq_gap_before", F.col("seq") % 7 == 0)
    return gaps.time_gaps(flagged, RATE_HZ)


@registered(GAPS + " SELECT * FROM gaps")
def time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir)


@registered(GAPS + f""", spans AS (SELECT capture_id, t_ns AS a, t_ns + {HOUR_NS} AS b FROM ev WHERE id = 272)
SELECT * FROM gaps g WHERE EXISTS (SELECT 1 FROM spans s WHERE s.capture_id = g.capture_id AND g.start_ns < s.b AND g.end_ns > s.a)""")
def gap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = tables.events(spark, sf_dir).where("id = 272").select("capture_id", F.col("t_ns").alias("start_ns"), (F.col("t_ns") + HOUR_NS).alias("end_ns"))
    return gaps.overlapping(_gaps(spark, sf_dir), errors)


@registered(GAPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_ns) AS k FROM gaps)
SELECT capture_id, count(*) AS gaps, CAST(sum(end_ns - start_ns) AS BIGINT) AS missing_ns, CAST(sum(lost_estimate) AS BIGINT) AS lost_estimate,
       string_agg(start_ns || '-' || end_ns, ';' ORDER BY start_ns) FILTER (k <= 5) AS first_gaps, greatest(count(*) - 5, 0) AS not_shown
FROM r GROUP BY capture_id""")
def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gap_totals(_gaps(spark, sf_dir))


BUCKET = """min(current_ua) AS min_ua, max(current_ua) AS max_ua, CASE WHEN count(current_ua) > 0 THEN round(sum(current_ua)::DOUBLE / count(current_ua), 6) END AS mean_ua, count(current_ua) AS count"""
DOWNSAMPLED = f"""WITH {SAMPLES}, sp AS (SELECT capture_id, min(t_ns) AS s, max(t_ns) + 1 AS e FROM samples GROUP BY capture_id),
w AS (SELECT *, (e - s + 63) // 64 AS w FROM sp), spine AS (SELECT w.*, b AS bucket FROM w, range(64) t(b)),
f AS (SELECT s.capture_id, least((s.t_ns - w.s) // w.w, 63) AS bucket, current_ua FROM samples s JOIN w USING (capture_id)),
down AS (SELECT capture_id, bucket, any_value(s + bucket * w) AS t_ns, {BUCKET} FROM spine LEFT JOIN f USING (capture_id, bucket) GROUP BY capture_id, bucket)"""


@registered(DOWNSAMPLED + " SELECT * FROM down")
def downsample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.downsample(tables.samples(spark, sf_dir), 64)


@registered(DOWNSAMPLED + """, hi AS (SELECT *, greatest(max(max_ua) OVER (PARTITION BY capture_id), 1) AS top FROM down)
SELECT capture_id, string_agg(CASE WHEN count = 0 THEN ' ' ELSE substring('▁▂▃▄▅▆▇█', CAST(least(greatest(floor(greatest(max_ua, 0)::DOUBLE / top::DOUBLE * 8.0), 0), 7) AS INTEGER) + 1, 1) END, '' ORDER BY bucket) AS line
FROM hi GROUP BY capture_id""")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.sparkline(buckets.downsample(tables.samples(spark, sf_dir), 64))


def level_sql(width: int) -> str:
    return f"SELECT capture_id, t_ns // {width} AS bucket, (t_ns // {width}) * {width} AS t_ns, {BUCKET} FROM samples GROUP BY capture_id, t_ns // {width}"


@registered(f"WITH {SAMPLES} {level_sql(HOUR_NS)}")
def summary_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.with_mean(buckets.summary_level(tables.samples(spark, sf_dir), HOUR_NS))


@registered(f"WITH {SAMPLES} {level_sql(DAY_NS)}")
def summary_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = buckets.summary_level(tables.samples(spark, sf_dir), HOUR_NS)
    return buckets.with_mean(buckets.rolled_up(fine, DAY_NS))


@registered(f"""WITH {SAMPLES}, e AS (SELECT capture_id, min(t_ns // {DAY_NS}) AS a, max(t_ns // {DAY_NS}) AS b FROM samples GROUP BY capture_id),
spine AS (SELECT capture_id, unnest(range(a, b + 1)) AS bucket FROM e)
SELECT capture_id, bucket, bucket * {DAY_NS} AS t_ns, {BUCKET} FROM spine LEFT JOIN (SELECT capture_id, t_ns // {DAY_NS} AS bucket, current_ua FROM samples) s USING (capture_id, bucket) GROUP BY capture_id, bucket""")
def summary_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.with_mean(buckets.summary_level(tables.samples(spark, sf_dir), DAY_NS, dense=True))


@registered(f"WITH {SAMPLES}, l AS ({level_sql(DAY_NS)}) SELECT * FROM l WHERE t_ns + {DAY_NS} > {FROM_NS + HOUR_NS} AND t_ns < {TO_NS + HOUR_NS}")
def bucket_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = buckets.with_mean(buckets.summary_level(tables.samples(spark, sf_dir), DAY_NS))
    return buckets.bucket_range(level, DAY_NS, FROM_NS + HOUR_NS, TO_NS + HOUR_NS)


@registered(f"""WITH {SAMPLES}, s AS (SELECT * FROM samples WHERE t_ns >= {FROM_NS} AND t_ns < {TO_NS})
SELECT capture_id, (t_ns - {FROM_NS}) // {2 * DAY_NS} AS bucket, {FROM_NS} + ((t_ns - {FROM_NS}) // {2 * DAY_NS}) * {2 * DAY_NS} AS t_ns, {BUCKET} FROM s GROUP BY capture_id, (t_ns - {FROM_NS}) // {2 * DAY_NS}""")
def overview_from_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.samples(spark, sf_dir)
    levels = {w: buckets.summary_level(samples, w) for w in buckets.SLOW_LEVELS_NS}
    return buckets.overview(samples, levels, FROM_NS, TO_NS, 7)


@registered(f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY t_ns, seq) - 1 AS k FROM samples)
SELECT capture_id, seq, t_ns, current_ua, voltage_uv FROM r WHERE k % 7 = 0""")
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.decimated(tables.samples(spark, sf_dir), 7)


NAMED = f"""WITH {EVENTS}, {DEFS}, ids AS (SELECT start_id AS id, name FROM defs UNION ALL SELECT stop_id, name || ':stop' FROM defs WHERE stop_id IS NOT NULL)"""


@registered(NAMED + " SELECT e.*, coalesce(i.name, printf('0x%04X', e.id)) AS name FROM ev e LEFT JOIN ids i USING (id)")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.with_names(tables.events(spark, sf_dir), tables.event_defs(spark))


@registered(NAMED + " SELECT id, count(*) AS n, printf('0x%04X', id) AS name FROM ev WHERE id NOT IN (SELECT id FROM ids WHERE id <> 272) GROUP BY id")
def undeclared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.undeclared(tables.events(spark, sf_dir), tables.event_defs(spark).where("name <> 'ERROR'"))


@registered(f"WITH {EVENTS} SELECT capture_id, id, min(t_ns) AS first_ns FROM ev GROUP BY capture_id, id")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.first_seen(tables.events(spark, sf_dir))


@registered(f"WITH {EVENTS}, s AS (SELECT *, (value * 517 + seq) % 65536 AS st FROM ev) SELECT capture_id, seq, (st >> 3) & 1 AS pin3, (st >> 12) & 1 AS pin12 FROM s")
def gpio_pin_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.gpio(spark, sf_dir).select("capture_id", "seq", names.pin_level(F.col("state"), 3).alias("pin3"), names.pin_level(F.col("state"), 12).alias("pin12"))


@registered(f"WITH {EVENTS} SELECT DISTINCT value * 700 AS id, value * 700 <> 0 AS valid, value * 700 >= 65280 AS internal, (value * 700) >> 8 AS category, printf('0x%04X', value * 700) AS hex FROM ev")
def id_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tables.events(spark, sf_dir).select((F.col("value") * 700).alias("id")).distinct()
    return ids.select("id", *(c.alias(n) for n, c in names.id_properties(F.col("id")).items()), names.hex_id(F.col("id")).alias("hex"))


@registered("""WITH d AS (SELECT p_name AS name, CAST(p_partkey % 4096 AS INTEGER) AS start_id, CAST((p_partkey * 7 + 1) % 4096 AS INTEGER) AS stop_id FROM part),
c AS (SELECT start_id AS id, name FROM d UNION ALL SELECT stop_id, name FROM d)
SELECT min(name) AS name, 'id claimed twice' AS problem FROM c GROUP BY id HAVING count(DISTINCT name) > 1
UNION ALL SELECT name, 'id 0' FROM d WHERE start_id = 0 OR stop_id = 0
UNION ALL SELECT name, 'start is stop' FROM d WHERE start_id = stop_id
UNION ALL SELECT name, 'duplicate name' FROM d GROUP BY name HAVING count(*) > 1""")
def definition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    defs = tables.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (key % 4096).cast("int").alias("start_id"), ((key * 7 + 1) % 4096).cast("int").alias("stop_id"))
    return names.problems(defs)


TICKS = f"""ticks AS (SELECT capture_id AS device, row_number() OVER (PARTITION BY capture_id ORDER BY t_ns, seq) - 1 AS arrival, (t_ns // 1000000) % 4294967296 AS ticks FROM samples)"""


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.operators.ordered import numbered

    rows = numbered(tables.samples(spark, sf_dir), ("capture_id",), ("t_ns", "seq"), name="arrival")
    millis = F.call_function("div", F.col("t_ns"), F.lit(1_000_000).cast("bigint"))
    return rows.select(F.col("capture_id").alias("device"), F.col("arrival").cast("bigint").alias("arrival"), (millis % (1 << 32)).alias("ticks"))


UNWRAPPED = f"""WITH {SAMPLES}, {TICKS}, b AS (SELECT *, lag(ticks) OVER (PARTITION BY device ORDER BY arrival) - ticks AS back FROM ticks),
s AS (SELECT *, CASE WHEN back IS NULL OR (back <= 0 AND back >= -2147483648) THEN 'ok' WHEN back > 2147483648 THEN 'wrap' WHEN back > 0 THEN 'backwards' ELSE 'implausible' END AS step FROM b),
u AS (SELECT device, arrival, ticks, step, CAST(sum(CASE WHEN step = 'wrap' THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY arrival) AS BIGINT) AS epoch FROM s)"""


@registered(UNWRAPPED + " SELECT *, epoch * 4294967296 + ticks AS full_ticks FROM u")
def tick_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timebase.unwrapped(_ticks(spark, sf_dir), slice_rows=64)


@registered(UNWRAPPED + """, x AS (SELECT * FROM u WHERE arrival % 5 <> 0), e AS (SELECT *, (ticks + 1000) % 4294967296 AS et FROM u WHERE arrival % 5 = 0),
a AS (SELECT e.device, e.arrival, e.et AS ticks, coalesce((SELECT max_by(x.epoch * 4294967296 + x.ticks, x.arrival) FROM x WHERE x.device = e.device AND x.arrival < e.arrival), 0) AS near FROM e),
f AS (SELECT *, (near // 4294967296) * 4294967296 + ticks AS base FROM a)
SELECT device, arrival, ticks, CASE WHEN base - near > 2147483648 AND base >= 4294967296 THEN base - 4294967296 WHEN near - base > 2147483648 THEN base + 4294967296 ELSE base END AS full_ticks FROM f""")
def resolve_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = timebase.unwrapped(_ticks(spark, sf_dir), slice_rows=64)
    late = times.where("arrival % 5 = 0").select("device", "arrival", ((F.col("ticks") + 1000) % (1 << 32)).alias("ticks"))
    return timebase.resolved(late, times.where("arrival % 5 <> 0"), slice_rows=64)


@registered(f"""WITH {SAMPLES} SELECT capture_id, seq, CAST((t_ns::HUGEINT // 30517) * 1000000000 // 32768 AS BIGINT) AS ns,
CAST(t_ns::HUGEINT * 32768 // 1000000000 AS BIGINT) AS ticks, CAST(((current_ua - 120)::HUGEINT * 1009) // 1000 AS BIGINT) AS calibrated_ua FROM samples""")
def time_and_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    hz = F.lit(32768).cast("bigint")
    ticks = F.call_function("div", F.col("t_ns"), F.lit(30517).cast("bigint"))
    one = timebase.calibrated(F.col("current_ua"), F.lit(120), F.lit(1009), F.lit(1000))
    return tables.samples(spark, sf_dir).select("capture_id", "seq", timebase.ticks_to_ns(ticks, hz).alias("ns"), timebase.ns_to_ticks(F.col("t_ns"), hz).alias("ticks"), one.alias("calibrated_ua"))


SYNC = f"""sync AS (SELECT capture_id, t_ns AS s, t_ns + 20000 + (seq * 7919) % 50000 + CASE WHEN seq % 5 = 0 THEN 4000000 ELSE 0 END AS r, t_ns // 1000 AS x FROM samples)"""


@registered(f"""WITH {SAMPLES}, {SYNC}, m AS (SELECT *, r - s AS rtt, s + (r - s) // 2 AS y, row_number() OVER (PARTITION BY capture_id ORDER BY r - s) - 1 AS k, count(*) OVER (PARTITION BY capture_id) AS n FROM sync),
l AS (SELECT capture_id, min(rtt) AS lim FROM m WHERE k = least(greatest(n // 5, 2), n - 1) AND n >= 3 GROUP BY capture_id),
kept AS (SELECT capture_id, (x - min(x) OVER (PARTITION BY capture_id))::DOUBLE AS x, (y - min(y) OVER (PARTITION BY capture_id))::DOUBLE AS y FROM m JOIN l USING (capture_id) WHERE rtt <= lim),
line AS (SELECT capture_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM kept GROUP BY capture_id HAVING var_pop(x) > 0)
SELECT capture_id, count(*) AS samples, round(any_value(a), 6) AS a, round((any_value(a) / 1000 - 1) * 1e6, 2) + 0.0 AS drift_ppm, round(sqrt(avg((y - a * x - b) ** 2)) / 1e3, 0) AS residual_us FROM kept JOIN line USING (capture_id) GROUP BY capture_id""")
def clock_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    jitter = 20000 + (F.col("seq") * 7919) % 50000 + F.when(F.col("seq") % 5 == 0, 4_000_000).otherwise(0)
    rows = tables.samples(spark, sf_dir).select("capture_id", F.col("t_ns").alias("host_send_ns"), (F.col("t_ns") + jitter).alias("host_recv_ns"), F.call_function("div", F.col("t_ns"), F.lit(1000).cast("bigint")).alias("device_ticks"))
    drift = timebase.drift_ppm(F.col("a"), F.lit(1_000_000))
    kept = settle(timebase.quick_trips(rows))
    fits = timebase.whole_microseconds(kept, settle(timebase.fitted(kept)))
    return fits.select("capture_id", "samples", F.round("a", 6).alias("a"), (F.round(drift, 2) + F.lit(0.0)).alias("drift_ppm"), "residual_us")


@registered(f"""WITH {EVENTS}, p AS (SELECT capture_id, seq, t_ns AS a, t_ns + value * 60000000000 AS b, lead(t_ns) OVER w AS c, lead(t_ns + value * 60000000000) OVER w AS d FROM ev WINDOW w AS (PARTITION BY capture_id ORDER BY t_ns, seq))
SELECT capture_id, seq, a < d AND c < b AS overlaps, CASE WHEN a < d AND c < b THEN greatest(a, c) END AS from_ns, CASE WHEN a < d AND c < b THEN least(b, d) END AS to_ns, least(a, c) AS hull_from_ns, greatest(b, d) AS hull_to_ns FROM p WHERE c IS NOT NULL""")
def span_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.operators.ordered import with_next

    rows = tables.events(spark, sf_dir).withColumn("b", F.col("t_ns") + F.col("value") * 60_000_000_000)
    pairs = with_next(rows, ("capture_id",), ("t_ns", "seq"), ("b",)).where("next IS NOT NULL")
    return pairs.select("capture_id", "seq", *(c.alias(n) for n, c in timebase.overlap(F.col("t_ns"), F.col("b"), F.col("next.t_ns"), F.col("next.b")).items()))


@registered(f"""WITH {EVENTS}, f AS (SELECT capture_id AS device, row_number() OVER (PARTITION BY capture_id ORDER BY t_ns, seq) - 1 AS arrival, CAST(seq % 256 AS INTEGER) AS seq, value <> 13 AS accepted FROM ev),
n AS (SELECT *, lead(seq) OVER (PARTITION BY device ORDER BY arrival) AS nx FROM f WHERE accepted)
SELECT device, count(*) AS accepted, count(*) FILTER (nx <> (seq + 1) % 256) AS gaps, CAST(coalesce(sum(CASE WHEN nx <> (seq + 1) % 256 THEN ((nx - seq - 1) % 256 + 256) % 256 ELSE 0 END), 0) AS BIGINT) AS missing FROM n GROUP BY device""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.operators.ordered import numbered

    rows = numbered(tables.events(spark, sf_dir), ("capture_id",), ("t_ns", "seq"), name="arrival")
    frames = rows.select(F.col("capture_id").alias("device"), "arrival", (F.col("seq") % 256).cast("int").alias("seq"), (F.col("value") != 13).alias("accepted"))
    return gaps.sequence_gaps(frames, slice_rows=64)


RULES = [
    ("CLICK_TO_PURCHASE", "mean_energy_uj", "<=", 2.0e8), ("CLICK_TO_PURCHASE", "peak_current_ua", "<=", 1.0e9),
    ("VIEW_TO_SIGNUP", "max_duration_ns", "<=", 1.0), ("VIEW_TO_SIGNUP", "occurrences", ">=", 1.0), ("NOT_DECLARED", "mean_energy_uj", "<=", 1.0),
]
CHECKED = STATS + """, rules(event, metric, comparison, lim) AS (VALUES ('CLICK_TO_PURCHASE', 'mean_energy_uj', '<=', 2.0e8::DOUBLE), ('CLICK_TO_PURCHASE', 'peak_current_ua', '<=', 1.0e9),
  ('VIEW_TO_SIGNUP', 'max_duration_ns', '<=', 1.0), ('VIEW_TO_SIGNUP', 'occurrences', '>=', 1.0), ('NOT_DECLARED', 'mean_energy_uj', '<=', 1.0)),
vals AS (SELECT r.*, s.name, CASE r.metric WHEN 'mean_energy_uj' THEN round(s.energy_nj_mean * 1e-3, 6) WHEN 'peak_current_ua' THEN s.peak_ua::DOUBLE WHEN 'max_duration_ns' THEN s.duration_ns_max::DOUBLE ELSE s.occurrences::DOUBLE END AS value,
  concat_ws(', ', CASE WHEN s.unterminated > 0 THEN s.unterminated || ' unterminated' END, CASE WHEN s.orphaned > 0 THEN s.orphaned || ' orphaned' END, CASE WHEN s.unsampled > 0 THEN s.unsampled || ' unsampled' END) AS warnings
  FROM rules r LEFT JOIN stats s ON s.name = r.event),
checked AS (SELECT event, metric, comparison, lim AS "limit", value, coalesce(CASE comparison WHEN '<=' THEN value <= lim ELSE value >= lim END, false) AS passed,
  CASE WHEN name IS NULL THEN 'unknown_event' WHEN CASE comparison WHEN '<=' THEN value <= lim ELSE value >= lim END THEN 'passed' WHEN comparison = '<=' THEN 'over_budget' ELSE 'under_budget' END AS outcome, warnings FROM vals)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(spark.createDataFrame(RULES, "event string, metric string, comparison string, limit double"), settle(_stats(spark, sf_dir)))


@registered(CHECKED + " SELECT * FROM checked")
def assert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("event", "metric", "comparison", "limit", "value", "passed", "outcome", "warnings")


@registered(CHECKED + " SELECT count(*) AS rules, count(*) FILTER (NOT passed) AS failures, bool_and(passed) AS all_passed FROM checked")
def assertion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(_checked(spark, sf_dir))


#: The baseline is what lies before 2024-01-16, and what follows is held against it.
SPLIT_NS = 1_705_363_200_000_000_000
BEFORE, AFTER = (STATS.replace("FROM events)", f"FROM events WHERE epoch_us(ts) * 1000 {sign} {SPLIT_NS})") for sign in ("<", ">="))


@registered(f"""WITH b AS (SELECT * FROM ({BEFORE} SELECT name, occurrences, unsampled, round(energy_nj_mean * 1e-3, 6) AS v FROM stats) t), n AS (SELECT * FROM ({AFTER} SELECT name, occurrences, unsampled, round(energy_nj_mean * 1e-3, 6) AS v FROM stats) t),
m AS (SELECT b.name AS event, b.v AS before, CASE WHEN n.occurrences > 0 AND n.unsampled < n.occurrences THEN n.v END AS value FROM b JOIN n USING (name) WHERE b.occurrences > 0 AND b.unsampled < b.occurrences)
SELECT event, 'mean_energy_uj' AS metric, round(before * (1 + 5.0 / 100), 2) AS "limit", round(value, 2) AS value, coalesce(value <= round(before * (1 + 5.0 / 100), 6), false) AS passed,
       CASE WHEN before <> 0 THEN round((value - before) / before * 100, 4) END AS change_percent FROM m""")
def regression_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, events, defs = tables.samples(spark, sf_dir), tables.events(spark, sf_dir), tables.event_defs(spark)
    before, now = (settle(occurrences.event_stats(samples.where(side), _between(events.where(side)), defs)) for side in (f"t_ns < {SPLIT_NS}", f"t_ns >= {SPLIT_NS}"))
    return rules.evaluate(rules.regression_rules(now, before, 5.0), now, before).select("event", "metric", F.round("limit", 2).alias("limit"), F.round("value", 2).alias("value"), "passed", "change_percent")


@registered(f"""WITH {EVENTS} SELECT capture_id, seq, value::DOUBLE / 1000.0 AS milli, value::DOUBLE * 1000.0 AS kilo, value::DOUBLE AS plain, CAST(value * 1000000 AS BIGINT) AS duration_ns, value::DOUBLE / 100 AS ratio, CASE WHEN value >= 1 THEN value * 1000 END AS rate_hz, CASE WHEN seq % 2 = 0 THEN value::DOUBLE END AS refused FROM ev""")
def parse_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value").cast("string")
    said = lambda s: F.concat(v, F.lit(s))
    return tables.events(spark, sf_dir).select(
        "capture_id", "seq", units.parse_quantity(said("mA"), "A").alias("milli"), units.parse_quantity(said(" k"), "J").alias("kilo"), units.parse_quantity(said("V"), "V").alias("plain"),
        units.parse_duration_ns(said(" ms")).alias("duration_ns"), units.parse_ratio(said("%")).alias("ratio"), units.parse_rate_hz(said("kHz")).alias("rate_hz"), units.parse_quantity(F.when(F.col("seq") % 2 == 0, said("A")).otherwise(said("e3A")), "A").alias("refused"),
    )


@registered(f"""WITH {EVENTS} SELECT capture_id, seq, CASE WHEN value = 0 THEN '0.000 A' WHEN value * 37 >= 1000 THEN printf('%d.%03d kA', value * 37 // 1000, value * 37 % 1000) ELSE printf('%d.000 A', value * 37) END AS quantity,
CASE WHEN value < 1024 THEN value || ' B' END AS bytes FROM ev""")
def format_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).select("capture_id", "seq", units.format_quantity((F.col("value") * 37).cast("double"), "A").alias("quantity"), units.human_bytes(F.col("value")).alias("bytes"))


@registered("""SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g')) AS identifier, replace(replace(replace(replace('<' || p_name || '&"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
CASE p_partkey % 20 WHEN 0 THEN 'NONE' WHEN 1 THEN 'UNSUPPORTED_FRAME' WHEN 2 THEN 'BAD_CONFIG' WHEN 3 THEN 'NOT_CONFIGURED' WHEN 4 THEN 'ALREADY_CAPTURING' WHEN 5 THEN 'NOT_CAPTURING' WHEN 16 THEN 'BUFFER_OVERFLOW' WHEN 17 THEN 'ADC_FAULT' WHEN 18 THEN 'OVERCURRENT' ELSE printf('0x%04X', p_partkey % 20) END AS error, p_partkey AS mask FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return tables.table(spark, sf_dir, "part").select(
        "p_partkey", text.c_identifier(F.col("p_name")).alias("identifier"), text.xml_escape(F.concat(F.lit("<"), "p_name", F.lit('&"'))).alias("escaped"),
        text.error_name((key % 20).cast("int")).alias("error"), text.gpio_mask(F.concat(F.lit("0x"), F.hex(key))).alias("mask"),
    )


@registered(f"""WITH {SAMPLES} SELECT capture_id, min(t_ns) AS first_ns, max(t_ns) + 1 AS end_ns, count(*) AS samples, CASE WHEN count(*) > 1 THEN round((count(*) - 1)::DOUBLE * 1e9 / (max(t_ns) - min(t_ns))::DOUBLE, 9) ELSE 0.0 END AS rate_hz FROM samples GROUP BY capture_id""")
def capture_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.spans(tables.samples(spark, sf_dir))


@registered(GAPS + """, s AS (SELECT capture_id, min(t_ns) AS first_ns, max(t_ns) + 1 AS end_ns, count(*) AS samples, CASE WHEN count(*) > 1 THEN round((count(*) - 1)::DOUBLE * 1e9 / (max(t_ns) - min(t_ns))::DOUBLE, 9) ELSE 0.0 END AS rate_hz FROM samples GROUP BY capture_id),
e AS (SELECT capture_id, count(*) AS events, count(DISTINCT id) AS distinct_ids FROM ev GROUP BY capture_id), g AS (SELECT capture_id, count(*) AS gaps, CAST(sum(end_ns - start_ns) AS BIGINT) AS missing_ns FROM gaps GROUP BY capture_id)
SELECT s.*, coalesce(events, 0) AS events, coalesce(distinct_ids, 0) AS distinct_ids, coalesce(gaps, 0) AS gaps, coalesce(missing_ns, 0) AS missing_ns, capture_id::BIGINT % 7 <> 0 AS has_voltage, coalesce(events, 0) AS gpio, round((end_ns - 1 - first_ns)::DOUBLE / 1e9, 9) AS duration_s,
       coalesce(gaps, 0) = 0 AND capture_id::BIGINT % 5 <> 0 AS is_clean, round(rate_hz / (1.0::DOUBLE / 3600), 6) AS rate_ratio
FROM s LEFT JOIN e USING (capture_id) LEFT JOIN g USING (capture_id)""")
def capture_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh capture has no voltage, and the files of every fifth are not whole."""
    samples = tables.samples(spark, sf_dir).withColumn("voltage_uv", F.when(F.col("capture_id").cast("bigint") % 7 != 0, F.col("voltage_uv")))
    whole = samples.select("capture_id").distinct().withColumn("is_clean", F.col("capture_id").cast("bigint") % 5 != 0)
    return capture.info(samples, tables.events(spark, sf_dir), _gaps(spark, sf_dir), RATE_HZ, tables.gpio(spark, sf_dir), whole)


@registered(f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY t_ns, seq) - 1 AS k, (current_ua::BIGINT * voltage_uv + 500) // 1000 AS p FROM samples)
SELECT capture_id, seq, printf('%d.%09d', t_ns // 1000000000, t_ns % 1000000000) AS time_s, CAST(current_ua AS VARCHAR) AS "current_uA", CAST(voltage_uv AS VARCHAR) AS "voltage_uV", printf('%d.%03d', p // 1000, p % 1000) AS "power_uW" FROM r WHERE k % 10 = 0""")
def export_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.sample_rows(tables.samples(spark, sf_dir), 10)


@registered(NAMED + """ SELECT capture_id, seq, printf('%d.%09d', t_ns // 1000000000, t_ns % 1000000000) AS time_s, printf('0x%04X', e.id) AS event_id, coalesce(i.name, printf('0x%04X', e.id)) AS name, coalesce(CAST(value AS VARCHAR), '') AS value FROM ev e LEFT JOIN ids i USING (id)""")
def export_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.event_rows(tables.events(spark, sf_dir), tables.event_defs(spark))


@registered(f"""WITH {EVENTS} SELECT capture_id, seq, printf('%d.%09d', t_ns // 1000000000, t_ns % 1000000000) AS time_s, printf('0x%04X', (value * 517 + seq) % 65536) AS state FROM ev""")
def export_gpio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.gpio_rows(tables.gpio(spark, sf_dir))


# Bytes, files and streams: the result must be what went in, or what the batch operator gives.


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.operators.ordered import numbered

    rows = numbered(tables.samples(spark, sf_dir), ("capture_id",), ("t_ns", "seq"))
    return rows.withColumn("device", F.col("capture_id")).withColumn("ticks", F.call_function("div", F.col("t_ns"), F.lit(1000).cast("bigint")) % (1 << 32))


def _halves(frames: DataFrame) -> DataFrame:
    """Each frame in two chunks, as a line might deliver it."""
    cut = F.floor(F.length("bytes") / 3).cast("int")
    parts = F.array(F.struct((2 * F.col("chunk")).alias("chunk"), F.substring(F.col("bytes"), F.lit(1), cut).alias("bytes")), F.struct((2 * F.col("chunk") + 1).alias("chunk"), F.substring(F.col("bytes"), cut + 1, F.lit(1 << 20)).alias("bytes")))
    return frames.select("device", F.explode(parts).alias("p")).select("device", "p.chunk", "p.bytes")


@registered(f"WITH {SAMPLES} SELECT capture_id AS device, (t_ns // 1000) % 4294967296 AS ticks, current_ua, voltage_uv FROM samples")
def wire_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.sources import wire

    chunks = _halves(wire.encoded_samples(_numbered(spark, sf_dir)))
    return wire.samples(wire.frames(chunks)).select("device", "ticks", "current_ua", "voltage_uv")


@registered(f"""WITH {SAMPLES}, b AS (SELECT capture_id AS device, generate_series AS chunk FROM (SELECT capture_id, (count(*) - 1) // 8 AS last FROM samples GROUP BY capture_id) t, generate_series(0, last)),
k AS (SELECT *, lead(chunk) OVER (PARTITION BY device ORDER BY chunk) AS nx FROM b WHERE chunk % 5 <> 2)
SELECT device, count(*) AS frames, count(*) FILTER (nx <> chunk + 1) AS seq_gaps, (SELECT count(*) FROM b WHERE b.device = k.device AND b.chunk % 5 = 2) AS cobs_errors, count(*) FILTER (chunk % 5 = 3) AS resyncs FROM k GROUP BY device""")
def wire_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame gives way to a region that no encoder makes."""
    from joulegrid.sources import wire

    frames = wire.encoded_samples(_numbered(spark, sf_dir), 8)
    torn = frames.withColumn("bytes", F.when(F.col("chunk") % 5 == 2, F.unhex(F.lit("090100"))).otherwise(F.col("bytes")))
    return wire.counters(wire.frames(_halves(torn))).select("device", "frames", "seq_gaps", "cobs_errors", "resyncs")


@registered(f"WITH {SAMPLES} SELECT capture_id, t_ns, current_ua, voltage_uv FROM samples")
def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.shared import new_folder
    from joulegrid.sinks.capture_writer import write_captures
    from joulegrid.sources.capture_file import register

    register(spark)
    folder = new_folder(spark, "captures")
    write_captures(tables.samples(spark, sf_dir), folder)
    rows = spark.read.format("powercapture").option("kind", "samples").load(folder)
    return rows.select(F.regexp_extract("capture_id", r"^(.*)-[0-9]+$", 1).alias("capture_id"), "t_ns", "current_ua", "voltage_uv")


def _live(spark: SparkSession, sf_dir: str, read: Callable[[DataFrame], DataFrame], order: str = "ts") -> DataFrame:
    """The table in twelve micro-batches in order of a column."""
    from joulegrid.streaming.run import replay

    return read(replay(spark, f"{sf_dir}/events.parquet", order))


@registered(GAPS + " SELECT capture_id, start_ns, end_ns, lost_estimate FROM gaps")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.streaming import devices, run

    return run.drained(devices.time_gaps(_live(spark, sf_dir, tables.as_samples), RATE_HZ))


@registered(UNWRAPPED.replace("row_number() OVER (PARTITION BY capture_id ORDER BY t_ns, seq) - 1 AS arrival", "seq AS arrival") + " SELECT *, epoch * 4294967296 + ticks AS full_ticks FROM u")
def stream_tick_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.streaming import devices, run

    millis = F.call_function("div", F.col("t_ns"), F.lit(1_000_000).cast("bigint"))
    rows = _live(spark, sf_dir, tables.as_samples, "event_id").select(F.col("capture_id").alias("device"), F.col("seq").alias("arrival"), (millis % (1 << 32)).alias("ticks"))
    return run.drained(devices.unwrapped(rows))


@registered(PAIRS + " SELECT capture_id, name, seq, start_ns, end_ns, status FROM pairs")
def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of a live stream; each capture ends with a row that says so, upon which what is open is unterminated."""
    from joulegrid.streaming import run, scopes

    marks = pairing.marks(tables.events(spark, sf_dir), tables.event_defs(spark)).select("capture_id", "name", "seq", "t_ns", "step")
    ends = marks.groupBy("capture_id", "name").agg(F.lit(-1).cast("bigint").alias("seq"), (F.max("t_ns") + 1).alias("t_ns"), F.lit(0).alias("step"))
    rows = marks.unionByName(ends)
    span = rows.agg(F.min("t_ns").alias("a"), F.max("t_ns").alias("b")).first()
    cuts = [span["a"] + (span["b"] - span["a"]) * k // 12 for k in range(1, 12)]
    return run.drained(scopes.pairs(run.replayed(rows, ["t_ns", "seq"], cuts), 400 * DAY_NS)).select("capture_id", "name", "seq", "start_ns", "end_ns", "status")


# Frames of all types, capture files of all kinds, integrity, reports, exports and more streams.


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a device: device, chunk (increasing), ticks, id, value, state."""
    events = tables.events(spark, sf_dir).withColumn("device", F.col("capture_id")).withColumn("chunk", F.col("seq"))
    ticks = (F.call_function("div", F.col("t_ns"), F.lit(1000).cast("bigint")) % (1 << 32)).alias("ticks")
    return events.select("device", "chunk", ticks, "id", F.when(F.col("seq") % 4 != 0, F.col("value")).alias("value"), ((F.col("value") * 517 + F.col("seq")) % 65536).cast("int").alias("state"))


RECORDS = f"""WITH {EVENTS}, r AS (SELECT capture_id AS device, seq AS chunk, (t_ns // 1000) % 4294967296 AS ticks, id, CASE WHEN seq % 4 <> 0 THEN value END AS value, (value * 517 + seq) % 65536 AS state, value AS v FROM ev)"""


@registered(RECORDS + " SELECT device, ticks, CAST(id AS INTEGER) AS id, value FROM r")
def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.sources import wire

    return wire.events(wire.frames(_halves(wire.encoded_records(_rows(spark, sf_dir), "EVENT")))).select("device", "ticks", "id", "value")


@registered(RECORDS + " SELECT device, ticks, CAST(state AS INTEGER) AS state FROM r")
def wire_gpio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.sources import wire

    return wire.gpio(wire.frames(wire.encoded_records(_rows(spark, sf_dir), "GPIO_EVENT"))).select("device", "ticks", "state")


@registered(RECORDS + """ SELECT device, 'SYNC' AS kind, ticks AS a, chunk % 65536 AS b, ticks * 1000 - 7 AS c FROM r WHERE chunk % 5 = 0
UNION ALL SELECT device, 'MARKER', ticks, id, v FROM r WHERE chunk % 5 = 1 UNION ALL SELECT device, 'ERROR', v % 20, state, chunk % 1000 FROM r WHERE chunk % 5 = 2
UNION ALL SELECT device, 'HELLO', 256, state, 0 FROM r WHERE chunk % 5 = 3 UNION ALL SELECT device, 'CONFIG', ticks % 100000, state, -v FROM r WHERE chunk % 5 = 4""")
def wire_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of five types on one line, read back as three numbers each."""
    from joulegrid.sources import wire

    rows = _rows(spark, sf_dir).withColumn("v", ((F.col("state") - F.col("chunk")) % 65536)).drop("value")
    value = tables.events(spark, sf_dir).select(F.col("seq").alias("chunk"), F.col("value").alias("v"))
    rows = rows.drop("v").join(value, "chunk")
    of = lambda k: rows.where(F.col("chunk") % 5 == k)
    zero = F.lit(0)
    sent = {
        "SYNC": of(0).select("device", "chunk", "ticks", (F.col("chunk") % 65536).alias("wrap_count"), zero.alias("flags"), (F.col("ticks") * 1000 - 7).alias("host_time_ns")),
        "MARKER": of(1).select("device", "chunk", "ticks", F.col("id").alias("marker_id"), F.col("v").alias("value")),
        "ERROR": of(2).select("device", "chunk", (F.col("v") % 20).alias("code"), F.col("state").alias("detail"), (F.col("chunk") % 1000).alias("dropped_samples"), zero.alias("buffer_overflows"), zero.alias("context")),
        "HELLO": of(3).select("device", "chunk", F.lit(256).alias("proto_version"), F.col("state").alias("nonce"), zero.alias("reserved")),
        "CONFIG": of(4).select("device", "chunk", (F.col("ticks") % 100000).alias("sample_rate_hz"), zero.alias("averaging"), zero.alias("conv_time_code"), F.col("state").alias("gpio_mask"), (-F.col("v")).alias("shunt_micro_ohm"), zero.alias("flags"), zero.alias("reserved")),
    }
    line = None
    for kind, records in sent.items():
        made = wire.encoded_records(records, kind)
        line = made if line is None else line.unionByName(made)
    decoded = settle(wire.frames(line))
    read = {
        "SYNC": (wire.sync, ("ticks", "wrap_count", "host_time_ns")), "MARKER": (wire.markers, ("ticks", "marker_id", "value")), "ERROR": (wire.errors, ("code", "detail", "dropped_samples")),
        "HELLO": (wire.hellos, ("proto_version", "nonce", "reserved")), "CONFIG": (wire.configs, ("sample_rate_hz", "gpio_mask", "shunt_micro_ohm")),
    }
    out = None
    for kind, (decode, columns) in read.items():
        some = decode(decoded).select("device", F.lit(kind).alias("kind"), *(F.col(c).alias(n) for c, n in zip(columns, "abc", strict=True)))
        out = some if out is None else out.unionByName(some)
    return out


@registered("""SELECT s_name AS device, left(s_name, 16) AS serial, 'v' || s_nationkey AS fw_version, CAST(s_suppkey * 1000003 AS DECIMAL(20,0)) AS fw_build_id, 1000000 + s_suppkey AS timer_hz, CAST(-s_nationkey AS BIGINT) AS shunt_micro_ohm FROM supplier""")
def wire_device_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.sources import wire

    fixed = {"magic": 0x46525050, "proto_version": 256, "device_type": 1, "max_sample_rate_hz": 50_000, "adc_full_scale_ua": 9, "channel_count": 1, "gpio_count": 16, "caps": 3}
    rows = tables.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("device"), F.lit(0).alias("chunk"), F.col("s_name").alias("serial"), F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("fw_version"), (F.col("s_suppkey").cast("bigint") * 1_000_003).alias("fw_build_id"),
        (F.col("s_suppkey") + 1_000_000).alias("timer_hz"), (-F.col("s_nationkey")).alias("shunt_micro_ohm"), *(F.lit(v).alias(n) for n, v in fixed.items()),
    )
    return wire.device_infos(wire.frames(wire.encoded_records(rows, "DEVICE_INFO"))).select("device", "serial", "fw_version", "fw_build_id", "timer_hz", "shunt_micro_ohm")


def _through_files(spark: SparkSession, rows: DataFrame, kind: str) -> DataFrame:
    from joulegrid.shared import new_folder
    from joulegrid.sinks.capture_writer import write_captures
    from joulegrid.sources.capture_file import register

    register(spark)
    folder = new_folder(spark, "captures")
    write_captures(rows, folder, kind=kind)
    return spark.read.format("powercapture").option("kind", kind).load(folder).withColumn("capture_id", F.regexp_extract("capture_id", r"^(.*)-[0-9]+$", 1))


@registered(f"WITH {EVENTS} SELECT capture_id, t_ns, id, CASE WHEN seq % 4 <> 0 THEN value END AS value FROM ev")
def capture_event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.events(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 4 != 0, F.col("value")))
    return _through_files(spark, rows, "events").select("capture_id", "t_ns", "id", "value")


@registered(f"WITH {EVENTS} SELECT capture_id, t_ns, CAST((value * 517 + seq) % 65536 AS INTEGER) AS state FROM ev")
def capture_gpio_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, tables.gpio(spark, sf_dir), "gpio").select("capture_id", "t_ns", "state")


@registered(f"WITH {EVENTS} SELECT capture_id, t_ns AS host_send_ns, t_ns + 20000 + seq % 1000 AS host_recv_ns, t_ns // 1000 AS device_ticks FROM ev")
def capture_sync_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.samples(spark, sf_dir).select("capture_id", F.col("t_ns").alias("host_send_ns"), (F.col("t_ns") + 20_000 + F.col("seq") % 1000).alias("host_recv_ns"), F.call_function("div", F.col("t_ns"), F.lit(1000).cast("bigint")).alias("device_ticks"))
    return _through_files(spark, rows, "sync")


def _damaged(manifest: DataFrame) -> DataFrame:
    """Files whose last digit leaves 1 over 3 get a wrong byte in their first chunk, those that leave 2 lose their end."""

    def run(parts):
        import pyarrow.fs as pafs

        for pdf in parts:
            for path in pdf["path"]:
                fs, name = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                with fs.open_input_file(name) as f:
                    raw = bytearray(f.read())
                kind = int(name.rpartition("/")[2].partition("-")[0]) % 3
                if kind == 1:
                    raw[128 + 40 + 5] ^= 0xFF
                elif kind == 2:
                    raw = raw[:-50]
                with fs.open_output_stream(name) as f:
                    f.write(bytes(raw))
            yield pdf

    return settle(manifest.mapInPandas(run, "path string, rows long"))


@registered(f"""WITH {SAMPLES}, c AS (SELECT capture_id, capture_id::BIGINT % 3 AS k FROM samples GROUP BY capture_id)
SELECT capture_id, true AS finalized, k = 2 AS recovered, k = 2 AS truncated, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS BIGINT) AS corrupt_chunks, 0::BIGINT AS unknown_chunks, CAST(CASE WHEN k > 0 THEN 1 ELSE 0 END AS BIGINT) AS gaps, k = 0 AS is_clean FROM c""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged chunk and a lost end, each in a third of the files."""
    from joulegrid.shared import new_folder
    from joulegrid.sinks.capture_writer import write_captures
    from joulegrid.sources.capture_file import register

    register(spark)
    folder = new_folder(spark, "captures")
    _damaged(write_captures(tables.samples(spark, sf_dir), folder, slice_ns=1 << 62))
    read = lambda kind: spark.read.format("powercapture").option("kind", kind).load(folder)
    report = capture.integrity(read("captures"), read("chunks"))
    return report.select(F.regexp_extract("capture_id", r"^(.*)-[0-9]+$", 1).alias("capture_id"), "finalized", "recovered", F.col("truncated_at").isNotNull().alias("truncated"), "corrupt_chunks", "unknown_chunks", "gaps", "is_clean")


METADATA = "\n".join(
    f'[[event]]\nname = "{name}"\nstart_id = {start}\n' + (f"stop_id = {stop}\n" if stop else "") + (f'category = "{category}"\n' if category else "") + (f'value_units = "{units_}"\n' if units_ else "")
    for name, start, stop, category, units_, _ in tables.DEFINITIONS
)


@registered(NAMED + " SELECT i.name, count(*) AS n FROM ev e JOIN ids i USING (id) GROUP BY i.name")
def metadata_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the names that a metadata text declares."""
    from joulegrid.sources import metadata

    defs, _ = metadata.definitions(spark, METADATA)
    return names.with_names(tables.events(spark, sf_dir), defs).groupBy("name").agg(F.count("*").alias("n"))


@registered("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'serial' WHEN 2 THEN 'file' END AS kind,
CASE s_suppkey % 4 WHEN 0 THEN 'host:' || s_suppkey WHEN 1 THEN '/dev/tty' || s_suppkey WHEN 2 THEN '/data/' || s_suppkey END AS place FROM supplier""")
def device_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.sources import uri

    key = F.col("s_suppkey").cast("string")
    said = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("tcp://host:"), key)).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("serial:/dev/tty"), key)).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("file:///data/"), key)).otherwise(F.concat(F.lit("nowhere"), key))
    return tables.table(spark, sf_dir, "supplier").withColumn("d", uri.parsed(said)).select("s_suppkey", "d.kind", "d.place")


@registered("SELECT s_suppkey, coalesce((s_suppkey % 3 + 11914, s_nationkey % 4 + 9) IN ((11914, 10), (11915, 12)), false) AS likely FROM supplier")
def likely_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.functions.devices import likely_profiler

    ids = ((F.col("s_suppkey") % 3 + 11914).cast("int"), (F.col("s_nationkey") % 4 + 9).cast("int"))
    return tables.table(spark, sf_dir, "supplier").select("s_suppkey", likely_profiler(*ids, [(11914, 10), (11915, 12)]).alias("likely"))


@registered(STATS + " SELECT name, duration_ns_total FROM stats ORDER BY duration_ns_total DESC, name LIMIT 1")
def event_table_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.plans import analysis

    held = analysis.Tables(tables.samples(spark, sf_dir), _between(tables.events(spark, sf_dir)), tables.event_defs(spark))
    return analysis.event_table(held, sort="duration_ns_total", top=1).select("name", "duration_ns_total")


@registered("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE left(p_name, 3) END AS field FROM part")
def ascii_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that end at a NUL, or at a byte beyond ASCII."""
    name = F.encode("p_name", "ISO-8859-1")
    padded = F.concat(name, F.unhex(F.lit("0041")))
    cut = F.concat(F.substring(name, 1, 3), F.unhex(F.lit("E941")))
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.ascii_field(F.when(F.col("p_partkey") % 2 == 0, padded).otherwise(cut)).alias("field"))


LIMITED = STATS + """, l(metric, comparison, lim) AS (VALUES ('peak_current_ua', '<=', 500.0::DOUBLE), ('mean_duration_ns', '<=', 1e15), ('occurrences', '>=', 3.0)),
v AS (SELECT name AS event, metric, comparison, lim, CASE metric WHEN 'peak_current_ua' THEN peak_ua::DOUBLE WHEN 'mean_duration_ns' THEN duration_ns_mean ELSE occurrences::DOUBLE END AS value FROM stats, l),
w AS (SELECT event, metric, lim AS "limit", coalesce(CASE comparison WHEN '<=' THEN value <= lim ELSE value >= lim END, false) AS passed FROM v)"""


def _limited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from joulegrid.plans import budgets

    stats = settle(_stats(spark, sf_dir))
    return budgets.rules_from_options(spark, stats, max_peak_current="500 uA", max_duration="1000000 s", min_occurrences=3), stats


@registered(LIMITED + ' SELECT event, metric, "limit", passed FROM w')
def budget_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits as a user writes them, for every declared event."""
    return rules.evaluate(*_limited(spark, sf_dir)).select("event", "metric", "limit", "passed")


@registered(LIMITED + """ SELECT count(*) AS results, count(*) FILTER (NOT passed) AS failures, CASE WHEN bool_and(passed) THEN 0 ELSE 1 END AS exit_code, count(*) FILTER (NOT passed) AS junit_failures FROM w""")
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reports of a run say; there is a result for each rule, few for any table."""
    import json
    import re

    from joulegrid.plans import budgets

    results = budgets.judged(*_limited(spark, sf_dir))
    said = json.loads(budgets.as_json(results))
    junit = len(re.findall("<failure ", budgets.as_junit(results)))
    return spark.createDataFrame([(len(said["results"]), said["failures"], budgets.exit_code(results), junit)], "results long, failures long, exit_code int, junit_failures long")


@registered(STATS + " SELECT name, occurrences, energy_nj_total FROM stats")
def stored_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.plans import budgets
    from joulegrid.shared import new_folder

    stats, path = settle(_stats(spark, sf_dir)), new_folder(spark, "baseline")
    budgets.write_baseline(stats, path)
    return budgets.read_baseline(spark, path, stats).select("name", "occurrences", "energy_nj_total")


@registered(f"WITH {SAMPLES} SELECT count(*) AS rows, max(t_ns) AS last_ns FROM samples")
def counted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observation saw while rows were written."""
    from joulegrid.shared import new_folder
    from joulegrid.sinks.tables import counted

    rows, seen = counted(tables.samples(spark, sf_dir), "passed")
    rows.write.parquet(new_folder(spark, "counted"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["last_ns"])], "rows long, last_ns long")


@registered(f"WITH {EVENTS} SELECT f.kind, capture_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM ev, (VALUES ('csv'), ('json'), ('parquet')) f(kind) GROUP BY f.kind, capture_id")
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written in every format and read back."""
    from joulegrid.shared import new_folder

    rows, out = tables.events(spark, sf_dir), None
    for kind in export.FORMATS:
        path = new_folder(spark, f"export-{kind}")
        export.write(rows.repartition("capture_id"), path, kind)
        reader = spark.read.schema(rows.schema)
        back = (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)
        some = back.groupBy("capture_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.lit(kind).alias("kind"), "capture_id", "n", "total")
        out = some if out is None else out.unionByName(some)
    return out


@registered("""WITH n AS (SELECT upper(regexp_replace(n_name, '[^A-Za-z0-9]', '_', 'g')) AS name, n_nationkey + 1 AS start_id, n_nationkey + 257 AS stop_id FROM nation)
SELECT '#define EVENT_' || name || '_START ' || printf('0x%04Xu', start_id) AS line FROM n UNION ALL SELECT '#define EVENT_' || name || '_STOP ' || printf('0x%04Xu', stop_id) FROM n""")
def c_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    defs = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (key + 1).cast("int").alias("start_id"), (key + 257).cast("int").alias("stop_id"))
    lines = [x for x in export.c_header(defs).splitlines() if x.startswith("#define EVENT_") and "0x" in x]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@registered(f"WITH {SAMPLES} SELECT capture_id AS device, (t_ns // 1000) % 4294967296 AS ticks, current_ua, voltage_uv FROM samples")
def stream_wire_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From landed bytes to samples in one stream, with frames cut across micro-batches."""
    from joulegrid.sources import wire
    from joulegrid.streaming import devices, run

    line = settle(_halves(wire.encoded_samples(_numbered(spark, sf_dir))))
    chunks = run.replayed(line, ["chunk"], [1, 2, 5, 8])
    return run.drained(wire.samples(devices.frames(chunks)).select("device", "ticks", "current_ua", "voltage_uv"))


# Four micro-batches by the rows' numbers modulo 4; what a bucket is too late for depends on the batches before.
LIVE_BUCKETS = f"""WITH {SAMPLES}, b AS (SELECT *, seq % 4 AS batch, t_ns - t_ns % {HOUR_NS} AS bucket FROM samples),
m AS (SELECT capture_id, batch, max(t_ns) AS top FROM b GROUP BY capture_id, batch),
seen AS (SELECT capture_id, batch, coalesce(max(top) OVER (PARTITION BY capture_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before, max(top) OVER (PARTITION BY capture_id) AS last FROM m),
r AS (SELECT b.*, s.last, b.bucket + {HOUR_NS} + {10 * DAY_NS} <= s.before AS late FROM b JOIN seen s USING (capture_id, batch))
SELECT capture_id, bucket AS t_ns, min(current_ua)::BIGINT AS min_ua, max(current_ua)::BIGINT AS max_ua, CAST(sum(current_ua) AS BIGINT) AS sum_ua, count(*) AS count, late
FROM r WHERE late OR bucket + {HOUR_NS} + {10 * DAY_NS} <= last GROUP BY capture_id, bucket, late, CASE WHEN late THEN batch END"""


@registered(LIVE_BUCKETS)
def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed buckets, and late samples counted beside them."""
    from joulegrid.streaming import devices, run

    rows = tables.samples(spark, sf_dir).withColumn("batch", F.col("seq") % 4)
    live = run.replayed(rows, ["batch", "seq"], [1, 2, 3])
    return run.drained(devices.buckets(live, HOUR_NS, 10 * DAY_NS))


@registered(f"WITH {EVENTS} SELECT capture_id, count(*) AS samples, count(*) FILTER (id = 272) AS errors FROM ev GROUP BY capture_id")
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream written to two tables, and these counted."""
    from joulegrid.shared import new_folder
    from joulegrid.streaming import run

    folder = new_folder(spark, "fan-out")
    live = run.replay(spark, f"{sf_dir}/events.parquet", "ts")
    run.finished(run.fan_out(live, {"samples": tables.as_samples, "errors": lambda b: tables.as_events(b).where("id = 272")}, folder))
    read = lambda name, as_: spark.read.schema(f"capture_id string, seq bigint, t_ns bigint").parquet(f"{folder}/{name}").groupBy("capture_id").agg(F.count("*").alias(as_))
    return read("samples", "samples").join(read("errors", "errors"), "capture_id", "left").fillna(0, ["errors"])


@registered(UNWRAPPED + """, y AS (SELECT *, arrival % 50 = 7 AS sync, epoch + CASE WHEN arrival % 100 = 7 THEN 2 ELSE 0 END AS told FROM u),
z AS (SELECT *, last_value(CASE WHEN sync THEN told - epoch END IGNORE NULLS) OVER (PARTITION BY device ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moved FROM y)
SELECT device, arrival, ticks, CAST(epoch + coalesce(moved, 0) AS BIGINT) AS epoch, CAST((epoch + coalesce(moved, 0)) * 4294967296 + ticks AS BIGINT) AS full_ticks FROM z""")
def wrap_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device's own count of wraps, told now and then, moves the epochs that follow."""
    times = settle(timebase.unwrapped(_ticks(spark, sf_dir), slice_rows=64))
    told = times.where("arrival % 50 = 7").withColumn("wrap_count", F.col("epoch") + F.when(F.col("arrival") % 100 == 7, 2).otherwise(0))
    return timebase.resynced(times, told, slice_rows=64).select("device", "arrival", "ticks", "epoch", "full_ticks")


# Whole captures: files with all kinds of rows, their stored metadata and summaries.

#: Captures with an even number and those with an odd one mean different events by the same ids.
TOLD = {0: [("CLICK", 257, 258, "shop"), ("VIEW", 513, 514, None)], 1: [("SEEN", 257, None, "page"), ("FAILED", 272, None, None), ("BOUGHT", 258, 513, "shop")]}
TOLD_IDS = ", ".join(f"({k}, {i}, '{n}', {repr(c) if c else 'NULL'})" for k, defs in TOLD.items() for name, start, stop, c in defs for i, n in ((start, name), (stop, f"{name}:stop")) if i)


def _written(spark: SparkSession, sf_dir: str, slice_ns: int) -> Callable[[str], DataFrame]:
    """All rows of the table written as captures, with names, pins and sync rows, and opened again."""
    from joulegrid.shared import new_folder
    from joulegrid.sinks.capture_sink import capture_records
    from joulegrid.sources.capture_file import register

    register(spark)
    folder = new_folder(spark, "captures")
    samples, events = tables.samples(spark, sf_dir), tables.events(spark, sf_dir)
    sync = samples.select("capture_id", F.col("t_ns").alias("host_send_ns"), (F.col("t_ns") + 20_000 + F.col("seq") % 1000).alias("host_recv_ns"), F.call_function("div", F.col("t_ns"), F.lit(1000).cast("bigint")).alias("device_ticks"))
    kinds = {k: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("start_id"), F.lit(b).cast("int").alias("stop_id"), F.lit(c).cast("string").alias("category"), F.lit(None).cast("string").alias("value_units"), F.lit(0).cast("bigint").alias("latency_compensation_ns")) for n, a, b, c in defs]) for k, defs in TOLD.items()}
    told = events.select("capture_id").distinct().select("capture_id", F.when(F.col("capture_id").cast("bigint") % 2 == 0, kinds[0]).otherwise(kinds[1]).alias("event"), F.create_map(F.lit("board"), F.col("capture_id")).alias("notes"), F.lit(1_800_000).cast("bigint").alias("assumed_supply_uv"))
    records = capture_records(samples, events, tables.gpio(spark, sf_dir), sync, told, slice_ns)
    records.write.format("powercapture").mode("append").option("levels", f"{HOUR_NS},{DAY_NS}").save(folder)
    return capture.opened(spark, folder)


@registered(f"""WITH {EVENTS}, ids(odd, id, name, category) AS (VALUES {TOLD_IDS})
SELECT ev.capture_id, ev.t_ns, CAST(ev.id AS INTEGER) AS id, ev.value, coalesce(ids.name, printf('0x%04X', ev.id)) AS name, ids.category FROM ev LEFT JOIN ids ON ids.odd = ev.capture_id::BIGINT % 2 AND ids.id = ev.id""")
def capture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the names that their own capture's files declare. Definitions are counted and joined, so they are stored once."""
    from joulegrid.shared import stored
    from joulegrid.sources.metadata import capture_definitions

    read = _written(spark, sf_dir, 14 * DAY_NS)
    return names.with_capture_names(read("events"), stored(capture_definitions(read("metadata")))).select("capture_id", "t_ns", "id", "value", "name", "category")


@registered(f"""WITH {EVENTS}, n AS (SELECT capture_id, count(*) AS n, min(t_ns) AS first_ns, max(t_ns) AS last_ns, count(DISTINCT t_ns // {14 * DAY_NS}) AS files FROM ev GROUP BY capture_id)
SELECT capture_id, k.kind, CAST(CASE WHEN k.kind = 'metadata' THEN files ELSE n END AS BIGINT) AS rows, CASE WHEN k.kind <> 'metadata' THEN first_ns END AS first_ns, CASE WHEN k.kind <> 'metadata' THEN last_ns END AS last_ns, CASE WHEN k.kind = 'metadata' THEN capture_id END AS note
FROM n, (VALUES ('samples'), ('events'), ('gpio'), ('sync'), ('metadata')) k(kind)""")
def capture_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each capture's files hold of every kind."""
    read, out = _written(spark, sf_dir, 14 * DAY_NS), None
    for kind, time, note in (("samples", "t_ns", None), ("events", "t_ns", None), ("gpio", "t_ns", None), ("sync", "host_send_ns", None), ("metadata", None, "notes.board")):
        at, said = (F.col(c) if c else F.lit(None).cast(t) for c, t in ((time, "bigint"), (note, "string")))
        some = read(kind).groupBy("capture_id").agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.min(at).alias("first_ns"), F.max(at).alias("last_ns"), F.max(said).alias("note"))
        out = some if out is None else out.unionByName(some)
    return out


@registered(f"""WITH {SAMPLES}, s AS (SELECT * FROM samples WHERE t_ns >= {FROM_NS} AND t_ns < {TO_NS})
SELECT capture_id, (t_ns - {FROM_NS}) // {12 * HOUR_NS} AS bucket, {FROM_NS} + ((t_ns - {FROM_NS}) // {12 * HOUR_NS}) * {12 * HOUR_NS} AS t_ns, {BUCKET} FROM s GROUP BY capture_id, (t_ns - {FROM_NS}) // {12 * HOUR_NS}""")
def overview_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-day buckets from the hourly summaries that files store; slices of ten and a half days cut buckets."""
    return capture.overview_from_files(_written(spark, sf_dir, 10 * DAY_NS + HOUR_NS // 2), FROM_NS, TO_NS, 28, buckets.SLOW_LEVELS_NS)


# A chunk of samples ends where a step is beyond 32 bits; all chunks end after 8192 rows.
@registered(f"""WITH {SAMPLES}, d AS (SELECT capture_id, t_ns - lag(t_ns) OVER (PARTITION BY capture_id ORDER BY t_ns, seq) AS dt FROM samples),
n AS (SELECT capture_id, count(*) AS n, count(*) FILTER (dt IS NULL OR dt >= 4294967296) AS pieces FROM d GROUP BY capture_id)
SELECT capture_id, k.code, k.kind, CASE k.kind WHEN 'samples' THEN pieces WHEN 'metadata' THEN 1 WHEN 'summary' THEN 1 ELSE (n + 8191) // 8192 END AS chunks, CASE WHEN k.code < 16 THEN n ELSE 1 END AS rows
FROM n, (VALUES (1, 'samples'), (2, 'events'), (3, 'gpio'), (5, 'sync'), (16, 'metadata'), (32, 'summary')) k(code, kind)""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each kind in files that hold a capture each."""
    return capture.chunk_counts(_written(spark, sf_dir, 1 << 62)("chunks")).select("capture_id", "code", "kind", "chunks", "rows")


@registered(f"""WITH {EVENTS}, n AS (SELECT capture_id, count(*) AS n FROM ev GROUP BY capture_id)
SELECT k.kind, CAST(sum(8 * ((n + 8191) // 8192) + k.size * n) AS BIGINT) AS plain, true AS smaller FROM n, (VALUES ('events', 16), ('gpio', 12), ('sync', 24)) k(kind, size) GROUP BY k.kind""")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all chunks of a kind before compression, and whether they are stored as fewer."""
    sizes = capture.chunk_counts(_written(spark, sf_dir, 1 << 62)("chunks")).where("kind IN ('events', 'gpio', 'sync')").groupBy("kind").agg(F.sum("plain").alias("plain"), F.sum("stored").alias("stored"))
    return sizes.select("kind", "plain", (capture.compression("plain", "stored") > 1).alias("smaller"))


# What a viewer asks of captures.


def _viewed(spark: SparkSession, sf_dir: str):
    from joulegrid.plans import analysis

    samples = tables.samples(spark, sf_dir)
    levels = {w: buckets.summary_level(samples, w) for w in buckets.SLOW_LEVELS_NS}
    return analysis.Tables(samples, tables.events(spark, sf_dir), tables.event_defs(spark), _gaps(spark, sf_dir), levels)


@registered(f"""WITH {SAMPLES}, s AS (SELECT * FROM samples WHERE t_ns >= {FROM_NS} AND t_ns < {TO_NS})
SELECT capture_id, (t_ns - {FROM_NS}) // {6 * HOUR_NS} AS bucket, {FROM_NS} + ((t_ns - {FROM_NS}) // {6 * HOUR_NS}) * {6 * HOUR_NS} AS t_ns, {BUCKET} FROM s GROUP BY capture_id, (t_ns - {FROM_NS}) // {6 * HOUR_NS}""")
def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fortnight in 56 buckets, from the hourly level."""
    from joulegrid.plans import analysis

    return analysis.waveform(_viewed(spark, sf_dir), FROM_NS, TO_NS, 56)


@registered(NAMED + f" SELECT e.*, coalesce(i.name, printf('0x%04X', e.id)) AS name FROM ev e LEFT JOIN ids i USING (id) WHERE t_ns >= {FROM_NS} AND t_ns < {TO_NS}")
def marks_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.plans import analysis

    return analysis.marks_within(_viewed(spark, sf_dir), FROM_NS, TO_NS)


@registered(GAPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_ns) AS k FROM gaps)
SELECT capture_id, count(*) AS gaps, CAST(sum(end_ns - start_ns) AS BIGINT) AS missing_ns, CAST(sum(lost_estimate) AS BIGINT) AS lost_estimate FROM r GROUP BY capture_id""")
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.plans import analysis

    return analysis.gap_summary(_viewed(spark, sf_dir), RATE_HZ).select("capture_id", "gaps", "missing_ns", "lost_estimate")


# Live streams end to end.

LIVE_HZ, LIVE_RATE = 1000, 1 / 3600


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as devices send it: blocks of eight samples, and after each its events, pins and sync rows; every 40th sample frame is lost."""
    from joulegrid.sources import wire

    rows = _numbered(spark, sf_dir).withColumn("ticks", F.call_function("div", F.col("t_ns"), F.lit(1_000_000).cast("bigint")) % (1 << 32))
    rows = settle(rows.join(tables.events(spark, sf_dir).select(F.col("seq"), "id", "value"), "seq"))
    blocks = wire.encoded_samples(rows, 8).where("chunk % 40 <> 39").select("device", (F.col("chunk") * 64).alias("chunk"), "bytes")
    place = (F.floor(F.col("n") / 8) * 64 + 1 + F.col("n") % 8).alias("chunk")
    sent = {
        "EVENT": rows.select("device", place, "ticks", "id", "value"), "GPIO_EVENT": rows.where("seq % 3 = 0").select("device", (place + 8).alias("chunk"), "ticks", ((F.col("value") * 517 + F.col("seq")) % 65536).alias("state")),
        "SYNC": rows.where("seq % 5 = 0").select("device", (place + 16).alias("chunk"), "ticks", F.lit(0).alias("wrap_count"), F.lit(0).alias("flags"), F.col("t_ns").alias("host_time_ns")),
    }
    for kind, records in sent.items():
        blocks = blocks.unionByName(wire.encoded_records(records, kind))
    return settle(blocks)


#: Blocks of eight samples of which every 40th is lost; time counts from the first sample, by ticks of a millisecond.
LINE = f"""WITH {SAMPLES}, {EVENTS}, k AS (SELECT s.*, ev.id, ev.value, t_ns // 1000000 AS ms, row_number() OVER (PARTITION BY s.capture_id ORDER BY s.t_ns, s.seq) - 1 AS n FROM samples s JOIN (SELECT seq, id, value FROM ev) ev USING (seq)),
kept AS (SELECT *, lag(ms) OVER (PARTITION BY capture_id ORDER BY n) AS before, lag(n) OVER (PARTITION BY capture_id ORDER BY n) AS n_before FROM k WHERE (n // 8) % 40 <> 39),
o AS (SELECT capture_id, min_by(ms, n) AS origin FROM kept GROUP BY capture_id)"""


@registered(LINE + """ SELECT 'samples' AS kind, capture_id, (ms - origin) * 1000000 AS t_ns, current_ua::BIGINT AS a, voltage_uv AS b FROM kept JOIN o USING (capture_id)
UNION ALL SELECT 'events', capture_id, (ms - origin) * 1000000, id, value FROM k JOIN o USING (capture_id) UNION ALL SELECT 'gpio', capture_id, (ms - origin) * 1000000, (value * 517 + seq) % 65536, NULL FROM k JOIN o USING (capture_id) WHERE seq % 3 = 0
UNION ALL SELECT 'sync', capture_id, (ms - origin) * 1000000, t_ns, NULL FROM k JOIN o USING (capture_id) WHERE seq % 5 = 0
UNION ALL SELECT 'gaps', capture_id, (before - origin) * 1000000, (ms - origin) * 1000000, greatest((ms - before) // 3600000 - 1, 0) FROM kept JOIN o USING (capture_id) WHERE ms - before > 10800000""")
def stream_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From landed bytes to capture time and five tables in one query, over a dozen micro-batches."""
    from joulegrid.shared import new_folder
    from joulegrid.streaming import run, session

    line, folder = _line(spark, sf_dir), new_folder(spark, "captures")
    most = line.agg(F.max("chunk")).first()[0] or 0
    live = session.sessions(run.replayed(line, ["chunk"], [most * k // 12 + 1 for k in range(1, 12)]), LIVE_HZ, LIVE_RATE)
    kinds = {"samples": ("current_ua", "voltage_uv"), "events": ("id", "value"), "gpio": ("state", None), "sync": ("host_send_ns", None), "gaps": ("end_ns", "lost_estimate")}
    run.finished(run.fan_out(live, {kind: (lambda b, kind=kind: session.table(b, kind)) for kind in kinds}, folder))
    out = None
    for kind, (a, b) in kinds.items():
        rows = spark.read.parquet(f"{folder}/{kind}")
        some = rows.select(F.lit(kind).alias("kind"), "capture_id", "t_ns", F.col(a).cast("bigint").alias("a"), (F.col(b) if b else F.lit(None)).cast("bigint").alias("b"))
        out = some if out is None else out.unionByName(some)
    return out


@registered(f"""WITH {SAMPLES}, b AS (SELECT capture_id AS device, generate_series AS chunk FROM (SELECT capture_id, (count(*) - 1) // 8 AS last FROM samples GROUP BY capture_id) t, generate_series(0, last)),
k AS (SELECT *, lead(chunk) OVER (PARTITION BY device ORDER BY chunk) AS nx FROM b WHERE chunk % 5 <> 2)
SELECT device, count(*) AS frames, count(*) FILTER (nx <> chunk + 1) AS seq_gaps, (SELECT count(*) FROM b WHERE b.device = k.device AND b.chunk % 5 = 2) AS cobs_errors, count(*) FILTER (chunk % 5 = 3) AS resyncs FROM k GROUP BY device""")
def stream_wire_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a live line whose sequence and resynchronisation go on over micro-batches."""
    from joulegrid.sources import wire
    from joulegrid.streaming import run, session

    frames = wire.encoded_samples(_numbered(spark, sf_dir), 8)
    line = settle(_halves(frames.withColumn("bytes", F.when(F.col("chunk") % 5 == 2, F.unhex(F.lit("090100"))).otherwise(F.col("bytes")))))
    most = line.agg(F.max("chunk")).first()[0] or 0
    rows = run.drained(session.sessions(run.replayed(line, ["chunk"], [most * k // 12 + 1 for k in range(1, 12)]), 1_000_000, RATE_HZ))
    of = lambda name: F.sum(F.when(F.col("cause") == name, F.col("value")).otherwise(0)).alias(name)
    return session.table(rows, "counts").groupBy(F.col("capture_id").alias("device")).agg(*[of(c) for c in ("frames", "seq_gaps", "cobs_errors", "resyncs")])


@registered(UNWRAPPED + """, x AS (SELECT * FROM u WHERE arrival % 5 <> 0), e AS (SELECT *, (ticks + 1000) % 4294967296 AS et FROM u WHERE arrival % 5 = 0),
a AS (SELECT e.device, e.arrival, e.et AS ticks, coalesce((SELECT max_by(x.epoch * 4294967296 + x.ticks, x.arrival) FROM x WHERE x.device = e.device AND x.arrival < e.arrival), 0) AS near FROM e),
f AS (SELECT *, (near // 4294967296) * 4294967296 + ticks AS base FROM a)
SELECT device, arrival, ticks, CASE WHEN base - near > 2147483648 AND base >= 4294967296 THEN base - 4294967296 WHEN near - base > 2147483648 THEN base + 4294967296 ELSE base END AS full_ticks FROM f""")
def stream_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come up to 40 places early or late, resolved as the batch does; each device ends with a row that says so."""
    from joulegrid.streaming import resolve, run

    ticks = settle(_ticks(spark, sf_dir))
    event = F.col("arrival") % 5 == 0
    moved = F.when(event, F.pmod(F.xxhash64("device", "arrival"), F.lit(81)) - 40).otherwise(0)
    rows = ticks.select("device", F.when(event, "event").otherwise("sample").alias("kind"), "arrival", F.when(event, (F.col("ticks") + 1000) % (1 << 32)).otherwise(F.col("ticks")).alias("ticks"), F.greatest(F.col("arrival") + moved, F.lit(0)).alias("landed"))
    ends = ticks.groupBy("device").agg(F.lit("end").alias("kind"), (F.max("arrival") + 1).alias("arrival"), F.lit(0).cast("bigint").alias("ticks"), (F.max("arrival") + 99).alias("landed"))
    both = rows.unionByName(ends)
    most = both.agg(F.max("landed")).first()[0] or 0
    return run.drained(resolve.resolved(run.replayed(both, ["landed"], [most * k // 12 + 1 for k in range(1, 12)]))).select("device", "arrival", "ticks", "full_ticks")
