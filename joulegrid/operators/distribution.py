"""Distributions of a value: count, mean, extremes, sample deviation, nearest-rank percentiles, total.

Equal values are counted first. Ranks are found over those counts in stretches of even row numbers, however the values
are spread, so that neither a group with most rows nor one with very many different values is held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joulegrid.shared import stored

QUANTILES = (0.5, 0.95, 0.99)
#: Differences from the mean are squared in two limbs, the lower one of so many bits.
LIMB = 1 << 20


def column_name(q: float) -> str:
    return f"p{round(100 * q)}"


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, x and n: how often each value stands; a group without values has a row with a null."""
    return df.groupBy(*keys, F.col(value).cast("bigint").alias("x")).agg(F.count("*").alias("n"))


def same_keys(keys: Sequence[str]) -> Column:
    """Whether keys equal those of another table, there named ``_of_`` the key; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return out


def ranked_values(counts: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """keys and a column for each quantile: the value at rank ceil(q n), at least 1, of each group with values.

    Groups and values are range partitioned by splitters that Spark samples, so a stretch of a group is what one
    partition has of it, small whatever outliers there are. Counts of stretches tell which of them hold the wanted
    ranks, and only these are gone through value by value.
    """
    known = counts.where("x IS NOT NULL")
    placed = stored(known.repartitionByRange(*keys, "x").withColumn("_stretch", F.spark_partition_id()))
    here = placed.groupBy(*keys, "_stretch").agg(F.sum("n").alias("_here"))
    of_key = W.partitionBy(*keys)
    sums = here.withColumn("_upto", F.sum("_here").over(of_key.orderBy("_stretch").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_here").over(of_key))
    ranks = F.array(*[F.struct(F.lit(column_name(q)).alias("q"), F.greatest(F.ceil(F.lit(float(q)) * F.col("_all")), F.lit(1)).cast("bigint").alias("rank")) for q in quantiles])
    wanted = sums.select(*keys, "_stretch", (F.col("_upto") - F.col("_here")).alias("_before"), "_upto", F.explode(ranks).alias("_r"))
    wanted = wanted.where((F.col("_r.rank") > F.col("_before")) & (F.col("_r.rank") <= F.col("_upto")))
    asked = wanted.groupBy(*keys, "_stretch").agg(F.collect_list(F.struct(F.col("_r.q").alias("q"), (F.col("_r.rank") - F.col("_before")).alias("rank"))).alias("_asked"))
    inside = W.partitionBy(*keys, "_stretch").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    here = asked.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_stretch").alias("_at"), "_asked")
    walked = placed.join(here, same_keys(keys) & (F.col("_stretch") == F.col("_at"))).withColumn("_sum", F.sum("n").over(inside))
    found = walked.select(*keys, "x", "n", "_sum", F.explode("_asked").alias("_r")).where((F.col("_sum") >= F.col("_r.rank")) & (F.col("_sum") - F.col("n") < F.col("_r.rank")))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_r.q") == column_name(q), F.col("x"))).alias(column_name(q)) for q in quantiles))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Nearest-rank percentiles of each group with values."""
    return ranked_values(counted(df, keys, value), keys, quantiles)


def describe(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """The distribution of an integer column by group. Without values all are 0; the deviation of one value is 0.

    Sums are exact, so that neither order nor partitioning changes a result. Squares are taken of the differences from
    the mean's whole part, each in two limbs, so their sums stay within a decimal for any longs and 10^11 rows. The
    total is exact before it becomes a double, as nanoseconds of a few centuries are beyond a long.
    """
    counts = counted(df, keys, value)
    x, times = F.col("x").cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")
    n = F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0))
    sums = counts.groupBy(*keys).agg(
        n.alias("n"), F.coalesce(F.min("x"), F.lit(0)).alias("min"), F.coalesce(F.max("x"), F.lit(0)).alias("max"),
        F.coalesce(F.sum((x * times).cast("decimal(38,0)")), F.lit(0)).alias("_total"),
    )
    some = F.greatest("n", F.lit(1))
    sums = sums.withColumn("_mean", F.call_function("div", F.col("_total"), some.cast("decimal(19,0)")).cast("decimal(19,0)"))
    apart = F.abs(x - F.col("_mean")).cast("decimal(20,0)")
    high = F.call_function("div", apart, F.lit(LIMB).cast("decimal(8,0)")).cast("decimal(14,0)")
    low = (apart % F.lit(LIMB).cast("decimal(8,0)")).cast("decimal(8,0)")
    limbs = {"_hh": high * high, "_hl": high * low, "_ll": low * low, "_rest": x - F.col("_mean")}
    means = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_mean")
    same = same_keys(keys)
    squares = counts.where("x IS NOT NULL").join(means, same).groupBy(*keys).agg(*[F.sum((v * times).cast("decimal(38,0)")).alias(c) for c, v in limbs.items()])
    number = lambda c: F.col(c).cast("double")
    spread = number("_hh") * float(LIMB) ** 2 + number("_hl") * (2.0 * LIMB) + number("_ll") - number("_rest") * number("_rest") / number("n")
    joined = sums.drop("_mean")
    for part in (squares, ranked_values(counts, keys)):
        columns = [c for c in part.columns if c not in keys]
        renamed = part.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *columns)
        joined = joined.join(renamed, same, "left").drop(*[f"_of_{k}" for k in keys])
    return joined.select(
        *keys, "n", F.round(number("_total") / some.cast("double"), digits).alias("mean"), "min", "max",
        F.when(F.col("n") > 1, F.round(F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("n") - 1).cast("double")), digits)).otherwise(F.lit(0.0)).alias("stddev"),
        *(F.coalesce(column_name(q), F.lit(0)).alias(column_name(q)) for q in QUANTILES),
        number("_total").alias("total"),
    )


def variation(mean: str = "mean", stddev: str = "stddev") -> Column:
    """Coefficient of variation, null where the mean is 0."""
    return F.when(F.col(mean) != 0, F.round(F.col(stddev) / F.abs(F.col(mean)), 6))
