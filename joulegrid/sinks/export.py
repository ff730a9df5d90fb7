"""Exports: CSV rows in fixed formats, JSON, and C headers of event definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.buckets import decimated
from joulegrid.operators.names import hex_id, with_names
from joulegrid.operators.regions import in_span

FORMATS = ("csv", "json", "parquet")
#: So many folders at most are written.
FOLDERS = 1000


class UnsupportedFormat(ValueError):
    """A format that is known by name but not written."""


def seconds(ns: Column) -> Column:
    """Nanoseconds as seconds with nine decimals, exactly."""
    return F.concat(F.call_function("div", ns, F.lit(1_000_000_000).cast("bigint")).cast("string"), F.lit("."), F.lpad((ns % 1_000_000_000).cast("string"), 9, "0"))


def thousandths(c: Column) -> Column:
    """A whole number of thousandths as a decimal with three places."""
    size = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.call_function("div", size, F.lit(1000).cast("bigint")).cast("string"), F.lit("."), F.lpad((size % 1000).cast("string"), 3, "0"))


def sample_rows(samples: DataFrame, every: int = 1, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """time_s, current_uA, voltage_uV, power_uW as text; power is rounded half up."""
    chosen = decimated(in_span(samples, start_ns, end_ns), every)
    product = F.col("current_ua").cast("bigint") * F.col("voltage_uv")
    milli = F.call_function("div", F.abs(product) + 500, F.lit(1000).cast("bigint")) * F.signum(product).cast("bigint")
    return chosen.select("capture_id", "seq", seconds(F.col("t_ns")).alias("time_s"), F.col("current_ua").cast("string").alias("current_uA"), F.col("voltage_uv").cast("string").alias("voltage_uV"), thousandths(milli).alias("power_uW"))


def event_rows(events: DataFrame, defs: DataFrame) -> DataFrame:
    named = with_names(events, defs)
    return named.select("capture_id", "seq", seconds(F.col("t_ns")).alias("time_s"), hex_id(F.col("id")).alias("event_id"), "name", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))


def gpio_rows(gpio: DataFrame) -> DataFrame:
    return gpio.select("capture_id", "seq", seconds(F.col("t_ns")).alias("time_s"), hex_id(F.col("state")).alias("state"))


def write(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = ("capture_id",)) -> None:
    """Write a result, one folder for each capture; VCD is known but not written.

    Of over ``FOLDERS`` captures, none has a folder of its own: its name stays in its rows, which lie together in a file.
    Folders and files so do not grow with the captures, and readers that are given the schema read either.
    """
    if kind not in FORMATS:
        raise UnsupportedFormat(f"{kind!r}: one of {FORMATS}")
    keys = [c for c in partition_by if c in df.columns]
    if keys and df.select(*keys).distinct().limit(FOLDERS + 1).count() > FOLDERS:
        df, keys = df.repartition(*keys).sortWithinPartitions(*keys), []
    writer = df.write.partitionBy(*keys)
    if kind == "csv":
        writer = writer.option("header", True).option("emptyValue", "")
    getattr(writer, kind)(path)


def c_header(defs: DataFrame, guard: str = "EVENT_IDS_H") -> str:
    """A C header with a constant for each id. Definitions are a firmware's own list, checked for size before they are read."""
    rows = defs.orderBy("start_id").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more definitions than a firmware declares")
    lines = [f"#ifndef {guard}", f"#define {guard}", ""]
    for r in rows:
        name = re.sub("[^A-Za-z0-9]", "_", r["name"]).upper()
        lines.append(f"#define EVENT_{name}{'_START' if r['stop_id'] is not None else ''} 0x{r['start_id']:04X}u")
        if r["stop_id"] is not None:
            lines.append(f"#define EVENT_{name}_STOP 0x{r['stop_id']:04X}u")
    return "\n".join([*lines, "", f"#endif /* {guard} */", ""])
