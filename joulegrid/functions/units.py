"""Quantities as text: parsing and formatting, as column expressions, and the same for a single value on the driver."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of ten of the prefixes; both micro signs are known.
PREFIXES = {"p": -12, "n": -9, "u": -6, "µ": -6, "μ": -6, "m": -3, "": 0, "k": 3, "K": 3, "M": 6, "G": 9}
DURATIONS = {"ns": 1.0, "us": 1e3, "µs": 1e3, "μs": 1e3, "ms": 1e6, "s": 1e9, "": 1e9, "min": 60e9, "h": 3600e9}
NUMBER = r"[+-]?(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)"


class InvalidQuantity(ValueError):
    """A text that is no quantity of the unit asked for."""


def _number(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("")).cast("double")


def _choose(suffix: Column, table: dict[str, float]) -> Column:
    chosen = None
    for key, factor in table.items():
        chosen = F.when(suffix == key, F.lit(float(factor))) if chosen is None else chosen.when(suffix == key, F.lit(float(factor)))
    return chosen


def parse_quantity(c: Column, unit: str) -> Column:
    """Value in base units, null if it does not parse. The unit may be left out; a prefix needs no unit after it.

    Underscores and spaces are allowed, scientific notation is not. Where a suffix is both a unit and a prefix, the
    unit wins: it is the longer reading.
    """
    pattern = rf"^\s*({NUMBER})\s*([pnuµμmkKMG]?)\s*(?:{re.escape(unit)})?\s*$"
    plain = rf"^\s*({NUMBER})\s*{re.escape(unit)}\s*$"
    factors = {k: 10.0**abs(e) for k, e in PREFIXES.items()}
    number, prefix = _number(F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2)
    small = prefix.isin(*[k for k, e in PREFIXES.items() if e < 0])
    scaled = F.when(small, number / _choose(prefix, factors)).otherwise(number * _choose(prefix, factors))
    return F.when(c.rlike(plain), _number(F.regexp_extract(c, plain, 1))).when(c.rlike(pattern), scaled)


def parse_duration_ns(c: Column) -> Column:
    """Nanoseconds of a duration; a bare number is seconds."""
    pattern = rf"^\s*({NUMBER})\s*(ns|us|µs|μs|ms|s|min|h|)\s*$"
    value = _number(F.regexp_extract(c, pattern, 1)) * _choose(F.regexp_extract(c, pattern, 2), DURATIONS)
    return F.when(c.rlike(pattern), F.round(value).cast("bigint"))


def parse_ratio(c: Column) -> Column:
    """A fraction, or a percentage with its sign."""
    pattern = rf"^\s*({NUMBER})\s*(%?)\s*$"
    number = _number(F.regexp_extract(c, pattern, 1))
    return F.when(c.rlike(pattern), F.when(F.regexp_extract(c, pattern, 2) == "%", number / 100).otherwise(number))


def parse_rate_hz(c: Column) -> Column:
    """Whole samples a second, from 1 to 2^32 - 1, else null."""
    rate = F.round(parse_quantity(c, "Hz"))
    return F.when((rate >= 1) & (rate <= 4294967295), rate.cast("bigint"))


def format_quantity(c: Column, unit: str) -> Column:
    """Three decimals with the prefix that leaves one to three digits before the point."""
    size = F.abs(c)
    out = F.when(c == 0, F.format_string(f"0.000 {unit}"))
    for prefix, power in (("G", 9), ("M", 6), ("k", 3), ("", 0), ("m", -3), ("µ", -6), ("n", -9)):
        scaled = c / F.lit(10.0**power) if power >= 0 else c * F.lit(10.0**-power)
        out = out.when(size >= F.lit(10.0**power), F.format_string(f"%.3f {prefix}{unit}", scaled))
    return out.otherwise(F.format_string(f"%.3f p{unit}", c * F.lit(1e12)))


def human_bytes(c: Column) -> Column:
    n = c.cast("double")
    return (
        F.when(c < 1024, F.format_string("%d B", c.cast("bigint"))).when(c < 1024**2, F.format_string("%.1f KiB", n / 1024))
        .when(c < 1024**3, F.format_string("%.1f MiB", n / 1024**2)).otherwise(F.format_string("%.2f GiB", n / 1024**3))
    )


def quantity(text: str, unit: str) -> float:
    """The same as parse_quantity for one text; raises InvalidQuantity."""
    if m := re.fullmatch(rf"\s*({NUMBER})\s*{re.escape(unit)}\s*", text):
        return float(m[1].replace("_", ""))
    m = re.fullmatch(rf"\s*({NUMBER})\s*([pnuµμmkKMG]?)\s*(?:{re.escape(unit)})?\s*", text)
    if not m:
        raise InvalidQuantity(f"{text!r} is no quantity in {unit}")
    e = PREFIXES[m[2]]
    number = float(m[1].replace("_", ""))
    return number / 10.0**-e if e < 0 else number * 10.0**e


def duration_ns(text: str) -> int:
    m = re.fullmatch(rf"\s*({NUMBER})\s*(ns|us|µs|μs|ms|s|min|h|)\s*", text)
    if not m:
        raise InvalidQuantity(f"{text!r} is no duration")
    value = float(m[1].replace("_", "")) * DURATIONS[m[2]]
    if not math.isfinite(value):
        raise InvalidQuantity(f"{text!r} is not finite")
    return round(value)


def tolerance_percent(text: str) -> float:
    """A tolerance must say that it is a percentage, so that 5 is not taken for 500 %."""
    m = re.fullmatch(rf"\s*({NUMBER})\s*%\s*", text)
    if not m:
        raise InvalidQuantity(f"{text!r} is no percentage")
    return float(m[1].replace("_", ""))
