"""Device rows: which are likely profilers, and whether a requested rate can be met."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class RateTooHigh(ValueError):
    """A rate above what the device says it can do; it is refused, not lowered."""


def likely_profiler(vid: Column, pid: Column, known: list[tuple[int, int]]) -> Column:
    """Whether a USB vendor and product are among the known ones; null ids are not."""
    pairs = F.array(*[F.lit((v << 16) | p) for v, p in known])
    return F.coalesce(F.array_contains(pairs, F.shiftleft(vid, 16).bitwiseOR(pid)), F.lit(False))


def checked_rate(requested_hz: int, most_hz: int) -> int:
    if not 1 <= requested_hz <= most_hz:
        raise RateTooHigh(f"{requested_hz} Hz is asked for; the device does 1 to {most_hz}")
    return requested_hz
