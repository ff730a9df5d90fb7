"""Analysis of captures: statistics of a region, of events, and an overview, from one set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from joulegrid.functions.units import duration_ns
from joulegrid.operators import buckets, gaps, occurrences, regions


@dataclass(frozen=True)
class Tables:
    """The tables of one or more captures; levels are stored summaries by their width."""

    samples: DataFrame
    events: DataFrame
    defs: DataFrame
    gaps: DataFrame | None = None
    levels: dict[int, DataFrame] | None = None


def span(start: str | None, end: str | None) -> tuple[int | None, int | None]:
    """A half-open span from two durations since the capture began."""
    a, b = (None if t is None else duration_ns(t) for t in (start, end))
    if a is not None and b is not None and b <= a:
        raise ValueError("the span is empty")
    return a, b


def region(tables: Tables, start: str | None = None, end: str | None = None, gap_policy: str = "strict", supply_uv: int | None = None) -> DataFrame:
    a, b = span(start, end)
    return regions.battery_hours(regions.region_stats(tables.samples, start_ns=a, end_ns=b, gaps=tables.gaps, gap_policy=gap_policy, supply_uv=supply_uv))


def event_table(tables: Tables, start: str | None = None, end: str | None = None, sort: str = "energy_nj_total", top: int | None = None) -> DataFrame:
    """Statistics of events, largest first by a column; of the whole captures, or of the events within a span."""
    a, b = span(start, end)
    stats = occurrences.event_stats(tables.samples, regions.in_span(tables.events, a, b), tables.defs)
    ordered = stats.orderBy(stats[sort].desc_nulls_last(), "name") if sort != "name" else stats.orderBy("name")
    return ordered.limit(top) if top else ordered


def waveform(tables: Tables, start_ns: int, end_ns: int, n: int) -> DataFrame:
    return buckets.overview(tables.samples, tables.levels or {}, start_ns, end_ns, n)


def marks_within(tables: Tables, start_ns: int, end_ns: int) -> DataFrame:
    """Events of a span with their names."""
    from joulegrid.operators.names import with_names

    return with_names(regions.in_span(tables.events, start_ns, end_ns), tables.defs)


def gap_summary(tables: Tables, rate_hz: float) -> DataFrame:
    return gaps.gap_totals(tables.gaps if tables.gaps is not None else gaps.time_gaps(tables.samples, rate_hz))
