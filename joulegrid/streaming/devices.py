"""State that follows a device's live stream: frames, tick epochs, gaps, and buckets.

Rows of a device may arrive in any order within a micro-batch and are put in arrival order there; across batches the
sources keep it. Errors of device time are rows of their own rather than lost. Devices are dealt to groups (``groups``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from joulegrid.sources import wire
from joulegrid.streaming.groups import GROUP, dealt, numbers_of, stretches
from joulegrid.streaming.session import WRAP, steps_between

UNWRAPPED = "device string, arrival long, ticks long, epoch long, full_ticks long, step string"
GAPS = "capture_id string, start_ns long, end_ns long, lost_estimate long"
FIGURES = ("t_ns", "min_ua", "max_ua", "sum_ua", "count")


def unwrapped(raw: DataFrame) -> DataFrame:
    """The streaming form of the batch operator: (device, arrival, ticks) rows with epochs."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
        rows = pd.concat(list(pdfs))
        numbers, names = numbers_of(rows["device"])
        at = np.lexsort((rows["arrival"].to_numpy(), numbers))
        numbers, arrival, ticks = numbers[at], rows["arrival"].to_numpy("int64")[at], rows["ticks"].to_numpy("int64")[at]
        first, last = edges(numbers)
        known = [held.get(names[k], (0, -1)) for k in numbers[first].tolist()]
        before = np.concatenate([[0], ticks[:-1]])
        before[first] = [b if b >= 0 else t for (_, b), t in zip(known, ticks[first].tolist(), strict=True)]
        steps, wraps = steps_between(before, ticks)
        sums = np.cumsum(wraps)
        base = np.array([e for e, _ in known], np.int64) - sums[first] + wraps[first]
        epochs = sums + np.repeat(base, last - first + 1)
        held |= {names[k]: (e, t) for k, e, t in zip(numbers[first].tolist(), epochs[last].tolist(), ticks[last].tolist(), strict=True)}
        state.update((list(held), [e for e, _ in held.values()], [t for _, t in held.values()]))
        yield pd.DataFrame({"device": [names[k] for k in numbers.tolist()], "arrival": arrival, "ticks": ticks, "epoch": epochs, "full_ticks": epochs * WRAP + ticks, "step": steps})

    return dealt(raw, "device").groupBy(GROUP).applyInPandasWithState(step, UNWRAPPED, "device array<string>, epoch array<long>, last array<long>", "append", GroupStateTimeout.NoTimeout)


def edges(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of each stretch of equal numbers."""
    change = np.flatnonzero(numbers[1:] != numbers[:-1])
    return np.concatenate([[0], change + 1]), np.concatenate([change, [len(numbers) - 1]])


def time_gaps(samples: DataFrame, rate_hz: float, periods: int = 3) -> DataFrame:
    """Gaps between a capture's consecutive samples, those between two micro-batches included."""
    period = int(1e9 // rate_hz)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(pdfs))
        numbers, names = numbers_of(rows["capture_id"])
        at = np.lexsort((rows["seq"].to_numpy(), rows["t_ns"].to_numpy(), numbers))
        numbers, times = numbers[at], rows["t_ns"].to_numpy("int64")[at]
        first, last = edges(numbers)
        before = np.concatenate([[0], times[:-1]])
        before[first] = [held.get(names[k], t) for k, t in zip(numbers[first].tolist(), times[first].tolist(), strict=True)]
        held |= {names[k]: t for k, t in zip(numbers[last].tolist(), times[last].tolist(), strict=True)}
        state.update((list(held), list(held.values())))
        found = np.flatnonzero(times - before > periods * period)
        a, b = before[found], times[found]
        yield pd.DataFrame({"capture_id": pd.Series([names[k] for k in numbers[found].tolist()], dtype=object), "start_ns": a, "end_ns": b, "lost_estimate": np.maximum((b - a) // period - 1, 0)})

    return dealt(samples, "capture_id").groupBy(GROUP).applyInPandasWithState(step, GAPS, "capture_id array<string>, last array<long>", "append", GroupStateTimeout.NoTimeout)


def buckets(samples: DataFrame, width_ns: int, delay_ns: int) -> DataFrame:
    """Closed buckets of a width by capture, and what came too late for its bucket as rows of its own (``late``).

    A bucket closes once a sample ``delay_ns`` or more after its end has been seen in an earlier micro-batch or this one;
    until then it is in the state, so the state holds what falls within the delay. Late samples are counted, never lost:
    sums of both kinds of rows are the whole stream, but for buckets still open.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tops, *open_ = (dict(zip(*state.get[:2], strict=True)), *state.get[2:]) if state.exists else ({}, *[[]] * 6)
        held = pd.DataFrame({"capture_id": pd.Series(open_[0], dtype=object)} | {c: pd.Series(x, dtype="int64") for c, x in zip(FIGURES, open_[1:], strict=True)})
        rows = pd.concat(list(pdfs))
        at, i = rows["t_ns"].to_numpy(), rows["current_ua"].to_numpy().astype("int64")
        numbers, names = numbers_of(rows["capture_id"])
        before = np.array([tops.get(n, -1) for n in names], np.int64)
        now = pd.DataFrame({"capture_id": rows["capture_id"].to_numpy(object), "t_ns": at - at % width_ns, "min_ua": i, "max_ua": i, "sum_ua": i, "count": 1})
        late = (now["t_ns"] + width_ns + delay_ns).to_numpy() <= before[numbers]
        sums = {"min_ua": "min", "max_ua": "max", "sum_ua": "sum", "count": "sum"}
        together = lambda some: some.groupby(["capture_id", "t_ns"], as_index=False, dropna=False).agg(sums)
        missed, every = together(now[late]).assign(late=True), together(pd.concat([held, now[~late]]))
        np.maximum.at(before, numbers, at)
        tops |= dict(zip(names, before.tolist(), strict=True))
        owners = every["capture_id"].astype(object).where(every["capture_id"].notna(), None)
        closed = (every["t_ns"] + width_ns + delay_ns).to_numpy() <= np.array([tops[c] for c in owners], np.int64)
        state.update((list(tops), list(tops.values()), owners[~closed].tolist(), *(every[~closed][c].tolist() for c in FIGURES)))
        yield pd.concat([every[closed].assign(late=False), missed])[["capture_id", *FIGURES, "late"]]

    schema = "capture_id string, t_ns long, min_ua long, max_ua long, sum_ua long, count long, late boolean"
    held = "capture_id array<string>, seen array<long>, of array<string>, t_ns array<long>, min_ua array<long>, max_ua array<long>, sum_ua array<long>, count array<long>"
    return dealt(samples.select("capture_id", "t_ns", "current_ua"), "capture_id").groupBy(GROUP).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)


def frames(chunks: DataFrame) -> DataFrame:
    """Frames of a live line, as the batch operator has them, out of (device, chunk, bytes) rows.

    The state is what follows the last delimiter, and at most one byte more than a frame may have: a longer region is
    refused whatever comes. Within a micro-batch chunks are put in order; across them the source keeps it.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tails = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for (device,), rows in stretches(pd.concat(list(pdfs)), ["device"], ["chunk"]):
            tail = bytes(tails.get(device, b""))
            for chunk, data in zip(rows["chunk"].tolist(), rows["bytes"].tolist(), strict=True):
                *regions, tail = (tail + bytes(data or b"")).split(b"\0")
                tail = tail[: wire.MAX_ENCODED + 1]
                out += [(device, wire.arrival_of(chunk, k), *wire.opened(r)) for k, r in enumerate(regions) if r]
            tails[device] = tail
        state.update((list(tails), list(tails.values())))
        columns = dict(zip(("device", "arrival", "status", "type", "seq", "payload"), zip(*out, strict=True), strict=True)) if out else {c: () for c in ("device", "arrival", "status", "type", "seq", "payload")}
        columns |= {c: pd.array(columns[c], "Int32") for c in ("type", "seq")}
        yield pd.DataFrame(columns)

    return dealt(chunks.select("device", "chunk", "bytes"), "device").groupBy(GROUP).applyInPandasWithState(step, wire.FRAMES, "device array<string>, tail array<binary>", "append", GroupStateTimeout.NoTimeout)
