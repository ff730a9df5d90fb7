"""Events of a live stream put into the epochs of its samples, in whatever order they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from joulegrid.streaming.groups import GROUP, dealt, packed, stretches, unpacked
from joulegrid.streaming.session import WRAP, nearest, stateful, steps_of

#: Arrays of more samples than that are kept apart.
INLINE = 512
DEVICES = "device string, epoch long, ticks long, arrival long, whole boolean, apart boolean, arrivals binary, full binary, waits boolean"
RESOLVED = "device string, arrival long, ticks long, full_ticks long, late string"


class Resolver(StatefulProcessor):
    """Samples advance their device's epoch; the last ``history`` of them are kept as arrays. Events wait in a list until a
    sample of their device arrives that comes after them, or ``patience_ms`` have passed.

    A group's devices have one value in common; arrays of over ``INLINE`` samples have entries of their own beside it, so the
    value stays small.
    """

    def __init__(self, history: int, patience_ms: int | None):
        self.history, self.patience = history, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("devices", "held binary")
        self.recent = handle.getMapState("recent", "device string", "arrivals binary, full binary")
        self.early = handle.getListState("early", "device string, arrival long, ticks long, due long")

    def devices(self) -> dict:
        held = self.held.get()
        return {device: state for device, *state in unpacked(bytes(held[0]))} if held else {}

    def arrays(self, device: str, state: list) -> list[np.ndarray]:
        return [np.frombuffer(x, np.int64) for x in (self.recent.getValue((device,)) if state[4] else state[5:7])]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states, early, out = self.devices(), {}, []
        due = timerValues.getCurrentProcessingTimeInMs() + self.patience if self.patience is not None else 0
        if any(state[7] for state in states.values()):
            for device, *e in self.early.get():
                early.setdefault(device, []).append(tuple(e))
        changed = False
        for (device,), held in stretches(pd.concat(list(rows)), ["device"], ["arrival"]):
            state = states.get(device) or [0, -1, -1, True, False, b"", b"", False]
            epoch, last, seen, whole, apart, *_ = state
            arrivals, full = self.arrays(device, state)
            kinds = held["kind"].to_numpy(object)
            ended = bool((kinds == "end").any())
            arrival, reading = held["arrival"].to_numpy(np.int64), held["ticks"].to_numpy(np.int64)
            before = seen
            if (sample := kinds == "sample").any():
                ticks, at = reading[sample], arrival[sample]
                now = (epoch + np.cumsum(steps_of(ticks, last)[1])) * WRAP + ticks
                epoch, last, seen = int(now[-1]) // WRAP, int(ticks[-1]), int(at[-1])
                arrivals, full = np.concatenate([arrivals, at]), np.concatenate([full, now])
            event = kinds == "event"
            waited = early.get(device, [])
            every = [*waited, *((a, t, due) for a, t in zip(arrival[event].tolist(), reading[event].tolist(), strict=True))]
            out += self.resolved(device, [e for e in every if e[0] < seen or ended], arrivals, full, before, whole)
            left = [e for e in every if e[0] >= seen and not ended]
            changed, early[device] = changed or left != waited, left
            whole = whole and len(arrivals) <= self.history
            kept = [x[-self.history :].tobytes() for x in (arrivals, full)]
            if apart or len(arrivals) > INLINE:
                self.recent.updateValue((device,), tuple(kept))
                apart, kept = True, [b"", b""]
            states[device] = [epoch, last, seen, whole, apart, *kept, bool(left)]
        if changed:
            self.wait(early)
        self.held.update((packed([(device, *state) for device, state in states.items()], DEVICES),))
        yield table(out)

    def wait(self, early: dict[str, list[tuple]]) -> None:
        """Events that wait now, and a timer at the time at which the first of them is released."""
        rows = [(device, *e) for device, found in early.items() for e in found]
        self.early.put(rows) if rows else self.early.clear()
        if rows and self.patience is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(min(r[3] for r in rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, states, early, out = expiredTimerInfo.getExpiryTimeInMs(), self.devices(), {}, []
        for device, *e in self.early.get():
            early.setdefault(device, []).append(tuple(e))
        for device, waited in early.items():
            ready, early[device] = [e for e in waited if e[2] <= now], [e for e in waited if e[2] > now]
            if ready:
                state = states[device]
                out += self.resolved(device, ready, *self.arrays(device, state), state[2], state[3])
                state[7] = bool(early[device])
        self.handle.deleteTimer(now)
        self.wait(early)
        self.held.update((packed([(device, *state) for device, state in states.items()], DEVICES),))
        yield table(out)

    @staticmethod
    def resolved(device: str, events: list[tuple[int, int]], arrivals: np.ndarray, full: np.ndarray, before: int, whole: bool) -> list[tuple]:
        """Each event by the last sample that arrived before it; without one it is of epoch 0, if no sample has been forgotten."""
        at = np.searchsorted(arrivals, [e[0] for e in events]) - 1
        out = []
        for (arrival, ticks, _), k in zip(events, at.tolist(), strict=True):
            forgotten = k < 0 and not whole
            near = int(full[max(k, 0)]) if k >= 0 or forgotten else 0
            out.append((device, arrival, ticks, nearest(ticks, near), "unknown" if forgotten else "late" if arrival < before else "no"))
        return out


def table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["device", "arrival", "ticks", "full_ticks", "late"]).astype({"arrival": "int64", "ticks": "int64", "full_ticks": "int64"})


def resolved(rows: DataFrame, history: int = 65_536, patience_ms: int | None = None) -> DataFrame:
    """Events of (device, kind, arrival, ticks) rows, kind being sample, event, or end where a device's stream ends.

    Samples come in order over micro-batches; an event may come early or late. ``late`` tells what became of one: ``no``,
    ``late`` (a later sample had been seen in an earlier micro-batch; resolved all the same), or ``unknown`` (it is older than the
    samples that are kept, and takes the oldest of them). ``late_counts`` sums them up. Events that nothing follows wait for
    the end, or for ``patience_ms`` of processing time.
    """
    stateful(rows.sparkSession)
    mode = "None" if patience_ms is None else "ProcessingTime"
    return dealt(rows.select("device", "kind", "arrival", "ticks"), "device").groupBy(GROUP).transformWithStateInPandas(Resolver(history, patience_ms), outputStructType=RESOLVED, outputMode="Append", timeMode=mode)


def late_counts(rows: DataFrame) -> DataFrame:
    """How many events of each device came late, and how."""
    return rows.where("late <> 'no'").groupBy("device", "late").count()
