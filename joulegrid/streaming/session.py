"""From landed bytes to capture time in one query: a device's whole session as one stateful operator.

Frames, tick epochs, the capture's origin, gaps, sequence numbers and counters follow one another in order of arrival, so
they are kept in a state of each device, of a size that does not depend on the stream: the bytes after the last delimiter,
the last sample, and counts. Only events that come before a device's first sample wait, as their time has no origin yet.
Devices are dealt to groups (``groups``), whose devices' states are read and written as one value.
Every row tells its ``kind``; ``run.fan_out`` writes each kind to its table, all of a micro-batch or none of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from joulegrid.sources import wire
from joulegrid.streaming.groups import GROUP, dealt, packed, stretches, unpacked

WRAP, HALF = 1 << 32, 1 << 31
#: Rows of all kinds; columns that a kind has not are null.
COLUMNS = (
    "capture_id string, kind string, arrival long, record int, t_ns long, ticks long, step string, current_ua int, voltage_uv long, id int, value long, state int, "
    "host_send_ns long, end_ns long, cause string, lost_estimate long"
)
NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]
TEXTS = ("capture_id", "kind", "step", "cause")
#: What each table keeps of the rows of its kind.
TABLES = {
    "samples": ("capture_id", "arrival", "record", "t_ns", "current_ua", "voltage_uv", "step"),
    "events": ("capture_id", "arrival", "record", "t_ns", "id", "value"),
    "gpio": ("capture_id", "arrival", "record", "t_ns", "state"),
    "sync": ("capture_id", "arrival", "record", "t_ns", "host_send_ns", "ticks"),
    "gaps": ("capture_id", "arrival", "t_ns", "end_ns", "cause", "lost_estimate"),
    "errors": ("capture_id", "arrival", "record", "id", "value"),
    "counts": ("capture_id", "cause", "value"),
}
STATE = "device string, tail binary, epoch long, last long, origin long, last_ns long, seq int, lost boolean, bad boolean, waits boolean"
EARLY = "device string, kind string, arrival long, record int, ticks long, id int, value long, state int, host_send_ns long"
STATES, EARLIES = ([c.split(" ")[0] for c in x.split(", ")][1:] for x in (STATE, EARLY))
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """State with lists, maps and timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def nanos(ticks: int, hz: int) -> int:
    return ticks * 1_000_000_000 // max(1, hz)


def steps_of(ticks: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each sample's step is ok, a wrap, backwards or implausible, and which are wraps; ``last`` is -1 at the start."""
    return steps_between(np.concatenate([[last if last >= 0 else ticks[0]], ticks[:-1]]), ticks)


def steps_between(before: np.ndarray, ticks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of each reading and the one before it."""
    back = before - ticks
    wraps = back > HALF
    return np.select([wraps, back > 0, back < -HALF], ["wrap", "backwards", "implausible"], "ok"), wraps


def nearest(ticks: int, near: int) -> int:
    """Full ticks of a reading in the epoch that puts it next to ``near``."""
    full = near - near % WRAP + ticks
    if full - near > HALF and full >= WRAP:
        return full - WRAP
    return full + WRAP if near - full > HALF else full


class Session(StatefulProcessor):
    """Rows of ``COLUMNS`` out of (device, chunk, bytes) rows. Errors of time and refused regions are rows too."""

    def __init__(self, timer_hz: int, period_ns: int, periods: int = 3):
        self.hz, self.period, self.periods = timer_hz, period_ns, periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("sessions", "held binary")
        self.early = handle.getListState("early", EARLY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        sessions = {device: state for device, *state in unpacked(bytes(held[0]))} if held else {}
        out: dict[str, list] = {c: [] for c in NAMES}
        waiting: dict[str, list[dict]] = {}
        if any(state[STATES.index("waits")] for state in sessions.values()):
            for device, *e in self.early.get():
                waiting.setdefault(device, []).append(dict(zip(EARLIES, e, strict=True)))
        left, fresh = 0, []
        for (device,), chunks in stretches(pd.concat(list(rows)), ["device"], ["chunk"]):
            s = dict(zip(STATES, sessions.get(device) or (b"", 0, -1, -1, -1, -1, False, False, False), strict=True))
            early, counts = waiting.setdefault(device, []), Counter()
            known = len(early)
            put = partial(put_rows, out, device)
            tail = bytes(s["tail"])
            for chunk, data in zip(chunks["chunk"].tolist(), chunks["bytes"].tolist(), strict=True):
                *regions, tail = (tail + bytes(data or b"")).split(b"\0")
                tail = tail[: wire.MAX_ENCODED + 1]
                for k, region in enumerate(regions):
                    if region:
                        self.take(s, wire.arrival_of(chunk, k), region, put, early, counts)
            s["tail"] = tail
            if s["origin"] >= 0:
                for e in early:  # what came before the first sample is of epoch 0
                    put(e["kind"], **{c: v for c, v in e.items() if c != "kind"} | {"t_ns": self.time(s, e["ticks"])})
                left += known
                early.clear()
            fresh += [(device, *e.values()) for e in early[known:]]
            s["waits"] = bool(early)
            for name, n in counts.items():
                put("counts", cause=name, value=n)
            sessions[device] = tuple(s.values())
        if left:
            still = [(device, *e.values()) for device, found in waiting.items() for e in found]
            self.early.put(still) if still else self.early.clear()
        elif fresh:
            self.early.appendList(fresh)
        self.held.update((packed([(device, *state) for device, state in sessions.items()], STATE),))
        yield table_of(out)

    def time(self, s: dict, full: int) -> int:
        return nanos(max(0, full - s["origin"]), self.hz)

    def take(self, s: dict, arrival: int, region: bytes, put, waiting: list, counts: Counter) -> None:
        status, kind, seq, payload = wire.opened(region)
        counts["frames" if status == "ok" else "oversize" if status == "oversize" else f"{status}_errors"] += 1
        counts["resyncs"] += s["bad"] and status == "ok"
        s["bad"] = status != "ok"
        if status in ("ok", "payload"):
            gap = s["seq"] >= 0 and seq != (s["seq"] + 1) % 256
            counts["seq_gaps"] += gap
            s["lost"], s["seq"] = s["lost"] or gap, seq
        if status != "ok":
            return
        if kind == wire.TYPES["CURRENT_SAMPLES"]:
            self.samples(s, arrival, payload, put)
        elif kind in UNPACK:
            name, fields = UNPACK[kind](payload)
            for record in range(len(next(iter(fields.values())))):
                row = {"arrival": arrival, "record": record} | {c: None if (v := x[record]) is None else int(v) for c, x in fields.items()}
                if name == "errors":
                    put(name, **row)
                elif s["origin"] < 0:
                    waiting.append({"kind": name, "arrival": arrival, "record": record} | {c: row.get(c) for c in ("ticks", "id", "value", "state", "host_send_ns")})
                else:
                    row["ticks"] = nearest(row["ticks"], s["epoch"] * WRAP + s["last"])
                    put(name, **row | {"t_ns": self.time(s, row["ticks"])})

    def samples(self, s: dict, arrival: int, payload: bytes, put) -> None:
        block = wire._samples(payload)
        ticks = block["ticks"]
        if not len(ticks):
            return
        steps, wraps = steps_of(ticks, s["last"])
        full = (s["epoch"] + np.cumsum(wraps)) * WRAP + ticks
        if s["origin"] < 0:
            s["origin"] = int(full[0])
        t = np.array([self.time(s, x) for x in full.tolist()], np.int64)
        before = np.concatenate([[s["last_ns"] if s["last_ns"] >= 0 else t[0]], t[:-1]])
        for k in np.flatnonzero(t - before > self.periods * self.period).tolist():
            cause = "device_overflow" if block["overflow_before"][k] else "sequence_gap" if k == 0 and s["lost"] else "timestamp_jump"
            put("gaps", arrival=arrival, t_ns=int(before[k]), end_ns=int(t[k]), cause=cause, lost_estimate=max(int(t[k] - before[k]) // self.period - 1, 0))
        columns = {"t_ns": t, "ticks": full, "step": steps, "current_ua": block["current_ua"], "voltage_uv": block["voltage_uv"]}
        put("samples", len(t), arrival=[arrival] * len(t), record=range(len(t)), **{c: x.tolist() for c, x in columns.items()})
        s["epoch"], s["last"], s["last_ns"], s["lost"] = int(full[-1]) // WRAP, int(ticks[-1]), int(t[-1]), False


def _sync(payload: bytes) -> tuple[str, dict]:
    row = wire.SYNC_FIELDS(payload)
    return "sync", {"ticks": row["ticks"], "host_send_ns": row["host_time_ns"]}


def _error(payload: bytes) -> tuple[str, dict]:
    row = wire.ERROR_FIELDS(payload)
    return "errors", {"id": row["code"], "value": row["dropped_samples"]}


def _events(payload: bytes) -> tuple[str, dict]:
    columns = wire._events(payload)
    return "events", columns | {"value": columns["value"].to_pylist()}


UNPACK = {wire.TYPES["EVENT"]: _events, wire.TYPES["GPIO_EVENT"]: lambda p: ("gpio", wire._gpio(p)), wire.TYPES["SYNC"]: _sync, wire.TYPES["ERROR"]: _error}


def put_rows(out: dict[str, list], capture: str, kind: str, n: int | None = None, **columns) -> None:
    """Appends a row of a kind to the columns of all rows, or ``n`` rows that are given as columns."""
    fixed = {"capture_id": capture, "kind": kind}
    for c, held in out.items():
        if c in fixed:
            held += [fixed[c]] * (1 if n is None else n)
        elif n is None:
            held.append(columns.get(c))
        else:
            held += columns.get(c) or [None] * n


def table_of(columns: dict[str, list]) -> pd.DataFrame:
    """Rows of all kinds with all columns."""
    whole = lambda c: pd.Series(pa.array(columns[c], pa.int64()).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get))
    return pd.DataFrame({c: pd.Series(columns[c], dtype=object) if c in TEXTS else whole(c) for c in NAMES})


def sessions(chunks: DataFrame, timer_hz: int, rate_hz: float) -> DataFrame:
    """Rows of ``COLUMNS`` of a stream of (device, chunk, bytes) rows, whose chunks come in order over micro-batches."""
    stateful(chunks.sparkSession)
    return dealt(chunks.select("device", "chunk", "bytes"), "device").groupBy(GROUP).transformWithStateInPandas(Session(timer_hz, int(1e9 // rate_hz)), outputStructType=COLUMNS, outputMode="Append", timeMode="None")


def table(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select(*TABLES[kind])
