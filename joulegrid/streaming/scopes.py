"""Open scopes of live captures, in bounded state: what stays open for too long is given up as unterminated."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from joulegrid.streaming.groups import GROUP, dealt, packed, stretches, unpacked
from joulegrid.streaming.session import stateful

PAIRED = "capture_id string, name string, seq long, start_ns long, end_ns long, status string"
OPEN = "capture_id string, name string, seq long, t_ns long"
MILLI = 1_000_000


class Scopes(StatefulProcessor):
    """The stacks of open starts of a group of (capture, definition) pairs: (seq, time), oldest first, all in one value.

    The oldest open start of the group has a timer, so a stack also shrinks when nothing comes for it any more.
    """

    def __init__(self, patience_ns: int):
        self.patience = patience_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "held binary")

    def stacks(self) -> dict[tuple, deque]:
        held, out = self.open.get(), {}
        for capture, name, seq, t in unpacked(bytes(held[0])) if held else []:
            out.setdefault((capture, name), deque()).append((seq, t))
        return out

    def keep(self, stacks: dict[tuple, deque]) -> None:
        """The stacks as they are now, and one timer at the time at which the oldest start of all is given up."""
        rows = [(*key, *start) for key, stack in stacks.items() for start in stack]
        self.open.update((packed(rows, OPEN),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            oldest = min(stack[0][1] for stack in stacks.values() if stack)
            self.handle.registerTimer((oldest + self.patience) // MILLI + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stacks, out = self.stacks(), []
        for of, marks in stretches(pd.concat(list(rows)), ["capture_id", "name"], ["t_ns", "seq"]):
            stack = stacks.setdefault(of, deque())
            for seq, t, step in zip(marks["seq"].tolist(), marks["t_ns"].tolist(), marks["step"].tolist(), strict=True):
                while stack and (step == 0 or stack[0][1] + self.patience < t):
                    out.append((*of, *stack.popleft(), None, "unterminated"))
                if step > 0:
                    stack.append((seq, t))
                elif step < 0 and stack:
                    out.append((*of, *stack.pop(), t, "paired"))
                elif step < 0:
                    out.append((*of, seq, None, t, "orphaned"))
        self.keep(stacks)
        yield table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * MILLI
        stacks, out = self.stacks(), []
        for of, stack in stacks.items():
            while stack and stack[0][1] + self.patience < now:
                out.append((*of, *stack.popleft(), None, "unterminated"))
        self.keep(stacks)
        yield table(out)


def table(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in PAIRED.split(", ")]
    columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: () for n in names}
    return pd.DataFrame({n: pd.Series(columns[n], dtype="Int64" if n in ("seq", "start_ns", "end_ns") else object) for n in names})


def pairs(marks: DataFrame, patience_ns: int, delay: str = "0 seconds") -> DataFrame:
    """Pairs, orphans and unterminated starts of (capture_id, name, seq, t_ns, step) rows, step being 1, -1, or 0 at a capture's end.

    A start that is open for over ``patience_ns`` of the stream's time is unterminated, and a stop that comes yet belongs
    to an earlier start or is orphaned. Rows must not be older than the latest of earlier micro-batches by more than ``delay``.
    """
    stateful(marks.sparkSession)
    timed = dealt(marks, "capture_id", "name").withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("t_ns"), F.lit(1000).cast("bigint")))).withWatermark("event_time", delay)
    return timed.groupBy(GROUP).transformWithStateInPandas(Scopes(patience_ns), outputStructType=PAIRED, outputMode="Append", timeMode="EventTime")
