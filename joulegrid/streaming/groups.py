"""Keys of a stream dealt to groups, and the states of a group's keys as one value.

A call of a stateful operator has a cost of its own, so with a call for each device a stream of many devices is little else.
Operators are called for groups of devices instead, of which there are ``GROUPS`` at most, and go through a group's
rows together. A device is always in the same group, and a group's state holds what its devices' states hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = 1024
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
GROUP = "_group"


def dealt(rows: DataFrame, *keys: str, groups: int = GROUPS) -> DataFrame:
    """``rows`` with the group that each one's key is dealt to."""
    return rows.withColumn(GROUP, F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"))


def numbers_of(keys: pd.Series) -> tuple[np.ndarray, list]:
    """A number for each row's key, and the keys by number; null is a key like any other."""
    numbers, found = pd.factorize(keys.to_numpy(object), use_na_sentinel=False)
    return numbers, [None if k is None or k != k else k for k in found]


def stretches(rows: pd.DataFrame, keys: list[str], order: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Each key's rows in order."""
    numbers = [numbers_of(rows[k]) for k in keys]
    at = np.lexsort([*(rows[c].to_numpy() for c in reversed(order)), *(n for n, _ in reversed(numbers))])
    rows, numbers = rows.iloc[at], [(n[at], found) for n, found in numbers]
    change = np.zeros(len(rows), bool)
    for n, _ in numbers:
        change[1:] |= n[1:] != n[:-1]
    starts = [0, *np.flatnonzero(change).tolist()]
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield tuple(found[n[a]] for n, found in numbers), rows.iloc[a:b]


def packed(rows: list[tuple], schema: str) -> bytes:
    """Rows of a schema as the bytes that a value of a state holds."""
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    batch = pa.record_batch([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> list[tuple]:
    """The rows that ``packed`` was given."""
    table = pa.ipc.open_stream(raw).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))
