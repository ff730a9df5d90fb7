"""Event definitions: the TOML that people write and the CBOR that captures store."""

from __future__ import annotations

import struct
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulegrid.operators.names import validated
from joulegrid.schemas import EVENT_DEFS

#: What a capture stores about itself, as columns.
DEFINITION = "name string, start_id int, stop_id int, category string, value_units string, latency_compensation_ns long"
STORED = (
    f"capture_id string, event array<struct<{', '.join(c.replace(' ', ':') for c in DEFINITION.split(', '))}>>, notes map<string,string>, invocation string, device string, "
    "writer_version string, host string, clock_fit struct<a:double, b:double, samples:long, residual_ns:double>, assumed_supply_uv long"
)
EVENT_TYPE = pa.list_(
    pa.struct([("name", pa.string()), ("start_id", pa.int32()), ("stop_id", pa.int32()), ("category", pa.string()), ("value_units", pa.string()), ("latency_compensation_ns", pa.int64())])
)
FIT_TYPE = pa.struct([("a", pa.float64()), ("b", pa.float64()), ("samples", pa.int64()), ("residual_ns", pa.float64())])
TEXTS = ("invocation", "device", "writer_version", "host")


class InvalidMetadata(ValueError):
    """Text or bytes that hold no metadata."""


def cbor(data: bytes) -> object:
    """One item of CBOR: integers, floats, texts, bytes, arrays, maps, booleans and null, of definite length or not."""
    try:
        value, end = _item(data, 0)
    except (struct.error, KeyError, TypeError, ValueError, RecursionError) as e:
        raise e if isinstance(e, InvalidMetadata) else InvalidMetadata(str(e)) from e
    if end != len(data):
        raise InvalidMetadata("bytes after the end of the metadata")
    return value


def _item(data: bytes, at: int) -> tuple[object, int]:
    try:
        major, low = data[at] >> 5, data[at] & 31
    except IndexError:
        raise InvalidMetadata("the metadata ends early") from None
    at += 1
    if major == 7 and low in (25, 26, 27):
        layout = {25: ">e", 26: ">f", 27: ">d"}[low]
        return struct.unpack_from(layout, data, at)[0], at + struct.calcsize(layout)
    if major == 7:
        return {20: False, 21: True, 22: None, 23: None}[low], at
    n = low
    if low in (24, 25, 26, 27):
        size = 1 << (low - 24)
        if at + size > len(data):
            raise InvalidMetadata("the metadata ends early")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    endless = low == 31
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3) and not endless:
        raw = data[at : at + n]
        if len(raw) < n:
            raise InvalidMetadata("the metadata ends early")
        return (raw if major == 2 else raw.decode()), at + n
    if major == 6:
        return _item(data, at)
    items, want = [], None if endless else n * (2 if major == 5 else 1)
    while want is None or len(items) < want:
        if want is None and data[at : at + 1] == b"\xff":
            at += 1
            break
        x, at = _item(data, at)
        items.append(x)
    if major == 5:
        return dict(zip(items[::2], items[1::2], strict=True)), at
    return (items if major == 4 else (b"" if major == 2 else "").join(items)), at


def definitions(spark: SparkSession, source: str | bytes) -> tuple[DataFrame, dict]:
    """Validated definitions out of TOML text or CBOR bytes, and the rest of the metadata (notes and the like)."""
    try:
        held = cbor(source) if isinstance(source, bytes) else tomllib.loads(source)
    except tomllib.TOMLDecodeError as e:
        raise InvalidMetadata(str(e)) from e
    if not isinstance(held, dict):
        raise InvalidMetadata("metadata is a table")
    rows = [(e.get("name", ""), e.get("start_id"), e.get("stop_id"), e.get("category"), e.get("value_units"), e.get("latency_compensation_ns", 0)) for e in held.get("event", [])]
    return validated(spark.createDataFrame(rows, EVENT_DEFS)), {k: v for k, v in held.items() if k != "event"}


def cbor_bytes(value: object) -> bytes:
    """An item of CBOR; what is None within a map is left out, as an absent field is."""

    def head(major: int, n: int) -> bytes:
        for low, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
            if n < 24:
                return bytes([major << 5 | n])
            if n < 1 << (8 * size):
                return bytes([major << 5 | low]) + n.to_bytes(size, "big")
        raise InvalidMetadata(f"{n} is beyond 64 bits")

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (str, bytes)):
        raw = value.encode() if isinstance(value, str) else value
        return head(3 if isinstance(value, str) else 2, len(raw)) + raw
    if isinstance(value, dict):
        held = [(k, v) for k, v in value.items() if v is not None]
        return head(5, len(held)) + b"".join(cbor_bytes(k) + cbor_bytes(v) for k, v in held)
    return head(4, len(value)) + b"".join(map(cbor_bytes, value))


def stored_columns(contents: list[bytes]) -> list[pa.Array]:
    """Columns of ``STORED`` after capture_id. A definition without a latency has 0; a notes' value that is no text, its text."""
    held = [cbor(c) for c in contents]
    if not all(isinstance(h, dict) for h in held):
        raise InvalidMetadata("metadata is a table")
    events = [[{"latency_compensation_ns": 0} | {k: e.get(k) for k in ("name", "start_id", "stop_id", "category", "value_units")} | ({"latency_compensation_ns": e["latency_compensation_ns"]} if e.get("latency_compensation_ns") else {}) for e in h.get("event", [])] for h in held]
    notes = [sorted((str(k), str(v)) for k, v in h.get("notes", {}).items()) for h in held]
    return [
        pa.array(events, EVENT_TYPE), pa.array(notes, pa.map_(pa.string(), pa.string())), *(pa.array([h.get(c) for h in held], pa.string()) for c in TEXTS),
        pa.array([h.get("clock_fit") for h in held], FIT_TYPE), pa.array([h.get("assumed_supply_uv") for h in held], pa.int64()),
    ]


def encoded(rows: DataFrame) -> DataFrame:
    """capture_id and metadata (CBOR) of rows with columns of ``STORED``; columns that are not there are absent fields."""
    known = [c for c in ("event", "notes", *TEXTS, "clock_fit", "assumed_supply_uv") if c in rows.columns]

    def work(it):
        for b in it:
            out = []
            for r in b.to_pylist():
                fields = {c: dict(r[c]) if c == "notes" and r[c] is not None else r[c] for c in known}
                fields["event"] = [{k: v for k, v in e.items() if k != "latency_compensation_ns" or v} for e in fields.get("event") or []]
                out.append(cbor_bytes(fields))
            yield pa.record_batch([b.column("capture_id"), pa.array(out, pa.binary())], ["capture_id", "metadata"])

    return rows.select("capture_id", *known).mapInArrow(work, "capture_id string, metadata binary")


def capture_definitions(stored: DataFrame) -> DataFrame:
    """Definitions by capture, each once, out of stored metadata: two captures may use one id for different names."""
    return stored.select("capture_id", F.explode("event").alias("e")).select("capture_id", "e.*").distinct()
