"""Frames of the device protocol, out of landed chunks of bytes and into DataFrames.

Chunks may cut frames anywhere. Every chunk is split at its delimiters by itself, once; only what lies before its first and
after its last delimiter is joined with its neighbours: within slices of a device's chunks, and over slices where a region
goes on beyond one. No task reads a device's whole stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joulegrid.shared import stored

#: Fixed values of the protocol, version 1.0.
MAX_PAYLOAD, MAX_FRAME, MAX_ENCODED = 1024, 1032, 1038
TYPES = {
    "HELLO": 0x01,
    "DEVICE_INFO": 0x02,
    "CONFIG": 0x03,
    "START_CAPTURE": 0x05,
    "STOP_CAPTURE": 0x06,
    "CURRENT_SAMPLES": 0x10,
    "EVENT": 0x11,
    "GPIO_EVENT": 0x12,
    "SYNC": 0x13,
    "MARKER": 0x14,
    "ERROR": 0x7F,
}
#: Sizes of the payloads that have one.
SIZES = {0x01: 8, 0x02: 72, 0x03: 24, 0x05: 0, 0x06: 0, 0x13: 16, 0x14: 12, 0x7F: 16}
EXPLICIT_TS, NO_VOLTAGE, OVERFLOW_BEFORE, DELTA16 = 1, 2, 4, 8

#: DEVICE_INFO: its layout, and its whole-number fields in order.
DEVICE = struct.Struct("<IHH16s16sQIIiIHHHH")
DEVICE_FIELDS = ("magic", "proto_version", "device_type", "timer_hz", "max_sample_rate_hz", "shunt_micro_ohm", "adc_full_scale_ua", "channel_count", "gpio_count", "caps")

#: A region is numbered within its chunk, of which it takes two bytes at least; a chunk has 2 GiB at most.
REGIONS = 1 << 30
MOST_CHUNKS = 1 << 33

#: So many frames are unpacked together.
FRAMES_AT_ONCE = 2048

FRAMES = "device string, arrival long, status string, type int, seq int, payload binary"


def arrival_of(chunk: int, region: int) -> int:
    """A region's place in a device's line: chunks in order, regions in order within them."""
    if not 0 <= chunk < MOST_CHUNKS:
        raise ValueError(f"chunks are numbered from 0 to {MOST_CHUNKS - 1}, not {chunk}")
    return chunk * REGIONS + region


def cobs_encode(data: bytes) -> bytes:
    """Each zero gives way to the distance to the next; runs of 254 bytes without one get a distance of their own."""
    out = bytearray()
    for part in data.split(b"\0"):
        while len(part) >= 254:
            out += b"\xff" + part[:254]
            part = part[254:]
        out += bytes([len(part) + 1]) + part
    return bytes(out)


def cobs_decode(data: bytes) -> bytes | None:
    """The bytes, or None if a distance leads beyond the end or to a zero."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n == 0 or at + n > len(data):
            return None
        out += data[at + 1 : at + n]
        at += n
        if n < 255 and at < len(data):
            out.append(0)
    return bytes(out)


def frame(kind: int, seq: int, payload: bytes) -> bytes:
    """An encoded frame with its delimiter."""
    body = struct.pack("<BHB", kind, len(payload), seq & 0xFF) + payload
    return cobs_encode(body + struct.pack("<I", zlib.crc32(body))) + b"\0"


def well_formed(kind: int, payload: bytes) -> bool:
    """Whether a known type's payload has a size that its own counts allow; unknown types always do."""
    n = len(payload)
    if kind in SIZES:
        return n == SIZES[kind]
    if kind == TYPES["CURRENT_SAMPLES"]:
        if n < 12:
            return False
        count, flags = struct.unpack_from("<HH", payload, 8)
        return not flags & DELTA16 and n == 12 + count * ((8 if not flags & NO_VOLTAGE else 4) + (4 if flags & EXPLICIT_TS else 0))
    if kind == TYPES["EVENT"]:
        if n < 4:
            return False
        count, size = struct.unpack_from("<HH", payload)
        return size in (6, 10) and n == 4 + count * size
    if kind == TYPES["GPIO_EVENT"]:
        return n >= 4 and n == 4 + 6 * struct.unpack_from("<H", payload)[0]
    return True


def opened(region: bytes) -> tuple[str, int | None, int | None, bytes | None]:
    """(status, type, seq, payload) of a delimited region: ok, or why it is refused."""
    if len(region) > MAX_ENCODED:
        return "oversize", None, None, None
    plain = cobs_decode(region)
    if plain is None:
        return "cobs", None, None, None
    if len(plain) < 8 or len(plain) > MAX_FRAME:
        return "length", None, None, None
    kind, size, seq = struct.unpack_from("<BHB", plain)
    if size > MAX_PAYLOAD or size + 8 != len(plain):
        return "length", kind, seq, None
    if zlib.crc32(plain[:-4]) != struct.unpack("<I", plain[-4:])[0]:
        return "crc", kind, seq, None
    payload = plain[4:-4]
    return ("ok" if well_formed(kind, payload) else "payload"), kind, seq, payload


def regions(chunks: DataFrame, slice_chunks: int = 1 << 16) -> DataFrame:
    """device, arrival (long, increasing), bytes: what lies between delimiters, out of (device, chunk, bytes) rows.

    Empty regions are idle line and left out, and so is what follows the last delimiter. A region over MAX_ENCODED is
    kept as its first bytes only, which is enough to refuse it, so that no line without delimiters fills a task.
    Chunks are read and split once, and what they hold is stored. A region is put together where ``slice_chunks`` chunks
    of a device are; two rows of a slice, what ends and what begins a region elsewhere, are joined by device.
    """

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for device, chunk, data in zip(*(b.column(c).to_pylist() for c in ("device", "chunk", "bytes")), strict=True):
                parts = (data or b"").split(b"\0")
                head, tail = parts[0], parts[-1]
                whole = len(parts) > 1
                rows.append((device, chunk, whole, head[: MAX_ENCODED + 1], tail[: MAX_ENCODED + 1] if whole else b"", [p[: MAX_ENCODED + 1] for p in parts[1:-1]]))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            types = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["device", "chunk", "whole", "head", "tail", "inner"])

    wrong = F.raise_error(F.concat(F.lit(f"chunks are numbered from 0 to {MOST_CHUNKS - 1}, not "), F.col("chunk").cast("string"))).cast("bigint")
    number = F.when((F.col("chunk") >= 0) & (F.col("chunk") < MOST_CHUNKS), F.col("chunk")).otherwise(wrong)
    parts = stored(chunks.select("device", number.alias("chunk"), "bytes").mapInArrow(split, "device string, chunk long, whole boolean, head binary, tail binary, inner array<binary>"))
    sliced = parts.select("device", F.floor(F.col("chunk") / F.lit(slice_chunks)).alias("slice"), "chunk", "whole", "head", "tail")
    opens = F.sum(F.col("whole").cast("bigint")).over(W.partitionBy("device", "slice").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0))
    piece = lambda group, place, part, ends: F.struct(group.alias("group"), place.alias("place"), F.col(part).alias("part"), F.lit(ends).alias("ends"))
    # A chunk's head ends the group that was open before it; a chunk with a delimiter opens the next with its tail.
    line, chunk = F.col("opens"), F.col("chunk")
    both = F.array(piece(line - 1, 2 * chunk, "head", True), piece(line, 2 * chunk + 1, "tail", False))
    cut = sliced.withColumn("opens", opens).select("device", "slice", F.explode(F.when(F.col("whole"), both).otherwise(F.array(piece(line, 2 * chunk, "head", False)))).alias("p"))
    groups = _together(cut.select("device", "slice", "p.*"), ("device", "slice", "group"))
    # A slice's group 0 began in an earlier one, and a group without an end goes on in a later one.
    across = (F.col("group") == 0) | F.col("end").isNull()
    closed = F.sum(F.col("end").isNotNull().cast("bigint")).over(W.partitionBy("device").orderBy("slice", "group").rowsBetween(W.unboundedPreceding, -1))
    edges = groups.where(across).select("device", F.coalesce(closed, F.lit(0)).alias("group"), F.coalesce("end", "place").alias("place"), F.col("bytes").alias("part"), F.col("end").isNotNull().alias("ends"))
    ended = groups.where(~across).select("device", "end", "bytes").unionByName(_together(edges, ("device", "group")).where(F.col("end").isNotNull()).select("device", "end", "bytes"))
    stitched = ended.select("device", (F.shiftright("end", 1) * REGIONS).alias("arrival"), "bytes")
    inner = parts.select("device", "chunk", F.posexplode("inner").alias("k", "bytes")).select("device", (F.col("chunk") * REGIONS + F.col("k") + 1).alias("arrival"), "bytes")
    return stitched.unionByName(inner).where(F.length("bytes") > 0)


def _together(pieces: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pieces of each group put together in order of ``place``: its last place, its ``end`` (null if open) and its bytes.

    Pieces that begin beyond MAX_ENCODED bytes are dropped.
    """
    before = F.coalesce(F.sum(F.length("part")).over(W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    useful = pieces.withColumn("before", before).where((F.col("before") <= MAX_ENCODED) & (F.length("part") > 0) | F.col("ends"))
    kept = F.when((F.col("before") <= MAX_ENCODED) & (F.length("part") > 0), F.struct("place", "part"))
    joined = useful.groupBy(*keys).agg(F.max("place").alias("place"), F.max(F.when(F.col("ends"), F.col("place"))).alias("end"), F.array_sort(F.collect_list(kept)).alias("parts"))
    return joined.select(*keys, "place", "end", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["part"])), "")).alias("bytes"))


def frames(chunks: DataFrame) -> DataFrame:
    """Every region with its status; refused ones stay, so that losses can be counted."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [opened(x) for x in b.column("bytes").to_pylist()]
            columns = zip(*out, strict=True) if out else [()] * 4
            types = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([b.column("device"), b.column("arrival"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["device", "arrival", "status", "type", "seq", "payload"])

    return regions(chunks).mapInArrow(work, FRAMES)


def counters(decoded: DataFrame, slice_arrivals: int = REGIONS << 10) -> DataFrame:
    """By device: frames, refusals by kind, sequence gaps, and resyncs (a good frame right after a refused region).

    A frame whose payload alone is malformed still counts for the sequence. Frames are read once: they are counted by slice
    of a device's line, and what a slice's first frame is to the last one before it is added from a row of each slice.
    """
    seq = F.when(F.col("status").isin("ok", "payload"), F.col("seq"))
    rows = decoded.select("device", "arrival", "status", seq.alias("seq"), F.floor(F.col("arrival") / F.lit(slice_arrivals)).alias("slice"))
    here, slices = W.partitionBy("device", "slice").orderBy("arrival"), W.partitionBy("device").orderBy("slice")
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    resync = lambda before, now: (F.col(before) != "ok") & (F.col(now) == "ok")
    gap = lambda before, now: F.col(now) != (F.col(before) + 1) % 256
    pairs = rows.withColumn("status_before", F.lag("status").over(here)).withColumn("seq_before", F.last("seq", True).over(earlier(here)))
    place = F.when(F.col("seq").isNotNull(), F.col("arrival"))
    counts = {"frames": F.col("status") == "ok"} | {f"{s}_errors": F.col("status") == s for s in ("cobs", "length", "crc", "payload")} | {"oversize": F.col("status") == "oversize"}
    of_slice = pairs.groupBy("device", "slice").agg(
        *(F.count_if(c).alias(name) for name, c in counts.items()), F.count_if(resync("status_before", "status")).alias("resyncs"), F.count_if(gap("seq_before", "seq")).alias("seq_gaps"),
        F.min_by("status", "arrival").alias("status"), F.max_by("status", "arrival").alias("last_status"), F.min_by("seq", place).alias("seq"), F.max_by("seq", place).alias("last_seq"),
    )
    edges = of_slice.withColumn("status_before", F.lag("last_status").over(slices)).withColumn("seq_before", F.last("last_seq", True).over(earlier(slices)))
    added = {"resyncs": resync("status_before", "status"), "seq_gaps": gap("seq_before", "seq")}
    total = lambda name, c: (F.sum(name) + F.count_if(c)).alias(name)
    return edges.groupBy("device").agg(*(F.sum(name).alias(name) for name in counts), *(total(name, c) for name, c in added.items()))


def unpacked(decoded: DataFrame, kind: str, unpack, schema: str) -> DataFrame:
    """Records of all good frames of a type: device, arrival, and what ``unpack(payloads)`` gives as columns.

    ``unpack`` takes the payloads of a batch together: it returns how many records each of them has, and columns of all
    records in order. Frames are small, and an array for each of them would take many times their bytes.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(a, FRAMES_AT_ONCE) for whole in it for a in range(0, whole.num_rows, FRAMES_AT_ONCE)):
            counts, columns = unpack(b.column("payload").to_pylist())
            frame = np.repeat(np.arange(b.num_rows), counts)
            record = (np.arange(len(frame)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            arrays = {"device": b.column("device").take(pa.array(frame)), "arrival": b.column("arrival").take(pa.array(frame)), "record": pa.array(record)}
            arrays |= {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
            yield pa.record_batch(list(arrays.values()), list(arrays))

    chosen = decoded.where((F.col("status") == "ok") & (F.col("type") == TYPES[kind])).select("device", "arrival", "payload")
    return chosen.mapInArrow(work, f"device string, arrival long, record int, {schema}")


def laid_out(payloads: list[bytes], size: int, counts: np.ndarray, layouts: np.ndarray, types: dict[int, list[tuple[str, str]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Fields of all records of payloads, after their first ``size`` bytes: values, and which records have the field.

    ``types`` has the fields of each layout that ``layouts`` names; each layout's records are read together.
    """
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    lengths = np.array([len(p) for p in payloads], np.int64)
    starts = np.cumsum(lengths) - lengths + size
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    out = {name: (np.zeros(n, np.int64), np.zeros(n, bool)) for fields in types.values() for name, _ in fields}
    for layout, fields in types.items():
        some = np.flatnonzero(layouts == layout)
        of = counts[some]
        within = np.arange(int(of.sum())) - np.repeat(np.cumsum(of) - of, of)
        dtype = np.dtype(fields)
        place = np.repeat(starts[some], of) + within * dtype.itemsize
        rows = np.ascontiguousarray(raw[place[:, None] + np.arange(dtype.itemsize)]).reshape(-1).view(dtype)
        at = np.repeat(first[some], of) + within
        for name, _ in fields:
            values, known = out[name]
            values[at], known[at] = rows[name], True
    return out


def heads(payloads: list[bytes], dtype: np.dtype) -> np.ndarray:
    """The fields at the beginning of each payload."""
    return np.frombuffer(b"".join(p[: dtype.itemsize] for p in payloads), dtype)


SAMPLES_HEAD = np.dtype([("t0", "<u4"), ("period", "<u4"), ("count", "<u2"), ("flags", "<u2")])
RECORDS_HEAD = np.dtype([("count", "<u2"), ("size", "<u2")])


def sample_records(payloads: list[bytes]) -> tuple[np.ndarray, dict]:
    """Samples of many blocks."""
    head = heads(payloads, SAMPLES_HEAD)
    counts, flags = head["count"].astype(np.int64), head["flags"]
    types = {f: [*([("t", "<u4")] if f & EXPLICIT_TS else []), ("i", "<i4"), *([] if f & NO_VOLTAGE else [("v", "<u4")])] for f in range(4)}
    found = laid_out(payloads, 12, counts, flags & (EXPLICIT_TS | NO_VOLTAGE), types)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    counted = (np.repeat(head["t0"].astype(np.int64), counts) + within * np.repeat(head["period"].astype(np.int64), counts)) % (1 << 32)
    (t, told), (i, _), (v, known) = (found[x] for x in "tiv")
    overflow = (within == 0) & np.repeat((flags & OVERFLOW_BEFORE) != 0, counts)
    return counts, {"ticks": np.where(told, t, counted), "current_ua": i.astype(np.int32), "voltage_uv": pa.array(v, mask=~known), "overflow_before": overflow}


def event_records(payloads: list[bytes]) -> tuple[np.ndarray, dict]:
    """Events of many frames."""
    head = heads(payloads, RECORDS_HEAD)
    counts = head["count"].astype(np.int64)
    plain = [("t", "<u4"), ("id", "<u2")]
    found = laid_out(payloads, 4, counts, head["size"], {6: plain, 10: [*plain, ("v", "<u4")]})
    value, known = found["v"]
    return counts, {"ticks": found["t"][0], "id": found["id"][0].astype(np.int32), "value": pa.array(value, mask=~known)}


def gpio_records(payloads: list[bytes]) -> tuple[np.ndarray, dict]:
    """Pin snapshots of many frames."""
    counts = heads(payloads, RECORDS_HEAD)["count"].astype(np.int64)
    found = laid_out(payloads, 4, counts, np.zeros(len(payloads)), {0: [("t", "<u4"), ("s", "<u2")]})
    return counts, {"ticks": found["t"][0], "state": found["s"][0].astype(np.int32)}


def _samples(payload: bytes) -> dict:
    t0, period, count, flags = struct.unpack_from("<IIHH", payload)
    names = [*(["t"] if flags & EXPLICIT_TS else []), "i", *([] if flags & NO_VOLTAGE else ["v"])]
    rows = np.frombuffer(payload, np.dtype([(x, "<i4" if x == "i" else "<u4") for x in names]), count, 12)
    ticks = rows["t"].astype(np.int64) if "t" in names else (t0 + np.arange(count, dtype=np.int64) * period) % (1 << 32)
    voltage = pa.array(rows["v"].astype(np.int64)) if "v" in names else pa.nulls(count, pa.int64())
    return {"ticks": ticks, "current_ua": rows["i"].astype(np.int32), "voltage_uv": voltage, "overflow_before": np.arange(count) == (0 if flags & OVERFLOW_BEFORE else -1)}


def _events(payload: bytes) -> dict:
    count, size = struct.unpack_from("<HH", payload)
    rows = np.frombuffer(payload, np.dtype([("t", "<u4"), ("id", "<u2"), *([("v", "<u4")] if size == 10 else [])]), count, 4)
    value = pa.array(rows["v"].astype(np.int64)) if size == 10 else pa.nulls(count, pa.int64())
    return {"ticks": rows["t"].astype(np.int64), "id": rows["id"].astype(np.int32), "value": value}


def _gpio(payload: bytes) -> dict:
    rows = np.frombuffer(payload, np.dtype([("t", "<u4"), ("s", "<u2")]), struct.unpack_from("<H", payload)[0], 4)
    return {"ticks": rows["t"].astype(np.int64), "state": rows["s"].astype(np.int32)}


def _fields(layout: str, names: tuple[str, ...]):
    return lambda payload: {n: np.array([v], np.int64) for n, v in zip(names, struct.unpack(layout, payload), strict=True)}


SYNC_FIELDS = _fields("<IHHq", ("ticks", "wrap_count", "flags", "host_time_ns"))
ERROR_FIELDS = _fields("<HHIII", ("code", "detail", "dropped_samples", "buffer_overflows", "context"))


def single(layout: str, names: tuple[str, ...]):
    """Payloads of one record each, all of a size."""

    def unpack(payloads: list[bytes]) -> tuple[np.ndarray, dict]:
        rows = list(struct.iter_unpack(layout, b"".join(payloads)))
        return np.ones(len(rows), np.int64), {n: np.array(v, np.int64) for n, v in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)}

    return unpack


def samples(decoded: DataFrame) -> DataFrame:
    """Samples in device ticks; blocks without voltage have null, not 0, so that an assumed supply applies."""
    return unpacked(decoded, "CURRENT_SAMPLES", sample_records, "ticks long, current_ua int, voltage_uv long, overflow_before boolean")


def events(decoded: DataFrame) -> DataFrame:
    return unpacked(decoded, "EVENT", event_records, "ticks long, id int, value long")


def gpio(decoded: DataFrame) -> DataFrame:
    return unpacked(decoded, "GPIO_EVENT", gpio_records, "ticks long, state int")


def sync(decoded: DataFrame) -> DataFrame:
    return unpacked(decoded, "SYNC", single("<IHHq", ("ticks", "wrap_count", "flags", "host_time_ns")), "ticks long, wrap_count long, flags long, host_time_ns long")


def markers(decoded: DataFrame) -> DataFrame:
    return unpacked(decoded, "MARKER", single("<III", ("ticks", "marker_id", "value")), "ticks long, marker_id long, value long")


def errors(decoded: DataFrame) -> DataFrame:
    return unpacked(decoded, "ERROR", single("<HHIII", ("code", "detail", "dropped_samples", "buffer_overflows", "context")), "code long, detail long, dropped_samples long, buffer_overflows long, context long")


def hellos(decoded: DataFrame) -> DataFrame:
    return unpacked(decoded, "HELLO", single("<HHI", ("proto_version", "nonce", "reserved")), "proto_version long, nonce long, reserved long")


def configs(decoded: DataFrame) -> DataFrame:
    names = ("sample_rate_hz", "averaging", "conv_time_code", "gpio_mask", "shunt_micro_ohm", "flags", "reserved")
    return unpacked(decoded, "CONFIG", single("<IHHIiII", names), ", ".join(f"{n} long" for n in names))


def device_records(payloads: list[bytes]) -> tuple[np.ndarray, dict]:
    """What many devices say of themselves."""
    rows = list(DEVICE.iter_unpack(b"".join(payloads)))
    text = lambda k: pa.array([v[k].split(b"\0")[0].decode("ascii", "ignore") for v in rows], pa.string())
    numbers = {n: np.array([v[k] for v in rows], np.int64) for n, k in zip(DEVICE_FIELDS, (0, 1, 2, *range(6, 13)), strict=True)}
    return np.ones(len(rows), np.int64), numbers | {"serial": text(3), "fw_version": text(4), "fw_build_id": pa.array([str(v[5]) for v in rows], pa.string())}


def device_infos(decoded: DataFrame) -> DataFrame:
    """What devices say of themselves; a build id uses all 64 bits and so is DECIMAL(20,0)."""
    schema = ", ".join(f"{n} long" for n in DEVICE_FIELDS) + ", serial string, fw_version string, fw_build_id string"
    return unpacked(decoded, "DEVICE_INFO", device_records, schema).withColumn("fw_build_id", F.col("fw_build_id").cast("decimal(20,0)"))


def unknown(decoded: DataFrame) -> DataFrame:
    """Good frames of types that this version does not know, with their payloads."""
    return decoded.where((F.col("status") == "ok") & ~F.col("type").isin(*TYPES.values()))


def sample_block(ticks: list[int], current: list[int], voltage: list[int] | None, flags: int = EXPLICIT_TS, period: int = 0) -> bytes:
    """Payload of a block of samples, with explicit times or from ``ticks[0]`` on."""
    flags |= 0 if voltage is not None else NO_VOLTAGE
    columns = [*([np.array(ticks, "<u4")] if flags & EXPLICIT_TS else []), np.array(current, "<i4"), *([np.array(voltage, "<u4")] if voltage is not None else [])]
    rows = np.rec.fromarrays(columns).tobytes() if len(current) else b""
    return struct.pack("<IIHH", ticks[0] if ticks else 0, period, len(current), flags) + rows


def event_block(rows: list[tuple[int, int, int | None]]) -> bytes:
    """Payload of (ticks, id, value) events; ten bytes each if one of them has a value, else six."""
    valued = any(v is not None for _, _, v in rows)
    records = b"".join(struct.pack("<IHI", t, i, v or 0) if valued else struct.pack("<IH", t, i) for t, i, v in rows)
    return struct.pack("<HH", len(rows), 10 if valued else 6) + records


def gpio_block(rows: list[tuple[int, int]]) -> bytes:
    return struct.pack("<HH", len(rows), 0) + b"".join(struct.pack("<IH", t, s) for t, s in rows)


#: How the records of single-record payloads are packed, by type: a function of a row.
PACKERS = {
    "EVENT": lambda r: event_block([(r["ticks"], r["id"], r["value"])]),
    "GPIO_EVENT": lambda r: gpio_block([(r["ticks"], r["state"])]),
    "SYNC": lambda r: struct.pack("<IHHq", r["ticks"], r["wrap_count"], r["flags"], r["host_time_ns"]),
    "MARKER": lambda r: struct.pack("<III", r["ticks"], r["marker_id"], r["value"]),
    "ERROR": lambda r: struct.pack("<HHIII", r["code"], r["detail"], r["dropped_samples"], r["buffer_overflows"], r["context"]),
    "HELLO": lambda r: struct.pack("<HHI", r["proto_version"], r["nonce"], r["reserved"]),
    "CONFIG": lambda r: struct.pack("<IHHIiII", *(r[c] for c in ("sample_rate_hz", "averaging", "conv_time_code", "gpio_mask", "shunt_micro_ohm", "flags", "reserved"))),
    "DEVICE_INFO": lambda r: DEVICE.pack(*(r[c] for c in DEVICE_FIELDS[:3]), r["serial"].encode()[:16], r["fw_version"].encode()[:16], r["fw_build_id"], *(r[c] for c in DEVICE_FIELDS[3:]), 0),
}


def packed(kind: str, row: dict) -> bytes:
    """The payload of one record."""
    return PACKERS[kind](row)


def encoded_records(rows: DataFrame, kind: str) -> DataFrame:
    """device, chunk, bytes: a frame of a type for each (device, chunk, ...) row."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [frame(TYPES[kind], r["chunk"], packed(kind, r)) for r in b.to_pylist()]
            yield pa.record_batch([b.column("device"), b.column("chunk"), pa.array(out, pa.binary())], ["device", "chunk", "bytes"])

    return rows.withColumn("chunk", F.col("chunk").cast("bigint")).mapInArrow(work, "device string, chunk long, bytes binary")


def encoded_samples(rows: DataFrame, block: int = 64) -> DataFrame:
    """device, chunk, bytes: frames of up to ``block`` samples out of (device, n, ticks, current_ua, voltage_uv) rows."""
    held = rows.groupBy("device", F.floor(F.col("n") / block).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", "ticks", "current_ua", "voltage_uv"))).alias("rows"))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = b.column("rows").flatten()
            ticks, current, voltage = (rows.field(c) for c in ("ticks", "current_ua", "voltage_uv"))
            records = np.empty(len(rows), np.dtype([("t", "<u4"), ("i", "<i4"), ("v", "<u4")]))
            if rows.null_count or ticks.null_count or current.null_count or voltage.null_count:
                raise ValueError("a sample without its ticks, current or voltage is in no block")
            for name, values in (("t", ticks.cast(pa.uint32())), ("i", current.cast(pa.int32())), ("v", voltage.cast(pa.uint32()))):
                records[name] = values.to_numpy()
            raw, size, first = records.tobytes(), records.dtype.itemsize, 0
            out = []
            for chunk, n in zip(b.column("chunk").to_pylist(), b.column("rows").value_lengths().to_pylist(), strict=True):
                head = struct.pack("<IIHH", int(records["t"][first]), 0, n, EXPLICIT_TS)
                out.append(frame(TYPES["CURRENT_SAMPLES"], chunk, head + raw[first * size : (first + n) * size]))
                first += n
            yield pa.record_batch([b.column("device"), b.column("chunk"), pa.array(out, pa.binary())], ["device", "chunk", "bytes"])

    return held.mapInArrow(work, "device string, chunk long, bytes binary")
