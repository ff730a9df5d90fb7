"""Capture files as a Spark data source: ``spark.read.format("powercapture").option("kind", "samples").load(path)``.

The driver lists files, a folder at a time; tasks read headers and indexes, and check and decode chunks. Small files share
a partition; of a large one the driver reads the index, and its chunks are dealt to several partitions. A file without a
valid index is walked chunk by chunk up to the first that is not valid.
"""

from __future__ import annotations

import json
import pickle
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from joulegrid.sources.metadata import STORED, InvalidMetadata, stored_columns

#: Fixed values of the format, version 1.
HEADER_LEN, CHUNK_LEN, FOOTER_LEN, ENTRY_LEN = 128, 40, 32, 32
KINDS = {
    "samples": 0x0001,
    "events": 0x0002,
    "gpio": 0x0003,
    "markers": 0x0004,
    "sync": 0x0005,
    "metadata": 0x0010,
    "annotations": 0x0011,
    "summary": 0x0020,
    "index": 0x00F0,
    "end": 0x00FF,
}
FINALIZED, HAS_VOLTAGE, HAS_GPIO, HAS_EVENTS, SYNTHETIC = 1, 2, 4, 8, 16
UNIFORM, VOLTAGE, CURRENT_DELTA = 1, 2, 4
NO_TIME = 2**64 - 1
HEADER = struct.Struct("<8sHHIQQIIII16s16sQiiIIQIQ")
CHUNK = struct.Struct("<4sHHIIQQI")
ENTRY = struct.Struct("<HHQIIQI")

SCHEMAS = {
    "samples": "capture_id string, seq long, t_ns long, current_ua int, voltage_uv long",
    "events": "capture_id string, seq long, t_ns long, id int, value long",
    "gpio": "capture_id string, seq long, t_ns long, state int",
    "sync": "capture_id string, host_send_ns long, host_recv_ns long, device_ticks long",
    "metadata": STORED,
    "summary": "capture_id string, level_ns long, t_ns long, min_ua int, max_ua int, mean_ua double, count long",
    "chunks": "capture_id string, place long, kind int, stored long, plain long, records long, first_ns long, last_ns long, status string",
    "captures": "capture_id string, finalized boolean, recovered boolean, truncated_at long, device_timer_hz long, sample_rate_hz long, flags long, compression string, device_serial string, fw_version string, shunt_micro_ohm int, current_offset_ua int, current_gain_num long, current_gain_den long",
}
COMPRESSIONS = ("none", "zstd", "lz4")
#: Rows of small chunks that go to Spark together.
BATCH_ROWS = 1 << 16
#: So many chunks at most are held for a batch, as the arrays of a chunk of a row or two are far larger than these.
BATCH_CHUNKS = 1 << 10
#: Files up to this size are read at once.
WHOLE = 1 << 20


@cache
def compressor() -> zstandard.ZstdCompressor:
    """One of a worker: chunks may be small, and a context of their own would cost more than they do."""
    return zstandard.ZstdCompressor(level=3)


@cache
def decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


class InvalidCapture(ValueError):
    """Not a capture file, or one of another major version."""


def ascii_field(raw: bytes) -> str:
    """Text up to the first NUL or non-ASCII byte."""
    end = next((k for k, b in enumerate(raw) if b == 0 or b > 127), len(raw))
    return raw[:end].decode("ascii")


def read_header(raw: bytes) -> dict:
    if len(raw) < HEADER_LEN or raw[:8] != b"PPROFCAP":
        raise InvalidCapture("not a capture file")
    names = ("magic", "major", "minor", "length", "created", "mono", "timer_hz", "rate_hz", "flags", "compression", "serial", "firmware", "build", "shunt", "offset", "num", "den", "footer", "chunk_bytes", "reserved")
    h = dict(zip(names, HEADER.unpack(raw[: HEADER.size]), strict=True))
    if zlib.crc32(raw[:124]) != struct.unpack_from("<I", raw, 124)[0]:
        raise InvalidCapture("the header's checksum does not match")
    if h["major"] != 1:
        raise InvalidCapture(f"version {h['major']} of the format is not known")
    return h


def read_chunk_header(raw: bytes) -> tuple | None:
    """(kind, flags, length, stored, first, last, crc), or None if these bytes are no chunk."""
    if len(raw) < CHUNK_LEN or raw[:4] != b"CHNK" or zlib.crc32(raw[:36]) != struct.unpack_from("<I", raw, 36)[0]:
        return None
    return CHUNK.unpack(raw[: CHUNK.size])[1:]


def open_file(path: str):
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return fs.open_input_file(name)


def files(path: str) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """A path and all folders below it, and paths and sizes of the capture files that lie right in each."""
    uri = path if "://" in path else "file://" + path
    fs, name = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(name)
    if info.type != pafs.FileType.Directory:
        yield uri, [(uri, info.size or 0)]
        return
    scheme, ahead = uri[: len(uri) - len(name)], [name]
    while ahead:
        found = fs.get_file_info(pafs.FileSelector(folder := ahead.pop()))
        ahead += sorted((x.path for x in found if x.type == pafs.FileType.Directory and x.base_name != ZONES), reverse=True)
        yield scheme + folder, sorted((scheme + x.path, x.size) for x in found if x.type != pafs.FileType.Directory and x.path.endswith(".pprof"))


def zones_of(path: str) -> dict[tuple[str, int], dict]:
    """Times that files have rows of, by name and size, as the sink has noted them; nothing where it has not."""
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{name}/{ZONES}", allow_not_found=True)):
        if info.base_name.endswith(".jsonl"):
            with fs.open_input_stream(info.path, compression=None) as f:
                for line in f.read().splitlines():
                    zone = json.loads(line)
                    out[zone["file"], zone["size"]] = zone["times"]
    return out


def places(source, header: dict) -> tuple[list[tuple], bool, int | None]:
    """(place, kind, stored, records) of all chunks; whether they were recovered by a walk; where that stopped early."""
    size = source.size()
    if header["flags"] & FINALIZED and header["footer"] == size - FOOTER_LEN and size >= HEADER_LEN + FOOTER_LEN:
        source.seek(size - FOOTER_LEN)
        raw = source.read(FOOTER_LEN)
        at, _, _, crc, magic = struct.unpack("<QQQI4s", raw)
        if magic == b"PEND" and zlib.crc32(raw[:24]) == crc:
            payload = chunk_at(source, at, header["compression"])[1]
            if payload is not None and len(payload) >= 8 and len(payload) >= 8 + ENTRY_LEN * (n := struct.unpack_from("<I", payload)[0]):
                entries = [ENTRY.unpack_from(payload, 8 + ENTRY_LEN * k) for k in range(n)]
                return [(e[2], e[0], e[3], e[4]) for e in entries], False, None
    found, at = [], HEADER_LEN
    while at < size:
        source.seek(at)
        head = read_chunk_header(source.read(CHUNK_LEN))
        if head is None or at + CHUNK_LEN + head[3] > size:
            break
        found.append((at, head[0], head[3], 0))
        at += CHUNK_LEN + head[3]
    return found, True, at if at < size else None


def chunk_at(source, at: int, compression: int) -> tuple[tuple | None, bytes | None]:
    """A chunk's header and content; the content is None where it is damaged."""
    source.seek(at)
    head = read_chunk_header(source.read(CHUNK_LEN))
    if head is None:
        return None, None
    raw = source.read(head[3])
    if len(raw) != head[3] or zlib.crc32(raw) != head[6]:
        return head, None
    try:
        if head[1] & 1:
            if compression == 2:
                raw = pa.decompress(raw[4:], struct.unpack_from("<I", raw)[0], "lz4_raw", asbytes=True)
            else:
                raw = decompressor().decompress(raw, max_output_size=max(1, head[2]))
    except (zstandard.ZstdError, pa.ArrowException, OSError):
        return head, None
    return head, raw if len(raw) == head[2] else None


def sample_columns(b: bytes) -> list[np.ndarray | None] | None:
    """Times, currents and voltages (None without) of a samples chunk; None where the layout is unknown or too short."""
    if len(b) < 24:
        return None
    count, flags, t0, period = struct.unpack_from("<IIQI", b)
    need = 24 + 4 * count * (1 + (not flags & UNIFORM) + bool(flags & VOLTAGE))
    if flags & CURRENT_DELTA or len(b) < need:
        return None
    at = 24
    if flags & UNIFORM:
        t = t0 + np.arange(count, dtype=np.int64) * period
    else:
        t = t0 + np.cumsum(np.frombuffer(b, "<u4", count, at).astype(np.int64))
        at += 4 * count
    i = np.frombuffer(b, "<i4", count, at)
    v = np.frombuffer(b, "<u4", count, at + 4 * count).astype(np.int64) if flags & VOLTAGE else None
    return [t, i, v]


ROWS = {
    "events": np.dtype([("t", "<u8"), ("id", "<u2"), ("flags", "<u2"), ("value", "<u4")]),
    "gpio": np.dtype([("t", "<u8"), ("state", "<u2"), ("pad", "<u2")]),
    "sync": np.dtype([("send", "<u8"), ("recv", "<u8"), ("ticks", "<u8")]),
}
BUCKET = np.dtype([("t", "<u8"), ("min", "<i4"), ("max", "<i4"), ("mean", "<f8"), ("count", "<u4"), ("pad", "<u4")])
#: Kinds of which the folder's zones tell the times, and where these lie.
TIMED, ZONES = ("samples", "events", "gpio"), "_zones"
#: Kinds whose rows have no number of their own.
UNNUMBERED = ("sync", "metadata", "summary")


def summary_columns(b: bytes) -> list[pa.Array] | None:
    """level_ns and the figures of all buckets of a summary chunk that hold samples; None where it is too short."""
    if len(b) < 8:
        return None
    at, levels, found = 8, struct.unpack_from("<I", b)[0], []
    for _ in range(levels):
        if len(b) < at + 16:
            return None
        width, n = struct.unpack_from("<QI", b, at)
        at += 16
        if len(b) < at + n * BUCKET.itemsize:
            return None
        rows = np.frombuffer(b, BUCKET, n, at)
        rows = rows[rows["count"] > 0]
        found.append((np.full(len(rows), width, np.int64), rows))
        at += n * BUCKET.itemsize
    if not found:
        return None
    rows = np.concatenate([r for _, r in found])
    return [pa.array(np.concatenate([w for w, _ in found])), pa.array(rows["t"].astype(np.int64)), pa.array(rows["min"].astype(np.int32)), pa.array(rows["max"].astype(np.int32)), pa.array(rows["mean"].astype(np.float64)), pa.array(rows["count"].astype(np.int64))]


def summary_content(t: np.ndarray, i: np.ndarray, widths: tuple[int, ...]) -> bytes:
    """Buckets of each width of samples in order, from the first that holds one to the last.

    A capture that begins at 0 has all buckets from there on, the empty ones too; where that would be many more than
    hold samples, empty ones are left out, as every bucket tells its time.
    """
    out = [struct.pack("<II", len(widths), 0)]
    for width in widths:
        at = t // width
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(t) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(t)))
        rows = np.zeros(len(starts), BUCKET)
        if len(starts):
            rows["t"], rows["count"] = at[starts] * width, count
            rows["min"], rows["max"] = np.minimum.reduceat(i, starts), np.maximum.reduceat(i, starts)
            rows["mean"] = np.add.reduceat(i.astype(np.int64), starts) / count
            last = int(at[-1]) + 1
            if last <= 4 * len(starts) + 1024:
                dense = np.zeros(last, BUCKET)
                dense["t"] = np.arange(last) * width
                dense[at[starts]] = rows
                rows = dense
        out += [struct.pack("<QII", width, len(rows), 0), rows.tobytes()]
    return b"".join(out)


def decoded(kind: str, b: bytes) -> list[pa.Array] | None:
    """Columns after capture_id and seq (which some kinds have not); None where the content is not what it should be."""
    if kind == "metadata":
        try:
            return stored_columns([b])
        except (InvalidMetadata, AttributeError, KeyError, OverflowError, TypeError, ValueError, pa.ArrowException):
            return None
    if kind == "summary":
        return summary_columns(b)
    if kind == "samples":
        columns = sample_columns(b)
        if columns is None:
            return None
        t, i, v = columns
        return [pa.array(t), pa.array(i.astype(np.int32)), pa.nulls(len(t), pa.int64()) if v is None else pa.array(v)]
    n = struct.unpack_from("<I", b)[0] if len(b) >= 8 else 0
    if len(b) < 8 + n * ROWS[kind].itemsize:
        return None
    rows = np.frombuffer(b, ROWS[kind], n, 8)
    whole = lambda c: pa.array(rows[c].astype(np.int64))
    if kind == "events":
        return [whole("t"), pa.array(rows["id"].astype(np.int32)), pa.array(rows["value"].astype(np.int64), mask=(rows["flags"] & 1) == 0)]
    if kind == "gpio":
        return [whole("t"), pa.array(rows["state"].astype(np.int32))]
    return [whole("send"), whole("recv"), whole("ticks")]


class Chunks(InputPartition):
    """Chunks of one or more files: (path, entries) of each; no entries stands for the whole file.

    They are packed, as the driver holds those of all files at once: paths that are much alike take a few bytes each.
    """

    def __init__(self, parts: list[tuple]):
        self.packed = zlib.compress(pickle.dumps(parts))

    @property
    def parts(self) -> list[tuple]:
        return pickle.loads(zlib.decompress(self.packed))


class CaptureReader(DataSourceReader):
    """It goes to every task, so it holds no list of files."""

    def __init__(self, options: dict):
        self.kind = options.get("kind", "samples")
        self.folder = options["path"]
        self.per_partition = int(options.get("bytesPerPartition", str(32 << 20)))
        self.low, self.high = 0, 2**63 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on t_ns let whole chunks be left out before they are decompressed; Spark still applies them to rows."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("t_ns",):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, int(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, int(f.value))
            yield f

    def wanted(self, source) -> tuple[dict, list[tuple]]:
        """A file's header, and what to read of it: numbered chunks of the kind, or its one row."""
        header = read_header(source.read(HEADER_LEN))
        entries, recovered, stopped = places(source, header)
        if self.kind == "captures":
            return header, [(recovered, stopped)]
        return header, [(k, *e) for k, e in enumerate(e for e in entries if self.kind == "chunks" or e[1] == KINDS[self.kind])]

    def met(self) -> Iterator[tuple[str, int]]:
        """Files that may have rows within the bounds. One that no zone knows, or knows in another size, always may."""
        bounded = self.kind in TIMED and (self.low > 0 or self.high < 2**63 - 1)
        inside = lambda times: times is not None and times[0] <= self.high and times[1] >= self.low
        for folder, found in files(self.folder):
            zones = zones_of(folder) if bounded and len(found) > 1 else {}
            yield from ((p, n) for p, n in found if (zone := zones.get((p.rpartition("/")[2], n))) is None or inside(zone.get(self.kind)))

    def partitions(self) -> list[Chunks]:
        """About ``bytesPerPartition`` of files or of a file's chunks; of a span only of files that may meet it."""
        out: list[Chunks] = []
        held, size = [], 0
        for path, n in self.met():
            if n > self.per_partition and self.kind != "captures":
                with open_file(path) as source:
                    part, room = [], 0
                    for entry in self.wanted(source)[1]:
                        part.append(entry)
                        room += entry[3] + CHUNK_LEN
                        if room >= self.per_partition:
                            out.append(Chunks([(path, part)]))
                            part, room = [], 0
                    out += [Chunks([(path, part)])] if part else []
                continue
            held.append((path, None))
            size += n + (1 << 12)  # opening a file costs about as much as reading so much
            if size >= self.per_partition:
                out.append(Chunks(held))
                held, size = [], 0
        return [*out, Chunks(held)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        names = columns_of(self.kind)
        rows: list[tuple] = []
        held: list[list[pa.Array]] = []
        size = 0
        for path, some in partition.parts:
            name = path.rpartition("/")[2].removesuffix(".pprof")
            with open_file(path) as file:
                source = pa.BufferReader(file.read()) if some is None and file.size() <= WHOLE else file
                if some is None:
                    header, entries = self.wanted(source)
                else:
                    header, entries = read_header(source.read(HEADER_LEN)), some
                if self.kind == "captures":
                    rows.append(capture_row(name, header, *entries[0]))
                    continue
                if self.kind == "chunks":
                    rows += [self.described(source, name, header["compression"], e) for e in entries]
                    continue
                for k, at, *_ in entries:
                    source.seek(at)
                    head = read_chunk_header(source.read(CHUNK_LEN))
                    if head is None or (self.kind not in UNNUMBERED and head[4] != NO_TIME and (head[5] < self.low or head[4] > self.high)):
                        continue
                    content = chunk_at(source, at, header["compression"])[1]
                    columns = decoded(self.kind, content) if content is not None else None
                    if columns is not None:
                        n = len(columns[0])
                        first = [pa.array([name] * n, pa.string())]
                        if self.kind not in UNNUMBERED:
                            first.append(pa.array((k << 32) + np.arange(n, dtype=np.int64)))
                        held.append([*first, *columns])
                        size += n
                        if size >= BATCH_ROWS or len(held) >= BATCH_CHUNKS:
                            yield joined(held, names)
                            held, size = [], 0
        if rows:
            yield as_batch(rows, self.kind)
        if held:
            yield joined(held, names)

    @staticmethod
    def described(source, name: str, compression: int, entry: tuple) -> tuple:
        _, at, kind, stored, records = entry
        head, content = chunk_at(source, at, compression)
        first, last = (None if t == NO_TIME else t for t in head[4:6]) if head else (None, None)
        return name, at, kind, stored, head[2] if head else None, records, first, last, "corrupt" if content is None else "ok" if kind in KINDS.values() else "unknown"


def columns_of(kind: str) -> list[str]:
    """Names of a kind's columns; what types hold in angle brackets names none."""
    flat, before = SCHEMAS[kind], ""
    while flat != before:
        flat, before = re.sub(r"<[^<>]*>", "", flat), flat
    return [c.strip().split(" ")[0] for c in flat.split(",")]


def joined(parts: list[list[pa.Array]], names: list[str]) -> pa.RecordBatch:
    """One batch out of the columns of many chunks, as chunks may be small."""
    return pa.record_batch([pa.concat_arrays(c) for c in zip(*parts, strict=True)] if len(parts) > 1 else parts[0], names)


def capture_row(name: str, header: dict, recovered: bool, stopped: int | None) -> tuple:
    return (
        name, bool(header["flags"] & FINALIZED), recovered, stopped, header["timer_hz"], header["rate_hz"], header["flags"],
        COMPRESSIONS[header["compression"]] if header["compression"] < 3 else "unknown", ascii_field(header["serial"]),
        ascii_field(header["firmware"]), header["shunt"], header["offset"], header["num"], header["den"],
    )


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def as_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    fields = [c.strip().split(" ") for c in SCHEMAS[kind].split(",")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class PowerCapture(DataSource):
    """Rows of one kind of chunk; damaged chunks give none, and stand as corrupt in kind ``chunks``.

    seq is the chunk's number and the place within it, so that order is kept where times are equal. Written rows are
    records of all kinds, as ``sinks.capture_sink.capture_records`` has them; see there.
    """

    @classmethod
    def name(cls) -> str:
        return "powercapture"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "samples")]

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        from joulegrid.sinks.capture_sink import CaptureSink

        return CaptureSink(dict(self.options), schema, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PowerCapture)


def packed_chunk(kind: int, content: bytes, first: int, last: int, compression: int) -> bytes:
    stored, flags = content, 0
    if compression == 1:
        stored, flags = compressor().compress(content), 1
    elif compression == 2:
        stored, flags = struct.pack("<I", len(content)) + pa.compress(content, "lz4_raw", asbytes=True), 1
    head = CHUNK.pack(b"CHNK", kind, flags, len(content), len(stored), first, last, zlib.crc32(stored))
    return head + struct.pack("<I", zlib.crc32(head)) + stored


def sample_content(t: np.ndarray, i: np.ndarray, v: np.ndarray | None) -> bytes:
    """Uniform where all steps are equal, else with a step for each sample."""
    steps = np.diff(t)
    uniform = len(t) < 2 or bool((steps == steps[0]).all() and steps[0] < 2**32)
    period = int(steps[0]) if uniform and len(t) > 1 else 0
    flags = (UNIFORM if uniform else 0) | (VOLTAGE if v is not None else 0)
    parts = [struct.pack("<IIQII", len(t), flags, int(t[0]), period, 0)]
    if not uniform:
        parts.append(np.concatenate([[0], steps]).astype("<u4").tobytes())
    return b"".join([*parts, i.astype("<i4").tobytes(), v.astype("<u4").tobytes() if v is not None else b""])


def capture_bytes(chunks: list[tuple[int, bytes, int, int, int]], compression: int = 1, timer_hz: int = 1_000_000, rate_hz: int = 0, finalized: bool = True, serial: bytes = b"", flags: int = 0) -> bytes:
    """A file out of (kind, content, first, last, records) chunks; without ``finalized``, as a killed writer leaves it."""
    body, entries, at = [], [], HEADER_LEN
    for kind, content, first, last, records in chunks:
        raw = packed_chunk(kind, content, first, last, compression)
        entries.append(ENTRY.pack(kind, 0, at, len(raw) - CHUNK_LEN, records, first, 0))
        body.append(raw)
        at += len(raw)
    footer = 0
    if finalized:
        index = packed_chunk(KINDS["index"], struct.pack("<II", len(entries), 0) + b"".join(entries), NO_TIME, NO_TIME, 0)
        tail = struct.pack("<QQQ", at, len(index), sum(c[4] for c in chunks if c[0] == KINDS["samples"]))
        body += [index, tail + struct.pack("<I4s", zlib.crc32(tail), b"PEND")]
        footer = at + len(index)
    head = HEADER.pack(b"PPROFCAP", 1, 0, HEADER_LEN, 0, 0, timer_hz, rate_hz, flags | (FINALIZED if finalized else 0), compression, serial, b"", 0, 0, 0, 1, 1, footer, 65536, 0).ljust(124, b"\0")
    return head[:124] + struct.pack("<I", zlib.crc32(head[:124])) + b"".join(body)


def sample_chunk(t: np.ndarray, i: np.ndarray, v: np.ndarray | None) -> tuple[int, bytes, int, int, int]:
    return KINDS["samples"], sample_content(t, i, v), int(t[0]), int(t[-1]), len(t)
