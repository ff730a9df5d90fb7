"""Samples written as capture files, one for each capture and time slice, in chunks of bounded size."""

from __future__ import annotations

import contextlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.ordered import slice_length
from joulegrid.shared import settle
from joulegrid.sources.capture_file import HAS_EVENTS, HAS_GPIO, HAS_VOLTAGE, KINDS, ROWS, ZONES, capture_bytes, sample_chunk, zones_of

CHUNK_ROWS = 8192
#: About so many samples are in a file at most.
FILE_ROWS = 4_000_000
#: A folder of more files than this has them in so many subfolders, as who lists it holds one folder's files at a time.
FOLDER_FILES, SUBFOLDERS, SUBFOLDER = 4096, 1024, "of-1024-"


def subfolder(file: str) -> str:
    """Where a file lies in a folder of many: of one name there is one file, whoever writes it."""
    return f"{SUBFOLDER}{zlib.crc32(file.encode()) % SUBFOLDERS:04d}"


def is_spread(folder: str, more: int) -> bool:
    """Whether a folder has its files in subfolders, or is to have them there with so many more."""
    fs, name = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    found = fs.get_file_info(pafs.FileSelector(name, allow_not_found=True))
    return any(x.base_name.startswith(SUBFOLDER) and x.type == pafs.FileType.Directory for x in found) or more + sum(x.base_name.endswith(".pprof") for x in found) > FOLDER_FILES


def spread(folder: str) -> None:
    """Moves files that lie in a folder itself to their subfolders, and with them what is noted of their times."""
    fs, name = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    known, zones = zones_of(folder), {}
    for x in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
        if x.base_name.endswith(".pprof"):
            place = f"{name}/{subfolder(x.base_name)}"
            fs.create_dir(place, recursive=True)
            fs.move(x.path, f"{place}/{x.base_name}")
            if (x.base_name, x.size) in known:
                zones.setdefault(place, []).append(json.dumps({"file": x.base_name, "size": x.size, "times": known[x.base_name, x.size]}) + "\n")
    note_zones(fs, zones, uuid.uuid4().hex)
    with contextlib.suppress(FileNotFoundError, OSError):
        fs.delete_dir(f"{name}/{ZONES}")


def note_zones(fs: pafs.FileSystem, zones: dict[str, list[str]], name: str) -> None:
    """Writes beside the files of each folder, a line for each, what times they have rows of."""
    for place, some in zones.items():
        fs.create_dir(f"{place}/{ZONES}", recursive=True)
        with fs.open_output_stream(f"{place}/{ZONES}/{name}.jsonl", compression=None) as out:
            out.write("".join(some).encode())


def chunk_edges(t: np.ndarray, unknown: np.ndarray) -> list[tuple[int, int]]:
    """Where chunks begin and end.

    A step of 2^32 ns or more starts a new chunk, as steps are stored in 32 bits; so does a voltage that becomes known or
    unknown, as a chunk has voltages for all of its samples or none.
    """
    edges = [0, *(np.flatnonzero((np.diff(t) >= 2**32) | (unknown[1:] != unknown[:-1])) + 1).tolist(), len(t)]
    return [(c, min(c + CHUNK_ROWS, b)) for a, b in zip(edges, edges[1:], strict=False) for c in range(a, b, CHUNK_ROWS)]


#: Columns of each kind, the time first.
COLUMNS = {"samples": ("t_ns", "current_ua", "voltage_uv"), "events": ("t_ns", "id", "value"), "gpio": ("t_ns", "state"), "sync": ("host_send_ns", "host_recv_ns", "device_ticks")}


def record_chunk(kind: str, columns: list[pa.ChunkedArray], a: int, b: int) -> tuple[int, bytes, int, int, int]:
    """A chunk of rows a to b of events, pins or sync rows."""
    rows = np.zeros(b - a, ROWS[kind])
    parts = [c.slice(a, b - a) for c in columns]
    if kind == "events":
        rows["flags"] = parts[2].is_valid().to_numpy()
        parts[2] = parts[2].fill_null(0)
    for name, part in zip([n for n in rows.dtype.names if n not in ("flags", "pad")], parts, strict=True):
        rows[name] = part.to_numpy()
    first, last = int(rows[rows.dtype.names[0]][0]), int(rows[rows.dtype.names[0]][-1])
    return KINDS[kind], struct.pack("<II", b - a, 0) + rows.tobytes(), first, last, b - a


def write_captures(samples: DataFrame, folder: str, slice_ns: int | None = None, compression: int = 1, kind: str = "samples") -> DataFrame:
    """path and rows of each file, of samples or another ``kind`` of rows. A slice, not a capture, is the unit, so a long capture is many files of many tasks.

    Slices hold about ``FILE_ROWS`` samples of a capture by default. Content depends on the rows alone and a file
    appears under its name once it is whole, so a task may run again. Rows come to a task in order, file by file.
    """
    names_of = COLUMNS[kind]
    time = names_of[0]
    slice_ns = slice_ns or slice_length(samples, ["capture_id"], time, rows=FILE_ROWS, most_ns=1 << 62)

    def put(key: tuple[str, int], parts: list[pa.RecordBatch]) -> tuple[str, int]:
        table = pa.Table.from_batches(parts)
        t, flags = table[time].to_numpy(), {"events": HAS_EVENTS, "gpio": HAS_GPIO}.get(kind, 0)
        if kind == "samples":
            i = table["current_ua"].to_numpy()
            v, unknown = table["voltage_uv"].fill_null(0).to_numpy(), table["voltage_uv"].is_null().to_numpy()
            chunks = [sample_chunk(t[a:b], i[a:b], None if unknown[a] else v[a:b]) for a, b in chunk_edges(t, unknown)]
            flags = 0 if unknown.all() else HAS_VOLTAGE
        else:
            chunks = [record_chunk(kind, [table[c] for c in names_of], a, min(a + CHUNK_ROWS, len(t))) for a in range(0, len(t), CHUNK_ROWS)]
        file = f"{key[0]}-{key[1]}.pprof"
        path = f"{folder}/{subfolder(file)}/{file}" if many else f"{folder}/{file}"
        fs, name = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        if many:
            fs.create_dir(name.rpartition("/")[0], recursive=True)
        draft = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(capture_bytes(chunks, compression, flags=flags))
        fs.move(draft, name)
        return path, len(t)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(name, recursive=True)
        key, held, done = None, [], []
        for b in it:
            if not b.num_rows:
                continue
            names, slices = b.column("capture_id").to_pylist(), b.column("slice").to_numpy()
            change = [k for k in range(1, b.num_rows) if slices[k] != slices[k - 1] or names[k] != names[k - 1]]
            for a, z in zip([0, *change], [*change, b.num_rows], strict=True):
                now = (names[a], int(slices[a]))
                if now != key and held:
                    done.append(put(key, held))
                    held = []
                key = now
                held.append(b.slice(a, z - a))
        if held:
            done.append(put(key, held))
        paths, rows = zip(*done, strict=True) if done else ((), ())
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(rows, pa.int64())], ["path", "rows"])

    sliced = samples.withColumn("slice", F.call_function("div", F.col(time), F.lit(slice_ns).cast("bigint")))
    many = is_spread(folder, sliced.select("capture_id", "slice").distinct().limit(FOLDER_FILES + 1).count())
    if many:
        spread(folder)
    ordered = sliced.repartition("capture_id", "slice").sortWithinPartitions("capture_id", "slice", time, *[c for c in ("seq",) if c in samples.columns])
    return settle(ordered.select("capture_id", "slice", *names_of).mapInArrow(run, "path string, rows long"))
