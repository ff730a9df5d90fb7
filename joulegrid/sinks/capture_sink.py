"""Captures of all kinds of rows written as capture files: ``capture_records(...).write.format("powercapture").save(folder)``.

A file holds a capture's slice of time: metadata first, so that a file that breaks off still has names, then samples,
events, pins and sync rows in chunks, and a summary of the samples in buckets. Tasks write drafts in a folder of the job;
only the driver's commit gives them their names, once all tasks have ended well, so neither a failed attempt nor a failed
job leaves a file that readers see. Tasks list their drafts in a file of their own, and the driver goes through these one
after the other, so it holds neither all files nor all their names. Beside the files lies what times they have rows of, so
that a reader of a span opens only those that it meets; more than ``FOLDER_FILES`` files lie in subfolders.
"""

from __future__ import annotations

import contextlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from joulegrid.operators.buckets import LEVELS_NS
from joulegrid.operators.ordered import slice_length
from joulegrid.sinks.capture_writer import CHUNK_ROWS, FILE_ROWS, SUBFOLDER, chunk_edges, is_spread, note_zones, record_chunk, spread, subfolder
from joulegrid.sources.capture_file import COMPRESSIONS, HAS_EVENTS, HAS_GPIO, HAS_VOLTAGE, KINDS, NO_TIME, TIMED, ZONES, capture_bytes, sample_chunk, summary_content
from joulegrid.sources.metadata import encoded

RECORDS = "capture_id string, slice long, place int, t_ns long, seq long, current_ua int, voltage_uv long, id int, value long, state int, host_recv_ns long, device_ticks long, metadata binary"
#: Kinds in the order in which a file has them, and the columns of their rows, the time first.
PLACES = ("metadata", "samples", "events", "gpio", "sync")
COLUMNS = {"events": ("t_ns", "id", "value"), "gpio": ("t_ns", "state"), "sync": ("t_ns", "host_recv_ns", "device_ticks")}
DRAFTS, LISTED = "_drafts", "listed.jsonl"
#: Of so many files the driver notes the times together.
NOTED = 1 << 16


class InvalidRecords(ValueError):
    """Rows that are not capture records."""


def capture_records(
    samples: DataFrame | None = None, events: DataFrame | None = None, gpio: DataFrame | None = None, sync: DataFrame | None = None, metadata: DataFrame | None = None, slice_ns: int | None = None
) -> DataFrame:
    """Rows of all kinds as records for the sink: of each capture and slice together, in order.

    Slices hold about ``FILE_ROWS`` samples at most by default; a sync row belongs to the slice of its host time.
    ``metadata`` has columns of ``sources.metadata.STORED``; every file of a capture gets it. Rows without a capture or a
    time are refused by the sink; a capture that has metadata alone gets no file.
    """
    given = {"samples": samples, "events": events, "gpio": gpio, "sync": sync.withColumnRenamed("host_send_ns", "t_ns") if sync is not None else None}
    given = {kind: df for kind, df in given.items() if df is not None}
    if not given:
        raise InvalidRecords("there are no rows to write")
    if slice_ns is None:
        slice_ns = min(slice_length(df, ["capture_id"], rows=FILE_ROWS, most_ns=1 << 62) for df in given.values())
    fields = [c.split(" ") for c in RECORDS.split(", ")]
    rows = None
    for kind, df in given.items():
        at = F.call_function("div", F.col("t_ns"), F.lit(slice_ns).cast("bigint")).alias("slice")
        known = {"slice": at, "place": F.lit(PLACES.index(kind)).alias("place")}
        some = df.select(*[known.get(c, F.col(c).cast(t).alias(c) if c in df.columns and c != "metadata" else F.lit(None).cast(t).alias(c)) for c, t in fields])
        rows = some if rows is None else rows.unionByName(some)
    if metadata is not None:
        files = rows.select("capture_id", "slice").distinct()
        told = files.join(encoded(metadata), "capture_id").select(*[F.lit(0).alias(c) if c == "place" else F.col(c) if c in ("capture_id", "slice", "metadata") else F.lit(None).cast(t).alias(c) for c, t in fields])
        rows = rows.unionByName(told)
    return rows.repartition("capture_id", "slice").sortWithinPartitions("capture_id", "slice", "place", "t_ns", "seq")


def file_bytes(parts: dict[str, pa.Table], compression: int, levels: tuple[int, ...], timer_hz: int) -> bytes:
    """A capture file of the rows of each kind."""
    chunks, flags, rate = [], 0, 0
    for content in parts["metadata"]["metadata"].to_pylist() if "metadata" in parts else []:
        chunks.append((KINDS["metadata"], content, NO_TIME, NO_TIME, 1))
    if "samples" in parts:
        table = parts["samples"]
        t, i = table["t_ns"].to_numpy(), table["current_ua"].to_numpy()
        v, unknown = table["voltage_uv"].fill_null(0).to_numpy(), table["voltage_uv"].is_null().to_numpy()
        chunks += [sample_chunk(t[a:b], i[a:b], None if unknown[a] else v[a:b]) for a, b in chunk_edges(t, unknown)]
        flags |= 0 if unknown.all() else HAS_VOLTAGE
        rate = round((len(t) - 1) * 1e9 / max(1, int(t[-1] - t[0])))
    for kind, columns in COLUMNS.items():
        if kind in parts:
            n = parts[kind].num_rows
            chunks += [record_chunk(kind, [parts[kind][c] for c in columns], a, min(a + CHUNK_ROWS, n)) for a in range(0, n, CHUNK_ROWS)]
            flags |= {"events": HAS_EVENTS, "gpio": HAS_GPIO}.get(kind, 0)
    if "samples" in parts and levels:
        chunks.append((KINDS["summary"], summary_content(t, i, levels), NO_TIME, NO_TIME, 1))
    return capture_bytes(chunks, compression, timer_hz, min(rate, 2**32 - 1), flags=flags)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's drafts, numbered from 0, and how many they are.

    A list beside them has a line for each: the name that it is to have, its size and the times that it has rows of, by kind.
    """

    folder: str
    files: int


def drafts(fs: pafs.FileSystem, tasks: list[Written]) -> Iterator[tuple[str, str, str]]:
    """Each draft, the name that it is to have, and its line."""
    for task in tasks:
        with fs.open_input_stream(f"{task.folder}/{LISTED}", compression=None) as raw:
            for k, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8")):
                yield f"{task.folder}/{k}", json.loads(line)["file"], line


class CaptureSink(DataSourceArrowWriter):
    """Options: path, compression (none, zstd or lz4), levels (bucket widths in ns, comma-separated; empty for no summary), timer_hz."""

    def __init__(self, options: dict, schema, overwrite: bool):
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]
        if list(schema.names) != names:
            raise InvalidRecords(f"columns are {', '.join(schema.names)}; records have {', '.join(names)}")
        path = options["path"]
        self.folder, self.overwrite, self.job = path if "://" in path else "file://" + path, overwrite, uuid.uuid4().hex
        if options.get("compression", "zstd") not in COMPRESSIONS:
            raise InvalidRecords(f"compression is one of {', '.join(COMPRESSIONS)}")
        self.compression = COMPRESSIONS.index(options.get("compression", "zstd"))
        self.levels = tuple(int(w) for w in options.get("levels", ",".join(map(str, LEVELS_NS))).split(",") if w)
        self.timer_hz = int(options.get("timerHz", options.get("timer_hz", "1000000")))

    def store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = self.store()
        folder = f"{folder}/{DRAFTS}-{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        key, held, done = None, {}, Written(folder, 0)

        def put() -> None:
            parts = {PLACES[p]: pa.Table.from_batches(bs) for p, bs in held.items()}
            content = file_bytes(parts, self.compression, self.levels, self.timer_hz)
            with fs.open_output_stream(f"{folder}/{done.files}", compression=None) as out:
                out.write(content)
            times = {kind: [t["t_ns"][0].as_py(), t["t_ns"][-1].as_py()] for kind, t in parts.items() if kind in TIMED}
            listed.write((json.dumps({"file": f"{key[0]}-{key[1]}.pprof", "size": len(content), "times": times}) + "\n").encode())
            done.files += 1

        with fs.open_output_stream(f"{folder}/{LISTED}", compression=None) as listed:
            for b in iterator:
                if not b.num_rows:
                    continue
                captures, slices, places = b.column("capture_id").to_pylist(), b.column("slice").to_numpy(zero_copy_only=False), b.column("place").to_numpy()
                if b.column("capture_id").null_count or b.column("slice").null_count:
                    raise InvalidRecords("a row has no capture or no time")
                change = [k for k in range(1, b.num_rows) if places[k] != places[k - 1] or slices[k] != slices[k - 1] or captures[k] != captures[k - 1]]
                for a, z in zip([0, *change], [*change, b.num_rows], strict=True):
                    now = (captures[a], int(slices[a]))
                    if now != key and held:
                        put()
                        held = {}
                    key = now
                    held.setdefault(int(places[a]), []).append(b.slice(a, z - a))
            if held:
                put()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        """Names the drafts. Overwriting removes the files that were there, but only once the new ones are all written."""
        fs, folder = self.store()
        fs.create_dir(folder, recursive=True)
        tasks = [m for m in messages if m is not None]
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(folder)):
                if old.path.endswith(".pprof"):
                    fs.delete_file(old.path)
                elif old.base_name == ZONES or old.base_name.startswith(SUBFOLDER):
                    fs.delete_dir(old.path)
        many = is_spread(self.folder, sum(m.files for m in tasks))
        if many:
            spread(self.folder)
        zones: dict[str, list[str]] = {}
        made = {folder}
        for k, (draft, file, line) in enumerate(drafts(fs, tasks)):
            place = f"{folder}/{subfolder(file)}" if many else folder
            if place not in made:
                fs.create_dir(place, recursive=True)
                made.add(place)
            fs.move(draft, f"{place}/{file}")
            zones.setdefault(place, []).append(line)
            if k % NOTED == NOTED - 1:
                note_zones(fs, zones, f"{self.job}-{k // NOTED}")
                zones = {}
        note_zones(fs, zones, self.job)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, folder = self.store()
        with contextlib.suppress(FileNotFoundError, OSError):
            fs.delete_dir(f"{folder}/{DRAFTS}-{self.job}")
