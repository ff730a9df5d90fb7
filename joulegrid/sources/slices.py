"""A table as a stream in order: ``spark.readStream.format("orderedslices")`` over Parquet files.

A micro-batch holds the rows of one slice of an order column (a whole number or a time), however the files are cut, so
order across micro-batches does not depend on when a file was written. The reader takes the extremes of row groups from
the files' footers once; a slice reads only row groups that meet it, each in a task of its own or with neighbours. An
offset is the slice's end, so a restart goes on where the last committed one ended.

Row groups without extremes (as those of times that are stored as INT96) are read for every slice.

Options: path, order, first and last (the column's extremes, by default those of the row groups), sliceLength (in units of the column; times in microseconds) or cuts (slices' ends, comma-separated),
progress and bytesPerPartition.
``progress`` is a folder of the query in which ends of slices are noted once they are committed: a source of this kind is
asked for its latest offset without being told where the query stands, and after a restart finds it there. A query goes
on with the slice length that it began with.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from joulegrid.shared import new_folder

EPOCH = datetime.datetime(1970, 1, 1)


def place_of(value) -> int:
    """A value of the order column as a whole number; times in microseconds."""
    if isinstance(value, datetime.datetime):
        return (value.replace(tzinfo=None) - EPOCH) // datetime.timedelta(microseconds=1)
    return int(value)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class RowGroups(InputPartition):
    """Row groups of files: (file, numbers), and the half-open slice that is wanted of them."""

    def __init__(self, parts: list[tuple[str, list[int]]], start: int, end: int):
        self.parts, self.start, self.end = parts, start, end


class SliceReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.path, self.order, self.schema = options["path"], options["order"], schema
        self.length = max(1, int(options.get("slicelength", options.get("sliceLength", str(1 << 62)))))
        self.cuts = sorted(int(c) for c in options.get("cuts", "").split(",") if c)
        self.per_partition = int(options.get("bytesperpartition", options.get("bytesPerPartition", str(64 << 20))))
        self.known = [int(options[k]) if k in options else None for k in ("first", "last")]
        self.progress = options.get("progress")
        if not self.progress:
            raise ValueError("name a folder for the query's progress")
        self.groups: list[tuple[str, int, int | None, int | None, int]] | None = None
        self.at: int | None = None

    def listed(self) -> list[tuple[str, int, int | None, int | None, int]]:
        """(file, row group, least, greatest, bytes) of all row groups; extremes are None where the footer has none."""
        if self.groups is None:
            fs, name = store(self.path)
            info = fs.get_file_info(name)
            files = [name] if info.type == pafs.FileType.File else [x.path for x in fs.get_file_info(pafs.FileSelector(name, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(".parquet") and not x.base_name.startswith(("_", "."))]
            self.groups = []
            for f in sorted(files):
                with fs.open_input_file(f) as source:
                    held = pq.ParquetFile(source).metadata
                for k in range(held.num_row_groups):
                    group = held.row_group(k)
                    column = next(c for c in (group.column(j) for j in range(group.num_columns)) if c.path_in_schema == self.order)
                    known = column.statistics is not None and column.statistics.has_min_max
                    least, greatest = (place_of(column.statistics.min), place_of(column.statistics.max)) if known else (None, None)
                    self.groups.append((f, k, least, greatest, group.total_byte_size))
        return self.groups

    def ends(self) -> tuple[int, int]:
        first, last = self.known
        if first is None or last is None:
            held = self.listed()
            if any(g[2] is None for g in held):
                raise ValueError(f"files do not tell the extremes of {self.order}; name the first and the last value")
            first, last = min((g[2] for g in held), default=0), max((g[3] for g in held), default=-1)
        return first, last + 1

    def initialOffset(self) -> dict:
        return {"end": self.ends()[0]}

    def latestOffset(self) -> dict:
        first, end = self.ends()
        if self.at is None:
            self.at = self.noted() or first
        following = next((c for c in self.cuts if c > self.at), end) if self.cuts else self.at + self.length
        self.at = min(end, following)
        return {"end": self.at}

    def noted(self) -> int | None:
        fs, name = store(self.progress)
        ends = []
        for m in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)):
            if m.base_name.endswith(".json"):
                with fs.open_input_stream(m.path) as f:
                    held = json.loads(f.read())
                if held["length"] != self.length:
                    raise ValueError(f"the query began with slices of {held['length']}, not {self.length}")
                ends.append(held["end"])
        return max(ends, default=None)

    def commit(self, end: dict) -> None:
        fs, name = store(self.progress)
        fs.create_dir(name, recursive=True)
        draft = f"{name}/{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps({"end": end["end"], "length": self.length}).encode())
        fs.move(draft, f"{name}/end.json")

    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        self.at = max(end["end"], self.at if self.at is not None else end["end"])
        out: list[RowGroups] = []
        held: dict[str, list[int]] = {}
        size = 0
        for f, k, least, greatest, n in self.listed():
            if least is None or (least < end["end"] and greatest >= start["end"]):
                held.setdefault(f, []).append(k)
                size += n
                if size >= self.per_partition:
                    out.append(RowGroups(list(held.items()), start["end"], end["end"]))
                    held, size = {}, 0
        return [*out, RowGroups(list(held.items()), start["end"], end["end"])] if held else out

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        fs, _ = store(self.path)
        schema = to_arrow_schema(self.schema)
        for f, numbers in partition.parts:
            with fs.open_input_file(f) as source:
                for b in pq.ParquetFile(source).iter_batches(row_groups=numbers, columns=list(dict.fromkeys([*schema.names, self.order]))):
                    at = b.column(b.schema.get_field_index(self.order))
                    if pa.types.is_timestamp(at.type):
                        at = at.cast(pa.timestamp("us", at.type.tz), safe=False).cast(pa.int64())
                    at = at.cast(pa.int64())
                    chosen = b.filter(pc.and_(pc.greater_equal(at, partition.start), pc.less(at, partition.end)))
                    if chosen.num_rows:
                        yield pa.record_batch([chosen.column(chosen.schema.get_field_index(n)).cast(schema.field(n).type) for n in schema.names], schema=schema)


class OrderedSlices(DataSource):
    """Rows whose order column is null are in no slice."""

    @classmethod
    def name(cls) -> str:
        return "orderedslices"

    def schema(self):
        raise ValueError("give the table's schema")

    def streamReader(self, schema) -> SliceReader:
        return SliceReader(dict(self.options), schema)


def ordered(spark: SparkSession, path: str, order: str, length: int | None = None, cuts: list[int] | None = None, count: int | None = None, progress: str | None = None, bytes_per_partition: int = 64 << 20) -> DataFrame:
    """A Parquet table as a stream in slices of its column ``order``; its schema is the table's.

    Slices are of a length, or up to each of ``cuts``, or ``count`` of one length for what the table has now.

    Without ``progress`` the query notes its own in the shared folder and cannot be started again by another driver.
    """
    spark.dataSource.register(OrderedSlices)
    rows = spark.read.parquet(path)
    place = F.unix_micros(order) if dict(rows.dtypes)[order] == "timestamp" else F.col(order)
    least, most = rows.agg(F.min(place), F.max(place)).first()
    first, last = (0, -1) if least is None else (place_of(least), place_of(most))
    reader = spark.readStream.format("orderedslices").schema(rows.schema).option("order", order).option("first", first).option("last", last)
    length = (last - first) // count + 1 if count else length
    reader = reader.option("sliceLength", length) if length else reader.option("cuts", ",".join(map(str, cuts or [])))
    return reader.option("bytesPerPartition", bytes_per_partition).option("progress", progress or new_folder(spark, "progress")).load(path)
