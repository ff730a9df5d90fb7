"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds data frames, a directory frame and the seek table. Each data frame is the ids of whole documents, as
little-endian unsigned 32-bit integers, and decompresses without any other. The directory frame lists the documents:
doc_id (int64), whether it is null, the data frame and the number of ids. The seek table is the skippable frame of the
public zstd seekable format: for each frame its compressed size, its size and the low 32 bits of the XXH64 of its
content, then the number of frames, a descriptor and a magic number. Plain zstd tools read such files too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joulegrid.llm.common import give_back, settle, sliced
from joulegrid.llm.tokens import word_ids
from joulegrid.shared import new_folder

#: Fixed values of the public zstd seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

DIRECTORY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("frame", "<u4"), ("n", "<u8")])
MANIFEST = "part int, path string, n_documents long, n_tokens long, bytes long"


class DamagedFrame(ValueError):
    """A frame's content does not have the checksum that the seek table gives."""


class Writer:
    """Appends documents; a data frame closes once it holds ``frame_bytes``. A document as long as that has a frame of its own."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.size = 0

    def frame(self, content: bytes) -> None:
        packed = self.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if len(ids) >= self.frame_bytes:
            self.flush()
        self.docs.append((doc_id or 0, doc_id is None, len(self.table), len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.frame(b"".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> int:
        self.flush()
        self.frame(np.array(self.docs, DIRECTORY).tobytes())
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))
        return sum(x[0] for x in self.table) + len(entries) + 17


class Reader:
    """Reads a file of which only the seek table and the directory are decompressed at first."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.expand = zstandard.ZstdDecompressor().decompress
        self.directory = np.frombuffer(self.content(n - 1), DIRECTORY)
        sizes = self.directory["n"].astype(np.int64)
        self.start = np.cumsum(sizes) - sizes
        first = np.searchsorted(self.directory["frame"], self.directory["frame"])
        self.within = self.start - self.start[first] if len(first) else self.start

    def content(self, k: int) -> bytes:
        self.source.seek(int(self.begin[k]))
        found = self.expand(self.source.read(int(self.table[k, 0])))
        if xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != self.table[k, 2]:
            raise DamagedFrame(f"frame {k}")
        return found

    def ids(self, rows: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Ids of the documents at these places of the directory; each frame that they need is read once if rows ascend."""
        held, content = -1, b""
        for row in rows:
            d = self.directory[row]
            if d["frame"] != held:
                held, content = int(d["frame"]), self.content(int(d["frame"]))
            yield row, np.frombuffer(content, "<u4", int(d["n"]), 4 * int(self.within[row]))

    def find(self, doc_id: int) -> list[int]:
        """Places of the rows with this id, by binary search."""
        nulls = int(self.directory["is_null"].sum())  # nulls stand first
        known = self.directory["doc_id"][nulls:]
        return list(range(nulls + int(np.searchsorted(known, doc_id)), nulls + int(np.searchsorted(known, doc_id, "right"))))


def location(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 1, file_bytes: int = 64 << 20, frame_bytes: int = 1 << 20) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; a row of the manifest for each file.

    Texts are range-partitioned by doc_id before they are encoded, at most about ``file_bytes`` of them for each task (fewer
    while cores are idle), and a task writes one file. Rows with one doc_id stand side by side, by a hash of their texts, and may go on in the next file.
    A task that runs again writes under a new name; only the names that the manifest gives are part of the result. A
    null or empty text is the end id alone, and null ids come first.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(-(-size // file_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (file_bytes // 16))), 1)
    ordered = (
        rows.withColumn("mark", F.xxhash64("text"))
        .repartitionByRange(files, "doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out, writer, total, part = word_ids(tokenizer), None, None, 0, 0
        for whole in it:
            for batch in sliced(whole, "text"):
                if writer is None and batch.num_rows:
                    part = batch.column("part")[0].as_py()
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                    fs, name = location(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                    writer = Writer(out, frame_bytes)
                for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist(), end_id), strict=True):
                    writer.add(doc, ids)
                    total += len(ids) // 4
        if writer is not None:
            size = writer.close()
            out.close()
            give_back()
            yield pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (path, pa.string()), (len(writer.docs), pa.int64()), (total, pa.int64()), (size, pa.int64()))], ["part", "path", "n_documents", "n_tokens", "bytes"])

    return settle(ordered.mapInArrow(run, MANIFEST))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read every file of a manifest back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, name = location(path)
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    crc = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in reader.ids(range(len(reader.directory)))), np.int64, len(reader.directory))
                    d = reader.directory
                    yield pa.record_batch(
                        [pa.array(d["doc_id"].astype(np.int64), mask=d["is_null"].astype(bool)), pa.array(base + reader.start), pa.array(d["n"].astype(np.int64)), pa.array(crc)],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return files.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """Ids of a few given documents: doc_id, ids. Only directories and frames that hold a wanted one are decompressed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column("path").to_pylist():
                fs, name = location(path)
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    found = list(reader.ids(sorted(k for i in set(wanted) for k in reader.find(i))))
                    docs = pa.array([int(reader.directory["doc_id"][k]) for k, _ in found], pa.int64())
                    yield pa.record_batch([docs, pa.array([x.tolist() for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids of ``docs`` under the shared folder and read the files back."""
    return read_ids(write_ids(docs, tokenizer, new_folder(docs.sparkSession, "ids"), end_id))
