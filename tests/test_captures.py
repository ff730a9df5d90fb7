"""Whole captures: files of all kinds of rows, committed together or not at all, with their own names and summaries."""

import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joulegrid.operators import buckets, names
from joulegrid.plans import capture
from joulegrid.schemas import EVENTS, SAMPLES
from joulegrid.sinks.capture_sink import InvalidRecords, capture_records
from joulegrid.sources import capture_file, metadata

ITEM = st.recursive(st.none() | st.booleans() | st.integers(-(2**64), 2**64 - 1) | st.floats(allow_nan=False) | st.text() | st.binary(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


def without_none(x):
    if isinstance(x, dict):
        return {k: without_none(v) for k, v in x.items() if v is not None}
    return [without_none(v) for v in x] if isinstance(x, list) else x


@settings(max_examples=200, deadline=None)
@given(ITEM)
def test_what_is_stored_comes_back(item):
    assert metadata.cbor(metadata.cbor_bytes(item)) == without_none(item)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_any_bytes_are_metadata_or_refused(raw):
    got = capture_file.decoded("metadata", raw)
    assert got is None or len(got) == 8


def rows_of(spark, captures=3, n=60, step=7_000_000):
    samples = [(f"c{c}", k, k * step, 10 * k - 200 * c, None if (k // 10) % 3 == 1 else 3_300_000 + k) for c in range(captures) for k in range(n)]
    events = [(f"c{c}", k, k * 5 * step + 1, 257 + k % 2, None if k % 3 else k) for c in range(captures) for k in range(n // 5)]
    gpio = [(f"c{c}", k, k * 9 * step, k * 300) for c in range(captures) for k in range(n // 9)]
    sync = [(f"c{c}", k * 10 * step, k * 10 * step + 50, k * 77) for c in range(captures) for k in range(n // 10)]
    return (
        spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(events, EVENTS), spark.createDataFrame(gpio, "capture_id string, seq long, t_ns long, state int"),
        spark.createDataFrame(sync, "capture_id string, host_send_ns long, host_recv_ns long, device_ticks long"),
    )


def told(spark):
    one = [("TX", 257, 258, "radio", "bytes", -20)]
    other = [("ON", 257, None, None, None, 0), ("OFF", 258, None, "é", None, 5)]
    rows = [("c0", one, {"board": "C", "git": "ab"}, "run --x", None, "1.0", None, (1.5, -2.0, 9, 0.25), 1_800_000), ("c1", other, {}, None, "sim://", None, "host", None, None), ("none", one, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, metadata.STORED)


def files(path):
    return sorted(f for _, _, found in os.walk(path) for f in found if f.endswith(".pprof"))


@pytest.fixture(scope="module")
def source(spark):
    capture_file.register(spark)
    return spark


@pytest.mark.parametrize("compression", ["none", "zstd", "lz4"])
def test_one_file_has_all_kinds(source, tmp_path, compression):
    given_rows = rows_of(source)
    folder = str(tmp_path / "out")
    capture_records(*given_rows, told(source), slice_ns=200_000_000).write.format("powercapture").mode("append").option("compression", compression).save(folder)
    assert files(folder) == [f"c{c}-{k}.pprof" for c in range(3) for k in range(3)]
    read = capture.opened(source, folder)
    for kind, df in zip(("samples", "events", "gpio", "sync"), given_rows, strict=True):
        columns = [c for c in df.columns if c != "seq"]
        assert sorted(map(tuple, read(kind).select(*columns).collect()), key=repr) == sorted(map(tuple, df.select(*columns).collect()), key=repr)
    report = capture.integrity(read("captures"), read("chunks"))
    assert report.count() == 9 and report.where("is_clean AND NOT recovered").count() == 9
    held = {tuple(r)[0]: r for r in read("metadata").dropDuplicates(["capture_id"]).collect()}
    want = {r["capture_id"]: r for r in told(source).collect()}
    assert set(held) == {"c0", "c1"}
    assert held["c0"] == want["c0"] and held["c1"]["event"] == want["c1"]["event"] and held["c1"]["notes"] == {} and held["c1"]["device"] == "sim://"
    assert read("captures").agg(F.min("sample_rate_hz")).first()[0] == round(1e9 / 7_000_000)
    first = source.read.format("powercapture").option("kind", "chunks").load(folder).where("capture_id = 'c0-0'").orderBy("place").first()
    assert first["kind"] == capture_file.KINDS["metadata"]  # a file that breaks off has its names


def test_names_are_of_the_capture(source, tmp_path):
    _, events, *_ = rows_of(source)
    folder = str(tmp_path / "out")
    capture_records(events=events, metadata=told(source), slice_ns=1 << 62).write.format("powercapture").mode("append").save(folder)
    read = capture.opened(source, folder)
    named = names.with_capture_names(read("events"), metadata.capture_definitions(read("metadata")))
    got = {tuple(r) for r in named.select("capture_id", "id", "name").distinct().collect()}
    assert got == {("c0", 257, "TX"), ("c0", 258, "TX:stop"), ("c1", 257, "ON"), ("c1", 258, "OFF"), ("c2", 257, "0x0101"), ("c2", 258, "0x0102")}


def test_failed_jobs_leave_nothing(source, tmp_path):
    samples, events, *_ = rows_of(source)
    folder = str(tmp_path / "out")
    write = lambda df, mode: df.write.format("powercapture").mode(mode).save(folder)
    write(capture_records(samples, slice_ns=1 << 62), "append")
    before = {f: open(f"{folder}/{f}", "rb").read() for f in files(folder)}
    bad = events.union(source.createDataFrame([("c9", 0, 4, 70_000, None), (None, 1, 5, 1, None)], EVENTS))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="capture or no time|out of bounds|too large|Python integer"):
            write(capture_records(samples, bad, slice_ns=100_000_000), mode)
        assert {f: open(f"{folder}/{f}", "rb").read() for f in files(folder)} == before and not [d for d in os.listdir(folder) if d.startswith("_drafts")]
    write(capture_records(samples.where("capture_id = 'c1'"), slice_ns=100_000_000), "overwrite")
    assert all(f.startswith("c1-") for f in files(folder)) and capture.opened(source, folder)("samples").count() == 60
    with pytest.raises(Exception, match="records have"):
        samples.write.format("powercapture").mode("append").save(folder)
    with pytest.raises(InvalidRecords):
        capture_records()


def damaged_samples(folder):
    """Every chunk of samples gets a wrong byte."""
    for name in files(folder):
        raw = bytearray(open(f"{folder}/{name}", "rb").read())
        at = capture_file.HEADER_LEN
        while (head := capture_file.read_chunk_header(bytes(raw[at : at + capture_file.CHUNK_LEN]))) is not None:
            if head[0] == capture_file.KINDS["samples"]:
                raw[at + capture_file.CHUNK_LEN + 9] ^= 0x55
            at += capture_file.CHUNK_LEN + head[3]
        with open(f"{folder}/{name}", "wb") as out:
            out.write(bytes(raw))


def test_overviews_need_no_samples(source, tmp_path):
    r = random.Random(4)
    rows = [(c, k, t, r.randint(-500, 90_000), None) for c in ("a", "b") for k, t in enumerate(sorted(r.randrange(0, 12_000_000_000) for _ in range(3000)))]
    samples = source.createDataFrame(rows, SAMPLES)
    folder = str(tmp_path / "out")
    capture_records(samples, slice_ns=1_234_567_891).write.format("powercapture").mode("append").save(folder)
    read = capture.opened(source, folder)
    asked = [(0, 12_000_000_000, 12), (0, 12_000_000_000, 1200), (3_000_000_000, 9_000_000_000, 3), (0, 600_000_000, 60)]
    exact = {a: sorted(map(tuple, buckets.overview(samples, {}, *a).collect())) for a in asked}
    assert sorted(map(tuple, capture.overview_from_files(read, 0, 1_000_000_000, 5000).collect())) == sorted(map(tuple, buckets.overview(samples, {}, 0, 1_000_000_000, 5000).collect()))
    damaged_samples(folder)
    assert read("samples").count() == 0
    for a in asked:
        assert sorted(map(tuple, capture.overview_from_files(read, *a).collect())) == exact[a]
    assert capture.overview_from_files(read, 0, 1_000_000_000, 5000).count() == 0  # finer than any level


def test_stored_levels():
    """Buckets stand at their places from 0 on where a capture begins there; far from 0 only those with samples."""
    t, i = np.array([5, 12, 19, 41], np.int64), np.array([3, -4, 9, 7], np.int32)
    content = capture_file.summary_content(t, i, (10, 40))
    levels, _, width, n = struct.unpack_from("<IIQI", content)
    assert (levels, width, n) == (2, 10, 5)
    assert [c.to_pylist() for c in capture_file.summary_columns(content)] == [[10, 10, 10, 40, 40], [0, 10, 40, 0, 40], [3, -4, 7, -4, 7], [3, 9, 7, 9, 7], [3.0, 2.5, 7.0, 8 / 3, 7.0], [1, 2, 1, 3, 1]]
    far = capture_file.summary_content(t + 10**18, i, (10,))
    assert struct.unpack_from("<I", far, 16)[0] == 3
    assert capture_file.summary_columns(content[:-1]) is None and capture_file.summary_columns(b"") is None


def test_chunks_are_counted(source, tmp_path):
    folder = str(tmp_path / "out")
    capture_records(*rows_of(source), told(source), slice_ns=1 << 62).write.format("powercapture").mode("append").save(folder)
    got = {(r["capture_id"], r["kind"]): (r["chunks"], r["rows"], r["plain"]) for r in capture.chunk_counts(capture.opened(source, folder)("chunks")).collect()}
    assert got["c0", "events"] == (1, 12, 8 + 12 * 16) and got["c0", "samples"][:2] == (5, 60) and ("c2", "metadata") not in got and got["c1", "summary"][0] == 1


def test_a_span_opens_only_files_that_it_meets(source, tmp_path):
    given_rows = rows_of(source, captures=4)
    folder = str(tmp_path / "out")
    capture_records(*given_rows, slice_ns=50_000_000).write.format("powercapture").mode("append").save(folder)
    assert len(files(folder)) > 30
    reader = capture_file.CaptureReader({"kind": "samples", "path": folder})
    reader.low, reader.high = 100_000_000, 120_000_000
    met = {p.rpartition("/")[2] for p, _ in reader.met()}
    assert met == {f"c{c}-2.pprof" for c in range(4)}
    assert sum(len(part.parts) for part in reader.partitions()) == 4
    read = capture.opened(source, folder)
    assert read("samples").where("t_ns >= 100000000 AND t_ns <= 120000000").count() == given_rows[0].where("t_ns >= 100000000 AND t_ns <= 120000000").count() > 0
    os.remove(f"{folder}/c1-2.pprof")
    with open(f"{folder}/c1-2.pprof", "wb") as out:  # not the file that the zone is of
        out.write(capture_file.capture_bytes([capture_file.sample_chunk(np.array([5], np.int64), np.array([1], np.int32), None)]))
    reader = capture_file.CaptureReader({"kind": "samples", "path": folder})
    reader.low, reader.high = 0, 10
    assert {p.rpartition("/")[2] for p, _ in reader.met()} == {*(f"c{c}-0.pprof" for c in range(4)), "c1-2.pprof"}
    write = capture_records(given_rows[0].where("capture_id = 'c0'"), slice_ns=1 << 62).write.format("powercapture")
    write.mode("overwrite").save(folder)
    assert set(capture_file.zones_of(folder)) == {("c0-0.pprof", os.path.getsize(f"{folder}/c0-0.pprof"))}
