"""What larger tables brought up: sums beyond a long, folders for each capture, calls for each device."""

import os
import pickle
import random
import uuid

import numpy as np

from joulegrid.operators import gaps, names, occurrences
from joulegrid.schemas import EVENT_DEFS, EVENTS, SAMPLES
from joulegrid.sinks import capture_sink, capture_writer, export
from joulegrid.sources import capture_file, wire
from joulegrid.streaming import devices, groups, resolve, run


def test_spans_whose_sum_is_beyond_a_long(spark):
    day, end = 86_400_000_000_000, 4 * 10**18
    samples = [(c, k, t, 10, 3_300_000) for c in "abc" for k, t in enumerate((0, day, end))]
    events = [(c, k, t, i, None) for c in "abc" for k, (t, i) in enumerate(((1, 1), (day + 1, 2)))]
    defs = spark.createDataFrame([("TX", 1, 2, "radio", None, 0)], EVENT_DEFS)
    got = occurrences.event_stats(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(events, EVENTS), defs).first()
    assert (got["occurrences"], got["unsampled"], got["duration_ns_total"]) == (3, 0, 3.0 * day)
    assert got["duty_cycle"] == round(3 * day / (3 * (end + 1)), 9) > 0


def test_devices_of_a_stream_share_calls_and_state(spark):
    rows = [(f"c{c}", k, k * 1000 + c % 7 + 5000 * (k > 2 and c % 3 == 0), 5, 1) for c in range(1500) for k in range(4)]
    samples = spark.createDataFrame(rows, SAMPLES)
    want = sorted(tuple(x) for x in gaps.time_gaps(samples, 10**6).select("capture_id", "start_ns", "end_ns", "lost_estimate").collect())
    found, stream = [], devices.time_gaps(run.replayed(samples, ["seq"], [2, 3]), 10**6)
    query = stream.writeStream.foreachBatch(lambda batch, _: found.extend(map(tuple, batch.collect()))).start()
    query.processAllAvailable()
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    query.stop()
    assert sorted(found) == want and len(want) == 500
    assert 0 < max(held) <= groups.GROUPS < 1500


def test_samples_that_are_kept_apart_resolve_events(spark):
    rows = [("d", "sample", k, k * 1000, k) for k in range(0, 3 * resolve.INLINE, 2)] + [("e", "sample", 0, 7, 0)]
    events = [("d", "event", k, k * 1000 + 1, min(k + 900, 1500)) for k in range(1, 1400, 77)]
    frame = spark.createDataFrame([*rows, *events], "device string, kind string, arrival long, ticks long, landed long")
    got = run.drained(resolve.resolved(run.replayed(frame, ["landed"], [700, 1300]))).collect()
    assert sorted((x["arrival"], x["full_ticks"]) for x in got) == [(e[2], e[3]) for e in events]


def test_exports_of_many_captures_make_few_folders(spark, tmp_path):
    rows = spark.range(3 * export.FOLDERS).selectExpr("CAST(id % 1500 AS STRING) AS capture_id", "id AS seq", "IF(id % 3 = 0, NULL, id) AS value")
    want = sorted(map(tuple, rows.collect()), key=repr)
    for kind in export.FORMATS:
        export.write(rows, str(tmp_path / kind), kind)
        reader = spark.read.schema(rows.schema)
        back = (reader.option("header", True) if kind == "csv" else reader).format(kind).load(str(tmp_path / kind)).select(*rows.columns)
        assert sorted(map(tuple, back.collect()), key=repr) == want
        assert not [x for x in (tmp_path / kind).iterdir() if x.is_dir()]


def test_records_of_many_frames_are_unpacked_together():
    samples = [wire.sample_block([5, 9], [1, -2], [3, 4]), wire.sample_block([], [], None), wire.sample_block([2**32 - 1, 0], [7, 8], None, wire.OVERFLOW_BEFORE, 3), wire.sample_block([4], [6], [2**32 - 1], 0)]
    events = [wire.event_block([(1, 2, None), (3, 4, None)]), wire.event_block([]), wire.event_block([(2**32 - 1, 65535, 2**32 - 1)])]
    pins = [wire.gpio_block([(1, 2), (2**32 - 1, 65535)]), wire.gpio_block([])]
    for payloads, together, one in ((samples, wire.sample_records, wire._samples), (events, wire.event_records, wire._events), (pins, wire.gpio_records, wire._gpio)):
        counts, columns = together(payloads)
        each = [one(p) for p in payloads]
        assert counts.tolist() == [len(x["ticks"]) for x in each]
        for c, found in columns.items():
            assert found.tolist() == [v for x in each for v in x[c].tolist()], c


def test_batches_of_tiny_chunks_are_bounded(tmp_path):
    n = 3 * capture_file.BATCH_CHUNKS
    chunks = [capture_file.sample_chunk(np.array([k * 2**33]), np.array([k]), None) for k in range(n)]
    (tmp_path / "c-0.pprof").write_bytes(capture_file.capture_bytes(chunks))
    reader = capture_file.CaptureReader({"path": str(tmp_path)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) <= capture_file.BATCH_CHUNKS
    assert [i for b in batches for i in b.column("current_ua").to_pylist()] == list(range(n))


def torn_lines(n: int = 400) -> tuple[list[tuple[str, int, bytes]], dict[str, list[bytes]]]:
    """Lines of good, bad, long and empty regions in chunks of any size, and what lies between their delimiters."""
    r = random.Random(7)
    chunks, regions = [], {}
    for device in "ab":
        line = b""
        for k in range(n):
            good = wire.frame(wire.TYPES["MARKER"], k + (k > n // 2), wire.packed("MARKER", {"ticks": k, "marker_id": 1, "value": 2}))
            line += r.choice([good, good, good, b"\t\1\0", b"\0", b"x" * (wire.MAX_ENCODED + r.randrange(3)) + b"\0", wire.frame(0x14, k, b"abc")])
        at = 0
        while at < len(line):
            size = r.choice([0, 1, 1, 2, 3, 30, 400])
            chunks.append((device, len(chunks), line[at : at + size]))
            at += size
        chunks.append((device, len(chunks), b"left over"))
        regions[device] = [x for x in line.split(b"\0")[:-1] if x]
    return chunks, regions


def test_regions_and_counters_do_not_depend_on_slices(spark):
    chunks, want = torn_lines()
    df = spark.createDataFrame(chunks, "device string, chunk long, bytes binary").repartition(5)
    counted = []
    for slice_chunks, arrivals in ((1 << 16, wire.REGIONS << 10), (1, wire.REGIONS), (3, 5 * wire.REGIONS), (64, 1 << 5)):
        got = {d: [] for d in want}
        for x in wire.regions(df, slice_chunks).orderBy("device", "arrival").collect():
            got[x["device"]].append(bytes(x["bytes"]))
        for d, some in want.items():
            assert [x[: wire.MAX_ENCODED + 1] for x in got[d]] == [x[: wire.MAX_ENCODED + 1] for x in some]
        counted.append(sorted(map(tuple, wire.counters(wire.frames(df), arrivals).collect())))
    for (d, some), row in zip(sorted(want.items()), counted[0], strict=True):
        found = [wire.opened(x) for x in some]
        status, seqs = [x[0] for x in found], [x[2] for x in found if x[0] in ("ok", "payload")]
        pairs = lambda v: zip(v[:-1], v[1:], strict=True)
        resyncs, gaps = sum(a != "ok" and b == "ok" for a, b in pairs(status)), sum(b != (a + 1) % 256 for a, b in pairs(seqs))
        assert row == (d, *(status.count(s) for s in ("ok", "cobs", "length", "crc", "payload", "oversize")), resyncs, gaps) and gaps and resyncs
    assert all(x == counted[0] for x in counted)


def test_landed_chunks_are_read_once(spark, tmp_path):
    def seen(it):
        for b in it:
            with open(tmp_path / uuid.uuid4().hex, "w") as f:
                f.write(str(b.num_rows))
            yield b

    chunks, _ = torn_lines(60)
    df = spark.createDataFrame(chunks, "device string, chunk long, bytes binary")
    assert wire.counters(wire.frames(df.mapInArrow(seen, df.schema))).count() == 2
    assert sum(int(x.read_text()) for x in tmp_path.iterdir()) == len(chunks)


def test_blocks_of_a_batch_are_packed_together(spark):
    r = random.Random(3)
    rows = [(d, n, r.randrange(2**32), r.randrange(-(2**31), 2**31), r.randrange(2**32)) for d in "abc" for n in range(100 + ord(d) % 5)]
    df = spark.createDataFrame(rows, "device string, n long, ticks long, current_ua int, voltage_uv long")
    got = {(x["device"], x["chunk"]): bytes(x["bytes"]) for x in wire.encoded_samples(df, 8).collect()}
    blocks = {}
    for d, n, *sample in rows:
        blocks.setdefault((d, n // 8), []).append(sample)
    assert got == {k: wire.frame(wire.TYPES["CURRENT_SAMPLES"], k[1], wire.sample_block(*map(list, zip(*some, strict=True)))) for k, some in blocks.items()}


def test_the_driver_holds_a_few_bytes_of_each_capture_file(tmp_path):
    n = 6000
    for k in range(n):
        (tmp_path / f"{k // 3}-{1408 + k % 3}.pprof").write_bytes(b"")
    reader = capture_file.CaptureReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert sorted(path for p in parts for path, _ in p.parts) == sorted(f"file://{x}" for x in tmp_path.iterdir())
    assert len(pickle.dumps(reader)) < 1000 and sum(len(pickle.dumps(p)) for p in parts) < 20 * n


def test_a_folder_of_many_capture_files_has_subfolders(spark, tmp_path, monkeypatch):
    capture_file.register(spark)
    monkeypatch.setattr(capture_writer, "FOLDER_FILES", 30)
    monkeypatch.setattr(capture_sink, "NOTED", 7)
    folder, at = str(tmp_path / "out"), 100_000_000
    rows = lambda captures, add: [(c, k, k * at, k + add, None) for c in captures for k in range(10)]

    def write(some, overwrite=False):
        records = capture_sink.capture_records(spark.createDataFrame(some, SAMPLES), slice_ns=2 * at).toArrow()
        sink = capture_sink.CaptureSink({"path": folder}, records.schema, overwrite)
        done = [sink.write(iter(records.slice(a, 20).to_batches())) for a in range(0, len(records), 20)]
        assert max(len(pickle.dumps(m)) for m in done) < 500
        sink.commit(done)

    def held():
        right_in = [x.name for x in tmp_path.joinpath("out").iterdir() if x.name.endswith(".pprof")]
        read = spark.read.format("powercapture").load(folder)
        return len(right_in), sorted((r["capture_id"].partition("-")[0], r["t_ns"], r["current_ua"]) for r in read.collect())

    of = lambda some: sorted((c, t, i) for c, _, t, i, _ in some)
    write(rows("abcd", 0))
    assert held() == (20, of(rows("abcd", 0)))
    write(rows("cdefgh", 5))  # a name that is there is written anew, wherever it lies
    assert held() == (0, of(rows("ab", 0) + rows("cdefgh", 5)))
    write(rows("a", 9))
    assert held() == (0, of(rows("a", 9) + rows("b", 0) + rows("cdefgh", 5)))
    reader = capture_file.CaptureReader({"path": folder})
    reader.low, reader.high = 2 * at, 3 * at
    assert {p.rpartition("/")[2] for p, _ in reader.met()} >= {f"{c}-1.pprof" for c in "abcdefgh"}
    noted = [z for place, _ in capture_file.files(folder) for z in capture_file.zones_of(place)]
    assert {f for f, _ in noted} == {f"{c}-{k}.pprof" for c in "abcdefgh" for k in range(5)}
    write(rows("xy", 1), overwrite=True)
    assert held() == (10, of(rows("xy", 1))) and not [x for x in os.listdir(folder) if x.startswith(capture_writer.SUBFOLDER)]
    capture_writer.write_captures(spark.createDataFrame(rows("xabcdefg", 2), SAMPLES), folder, slice_ns=2 * at)
    assert held() == (0, of(rows("xabcdefg", 2) + rows("y", 1)))


def test_definitions_are_read_once_for_starts_and_stops(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    defs = spark.createDataFrame([("a", "X", 1, 2, "s"), ("a", "Y", 3, None, None), ("b", "Z", 1, 3, None)], "capture_id string, name string, start_id int, stop_id int, category string")
    events = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3), ("c", 1)], "capture_id string, id int")
    got = names.with_capture_names(events, defs.mapInArrow(count, defs.schema)).select("capture_id", "id", "name", "category").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "X", "s"), ("a", 2, "X:stop", "s"), ("a", 3, "Y", None), ("b", 2, "0x0002", None), ("b", 3, "Z:stop", None), ("c", 1, "0x0001", None)]
    assert seen.value == 2 * 3  # counted, then joined
