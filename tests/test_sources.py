"""Frames, capture files, metadata and streams: what goes in comes out, and damage is seen."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulegrid.operators import gaps, pairing
from joulegrid.schemas import EVENT_DEFS, SAMPLES
from joulegrid.sinks import export
from joulegrid.sources import capture_file, metadata, wire
from joulegrid.sources import tables as engine_tables
from joulegrid.streaming import devices, run
from tests.conftest import DATA


def test_cobs_and_crc():
    r = random.Random(2)
    for size in (0, 1, 253, 254, 255, 508, 600, 1024):
        for zeros in (0.0, 0.1, 1.0):
            data = bytes(0 if r.random() < zeros else r.randint(1, 255) for _ in range(size))
            assert b"\0" not in wire.cobs_encode(data) and wire.cobs_decode(wire.cobs_encode(data)) == data
    assert wire.cobs_decode(b"\x05a") is None
    status, kind, seq, payload = wire.opened(wire.frame(0x14, 300, b"x" * 12)[:-1])
    assert (status, kind, seq, payload) == ("ok", 0x14, 44, b"x" * 12)


def stream_of(frames):
    return b"".join(frames)


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_frames_do_not_depend_on_chunks(spark, size):
    r = random.Random(size)
    payload = wire.sample_block([5, 6], [1, -2], [3, 4])
    sent = [wire.frame(0x10, k, payload) for k in range(20)]
    sent[5] = b"\x09\x01\0"  # not COBS
    sent[6] = sent[6][:3] + bytes([sent[6][3] ^ 1 or 2]) + sent[6][4:]
    sent.insert(9, b"\0\0")
    sent.insert(12, b"a" * 3000 + b"\0")
    sent.append(wire.frame(0x55, 20, b"new"))
    sent.append(b"tail without end")
    raw = stream_of(sent)
    chunks = [("d", k, raw[a : a + size]) for k, a in enumerate(range(0, len(raw), size))]
    r.shuffle(chunks)
    decoded = wire.frames(spark.createDataFrame(chunks, "device string, chunk long, bytes binary")).orderBy("arrival").collect()
    assert [x["status"] for x in decoded if x["status"] == "ok"] == ["ok"] * 19
    assert sorted(x["status"] for x in decoded if x["status"] != "ok")[-1] == "oversize" and len(decoded) == 22
    assert [x["seq"] for x in decoded if x["status"] == "ok"][:6] == [0, 1, 2, 3, 4, 7]


def test_blocks_and_counters(spark):
    uniform = wire.sample_block([0xFFFFFFFE], [1, 2, 3], None, 0, 2)
    events = struct.pack("<HHIHI", 1, 10, 7, 0x0101, 64) + b""
    gpio = struct.pack("<HHIH", 1, 0, 9, 0x8001)
    frames = [wire.frame(0x10, 0, uniform), wire.frame(0x11, 1, events), wire.frame(0x12, 3, gpio), wire.frame(0x13, 4, struct.pack("<IHHq", 1, 2, 0, 3)), wire.frame(0x7F, 5, struct.pack("<HHIII", 16, 0, 1, 2, 3)), wire.frame(0x11, 6, b"\1\0\7\0")]
    df = spark.createDataFrame([("d", 0, b"".join(frames))], "device string, chunk long, bytes binary")
    decoded = wire.frames(df)
    assert [(r["ticks"], r["current_ua"], r["voltage_uv"]) for r in wire.samples(decoded).orderBy("record").collect()] == [(0xFFFFFFFE, 1, None), (0, 2, None), (2, 3, None)]
    assert tuple(wire.events(decoded).first())[3:] == (7, 0x0101, 64) and wire.gpio(decoded).first()["state"] == 0x8001
    assert wire.sync(decoded).first()["wrap_count"] == 2 and wire.errors(decoded).first()["code"] == 16
    c = wire.counters(decoded).first()
    assert (c["frames"], c["payload_errors"], c["seq_gaps"]) == (5, 1, 1)


@pytest.fixture(scope="module")
def source(spark):
    capture_file.register(spark)
    return spark


def capture(n=3, finalized=True, compression=1):
    t = np.arange(100, dtype=np.int64) * 20_000
    chunks = [capture_file.sample_chunk(t + k * 2_000_000, np.arange(100) - 50, np.full(100, 3_300_000) if k % 2 else None) for k in range(n)]
    marks = struct.pack("<II", 2, 0) + struct.pack("<QHHI", 5, 0x0101, 1, 9) + struct.pack("<QHHI", 6, 0x0102, 0, 0)
    chunks.append((capture_file.KINDS["events"], marks, 5, 6, 2))
    chunks.append((0x0777, b"of a later version", 2**64 - 1, 2**64 - 1, 0))
    return capture_file.capture_bytes(chunks, compression, finalized=finalized, serial=b"ABC")


@pytest.mark.parametrize("compression", [0, 1, 2])
def test_capture_files(source, tmp_path, compression):
    (tmp_path / "a.pprof").write_bytes(capture(3, True, compression))
    (tmp_path / "b.pprof").write_bytes(capture(2, False, compression))
    read = lambda kind: source.read.format("powercapture").option("kind", kind).option("bytesPerPartition", 400).load(str(tmp_path))
    rows = read("samples").orderBy("capture_id", "seq").collect()
    assert len(rows) == 500 and rows[101]["t_ns"] == 2_020_000 and rows[0]["voltage_uv"] is None and rows[101]["voltage_uv"] == 3_300_000
    assert [(r["id"], r["value"]) for r in read("events").where("capture_id = 'a'").orderBy("seq").collect()] == [(0x0101, 9), (0x0102, None)]
    info = {r["capture_id"]: r for r in read("captures").collect()}
    assert (info["a"]["finalized"], info["a"]["recovered"], info["b"]["recovered"], info["a"]["device_serial"]) == (True, False, True, "ABC")
    assert {r["status"] for r in read("chunks").collect()} == {"ok", "unknown"}
    assert read("samples").where("t_ns >= 4000000").count() == 100


def test_written_captures_keep_known_voltages(source, tmp_path):
    from joulegrid.sinks.capture_writer import write_captures

    rows = [("c", k, 1000 * k, 5 * k, None if k in (3, 7, 8, 19) else 3_000_000 + k) for k in range(20)] + [("d", 0, 0, 1, None), ("d", 1, 10, 2, None)]
    samples = source.createDataFrame(rows, "capture_id string, seq long, t_ns long, current_ua int, voltage_uv long").repartition(3)
    write_captures(samples, str(tmp_path / "out"))
    got = source.read.format("powercapture").option("kind", "samples").load(str(tmp_path / "out"))
    assert sorted(((r["capture_id"][0], r["t_ns"], r["current_ua"], r["voltage_uv"]) for r in got.collect()), key=repr) == sorted(((c, t, i, v) for c, _, t, i, v in rows), key=repr)


def test_damage_costs_a_chunk_and_no_more(source, tmp_path):
    whole = capture(4)
    raw = bytearray(whole)
    raw[capture_file.HEADER_LEN + capture_file.CHUNK_LEN + 3] ^= 1
    (tmp_path / "a.pprof").write_bytes(bytes(raw))
    read = lambda kind: source.read.format("powercapture").option("kind", kind).load(str(tmp_path / "a.pprof"))
    assert read("samples").count() == 300 and read("chunks").where("status = 'corrupt'").count() == 1
    counts = set()
    for cut in range(capture_file.HEADER_LEN, len(whole), len(whole) // 12):
        (tmp_path / "a.pprof").write_bytes(whole[:cut])
        counts.add(read("samples").count())
    assert counts <= {0, 100, 200, 300, 400} and len(counts) > 2
    for bad in (b"", b"x" * 200, b"PPROFCAP" + b"\2" * 200):
        (tmp_path / "a.pprof").write_bytes(bad)
        with pytest.raises(Exception, match="capture|checksum|version"):
            read("samples").count()


TOML = """
[[event]]
name = "TX"
start_id = 0x0101
stop_id = 0x0102
latency_compensation_ns = 10000
[[event]]
name = "PING"
start_id = 0x0110
[notes]
board = "C"
"""


def test_metadata(spark):
    defs, rest = metadata.definitions(spark, TOML)
    assert [tuple(r)[:3] for r in defs.orderBy("start_id").collect()] == [("TX", 257, 258), ("PING", 272, None)] and rest == {"notes": {"board": "C"}}
    stored = b"\xa1\x65event\x81\xa2\x64name\x62TX\x68start_id\x19\x01\x01"
    assert metadata.definitions(spark, stored)[0].first()["start_id"] == 257
    for bad in ("a = [", b"\x01", b"\xa1\x65ev", b"\xff\xff"):
        with pytest.raises((metadata.InvalidMetadata, KeyError)):
            metadata.definitions(spark, bad)
    header = export.c_header(defs)
    assert "#define EVENT_TX_START 0x0101u" in header and "#define EVENT_PING 0x0110u" in header


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("c", k, k * 20_000, -k, 3_300_000) for k in range(5)], SAMPLES)
    rows = export.sample_rows(df, 2).orderBy("seq").collect()
    assert [tuple(r)[2:] for r in rows] == [("0.000000000", "0", "3300000", "0.000"), ("0.000040000", "-2", "3300000", "-6.600"), ("0.000080000", "-4", "3300000", "-13.200")]
    for kind in export.FORMATS:
        export.write(export.sample_rows(df), str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 5
    with pytest.raises(export.UnsupportedFormat):
        export.write(df, str(tmp_path / "v"), "vcd")


def landed(spark, rows, schema, folder, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if False else rows[len(rows) * k // parts : len(rows) * (k + 1) // parts], schema).coalesce(1).write.mode("append").parquet(folder)


def test_streams_equal_batches(spark, tmp_path):
    r = random.Random(8)
    t, rows = 0, []
    for k in range(200):
        t += r.choice([1000, 1000, 1000, 9000])
        rows.append(("c", k, t, 5, 1))
    folder = str(tmp_path / "samples")
    landed(spark, rows, SAMPLES, folder, 4)
    want = sorted(tuple(x) for x in gaps.time_gaps(spark.createDataFrame(rows, SAMPLES), 10**6).select("capture_id", "start_ns", "end_ns", "lost_estimate").collect())
    got = run.drained(devices.time_gaps(spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 4).parquet(folder), 10**6))
    assert sorted(map(tuple, got.collect())) == want
    # In any order: what is closed and what was late are all samples but those of open buckets.
    closed = run.drained(devices.buckets(spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder), 100_000, 0))
    last = max(x[2] for x in rows)
    assert closed.where("NOT late").agg({"count": "sum"}).first()[0] == sum(x[2] - x[2] % 100_000 + 100_000 <= last for x in rows)
    again = run.drained(devices.buckets(run.replayed(spark.createDataFrame(rows[::-1], SAMPLES).withColumn("k", F.lit(200) - F.col("seq")), ["k"], [50, 100]), 100_000, 0))
    assert again.where("late").agg({"count": "sum"}).first()[0] > 100


def test_stream_of_bytes_equals_the_batch(spark):
    r = random.Random(5)
    sent = b"".join(wire.frame(0x10, k % 256, wire.sample_block([k, k + 9], [k, -k], [1, 2])) if k % 7 else bytes(r.randrange(256) for _ in range(r.choice([3, 900, 2600]))) + b"\0" for k in range(150))
    cuts = sorted(r.sample(range(len(sent)), 60))
    parts = [("d", k, sent[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(sent)], strict=True))]
    chunks = spark.createDataFrame(parts, "device string, chunk long, bytes binary")
    whole = [(x["status"], x["type"], x["seq"], x["payload"] and bytes(x["payload"])) for x in wire.frames(chunks).orderBy("arrival").collect()]
    live = run.drained(devices.frames(run.replayed(chunks, ["chunk"], [7, 20, 21, 40])))
    assert [(x["status"], x["type"], x["seq"], x["payload"] and bytes(x["payload"])) for x in live.orderBy("arrival").collect()] == whole


def test_stream_fans_out(spark, tmp_path):
    rows = [("c", k, k, 5, 1) for k in range(10)]
    landed(spark, rows, SAMPLES, str(tmp_path / "in"), 1)
    stream = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    run.finished(run.fan_out(stream, {"low": lambda b: b.where("seq < 4"), "high": lambda b: b.where("seq >= 4")}, str(tmp_path / "out")))
    assert (spark.read.parquet(str(tmp_path / "out/low")).count(), spark.read.parquet(str(tmp_path / "out/high")).count()) == (4, 6)
    assert pairing.marks(spark.createDataFrame([("c", 0, 1, 9, None)], "capture_id string, seq long, t_ns long, id int, value long"), spark.createDataFrame([("P", 9, None, None, None, 0)], EVENT_DEFS)).count() == 0


def test_device_names():
    from joulegrid.sources.uri import Device, InvalidDevice, parse

    assert parse("") == parse("AUTO") == Device("auto")
    assert parse("sim://ble-sensor?seed=1_0&rate=5") == Device("sim", "ble-sensor", {"seed": 10, "rate": 5})
    assert parse("serial:COM7?baud=9600").options == {"baud": 9600} and parse("/dev/ttyACM0").kind == "serial"
    assert parse("tcp://host:90").place == "host:90" and parse("file://a b").place == "a b"
    for bad in ("nothing", "sim://x?rate=0", "sim://x?pace=1", "serial:", "tcp://host", "serial:COM1?baud=x"):
        with pytest.raises(InvalidDevice):
            parse(bad)


def test_budgets_and_reports(spark):
    from joulegrid.plans import analysis, budgets

    tables = analysis.Tables(engine_tables.samples(spark, DATA), engine_tables.events(spark, DATA), engine_tables.event_defs(spark))
    stats = analysis.event_table(tables).checkpoint()
    energy = max(r["energy_nj_mean"] for r in stats.collect()) / 1e9
    made = budgets.rules_from_options(spark, stats, max_energy=f"{2 * energy:.3f} J", min_occurrences=1)
    assert budgets.exit_code(budgets.judged(made, stats)) == 0
    failed = budgets.judged(budgets.rules_from_options(spark, stats, max_energy="1uJ"), stats)
    assert budgets.exit_code(failed) == 1 and "FAIL CLICK_TO_PURCHASE mean_energy_uj" in budgets.as_text(failed)
    assert '"passed": false' in budgets.as_json(failed) and f'failures="{len(failed)}"' in budgets.as_junit(failed)
    worse = stats.withColumn("energy_nj_mean", F.col("energy_nj_mean") * 1.2)
    drift = budgets.rules_from_options(spark, worse, baseline=stats, tolerance="5%")
    assert not budgets.passed(budgets.judged(drift, worse, stats))
    with pytest.raises(budgets.NoRules):
        budgets.rules_from_options(spark, stats)
    assert not budgets.passed([])


def test_lost_samples_are_found(spark):
    rows = [("c", k, k * 20_000, 1, None, k % 40 == 0) for k in range(4000) if k % 40 not in (35, 36, 37, 38, 39)]
    df = spark.createDataFrame(rows, "capture_id string, seq long, t_ns long, current_ua int, voltage_uv long, overflow_before boolean")
    found = gaps.time_gaps(df, 50_000)
    assert {r["cause"] for r in found.collect()} == {"device_overflow"} and found.agg({"lost_estimate": "sum"}).first()[0] == 5 * 99


def test_other_frames(spark):
    info = wire.DEVICE.pack(0x46525050, 0x0100, 1, b"SN1\0x", b"v1", 2**64 - 1, 1_000_000, 50_000, -5, 9, 1, 16, 3, 0)
    sent = [wire.frame(0x02, 0, info), wire.frame(0x01, 1, struct.pack("<HHI", 256, 7, 0)), wire.frame(0x03, 2, struct.pack("<IHHIiII", 1000, 0, 0, 3, -1, 0, 0)), wire.frame(0x11, 3, wire.event_block([(1, 2, None), (3, 4, None)])), wire.frame(0x12, 4, wire.gpio_block([(5, 6)])), wire.frame(0x14, 5, struct.pack("<III", 1, 2, 3))]
    decoded = wire.frames(spark.createDataFrame([("d", 0, b"".join(sent))], "device string, chunk long, bytes binary"))
    d = wire.device_infos(decoded).first()
    assert (d["serial"], d["fw_version"], d["shunt_micro_ohm"], int(d["fw_build_id"]), d["gpio_count"]) == ("SN1", "v1", -5, 2**64 - 1, 16)
    assert wire.hellos(decoded).first()["nonce"] == 7 and wire.configs(decoded).first()["shunt_micro_ohm"] == -1
    assert [(r["ticks"], r["id"], r["value"]) for r in wire.events(decoded).orderBy("record").collect()] == [(1, 2, None), (3, 4, None)]
    assert wire.gpio(decoded).first()["state"] == 6 and wire.markers(decoded).first()["marker_id"] == 2 and wire.unknown(decoded).count() == 0


def test_tables_and_levels(spark, tmp_path):
    from joulegrid.functions import devices as named
    from joulegrid.operators import buckets
    from joulegrid.sinks import tables

    df = spark.createDataFrame([("c", k, k * 10**6, k % 50, 1) for k in range(3000)], SAMPLES)
    seen_df, seen = tables.counted(df, "passed")
    tables.write_samples(seen_df, str(tmp_path / "s"), 10**9, 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3000 and seen.get["rows"] == 3000
    tables.write_levels(df, str(tmp_path / "l"))
    levels = tables.read_levels(spark, str(tmp_path / "l"))
    want = buckets.with_mean(buckets.summary_level(df, 10**9)).select("bucket", "max_ua", "mean_ua", "count")
    assert sorted(map(tuple, buckets.with_mean(levels[10**9]).select("bucket", "max_ua", "mean_ua", "count").collect())) == sorted(map(tuple, want.collect()))
    rows = spark.createDataFrame([(0x2E8A, 10), (1, 2), (None, 3)], "vid int, pid int")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(named.likely_profiler(F.col("vid"), F.col("pid"), [(0x2E8A, 10)])).collect()] == [True, False, False]
    with pytest.raises(named.RateTooHigh):
        named.checked_rate(60_000, 50_000)
