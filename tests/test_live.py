"""Live streams end to end: they equal the batch, over any cuts into micro-batches, and over a stop in the middle."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from joulegrid.plans import ingest
from joulegrid.sources import wire
from joulegrid.sources import slices
from joulegrid.streaming import resolve, run, scopes, session

HZ, RATE = 1_000_000, 1000.0
CHUNKS = "device string, chunk long, bytes binary"


def line(r, frames=260):
    """A device's line: samples around the end of the tick range, events before and between them, losses and noise."""
    now, seq, out = (1 << 32) - 90_000, r.randrange(256), []
    send = lambda kind, payload: out.append(wire.frame(wire.TYPES[kind], seq, payload))
    for k in range(frames):
        if r.random() < 0.05:
            seq += r.choice([1, 1, 4])  # lost frames
            now += r.choice([0, 40_000])
        pick = r.random()
        near = (now + r.choice([-900, -70_000, 500])) % (1 << 32)
        if k > 3 and pick < 0.55:
            n = r.choice([0, 1, 2, 5])
            ticks = [(now + 1000 * j) % (1 << 32) for j in range(n)]
            send("CURRENT_SAMPLES", wire.sample_block(ticks, [r.randrange(-9, 99) for _ in ticks], None if r.random() < 0.3 else [3_300_000 + j for j in range(n)], wire.EXPLICIT_TS | (wire.OVERFLOW_BEFORE if r.random() < 0.1 else 0)))
            now += 1000 * n + (8000 if r.random() < 0.06 else 0)
        elif pick < 0.7:
            send("EVENT", wire.event_block([(near, 257, r.choice([None, 5])), ((near + 7) % (1 << 32), 258, None)]))
        elif pick < 0.8:
            send("GPIO_EVENT", wire.gpio_block([(near, k)]))
        elif pick < 0.88:
            send("SYNC", struct.pack("<IHHq", near, 0, 0, 10**15 + k))
        elif pick < 0.92:
            send("ERROR", struct.pack("<HHIII", 16, 0, k, 0, 0))
        elif pick < 0.95:
            send("EVENT", b"\1\0\7\0")  # a payload that contradicts itself
        else:
            out.append(bytes(r.randrange(1, 256) for _ in range(r.choice([3, 40, 1500]))) + b"\0")
            continue
        seq += 1
    return b"".join(out)


def chunks_of(r, devices=3, cuts=40):
    rows = []
    for d in range(devices):
        raw = line(r)
        at = sorted(r.sample(range(len(raw)), cuts))
        rows += [(f"d{d}", k, raw[a:b]) for k, (a, b) in enumerate(zip([0, *at], [*at, len(raw)], strict=True))]
    only = [wire.frame(0x11, k, wire.event_block([(k, 257, None)])) for k in range(3)]  # a device without samples has no origin
    return [*rows, *[("quiet", k, b) for k, b in enumerate(only)]]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def landed(spark):
    rows = chunks_of(random.Random(3))
    chunks = spark.createDataFrame(rows, CHUNKS)
    got = ingest.ingested(chunks, HZ, RATE)
    tables = {k: getattr(got, k) for k in ("samples", "events", "gpio", "sync", "gaps", "counts")}
    return chunks, {k: rows_of(df.select(*session.TABLES[k])) for k, df in tables.items()}


def counted(rows):
    total = {}
    for c, name, n in rows:
        total[c, name] = total.get((c, name), 0) + n
    return {k: v for k, v in total.items() if v}


def test_batch_form(landed):
    _, want = landed
    steps = {r[6] for r in want["samples"]}
    assert "wrap" in steps and len(want["gaps"]) > 5 and {r[4] for r in want["gaps"]} == {"device_overflow", "sequence_gap", "timestamp_jump"}
    assert all(want[k] for k in want) and not any(r[0] == "quiet" for k in ("samples", "events") for r in want[k])


@pytest.mark.parametrize("cuts", [[20], [1, 2, 3, 9, 17, 30]])
def test_sessions_equal_the_batch(spark, landed, cuts):
    chunks, want = landed
    live = run.drained(session.sessions(run.replayed(chunks, ["chunk"], cuts), HZ, RATE))
    for kind in ("samples", "events", "gpio", "sync", "gaps"):
        assert rows_of(session.table(live, kind)) == want[kind], kind
    assert counted(rows_of(session.table(live, "counts"))) == counted(want["counts"])
    assert session.table(live, "errors").count() > 0


def test_a_stop_in_the_middle_loses_and_doubles_nothing(spark, landed, tmp_path):
    chunks, want = landed
    stream = session.sessions(run.replayed(chunks, ["chunk"], [5, 10, 15, 20, 25, 30]), HZ, RATE)
    folder, calls = str(tmp_path / "out"), []

    def broken(batch):
        calls.append(1)
        if len(calls) in (2, 5):
            raise RuntimeError("the power went off")
        return session.table(batch, "gaps")

    sinks = {k: (lambda b, k=k: session.table(b, k)) for k in ("samples", "events", "gpio", "sync")} | {"gaps": broken, "counts": lambda b: session.table(b, "counts")}
    for attempt in range(3):
        query = run.fan_out(stream, sinks, folder)
        if attempt < 2:
            with pytest.raises(Exception, match="power went off"):
                run.finished(query)
        else:
            run.finished(query)
    assert len(calls) == 9  # seven micro-batches, two of them twice
    for kind in ("samples", "events", "gpio", "sync", "gaps"):
        assert rows_of(spark.read.parquet(f"{folder}/{kind}").select(*session.TABLES[kind])) == want[kind], kind
    assert counted(rows_of(spark.read.parquet(f"{folder}/counts").select(*session.TABLES["counts"]))) == counted(want["counts"])


def test_many_regions_in_a_chunk_keep_their_order(spark):
    """Over two million regions in one landed chunk, then more: numbers of one chunk do not run into the next one's."""
    noise = b"\1\0" * ((1 << 21) + 5)
    first, second = wire.frame(0x14, 0, struct.pack("<III", 1, 2, 3)), wire.frame(0x14, 1, struct.pack("<III", 4, 5, 6))
    df = spark.createDataFrame([("d", 0, noise + first), ("d", 1, second)], CHUNKS)
    decoded = wire.frames(df).where("status = 'ok'").orderBy("arrival").collect()
    assert [r["seq"] for r in decoded] == [0, 1] and decoded[0]["arrival"] == (1 << 21) + 5 and decoded[1]["arrival"] == wire.REGIONS
    c = wire.counters(wire.frames(df)).first()
    assert (c["frames"], c["length_errors"], c["seq_gaps"], c["resyncs"]) == (2, (1 << 21) + 5, 0, 1)
    with pytest.raises(Exception, match="numbered from 0"):
        wire.frames(df.withColumn("chunk", F.lit(-1).cast("long"))).count()


# Tables as ordered streams.


def batches_of(stream, folder, stop_after=None):
    """The numbers of each micro-batch, up to a stop."""
    seen = []

    def put(batch, number):
        if stop_after is not None and len(seen) == stop_after:
            raise RuntimeError("stopped")
        seen.append(sorted(r["k"] for r in batch.select("k").collect()))

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").start()
    if stop_after is None:
        run.finished(query)
    else:
        with pytest.raises(Exception, match="stopped"):
            run.finished(query)
    return seen


def test_files_in_any_order_give_ordered_slices(spark, tmp_path):
    rows = spark.range(1000).selectExpr("(id * 619) % 1000 AS k", "timestamp_micros((id * 619) % 1000 * 1000000) AS ts", "array(id) AS other")
    folder = str(tmp_path / "table")
    for part in range(4):  # every file has values from all over
        rows.where(f"other[0] % 4 = {3 - part}").repartitionByRange(3, "k").sortWithinPartitions("k").write.mode("append").parquet(folder)
    for order, length in (("k", 130), ("ts", 130_000_000)):
        found = batches_of(slices.ordered(spark, folder, order, length, progress=str(tmp_path / f"p-{order}")), tmp_path / order)
        assert found == [list(range(a, min(a + 130, 1000))) for a in range(0, 1000, 130)]
    cut = batches_of(slices.ordered(spark, folder, "k", cuts=[10, 500, 2000]), tmp_path / "cuts")
    assert cut == [list(range(10)), list(range(10, 500)), list(range(500, 1000))]


def test_ordered_streams_go_on_after_a_stop(spark, tmp_path):
    folder = str(tmp_path / "table")
    spark.range(100).selectExpr("id AS k").repartition(3).write.parquet(folder)
    stream = slices.ordered(spark, folder, "k", 9, progress=str(tmp_path / "progress"))
    parts = [batches_of(stream, tmp_path, n) for n in (1, 4, None)]
    assert [k for found in parts for batch in found for k in batch] == list(range(100))
    assert all(len(batch) <= 9 for found in parts for batch in found) and len(parts[1]) == 4
    with pytest.raises(Exception, match="began with slices"):
        batches_of(slices.ordered(spark, folder, "k", 10, progress=str(tmp_path / "progress")), tmp_path / "other")


def test_only_row_groups_that_meet_a_slice_are_read(spark, tmp_path):
    folder = str(tmp_path / "table")
    spark.range(0, 40_000).selectExpr("id AS k").repartitionByRange(8, "k").sortWithinPartitions("k").write.option("parquet.block.size", 1 << 13).parquet(folder)
    reader = slices.SliceReader({"path": folder, "order": "k", "sliceLength": "100", "progress": str(tmp_path)}, spark.read.parquet(folder).schema)
    assert reader.initialOffset() == {"end": 0} and reader.latestOffset() == {"end": 100}
    assert len(reader.listed()) >= 8 and reader.ends() == (0, 40_000)
    met = reader.partitions({"end": 20_000}, {"end": 20_100})
    assert sum(len(n) for p in met for _, n in p.parts) <= 2
    assert sum(b.num_rows for p in met for b in reader.read(p)) == 100


# Scopes.


def given_up(marks, patience):
    """Pairs by a stack whose oldest starts go once they are open for longer than allowed."""
    out, stack = [], []
    for seq, t, step in sorted(marks, key=lambda m: (m[1], m[0])):
        while stack and (step == 0 or stack[0][1] + patience < t):
            out.append((*stack.pop(0), None, "unterminated"))
        if step > 0:
            stack.append((seq, t))
        elif step < 0:
            out.append((*stack.pop(), t, "paired") if stack else (seq, None, t, "orphaned"))
    return out, stack


def test_scopes_that_expire(spark):
    r = random.Random(6)
    rows, t = [], 0
    for k in range(600):
        t += r.choice([1, 5, 40]) * 1_000_000
        rows.append((r.choice("ab"), "S", k, t, r.choice([1, 1, 1, -1])))  # mostly starts: without an end the stack would grow
    patience = 300_000_000
    rows += [("a", "S", 600, t + 1_000_000, 0)]
    frame = spark.createDataFrame(rows, "capture_id string, name string, seq long, t_ns long, step int")
    sizes = []
    stream = scopes.pairs(run.replayed(frame, ["t_ns", "seq"], [t * k // 10 for k in range(1, 10)]), patience)
    found = []

    def put(batch, number):
        found.extend(map(tuple, batch.collect()))

    query = stream.writeStream.foreachBatch(put).start()
    query.processAllAvailable()
    sizes = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    query.stop()
    want = []
    for c in "ab":
        closed, still = given_up([x[2:] for x in rows if x[0] == c], patience)
        want += [(c, "S", *x) for x in closed]
        assert c == "b" or not still
    # A timer may have given up what no later row of its own capture has made old.
    extra = [x for x in found if x not in want]
    assert set(want) <= set(found) and all(x[0] == "b" and x[-1] == "unterminated" for x in extra) and len(found) == len(set(found))
    assert max(sizes) < 150 < sum(x[-1] == "unterminated" for x in found)


# Events and epochs.


def test_resolving_in_any_order(spark):
    r = random.Random(9)
    rows, want, epoch, now, near = [], {}, 0, (1 << 32) - 60_000, None
    for k in range(400):
        if k % 4:
            now += r.choice([100, 900])
            rows.append(("d", "sample", k, now % (1 << 32), k))
            near = now
        else:
            ticks = (now + r.choice([-5000, -90_000, 3000])) % (1 << 32)
            rows.append(("d", "event", k, ticks, max(0, k + r.choice([0, 0, -30, 12, 90]))))
            want[k] = session.nearest(ticks, near) if near is not None else ticks
    rows.append(("d", "end", 400, 0, 999))
    frame = spark.createDataFrame(rows, "device string, kind string, arrival long, ticks long, landed long")
    cuts = [50, 100, 140, 200, 260, 300, 350]
    got = run.drained(resolve.resolved(run.replayed(frame, ["landed"], cuts))).collect()
    assert {x["arrival"]: x["full_ticks"] for x in got} == want and len(got) == len(want)
    assert {x["late"] for x in got} == {"no", "late"} and resolve.late_counts(spark.createDataFrame(got)).first()["count"] > 10
    short = run.drained(resolve.resolved(run.replayed(frame, ["landed"], cuts), history=5)).collect()
    assert len(short) == len(want) and {x["late"] for x in short} == {"no", "late", "unknown"}
    assert all(x["full_ticks"] == want[x["arrival"]] for x in short if x["late"] != "unknown")


def test_events_that_nothing_follows_are_released(spark):
    rows = [("d", "sample", 0, 100, 0), ("d", "event", 1, 160, 0), ("x", "sample", 0, 1, 1), ("x", "sample", 2, 2, 2), ("x", "sample", 3, 2, 3), ("x", "sample", 4, 2, 4)]
    frame = spark.createDataFrame(rows, "device string, kind string, arrival long, ticks long, landed long")
    live = run.replayed(frame, ["landed"], [1, 2, 3, 4])
    assert run.drained(resolve.resolved(live)).count() == 0
    found = []
    query = resolve.resolved(live, patience_ms=1).writeStream.foreachBatch(lambda batch, _: found.extend(map(tuple, batch.collect()))).start()
    deadline = time.monotonic() + 60  # with timers of processing time there is always something to come
    while not found and time.monotonic() < deadline:
        time.sleep(0.2)
    query.stop()
    assert found == [("d", 1, 160, 160, "no")]
