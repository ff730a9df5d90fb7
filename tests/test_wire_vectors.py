"""Published frames of the protocol: every field of each, and the same bytes from the same fields."""

import struct

import pytest

from joulegrid.sources import wire

#: Fixed values of the protocol: a frame of each type as it stands on the wire.
VECTORS = {
    "config": "030318040250C30102040207020F010104A08601010101010101010105541A7B8600",
    "current_samples_explicit": "031024020601020101010101020202010101020103B80B0104A05A32021402010806FFFFFF045B320508B6F82E00",
    "current_samples_uniform": "03102C0205010201021401010204010103B80B0104A05A320378690101034B3204B0300104EC2C320806FFFFFF045B32058266278700",
    "device_info": "0302480601505052460301010857532D30303031010101010101010106312E322E33010101010101010101010CEFCDAB896745230140420F0350C30104A086010440420F02010204020E01010584EE8E0100",
    "error": "037F10030C100202028001010201010101010101058276F69100",
    "event": "031110030702020601010201060101B60301070201A7FD673500",
    "event_with_value": "03110E030801020A0103010104100140010105797F0C2100",
    "gpio_event": "031210030902010101010201020102320201020B0538AF1BE100",
    "hello": "03010801010401415701010105E3AAF3B200",
    "marker": "03140C020B01020102070101022A0101057602195600",
    "start_capture": "0205010603947E938F00",
    "stop_capture": "0206010604D944420300",
    "sync": "031310070A78563412030101062301EFCDAB01010551FA0ECD00",
}
SAMPLES = [(3_000, 3_300_000), (27_000, 3_296_000), (78_000, 3_288_300), (-250, 3_300_100)]
DEVICE = (0x46525050, 0x0100, 1, b"WS-0001", b"1.2.3", 0x0123_4567_89AB_CDEF, 1_000_000, 50_000, 100_000, 1_000_000, 1, 4, 14, 0)


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(name, 0, bytes.fromhex(v)) for name, v in VECTORS.items()]
    return wire.frames(spark.createDataFrame(rows, "device string, chunk long, bytes binary")).checkpoint()


def rows_of(df, name):
    return [tuple(r)[2:] for r in df.where(f"device = '{name}'").orderBy("record").collect()]


def test_every_frame_is_good(decoded):
    got = {r["device"]: (r["status"], r["type"], r["seq"]) for r in decoded.collect()}
    types = {"config": 3, "current_samples_explicit": 16, "current_samples_uniform": 16, "device_info": 2, "error": 127, "event": 17, "event_with_value": 17, "gpio_event": 18, "hello": 1, "marker": 20, "start_capture": 5, "stop_capture": 6, "sync": 19}
    numbers = {"hello": 0, "device_info": 1, "config": 2, "start_capture": 3, "stop_capture": 4, "current_samples_uniform": 5, "current_samples_explicit": 6, "event": 7, "event_with_value": 8, "gpio_event": 9, "sync": 10, "marker": 11, "error": 12}
    assert got == {n: ("ok", types[n], numbers[n]) for n in VECTORS}


def test_every_field(decoded):
    assert rows_of(wire.samples(decoded), "current_samples_explicit") == [(0, 65536, 3000, 3_300_000, False), (1, 65556, -250, 3_300_100, False)]
    assert rows_of(wire.samples(decoded), "current_samples_uniform") == [(k, 65536 + 20 * k, *SAMPLES[k], False) for k in range(4)]
    assert rows_of(wire.events(decoded), "event") == [(0, 65536, 0x0101, None), (1, 65536 + 0x3B6, 0x0102, None)]
    assert rows_of(wire.events(decoded), "event_with_value") == [(0, 65536 + 0x100, 0x0110, 64)]
    assert rows_of(wire.gpio(decoded), "gpio_event") == [(0, 65536, 1), (1, 65586, 11)]
    assert rows_of(wire.sync(decoded), "sync") == [(0, 0x12345678, 3, 0, 0xABCDEF0123)]
    assert rows_of(wire.markers(decoded), "marker") == [(0, 65536, 7, 42)]
    assert rows_of(wire.errors(decoded), "error") == [(0, 16, 2, 128, 1, 0)]
    assert rows_of(wire.hellos(decoded), "hello") == [(0, 0x0100, 0x5741, 0)]
    assert rows_of(wire.configs(decoded), "config") == [(0, 50_000, 4, 7, 15, 100_000, 0, 0)]
    d = wire.device_infos(decoded).where("device = 'device_info'").first()
    assert (d["serial"], d["fw_version"], int(d["fw_build_id"]), d["timer_hz"], d["max_sample_rate_hz"], d["shunt_micro_ohm"], d["adc_full_scale_ua"], d["channel_count"], d["gpio_count"], d["caps"]) == ("WS-0001", "1.2.3", *DEVICE[5:13])


def test_the_same_bytes_from_the_same_fields():
    made = {
        "config": wire.frame(3, 2, struct.pack("<IHHIiII", 50_000, 4, 7, 15, 100_000, 0, 0)), "device_info": wire.frame(2, 1, wire.DEVICE.pack(*DEVICE)),
        "current_samples_uniform": wire.frame(16, 5, wire.sample_block([65536], [i for i, _ in SAMPLES], [v for _, v in SAMPLES], 0, 20)),
        "current_samples_explicit": wire.frame(16, 6, wire.sample_block([65536, 65556], [3000, -250], [3_300_000, 3_300_100])),
        "event": wire.frame(17, 7, wire.event_block([(65536, 0x0101, None), (65536 + 0x3B6, 0x0102, None)])), "event_with_value": wire.frame(17, 8, wire.event_block([(65536 + 0x100, 0x0110, 64)])),
        "gpio_event": wire.frame(18, 9, wire.gpio_block([(65536, 1), (65586, 11)])), "hello": wire.frame(1, 0, struct.pack("<HHI", 0x0100, 0x5741, 0)),
        "sync": wire.frame(19, 10, struct.pack("<IHHq", 0x12345678, 3, 0, 0xABCDEF0123)), "marker": wire.frame(20, 11, struct.pack("<III", 65536, 7, 42)),
        "error": wire.frame(127, 12, struct.pack("<HHIII", 16, 2, 128, 1, 0)), "start_capture": wire.frame(5, 3, b""), "stop_capture": wire.frame(6, 4, b""),
    }
    assert {n: b.hex().upper() for n, b in made.items()} == VECTORS
