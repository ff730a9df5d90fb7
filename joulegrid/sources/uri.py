"""Names of devices: what a text such as ``sim://ble-sensor?seed=7`` or ``serial:/dev/ttyACM0`` asks for."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARAMETERS = {"sim": ("rate", "seed", "faults"), "serial": ("baud",), "tcp": (), "file": (), "auto": ()}
WHOLE = ("rate", "seed", "baud")


class InvalidDevice(ValueError):
    """A text that names no device, or parameters that its kind does not have."""


@dataclass(frozen=True)
class Device:
    kind: str
    place: str = ""
    options: dict[str, int | bool] = field(default_factory=dict)


def parsed(text: Column) -> Column:
    """kind and place of each text, null where it names no device."""

    @F.pandas_udf("kind string, place string")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                d = parse(t or "")
                out.append((d.kind, d.place))
            except InvalidDevice:
                out.append((None, None))
        return pd.DataFrame(out, columns=["kind", "place"])

    return read(text)


def parse(text: str) -> Device:
    text = text.strip()
    if not text or text.lower() == "auto":
        return Device("auto")
    for kind, prefix in (("tcp", "tcp://"), ("sim", "sim://"), ("file", "file://"), ("serial", "serial:")):
        if text.startswith(prefix):
            rest = text[len(prefix) :]
            break
    else:
        kind, rest = ("serial", text) if text.startswith("/dev/") or text.upper().startswith("COM") else ("", "")
    if not kind:
        raise InvalidDevice(f"{text!r} names no device")
    place, _, query = (rest.lstrip("/") if kind == "serial" and rest.startswith("//") else rest).partition("?") if kind != "file" else (rest, "", "")
    options: dict[str, int | bool] = {}
    for k, v in parse_qsl(query, keep_blank_values=True):
        if k not in PARAMETERS[kind]:
            raise InvalidDevice(f"{kind} has no parameter {k!r}")
        if k in WHOLE and not v.replace("_", "").isdigit():
            raise InvalidDevice(f"{k} is a whole number")
        options[k] = int(v.replace("_", "")) if k in WHOLE else v not in ("0", "false", "False")
    if kind == "sim":
        place = place or "ble-sensor"
        if options.get("rate", 1) == 0:
            raise InvalidDevice("rate is at least 1 Hz")
    if kind in ("tcp", "serial", "file") and not place:
        raise InvalidDevice(f"{kind} needs a place")
    if kind == "tcp" and not place.rpartition(":")[2].isdigit():
        raise InvalidDevice("tcp needs host:port")
    return Device(kind, place, options)
