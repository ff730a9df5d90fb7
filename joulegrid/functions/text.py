"""Small text functions of reports and generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_identifier(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "_"))


def xml_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def ascii_field(c: Column) -> Column:
    """Text of a fixed-width field: up to the first NUL or non-ASCII byte."""
    return F.regexp_extract(F.decode(c, "ISO-8859-1"), r"^[\x01-\x7F]*", 0)


def gpio_mask(c: Column) -> Column:
    """A pin mask in hex (0x...) or decimal, null if neither."""
    return F.when(c.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(c, 3, 64), 16, 10)).when(c.rlike("^[0-9]+$"), c).cast("bigint")


#: Codes of the protocol's error frames.
ERROR_NAMES = {
    0x0000: "NONE",
    0x0001: "UNSUPPORTED_FRAME",
    0x0002: "BAD_CONFIG",
    0x0003: "NOT_CONFIGURED",
    0x0004: "ALREADY_CAPTURING",
    0x0005: "NOT_CAPTURING",
    0x0010: "BUFFER_OVERFLOW",
    0x0011: "ADC_FAULT",
    0x0012: "OVERCURRENT",
    0x00FF: "INTERNAL",
}


def error_name(code: Column) -> Column:
    """Name of an error code; an unknown one is kept in hex."""
    table = F.create_map(*[F.lit(x) for pair in ERROR_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.format_string("0x%04X", code))
