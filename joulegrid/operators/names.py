"""Event ids and their names, and the checks of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid.operators.pairing import broadcast_if_small


class InvalidDefinitions(ValueError):
    """Definitions that contradict themselves or one another."""


def hex_id(c: Column) -> Column:
    return F.format_string("0x%04X", c)


def id_names(defs: DataFrame) -> DataFrame:
    """(id, name) of all declared ids; a stop id's name ends in ``:stop``."""
    starts = defs.select(F.col("start_id").alias("id"), "name")
    stops = defs.where("stop_id IS NOT NULL").select(F.col("stop_id").alias("id"), F.concat("name", F.lit(":stop")).alias("name"))
    return starts.unionByName(stops)


def with_names(events: DataFrame, defs: DataFrame) -> DataFrame:
    """Events with their names, or the id in hex where it is undeclared."""
    return events.join(broadcast_if_small(id_names(defs)), "id", "left").withColumn("name", F.coalesce("name", hex_id(F.col("id"))))


def with_capture_names(events: DataFrame, defs: DataFrame) -> DataFrame:
    """Events with the names that their own capture declares, and the category; ids that it does not declare in hex.

    ``defs`` has a row for each definition of each capture, so it grows with captures and is broadcast only while small.
    """
    both = F.array(F.struct(F.col("start_id").alias("id"), "name"), F.struct(F.col("stop_id").alias("id"), F.concat("name", F.lit(":stop")).alias("name")))
    ids = defs.select("capture_id", "category", F.explode(both).alias("e")).select("capture_id", "e.*", "category").where("id IS NOT NULL")
    named = events.join(broadcast_if_small(ids), ["capture_id", "id"], "left")
    return named.withColumn("name", F.coalesce("name", hex_id(F.col("id"))))


def undeclared(events: DataFrame, defs: DataFrame) -> DataFrame:
    return events.join(broadcast_if_small(id_names(defs)), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n")).withColumn("name", hex_id(F.col("id")))


def id_properties(c: Column) -> dict[str, Column]:
    """0 is no id; ids from 0xFF00 on are the firmware's own; the high byte is the category."""
    return {"valid": c != 0, "internal": c >= 0xFF00, "category": F.shiftright(c, 8)}


def problems(defs: DataFrame) -> DataFrame:
    """(name, problem) for each definition that cannot stand."""
    claims = id_names(defs).withColumn("name", F.regexp_replace("name", ":stop$", ""))
    twice = claims.groupBy("id").agg(F.countDistinct("name").alias("n"), F.min("name").alias("name")).where("n > 1").select("name", F.lit("id claimed twice").alias("problem"))
    said = [
        defs.where("name IS NULL OR trim(name) = ''").select("name", F.lit("empty name").alias("problem")),
        defs.where("start_id = 0 OR stop_id = 0").select("name", F.lit("id 0").alias("problem")),
        defs.where("start_id = stop_id").select("name", F.lit("start is stop").alias("problem")),
        defs.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate name").alias("problem")),
    ]
    for more in said:
        twice = twice.unionByName(more)
    return twice


def validated(defs: DataFrame) -> DataFrame:
    found = problems(defs).limit(5).collect()
    if found:
        raise InvalidDefinitions("; ".join(f"{r['name']}: {r['problem']}" for r in found))
    return defs


def pin_level(state: Column, pin: int) -> Column:
    """Level of one pin in a 16-pin snapshot."""
    return F.shiftright(state, pin).bitwiseAND(F.lit(1))


def first_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("capture_id", "id").agg(F.min("t_ns").alias("first_ns"))
