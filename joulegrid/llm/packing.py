"""Best-fit packing of tokenised documents into sequences of fixed length, planned over counts of lengths.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers. Best fit runs over these
counts, longest first, and gives runs of equal bins; each piece then takes its slot by its rank within its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, settle
from joulegrid.llm.tokens import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "plan_length long, first_rank long, n long, first_bin long, offset long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of at most ``capacity`` ids; a longer document's first piece takes the remainder, the others are full.

    A null or empty text is the end id alone. Repeated rows are packed as often as they stand; a null doc_id stays null.
    """

    def make():
        words = word_ids(tokenizer)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist(), end_id), strict=True):
                n, begin, piece = len(ids) // 4, 0, 0
                while begin < n:
                    stop = begin + ((n - begin - 1) % capacity + 1 if piece == 0 else capacity)
                    for column, v in zip(out, (doc, piece, begin, stop - begin, zlib.crc32(ids[4 * begin : 4 * stop])), strict=True):
                        column.append(v)
                    begin, piece = stop, piece + 1
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return work

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, PIECES, "text")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, n, first bin, offset): n pieces of a length go to n bins in a row at one offset.

    Lengths go from long to short. A run of equal pieces fills the open bins with the least room that is enough, and
    then opens new bins, each with as many pieces of the length as fit. Runs of bins with equal content stay together,
    so the work depends on the number of lengths, not of pieces.
    """
    plan, bins = [], 0
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first bin, count)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = min((r for r, runs in open_bins.items() if r >= length and runs), default=None)
            if room is None:
                fit = capacity // length
                new = max(1, left // fit)
                open_bins[capacity].append((bins, new))
                bins += new
                # Fill the new bins level by level, so that each is full of this length before more are opened.
                for level in range(min(fit, left)):
                    first, count = open_bins[capacity - level * length].pop()
                    take = min(count, left)
                    plan.append((length, rank, take, first, level * length))
                    open_bins[capacity - (level + 1) * length].append((first, take))
                    if take < count:
                        open_bins[capacity - level * length].append((first + take, count - take))
                    rank, left = rank + take, left - take
                    if not left:
                        break
                continue
            first, count = open_bins[room].pop()
            take = min(count, left)
            plan.append((length, rank, take, first, capacity - room))
            open_bins[room - length].append((first, take))
            if take < count:
                open_bins[room].append((first + take, count - take))
            rank, left = rank + take, left - take
    return plan


def ranked(pieces: DataFrame, total: int, per_bucket: int = 50_000) -> DataFrame:
    """Rank of each piece within its length, from 0. A length may hold most rows, so ranks are counted in buckets.

    ``row`` numbers the settled pieces, so that equal ones fall in different buckets.
    """
    buckets = max(64, -(-total // per_bucket))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("base"))
    within = W.partitionBy("length", "bucket").orderBy("row")
    return (
        spread.withColumn("local", F.row_number().over(within) - 1)
        .join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("local"))
        .drop("bucket", "local", "base")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, most_broadcast: int = 100_000) -> DataFrame:
    """Pack every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The histogram and the plan have at most a few thousand rows for any input (lengths are bounded by ``capacity``),
    so they pass through the driver and the plan is broadcast, up to ``most_broadcast`` rows.
    """
    spark = docs.sparkSession
    pieces = settle(tokenised_pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_plan(histogram, capacity)
    plan = spark.createDataFrame(runs, PLAN)
    slot = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    return (
        ranked(pieces, sum(histogram.values()))
        .join(F.broadcast(plan) if len(runs) <= most_broadcast else plan, slot)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_bin") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
    )


def fewest_sequences(histogram: dict[int, int], capacity: int) -> int:
    """No packing needs fewer sequences than all tokens over the capacity, or than pieces over half of it."""
    tokens = sum(k * n for k, n in histogram.items())
    return max(-(-tokens // capacity), int(np.sum([n for k, n in histogram.items() if 2 * k > capacity], dtype=np.int64)))
