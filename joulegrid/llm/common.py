"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulegrid.shared import stored as settle

__all__ = ["batches", "give_back", "id_crc", "read_table", "settle", "sliced"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Let the C library return freed memory at a task's end: workers live on, beside each other and the JVM."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """Texts can be long, so a session that runs these operators sends at most so many rows and bytes to Python at once.

    Spark reads both settings when a query starts, so they stay set in the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, size_of: str | None = None, most: int = 4 << 20
) -> DataFrame:
    """Run ``make()`` once in each task and its result on every Arrow batch, cut to about ``most`` bytes of ``size_of``."""
    small_batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in it:
            for part in sliced(batch, size_of, most):
                out = work(part)
                if out is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, column: str | None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    if column is None or batch.num_rows == 0:
        yield batch
        return
    begin, held = 0, 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for row, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += n
    yield batch.slice(begin)


def id_crc(column: str = "doc_id"):
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
