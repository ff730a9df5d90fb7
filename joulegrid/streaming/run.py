"""Running streams: replay of tables in order, draining into Parquet, and a fan-out of one stream into several tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from joulegrid.shared import new_folder
from joulegrid.sources.slices import ordered


def replay(spark: SparkSession, path: str, order: str, slices: int = 12) -> DataFrame:
    """A Parquet table as it stands as a stream of ``slices`` micro-batches at most, in order of a column; nothing is copied."""
    return ordered(spark, path, order, count=slices)


def replayed(rows: DataFrame, order: list[str], cuts: list[int] | None = None, batch_rows: int = 1_000_000) -> DataFrame:
    """Rows as a stream of micro-batches in order, each a stretch of the first column of ``order``.

    The stretches end at ``cuts``, or at the column's quantiles with about ``batch_rows`` in each. Rows are written once,
    range partitioned, so a stretch reads the row groups that meet it.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "replay")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(folder)
    if cuts is None:
        written = spark.read.schema(rows.schema).parquet(folder)
        n = max(1, -(-written.count() // batch_rows))
        cuts = written.approxQuantile(order[0], [k / n for k in range(1, n)], 0.5 / n) if n > 1 else []
    return ordered(spark, folder, order[0], cuts=sorted({int(c) for c in cuts}))


def finished(query: StreamingQuery) -> None:
    """Wait until a query has gone through all input there is now, and stop it; what it failed with is raised.

    Timers of processing time keep a query going for ever, so one that has them is to be stopped by who started it.
    """
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is now, written to the shared folder and read back."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    finished(stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").start())
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> StreamingQuery:
    """Start a query that writes each micro-batch to several tables. A batch that runs again overwrites its own part.

    So a batch that failed between two tables, or whose end was not noted, leaves nothing twice; ``finished`` waits for it.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, of in sinks.items():
            of(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").start()
