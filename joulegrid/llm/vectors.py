"""What both vector searches share: parsing, distinct vectors with their least ids, and merging of partial results.

Copies of a vector score alike, so a search looks at distinct vectors. Of a vector's rows only the k + 1 with the least
ids can be among any query's k nearest (one may be the query itself), so no more are carried; rank limits are applied
within tasks before the shuffle, and a vector with a third of all rows reaches its group as a few rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joulegrid.llm.common import batches


def parsed(embeddings: DataFrame, convert: Callable[[np.ndarray], np.ndarray], nonzero: bool) -> DataFrame:
    """vec_id and v, the converted components as bytes.

    Null vectors and those with null or non-finite components take no part, nor do null ids; with ``nonzero`` neither
    do zero vectors. Shorter vectors count as filled up with zeros, so trailing zeros are left out of the bytes.
    """

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, vs = [], []
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(a).all() or (nonzero and not a.any()):
                    continue
                a = np.trim_zeros(convert(a) + 0, "b")  # adding zero makes a negative zero positive
                ids.append(i)
                vs.append(a.tobytes())
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(vs, pa.binary())], ["vec_id", "v"])

        return work

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return batches(rows, make, "vec_id long, v binary")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """v and ids, the ``keep`` least distinct ids of each vector in order."""
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    once = rows.groupBy("v", "vec_id").agg(F.lit(1).alias("one"))
    return once.withColumn("r", first).where(F.col("r") <= keep).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(vs: list[bytes], dtype: type, width: int | None = None) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the widest or to ``width``."""
    parts = [np.frombuffer(v, dtype) for v in vs]
    out = np.zeros((len(parts), max([width or 0, *map(len, parts)])), dtype)
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
    return out


def fit_width(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def nearest_rows(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from (q, score, ids) hits and (vec_id, v) query rows.

    Each hit is a distinct vector; its rows are its ids. A query's own id is left out, ties go to the smaller id.
    """
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = found.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    own = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(rows, "q")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(own).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
