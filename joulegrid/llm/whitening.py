"""Whitening of embeddings: exact moments, pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Tasks sum the distinct vectors, then their centred products; a row of the scatter matrix is summed over tasks by itself,
so what meets anywhere is bounded by dimensions and tasks, not by rows. The matrix itself, of at most ``MOST_WIDTH``
dimensions, is factored by the driver: A = P L L'P', and rotations from the right make the columns of L orthogonal. Their
squared norms are then A's eigenvalues and the columns, normalised, its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, give_back, settle

#: A matrix of so many dimensions takes 128 MiB.
MOST_WIDTH = 4096
LOW = np.int64((1 << 32) - 1)
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(entries: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as longs; what lies beyond a long becomes the nearest one."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * entries)
    out = np.where(y < 2.0**63, y, 0).clip(-(2.0**63)).astype(np.int64)
    out[y >= 2.0**63] = np.iinfo(np.int64).max
    return out


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v, the entries' whole numbers as bytes, of every row whose vector has finite entries only.

    Trailing zeros are left out, as a shorter vector counts as filled up with zeros. Rows without an id stay.
    """

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, vs = [], []
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                if not x.is_valid or x.values.null_count:
                    continue
                a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(a).all():
                    ids.append(i)
                    vs.append(np.trim_zeros(whole_numbers(a, scale), "b").tobytes())
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(vs, pa.binary())], ["vec_id", "v"])

        return work

    return batches(embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), make, "vec_id long, v binary")


def rows_of(vs: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(vs), width), np.int64)
    for k, v in enumerate(vs):
        part = np.frombuffer(v.as_buffer(), np.int64)
        out[k, : len(part)] = part
    return out


def sums(fit: DataFrame, width: int) -> list[int]:
    """The exact sum of each dimension, in two halves of a long each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in it:
            x = rows_of(b.column("v"), width)
            high += (x >> 32).sum(axis=0)
            low += (x & LOW).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(high), pa.array(low)], ["d", "high", "low"])

    each = fit.mapInArrow(run, "d long, high long, low long").groupBy("d").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    out = [0] * width
    for r in each.collect():
        out[r["d"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


class Centre:
    """Vectors less the mean: its whole part is taken off as longs, so that nothing is lost before the rest is."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total
        self.whole = np.array([t // n for t in total], np.int64)
        self.rest = np.array([float(Fraction(t % n, n)) for t in total])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        near = (np.abs(x) < 2**62).all() and (np.abs(self.whole) < 2**62).all()
        return ((x - self.whole).astype(np.float64) if near else x.astype(np.float64) - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2, exact; None beyond a long.

        Longs wrap around, and a sum that fits is right however its terms wrapped; only sums near the end of a long are
        taken with Python's integers.
        """
        about = (self(x) ** 2).sum(axis=1) * float(self.n) ** 2
        wrapped = lambda t: np.array([(v + 2**63) % 2**64 - 2**63 for v in t], np.int64)
        y = x * wrapped([self.n])[0] - wrapped(self.total)
        exact = (y * y).sum(axis=1)
        out: list[int | None] = exact.tolist()
        for k in np.flatnonzero(about > 2.0**62).tolist():
            v = sum((self.n * a - t) ** 2 for a, t in zip(x[k].tolist(), self.total, strict=True)) if about[k] < 2.0**64 else 2**63
            out[k] = v if v < 2**63 else None
        return out


def covariance(fit: DataFrame, centre: Centre, width: int) -> np.ndarray:
    """Mean of the products of centred entries. Each task adds up its own, each row of the matrix is then summed over tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width))
        for b in it:
            z = centre(rows_of(b.column("v"), width))
            held += z.T @ z
        yield pa.record_batch([pa.array(np.arange(width)), pa.array([r.tobytes() for r in held], pa.binary())], ["d", "part"])
        give_back()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in it:
            for d, part in zip(b.column("d").to_pylist(), b.column("part"), strict=True):
                row = np.frombuffer(part.as_buffer(), np.float64)
                total[d] = total[d] + row if d in total else row
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["d", "part"])

    out = np.zeros((width, width))
    for r in fit.mapInArrow(run, "d long, part binary").repartition("d").mapInArrow(add, "d long, part binary").collect():
        out[r["d"]] = np.frombuffer(r["part"], np.float64)
    return (out + out.T) / (2 * centre.n)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the order of rows: a[order][:, order] = L L', with a column for each dimension that the others leave open."""
    a, n = a.copy(), len(a)
    order, columns, least = np.arange(n), np.zeros((n, n)), n * np.finfo(np.float64).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        rest = a.diagonal()[k:]
        p = k + int(rest.argmax())
        if rest.max() <= least:
            return columns[:, :k], order
        if p != k:
            for m in (a, columns):
                m[[k, p]] = m[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            order[[k, p]] = order[[p, k]]
        columns[k, k] = np.sqrt(a[k, k])
        columns[k + 1 :, k] = a[k + 1 :, k] / columns[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(columns[k + 1 :, k], columns[k + 1 :, k])
    return columns, order


def rotated(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns turned against each other until all are orthogonal, half as many disjoint pairs at once."""
    w = factor.copy()
    r = w.shape[1]
    if r < 2:
        return w
    seats = list(range(r)) + [-1] * (r % 2)
    half = len(seats) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = np.array([p for p in zip(seats[:half], reversed(seats[half:]), strict=True) if -1 not in p])
            i, j = pairs.min(axis=1), pairs.max(axis=1)
            x, y = w[:, i], w[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            wide = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if wide.any():
                turned = True
                i, j, x, y, xx, yy, xy = i[wide], j[wide], x[:, wide], y[:, wide], xx[wide], yy[wide], xy[wide]
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                w[:, i], w[:, j] = c * x - c * t * y, c * t * x + c * y
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not turned:
            break
    return w


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues above zero of a covariance, and unit eigenvectors as rows."""
    factor, order = pivoted_cholesky(v)
    w = rotated(factor)
    values = (w * w).sum(axis=0)
    falling = np.argsort(-values, kind="stable")
    falling = falling[values[falling] > 0]
    out = np.zeros((len(falling), len(v)))
    out[:, order] = (w[:, falling] / np.sqrt(values[falling])).T
    return values[falling], out


def identity_error(fit: DataFrame, centre: Centre, turn: np.ndarray, width: int) -> float:
    """Largest entry of the covariance of whitened vectors less the identity."""
    k = len(turn)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = [f"m{i}" for i in range(k)] + [f"c{i}_{j}" for i, j in pairs]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in it:
            w = centre(rows_of(b.column("v"), width)) @ turn.T
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.record_batch([pa.array([float(x)]) for x in [*first, *(second[p] for p in pairs)]], names)

    row = fit.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    mean = [row[f"m{i}"] / centre.n for i in range(k)]
    return max((abs(row[f"c{i}_{j}"] / centre.n - mean[i] * mean[j] - (i == j)) for i, j in pairs), default=0.0)


def whiten(embeddings: DataFrame, components: int = 4, scale: float = 256.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row and each of the first components.

    Rows with a null vector, a null entry or one that is not finite take no part; repeated rows and rows without an id
    stay rows of their own, while a vector counts once for the fit. An entry's whole number beyond a long becomes the
    nearest long; a deviation beyond a long is null. Components without variance have no whitened value and are left
    out, so a table whose vectors are all alike, or without any, gives no rows. Columns other than vec_id and embedding
    are not read. Vectors of over ``MOST_WIDTH`` dimensions are refused.
    """
    rows = settle(quantised(embeddings, scale))
    fit = settle(rows.groupBy("v").agg(F.count("*").alias("times")).select("v"))
    size = fit.agg(F.count("*").alias("n"), F.max(F.length("v")).alias("bytes")).first()
    n, width = size["n"], (size["bytes"] or 0) // 8
    if width > MOST_WIDTH:
        raise ValueError(f"vectors have {width} dimensions; at most {MOST_WIDTH} are whitened")
    empty = rows.sparkSession.createDataFrame([], OUT)
    if not width:
        return empty
    centre = Centre(n, sums(fit, width))
    v = covariance(fit, centre, width)
    values, axes = principal(v)
    k = min(components, len(values))
    if not k:
        return empty
    turn = axes[:k] / np.sqrt(values[:k])[:, None]
    explained = [float(x / v.trace()) for x in values[:k]]
    error = identity_error(fit, centre, turn, width)

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            x = rows_of(b.column("v"), width)
            m = len(x)
            return pa.record_batch(
                [
                    pa.array(np.repeat(np.arange(m), k)) if not m else b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array([d for d in centre.deviation(x) for _ in range(k)], pa.int64()), pa.array((centre(x) @ turn.T).ravel()),
                    pa.array(np.tile(np.array(explained), m)), pa.array(np.full(m * k, error)),
                ],
                [c.split(" ")[0] for c in OUT.split(", ")],
            )

        return work

    return batches(rows, make, OUT)
