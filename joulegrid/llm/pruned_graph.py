"""Approximate nearest neighbours by largest inner product, with a robust-pruned directed graph in every shard.

Distinct vectors are dealt to shards by hash. A shard's graph starts random; then greedy searches from the medoid
propose neighbours for every point, and relaxed distance pruning keeps a diverse few: a candidate goes if a kept one is
``alpha`` times nearer to it than the point is. Reverse edges are added and pruned alike. Vectors get one more
component that makes all norms equal, so nearness by distance is nearness by inner product. Blocks of queries search
every shard by beam search, many queries in step, and the best of all shards are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import give_back, settle
from joulegrid.llm.vectors import distinct_vectors, fit_width, matrix, nearest_rows, parsed


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of the ``beam`` best that each query meets, best first; -1 where it met fewer.

    In a step every query opens its ``width`` best unopened places at once.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for no place
    place = np.full((m, beam), n)
    score = np.full((m, beam), -np.inf)
    opened = np.ones((m, beam), bool)
    place[:, 0], score[:, 0], opened[:, 0], seen[:, entry] = entry, q @ x[entry], False, True
    on = np.arange(m)
    while len(on):
        p, s, o = place[on], score[on], opened[on]
        todo = np.argsort(o, axis=1, kind="stable")[:, :width]  # places are sorted, so these are the best unopened
        cur = np.where(np.take_along_axis(o, todo, 1), n, np.take_along_axis(p, todo, 1))
        np.put_along_axis(o, todo, True, 1)
        near = np.where((cur < n)[:, :, None], graph[np.minimum(cur, n - 1)], n).reshape(len(on), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[on[:, None], near], n, near)
        seen[on[:, None], near] = True
        fresh = np.where(near < n, np.einsum("mkd,md->mk", x[np.minimum(near, n - 1)], q[on]), -np.inf)
        p, s, o = np.concatenate([p, near], axis=1), np.concatenate([s, fresh], axis=1), np.concatenate([o, near == n], axis=1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        place[on], score[on], opened[on] = (np.take_along_axis(a, top, 1) for a in (p, s, o))
        on = on[~opened[on].all(axis=1)]
    return np.where(place < n, place, -1), score


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each point out of its candidates (-1 for none), the nearest first, at most ``degree``."""
    n = len(points)
    valid = (candidates >= 0) & (candidates != points[:, None])
    order = np.sort(np.where(valid, candidates, -1), axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    valid = order >= 0
    y = x[np.maximum(order, 0)]
    d = np.where(valid, ((y - x[points][:, None]) ** 2).sum(axis=2), np.inf)
    square = (y * y).sum(axis=2)
    between = np.maximum(0, square[:, :, None] + square[:, None, :] - 2 * np.matmul(y, y.transpose(0, 2, 1)))
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(degree):
        best = d.argmin(axis=1)
        some = np.isfinite(d[rows, best])
        if not some.any():
            break
        out[some, k] = order[rows, best][some]
        gone = alpha * alpha * between[rows, best] <= d
        gone[rows, best] = True
        d = np.where(gone & some[:, None], np.inf, d)
    return out


def build_graph(x: np.ndarray, degree: int = 24, beam: int = 40, alpha: float = 1.2, batch: int = 256) -> tuple[np.ndarray, int]:
    """Edges (as many columns as ``degree``; the number of points stands for none) and the medoid."""
    n = len(x)
    rng = np.random.default_rng(11)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = rng.integers(0, n, (n, min(degree, 12)))
    graph = np.pad(graph, ((0, 0), (0, degree - graph.shape[1])), constant_values=n)
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for begin in range(0, n, batch):
            points = order[begin : begin + batch]
            # Nearness among vectors of equal norm: the product with the point itself.
            met = beam_search(x, graph, entry, x[points], beam)[0]
            own = np.where(graph[points] < n, graph[points], -1)
            kept = robust_prune(x, points, np.concatenate([met, own], axis=1), degree, relax)
            graph[points] = np.where(kept >= 0, kept, n)
            back = pd.DataFrame({"to": kept.ravel(), "of": np.repeat(points, degree)})
            back = back[back["to"] >= 0].sort_values("to", kind="stable")
            target, first, counts = np.unique(back["to"].to_numpy(), return_index=True, return_counts=True)
            wide = np.full((len(target), int(counts.max(initial=0))), -1)
            wide[np.repeat(np.arange(len(target)), counts), np.arange(len(back)) - np.repeat(first, counts)] = back["of"].to_numpy()
            for some in np.array_split(np.arange(len(target)), max(1, -(-len(target) // batch))):
                t = target[some]
                both = np.concatenate([np.where(graph[t] < n, graph[t], -1), wide[some]], axis=1)
                pruned = robust_prune(x, t, both, degree, relax)
                graph[t] = np.where(pruned >= 0, pruned, n)
    return graph, entry


def level(x: np.ndarray) -> np.ndarray:
    """One more component, so that all norms are equal."""
    squares = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(0, squares.max(initial=0) - squares))[:, None]], axis=1)


def measured(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(q * x, axis=1)[:, -1] if q.shape[1] else np.zeros(len(q))


def graph_search(embeddings: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 4096, query_rows: int = 1024, degree: int = 24, beam: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``; repeated rows count once.

    Null and zero vectors, vectors with null or non-finite components, and rows without an id take no part; ties go to the
    smaller id. Every distinct vector is in a graph, and every query searches all graphs, keeping ``beam`` places in each. Shards and
    blocks of queries have a bounded size, so their numbers grow with the table; ``shard_rows`` may be raised for large
    ones, as a search of a larger graph costs little more.
    """
    rows = settle(parsed(embeddings, lambda a: a, True))
    vectors = settle(distinct_vectors(rows, k + 1))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    shards = max(1, -(-vectors.count() // shard_rows))
    asked = queries.select("v").distinct()
    blocks = max(1, -(-asked.count() // query_rows))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        x = matrix(pdf["v"].tolist(), np.float64)
        graph, entry = build_graph(level(x), degree)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "index": [pickle.dumps((x, graph, entry, [list(map(int, i)) for i in pdf["ids"]]), protocol=5)]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "queries": [pickle.dumps(sorted(pdf["v"].tolist()), protocol=5)]})

    graphs = settle(vectors.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(index, "shard int, index binary"))
    asking = settle(asked.withColumn("block", F.pmod(F.xxhash64("v", F.lit(2)), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(block, "block int, queries binary"))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (None, None)
        for b in it:
            for row in range(b.num_rows):
                shard = b.column("shard")[row].as_py()
                if known[0] != shard:
                    known = (shard, pickle.loads(b.column("index")[row].as_py()))
                x, graph, entry, ids = known[1]
                vs = pickle.loads(b.column("queries")[row].as_py())
                q = matrix(vs, np.float64)
                width = max(x.shape[1], q.shape[1])
                x, q = fit_width(x, width), fit_width(q, width)
                place = np.concatenate([beam_search(x, graph, entry, q[a : a + 256], max(beam, k + 1))[0] for a in range(0, len(q), 256)])
                r, c = np.nonzero(place >= 0)
                at = place[r, c]
                score = measured(q[r], x[at])
                least = np.array([i[0] for i in ids])[at]
                order = np.lexsort((least, -score, r))
                r, at, score = r[order], at[order], score[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                keep = rank <= k
                yield pa.record_batch([pa.array([vs[i] for i in r[keep]], pa.binary()), pa.array(score[keep]), pa.array([ids[i] for i in at[keep]], pa.list_(pa.int64()))], ["q", "score", "ids"])
        give_back()

    # Every block meets every shard: a block's row goes to each, and a shard moves once, however many blocks there are.
    wide = max(1, min(8192, shards))
    spread = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(wide, "shard")
    pairs = spread.join(graphs.repartition(wide, "shard"), "shard")
    return nearest_rows(pairs.select("shard", "index", "queries").mapInArrow(search, "q binary, score double, ids array<long>"), queries, k)
