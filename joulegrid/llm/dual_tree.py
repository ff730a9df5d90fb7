"""Exact top-k inner products by dual-tree search of cover trees.

Distinct vectors are dealt to cells around pivots and cells are cut into shards of bounded size; every shard gets a
cover tree, and so does every block of queries. For a query node and a data node, the largest possible product is at
most <q, d> + |q| R + |d| r + r R, with centres q and d and covering radii r and R; the pair is pruned if that is less
than the worst kth score of the node's queries. The same bound drops whole cells and shards for whole blocks of
queries, once each block has searched its home shard. How much is pruned depends on the data: vectors without clusters
in many dimensions leave nearly all pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulegrid.llm.common import give_back, settle
from joulegrid.llm.vectors import distinct_vectors, fit_width, matrix, nearest_rows, parsed

#: Subtrees of at most so many points are compared as a whole.
LEAF = 64
#: Children of fewer points are compared together with their like.
FEW = 8
#: Products and sums below this are exact in doubles.
EXACT = float(1 << 53)
SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes in arrays; a node's points are order[low:high], its children are kids[first:last] (none for a single point).

    A node of level i stands for its centre in the net of that level: centres of a level are more than 2^i apart, and
    every point is within 2^i of one. radius is the largest distance of its own points from the centre.
    """

    x: np.ndarray
    order: np.ndarray
    centre: np.ndarray
    level: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kids: np.ndarray
    norm: np.ndarray  # of the centres
    largest: float  # norm of any point


def farthest_first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points in an order in which each is the farthest from all before it, and these distances (infinite for the first)."""
    n = len(x)
    square = (x * x).sum(axis=1)
    start = int((square - 2 * x @ x.mean(axis=0)).argmin())
    order, gap = np.zeros(n, np.int64), np.full(n, np.inf)
    order[0] = start
    near = np.maximum(0, square + square[start] - 2 * x @ x[start])
    near[start] = -1
    for k in range(1, n):
        c = int(near.argmax())
        order[k], gap[k] = c, np.sqrt(max(0.0, near[c]))
        np.minimum(near, np.maximum(0, square + square[c] - 2 * x @ x[c]), out=near)
        near[c] = -1
    return order, np.minimum.accumulate(gap)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=1))


def build(x: np.ndarray) -> CoverTree:
    """Nets of a farthest-first order are a cover tree: a prefix is both apart and covering at its last distance.

    A point enters at the level i with 2^i < distance <= 2^(i+1), below the nearest point of the net above.
    """
    n = len(x)
    order, gap = farthest_first(x) if n else (np.zeros(0, np.int64), np.zeros(0))
    enters = np.full(n, np.iinfo(np.int64).max)
    with np.errstate(divide="ignore"):
        enters[1:] = np.where(gap[1:] > 0, np.ceil(np.log2(gap[1:])) - 1, -1100)
    below: dict[int, dict[int, list[int]]] = {}  # point: level: points that enter under it
    for level in np.unique(enters[1:])[::-1].tolist() if n else []:
        these, net = order[enters == level], order[enters > level]
        square = (x[net] ** 2).sum(axis=1)
        parent = net[(square - 2 * x[these] @ x[net].T).argmin(axis=1)]
        for p, c in zip(parent.tolist(), these.tolist(), strict=True):
            below.setdefault(p, {}).setdefault(level, []).append(c)
    nodes: list[list] = []
    children: list[list[int]] = []
    placed: list[int] = []
    # A point without more below it is a leaf; else a node has itself, lower down, and those that enter there.
    stack: list[tuple[int, int, int]] = [(int(order[0]), 0, -1)] if n else []
    while stack:
        point, step, parent = stack.pop()
        if step < 0:
            nodes[point][3] = len(placed)
            continue
        k = len(nodes)
        if parent >= 0:
            children[parent].append(k)
        levels = sorted(below.get(point, {}), reverse=True)
        nodes.append([point, levels[step] + 1 if step < len(levels) else np.iinfo(np.int32).min, len(placed), len(placed) + 1])
        children.append([])
        if step == len(levels):
            placed.append(point)
            continue
        stack.append((k, -1, -1))
        stack += [(c, 0, k) for c in below[point][levels[step]]]
        stack.append((point, step + 1, k))
    table = np.array(nodes, np.int64).reshape(-1, 4)
    at = np.array(placed, np.int64)
    radius = np.array([distances(x[at[low:high]], x[c]).max() if high - low > 1 else 0.0 for c, _, low, high in table.tolist()])
    last = np.cumsum([len(c) for c in children]) if len(children) else np.zeros(0, np.int64)
    kids = np.array([c for some in children for c in some], np.int64)
    norms = np.sqrt((x * x).sum(axis=1))
    return CoverTree(x, at, table[:, 0], table[:, 1], radius, table[:, 2], table[:, 3], last - [len(c) for c in children], last, kids, norms[table[:, 0]], float(norms.max(initial=0)))


class Best:
    """The k best (score, place) of each query; ties go to the vector with the smaller least id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.place = np.full((n, k), -1)
        self.compared = 0

    def worst(self, rows: np.ndarray) -> float:
        """No query of these needs a lower score; ``floor`` is what another shard has shown."""
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def offer(self, rows: np.ndarray, score: np.ndarray, places: np.ndarray, ids: np.ndarray) -> None:
        self.compared += score.size
        some = (score >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]).any(axis=1)
        rows, score = rows[some], score[some]
        if not len(rows):
            return
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, score.shape)], axis=1)
        p = np.concatenate([self.place[rows], np.broadcast_to(places, score.shape)], axis=1)
        # Of many, only those that reach the kth are sorted.
        kth = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
        width = int((s >= kth[:, None]).sum(axis=1).max())
        if 4 * width < s.shape[1]:
            few = np.argpartition(-s, width - 1, axis=1)[:, :width]
            s, i, p = (np.take_along_axis(a, few, 1) for a in (s, i, p))
        top = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.ids[rows], self.place[rows] = (np.take_along_axis(a, top, 1) for a in (s, i, p))


def search(q: CoverTree, d: CoverTree, ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Best k of the data tree for every point of the query tree; ids are the data points' least ids."""
    best = Best(len(q.x), k, floor)
    sizes = d.high - d.low

    def near(centre: np.ndarray, norm: float, radius: float, nodes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Nodes that can hold a score that some of the queries needs, the most promising first."""
        at = d.x[d.centre[nodes]] @ centre + norm * d.radius[nodes] + d.norm[nodes] * radius + radius * d.radius[nodes]
        at += SLACK * (1 + np.abs(at) + (norm + radius) * (d.norm[nodes] + d.radius[nodes]))
        keep = at >= best.worst(rows)
        return nodes[keep][np.argsort(-at[keep], kind="stable")]

    def opened(nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([d.kids[d.first[n] : d.last[n]] if sizes[n] > LEAF else nodes[j : j + 1] for j, n in enumerate(nodes.tolist())]) if len(nodes) else nodes

    def compare(rows: np.ndarray, nodes: np.ndarray) -> None:
        """Queries of one group, with the ball around them, against what is left."""
        centre = q.x[rows].mean(axis=0)
        ball = (centre, float(np.sqrt((centre * centre).sum())), float(distances(q.x[rows], centre).max()))
        while len(nodes):
            nodes = near(*ball, nodes, rows)
            large = sizes[nodes] > LEAF
            if large.any():
                nodes = opened(nodes)
                continue
            some = max(1, int(np.searchsorted(np.cumsum(sizes[nodes]), 256, "right")))
            now, nodes = nodes[:some], nodes[some:]
            places = np.concatenate([d.order[d.low[n] : d.high[n]] for n in now.tolist()]) if len(now) else np.zeros(0, np.int64)
            if len(places):
                best.offer(rows, q.x[rows] @ d.x[places].T, places, ids[places])

    stack = [(0, np.zeros(1, np.int64))] if len(q.x) and len(d.x) else []
    while stack:
        a, nodes = stack.pop()
        rows = q.order[q.low[a] : q.high[a]]
        nodes = near(q.x[q.centre[a]], float(q.norm[a]), float(q.radius[a]), nodes, rows)
        if not len(nodes):
            continue
        if len(rows) <= LEAF:
            compare(rows, nodes)
            continue
        kids = q.kids[q.first[a] : q.last[a]]
        many = q.high[kids] - q.low[kids] > FEW
        nodes = opened(nodes)
        stack += [(c, nodes) for c in kids[many].tolist()]
        # Children of few points go together, up to a leaf's number.
        held: list[np.ndarray] = []
        for c in [*kids[~many].tolist(), -1]:
            part = q.order[q.low[c] : q.high[c]] if c >= 0 else np.zeros(0, np.int64)
            if held and (c < 0 or sum(map(len, held)) + len(part) > LEAF):
                compare(np.concatenate(held), nodes)
                held = []
            held.append(part)
    return best


def search_large(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each row of q the k best (exact product, place), where doubles do not hold the products.

    Products in doubles, with bounds of their error, leave few places, and these are multiplied as Python integers.
    """
    out = []
    length = np.sqrt((d * d).sum(axis=1))
    for row in q:
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.nan_to_num(d @ row, nan=0.0)
            e = np.nan_to_num(length * np.sqrt((row * row).sum()) * (len(row) + 4) * 2.0**-51, posinf=np.inf)
            least = np.sort(np.nan_to_num(s - e, nan=-np.inf))[::-1][min(k, len(s)) - 1]
            some = np.flatnonzero(~(s + e < least))
        exact = [(sum(int(a) * int(b) for a, b in zip(row.tolist(), d[j].tolist(), strict=True)), int(j)) for j in some]
        out.append(sorted(exact, key=lambda t: (-t[0], ids[t[1]]))[:k])
    return out


def pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice, from the first row on."""
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def to_cells(rows: DataFrame, centres: np.ndarray, extra: list[str]) -> DataFrame:
    """Adds the nearest pivot and the distance from it. Pivots are at most as many as were asked for."""
    held = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*[rows.schema[c] for c in ("v", *extra)], T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x, p = matrix(b.column("v").to_pylist(), np.float64), held.value
                width = max(x.shape[1], p.shape[1])
                x, p = fit_width(x, width), fit_width(p, width)
                cell = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
                yield pa.record_batch([*[b.column(c) for c in ("v", *extra)], pa.array(cell.astype(np.int32)), pa.array(distances(x, p[cell]))], ["v", *extra, "cell", "away"])

    return rows.select("v", *extra).mapInArrow(run, schema)


def dealt(rows: DataFrame, size: int) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """Cuts cells into shards of about ``size`` by a hash of the vector; also each cell's first shard and radius.

    Cells are as many as pivots, so their counts are few.
    """
    counts = {r["cell"]: (r["n"], r["away"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    first, total = {}, 0
    for cell in sorted(counts):
        first[cell] = (total, -(-counts[cell][0] // size))
        total += first[cell][1]
    if not total:
        return rows.withColumn("shard", F.lit(0)), {}
    begin = F.create_map(*[F.lit(x) for c, (a, _) in first.items() for x in (c, a)])
    parts = F.create_map(*[F.lit(x) for c, (_, n) in first.items() for x in (c, n)])
    return rows.withColumn("shard", (begin[F.col("cell")] + F.pmod(F.xxhash64("v"), parts[F.col("cell")])).cast("int")), {c: (first[c][0], counts[c][1]) for c in first}


PACKED = "shard int, cell int, n int, centre array<double>, radius double, norm double, tree binary"


def packed(rows: DataFrame, with_ids: bool) -> DataFrame:
    """A row for each shard: its cover tree with vectors (and ids) as bytes, and the ball around its tree's root."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        vs = pdf["v"].tolist()
        tree = build(matrix(vs, np.float64))
        held = (tree, vs, [list(map(int, i)) for i in pdf["ids"]] if with_ids else None)
        centre = tree.x[tree.centre[0]].tolist()
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "n": [len(pdf)], "centre": [centre], "radius": [tree.radius[0]], "norm": [tree.norm[0]], "tree": [pickle.dumps(held, protocol=5)]})

    return settle(rows.groupBy("shard").applyInPandas(run, PACKED))


FOUND = "block int, floors array<double>, hits array<struct<q: binary, score: bigint, ids: array<bigint>>>"
LONG = (1 << 63) - 1


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """block, floors and hits for rows (block, asked, shard, held, floors): a query block, a data shard, what is known.

    hits are the up to k best of each query in the shard, floors the kth score of each, -inf where there are fewer.
    """
    hit = pa.struct([("q", pa.binary()), ("score", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (None, None)
        for b in it:
            for row in range(b.num_rows):
                block, shard, floors = (b.column(c)[row].as_py() for c in ("block", "shard", "floors"))
                q, names, _ = pickle.loads(b.column("asked")[row].as_py())
                if known[0] != shard:
                    d, _, ids = pickle.loads(b.column("held")[row].as_py())
                    known = (shard, (d, ids, np.array([i[0] for i in ids], np.int64)))
                d, ids, least = known[1]
                width = max(q.x.shape[1], d.x.shape[1])
                q.x, d.x = fit_width(q.x, width), fit_width(d.x, width)
                floor = np.array(floors, float) if floors else np.full(len(q.x), -np.inf)
                out: list[dict] = []
                if q.largest * d.largest < EXACT:
                    best = search(q, d, least, k, floor)
                    for r, c in zip(*np.nonzero((best.place >= 0) & (best.score >= floor[:, None])), strict=True):
                        out.append({"q": names[r], "score": int(best.score[r, c]), "ids": ids[best.place[r, c]]})
                    now = best.score[:, -1].tolist()
                else:
                    found = search_large(q.x, d.x, least, k)
                    out = [{"q": names[r], "score": max(-LONG - 1, min(LONG, s)), "ids": ids[j]} for r, rows in enumerate(found) for s, j in rows]
                    now = [-np.inf] * len(found)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([now], pa.list_(pa.float64())), pa.array([out], pa.list_(hit))], ["block", "floors", "hits"])
        give_back()

    return pairs.select("block", "asked", "shard", "held", "floors").mapInArrow(run, FOUND)


def quantised(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles: times 256 is exact, and the largest doubles stay finite."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256 * x), -np.finfo(float).max, np.finfo(float).max)


def ball_bound(qc: Column, qn: Column, qr: Column, dc: Column, dn: Column, dr: Column) -> Column:
    """The largest product of two balls' points, a little more for rounding."""
    none = F.lit(0.0)
    dot = F.aggregate(F.zip_with(qc, dc, lambda a, b: F.coalesce(a, none) * F.coalesce(b, none)), none, lambda s, x: s + x)
    bound = dot + qn * dr + dn * qr + qr * dr
    return bound + SLACK * (1 + F.abs(bound) + (qn + qr) * (dn + dr))


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, shard_rows: int = 4096, query_rows: int = 1024, sample_rows: int = 2048, most_pivots: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of every row whose id is divisible by ``every``.

    Null vectors, vectors with null or non-finite components, and rows without an id take no part; a zero vector does.
    Rows with one id and one vector count once, and so do queries; ties go to the smaller id. Products are exact integers; one that a long does not
    hold is given as the nearest long. Pivots come from about ``sample_rows`` vectors; every vector is indexed and every
    query answered. Shards and blocks have a bounded size, so their numbers grow with the table.
    """
    rows = settle(parsed(embeddings, quantised, False))
    vectors = settle(distinct_vectors(rows, k + 1))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, parts = vectors.count(), 1_000_000
    share = parts if n <= sample_rows else max(1, parts * sample_rows // n)
    sample = sorted(bytes(r["v"]) for r in vectors.where(F.pmod(F.xxhash64("v"), F.lit(parts)) < share).select("v").collect()) or [b""]
    centres = pivots(matrix(sample, np.float64, 1), max(1, min(most_pivots, n // shard_rows)))
    data, cells = dealt(settle(to_cells(vectors, centres, ["ids"])), shard_rows)
    asking, _ = dealt(settle(to_cells(queries.select("v").distinct(), centres, [])), query_rows)
    shards, blocks = packed(data, True), packed(asking, False).withColumnRenamed("shard", "block")

    # Each block first searches one shard of its own cell, or of the cell with the least number.
    held = shards.select("shard", F.col("tree").alias("held"))
    home = F.lit(0)
    if cells:
        home = F.coalesce(F.create_map(*[F.lit(x) for c, (s, _) in cells.items() for x in (c, s)])[F.col("cell")], F.lit(min(s for s, _ in cells.values())))
    asked = blocks.withColumnRenamed("tree", "asked").withColumn("home", home)
    none = F.lit(None).cast("array<double>").alias("floors")
    first = settle(searched(asked.join(held, F.col("home") == F.col("shard")).select("block", "asked", "shard", "held", none), k + 1))

    # Then all others, unless the bound of the two balls is below the block's worst score: cells first (at most
    # most_pivots, broadcast), then the shards of those that are left, joined by their cell.
    table = sorted(cells)
    balls = embeddings.sparkSession.sparkContext.broadcast((table, centres, np.array([cells[c][1] for c in table])))

    def reach(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, centres, radius = balls.value
        for b in it:
            out: list[tuple[int, int]] = []
            for block, centre, r, norm, floor in zip(*(b.column(c).to_pylist() for c in ("block", "centre", "radius", "norm", "worst")), strict=True):
                q = np.array([centre], float)
                width = max(q.shape[1], centres.shape[1])
                p, c = fit_width(centres, width)[table], fit_width(q, width)[0]
                size = np.sqrt((p * p).sum(axis=1))
                bound = p @ c + norm * radius + size * r + r * radius
                bound += SLACK * (1 + np.abs(bound) + (norm + r) * (size + radius))
                out += [(block, table[j]) for j in np.flatnonzero(~(bound < floor)).tolist()]
            columns = zip(*out, strict=True) if out else ((), ())
            yield pa.record_batch([pa.array(c, pa.int32()) for c in columns], ["to", "cell"])

    known = asked.join(first.select("block", "floors"), "block").withColumn("worst", F.array_min("floors"))
    near_cells = known.select("block", "centre", "radius", "norm", "worst").mapInArrow(reach, "to int, cell int")
    there = shards.select("shard", "cell", F.col("centre").alias("c"), F.col("radius").alias("r"), F.col("norm").alias("n"))
    both = near_cells.join(there, "cell").join(known.select("block", "home", "centre", "radius", "norm", "worst"), F.col("to") == F.col("block"))
    bound = ball_bound(*map(F.col, ("centre", "norm", "radius", "c", "n", "r")))
    pairs = both.where((F.col("shard") != F.col("home")) & ~(bound < F.col("worst"))).select("block", "shard")
    # A pair carries its block to the shard; the shard itself moves once, however many blocks ask it.
    wide = max(1, min(8192, shards.count()))
    carried = pairs.join(known.select("block", "asked", "floors"), "block").repartition(wide, "shard")
    rest = searched(carried.join(held.repartition(wide, "shard"), "shard"), k + 1)
    hits = first.select("hits").union(rest.select("hits")).select(F.explode("hits").alias("h")).select("h.*")
    return nearest_rows(hits, queries, k)
