"""Vector searches against brute force: ties, copies, nulls, zero vectors, missing and extra components."""

import math

import numpy as np
import pytest

from joulegrid.llm import dual_tree, pruned_graph

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def table(n=700, d=12, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) / 3
    x[50:250] = x[50]  # a third of the rows are copies
    x[300:320] = np.round(x[300:320], 1)
    rows = [(int(k), [float(v) for v in np.float32(x[k])], 0.0, 1) for k in range(n)]
    rows += [(11000, None, 0.0, 1), (11050, [None, 1.0] + [0.0] * (d - 2), 0.0, 1), (11100, [math.nan] * d, 0.0, 1), (11150, [math.inf] * d, 0.0, 1), (11200, [0.0] * d, 0.0, 1), (None, [1.0] * d, 0.0, 1), (11300, [0.5, 0.25], 0.0, 1), (11350, [], 0.0, 1)]
    return rows + rows[:3]  # and some rows come again


def usable(rows, nonzero):
    out = {}
    d = max(len(v) for _, v, *_ in rows if v)
    for i, v, *_ in rows:
        if i is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        a = np.array(v + [0.0] * (d - len(v)), float)
        if nonzero and not a.any():
            continue
        out[i] = a
    return out


def test_top_k_is_exact(spark):
    rows = table()
    held = {i: np.floor(256 * a) for i, a in usable(rows, False).items()}
    want = []
    for q in held:
        if q % 50 == 0:
            scored = sorted((-int(held[q] @ v), i) for i, v in held.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for size, query_rows in ((64, 8), (1024, 1024)):
        got = dual_tree.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, 50, size, query_rows)
        assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0.0, 1), (7, [2.0, 1.0], 0.0, 1)], SCHEMA)
    assert [tuple(r) for r in dual_tree.top_k(few).collect()] == [(0, 1, 7, 262144)]
    assert [tuple(r) for r in pruned_graph.graph_search(few).collect()] == [(0, 1, 7, 4.0)]
    for f in (dual_tree.top_k, pruned_graph.graph_search):
        assert f(few.limit(0)).count() == 0
        assert f(few.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 30, 500])
def test_cover_tree_keeps_its_invariants(n):
    x = np.unique(np.random.default_rng(n).integers(-50, 50, (n, 5)).astype(float), axis=0)
    n = len(x)
    tree = dual_tree.build(x)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    points = lambda k: tree.order[tree.low[k] : tree.high[k]]
    kids = lambda k: tree.kids[tree.first[k] : tree.last[k]]
    assert sorted(tree.order.tolist()) == list(range(n))
    for k in range(len(tree.centre)):
        assert apart[tree.centre[k], points(k)].max() == pytest.approx(tree.radius[k])
        below = kids(k)
        assert (len(below) == 0) == (len(points(k)) == 1)
        if len(below):
            # Nesting: the centre goes on, and the children share the points among them.
            assert tree.centre[k] in tree.centre[below]
            assert sorted(p for c in below for p in points(c)) == sorted(points(k))
            # Covering: a child is within 2^i of its parent of level i.
            assert (apart[tree.centre[k], tree.centre[below]] <= 2.0 ** tree.level[k] + 1e-9).all()
    # Separation: the centres that enter at a level, and all above, are more than 2^i apart.
    enters = {p: np.inf for p in tree.centre[:1].tolist()}
    for k in range(len(tree.centre)):
        enters |= {c: tree.level[k] - 1 for c in tree.centre[kids(k)].tolist() if c != tree.centre[k]}
    for level in set(enters.values()) - {np.inf}:
        net = [p for p, i in enters.items() if i >= level]
        assert apart[np.ix_(net, net)][np.triu_indices(len(net), 1)].min() > 2.0**level - 1e-9


def test_node_pairs_are_pruned_where_data_has_clusters():
    r = np.random.default_rng(5)
    x = np.unique(np.floor(256 * (r.normal(size=(60, 16))[r.integers(0, 60, 4000)] + 0.03 * r.normal(size=(4000, 16)))), axis=0)
    r.shuffle(x)
    q, d = x[:800], x[800:]
    best = dual_tree.search(dual_tree.build(q), dual_tree.build(d), np.arange(len(d)), 6, np.full(len(q), -np.inf))
    assert (best.score == -np.sort(-(q @ d.T), axis=1)[:, :6]).all()
    assert best.compared < 0.4 * len(q) * len(d)


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**30 + 1, 9.0, 0.5]), (1, [2.0**30 + 1, 9.0, -0.5]), (2, [2.0**30 + 1, 9.0 - 2**-8, 0.5]), (50, [1e20, 0.0, 1.0]), (51, [-1e20, 0.0, 1.0]), (52, [0.0, 0.0, 0.0])]
    held = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    want = []
    for q in (0, 50):
        # A score that a long does not hold is the nearest long.
        scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(held[q], v, strict=True)))), i) for i, v in held.items() if i != q]
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(scored, key=lambda t: (-t[0], t[1])))]
    got = dual_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_graph_search_recall(spark):
    rows = table(1500, 12, 1)
    held = usable(rows, True)
    ids = np.array(sorted(held))
    x = np.stack([held[i] for i in ids])
    got = {}
    for r in pruned_graph.graph_search(spark.createDataFrame(rows, SCHEMA), 20, 20, 400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [i for i in ids if i % 20 == 0]
    assert set(got) == set(queries)
    recall = []
    for q in queries:
        scores = np.cumsum(x * held[q], axis=1)[:, -1]
        scores[ids == q] = -np.inf
        kth = np.sort(scores)[-20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        assert all(scores[np.searchsorted(ids, f[1])] == f[2] for f in found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:], strict=False))
        recall.append(np.mean([f[2] >= kth for f in found]))
    assert np.mean(recall) >= 0.9


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 1]])
    kept = pruned_graph.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 0, -1, 1]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]
