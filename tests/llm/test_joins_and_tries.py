"""The n-gram join, whitening and the prefix trie against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from joulegrid.llm import prefix_trie, token_groups, whitening
from joulegrid.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < 3 else zip(words, words[1:], words[2:], strict=False))


def joined(rows, num=9, den=10):
    """doc_id, size and component by comparing all sets that share anything."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        met = Counter(j for x in s for j in holders[x])
        for j, both in met.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                above[top(k)] = top(j)
        for x in s:
            holders[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = top(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, len(sets[k]), least[top(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def edited(r, words, times, vocabulary):
    out = list(words)
    for _ in range(times):
        k = r.randrange(len(out))
        if r.random() < 0.5:
            out[k] = r.choice(vocabulary)
        elif r.random() < 0.5 or len(out) == 1:
            out.insert(k, r.choice(vocabulary))
        else:
            del out[k]
    return out


def texts(seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(300)]
    rows = []
    for size in (1, 2, 3, 9, 10, 12, 20, 21, 40, 100, 300):
        for _ in range(3):
            base = [r.choice(vocabulary) for _ in range(size)]
            for k in range(9):
                words = edited(r, base, r.choice([0, 1, 1, 2, size // 40, size // 25]), vocabulary)
                rows.append((len(rows), (" ".join(words).upper() if k % 5 == 4 else "\t\n".join(words)).replace("É", "é")))
    passage = [r.choice(vocabulary) for _ in range(120)]  # shared by many, linking none
    rows += [(len(rows) + k, " ".join(passage + [r.choice(vocabulary) for _ in range(60)])) for k in range(60)]
    copies = [r.choice(vocabulary) for _ in range(80)]  # a third of the rows, in part copies, in part near ones
    rows += [(len(rows) + k, " ".join(edited(r, copies, k % 2, vocabulary))) for k in range(200)]
    long = [f"long{k}" for k in range(60_000)]
    rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(long[:55_000])), (len(rows) + 2, " ".join(long[:50_000]))]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (None, rows[0][1]), (None, "no id here"), rows[3], rows[3]]
    return rows


def test_join_loses_no_link(spark):
    rows = texts()
    df = spark.createDataFrame([(*x, "n", 7) for x in rows], "doc_id long, text string, name string, size int").repartition(5)
    got = token_groups.jaccard_join(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == joined(rows)


def test_join_at_another_similarity(spark):
    rows = [x for x in texts(1) if x[0] is not None and len(x[1] or "") < 3000]
    got = token_groups.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), Fraction(7, 10))
    assert sorted(map(tuple, got.collect()), key=repr) == joined(rows, 7, 10)


def test_join_of_few_rows(spark):
    schema = "doc_id long, text string"
    assert token_groups.jaccard_join(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in token_groups.jaccard_join(spark.createDataFrame([(5, None)], schema)).collect()] == [(5, 0, 5)]


@pytest.mark.parametrize("least", [Fraction(9, 10), Fraction(3, 4), Fraction(1, 2)])
def test_partners_share_a_kept_signature(least):
    """Any two sets at the similarity have one in common: of any sizes, where many parts are empty, and whichever are the frequent ones."""
    r, sign = np.random.default_rng(2), token_groups.Signatures(least)

    def kept(tokens, salt):
        found, of = sign(tokens)
        order = sorted(range(len(found)), key=lambda k: hash((int(found[k]), salt)))
        left = {0: [], 1: []}
        for k in order:
            left[int(of[k]) // 16].append((int(of[k]) % 16, int(found[k])))
        return {x for side in left.values() for n, (drop, x) in enumerate(side) if n >= drop}

    tried = 0
    for _ in range(900):
        n = int(r.integers(1, 90))
        a = np.unique(r.choice(2**40, n, replace=False).astype(np.uint64) * np.uint64(977 if n % 2 else 1 << 20))
        b = np.unique(np.concatenate([a[int(r.integers(0, n // 4 + 1)) :], r.choice(2**40, int(r.integers(0, n // 4 + 1)), replace=False).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and both < max(len(a), len(b)) and both * least.denominator >= least.numerator * (len(a) + len(b) - both):
            tried += 1
            assert all(kept(a, salt) & kept(b, salt) for salt in range(3))
    assert tried > 50


def test_filter_passes_all_that_is_wanted(spark):
    ids = [*range(0, 90_000, 7), -(2**63), 2**63 - 1]
    bits = token_groups.wanted_filter(spark.createDataFrame([(i,) for i in [*ids, None]], "wanted long"))
    passed = lambda x: np.logical_and.reduce([(bits[at >> 3] >> (at & 7)) & 1 for at in token_groups.places(np.array(x, np.int64))])
    assert passed(ids).all() and passed([k for k in range(90_000) if k % 7]).sum() < 30


def test_group_bound_and_partners():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    g = token_groups.Group.of(list(range(30)), sets)
    assert all((g.member(k) == sets[k]).all() for k in range(30))
    for q in (*sets[:5], np.arange(1000, 1010, dtype=np.uint64), np.zeros(0, np.uint64)):
        want = [k for k, s in enumerate(sets) if len(q) and 10 * len(np.intersect1d(q, s)) >= 6 * len(np.union1d(q, s))]
        assert g.partners(q, Fraction(6, 10)).tolist() == want


# Whitening.


def vectors(n=600, d=9, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) @ np.diag(np.linspace(1, 0.2, d)) + r.normal(size=d)
    x[40:240] = x[40]
    rows = [(k, [float(v) for v in x[k]]) for k in range(n)]
    rows += [(n, None), (n + 1, [None] + [0.5] * (d - 1)), (n + 2, [math.nan] * d), (n + 3, [math.inf] * d), (n + 4, [0.25, -0.25]), (n + 5, []), (None, [1.0] * d)]
    return rows + rows[:3]


def whitened(rows, components=4):
    d = max(len(v) for _, v in rows if v)
    kept = [(i, [int(math.floor(256 * c)) for c in v] + [0] * (d - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array(fit, float) - np.array(total) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    return kept, n, total, values, axes


def test_whitening_against_eigenvectors(spark):
    rows = vectors()
    kept, n, total, values, axes = whitened(rows)
    df = spark.createDataFrame([(*x, 0.5, 1) for x in rows], "vec_id long, embedding array<double>, v double, n int").repartition(4)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 4 * len(kept) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    for k in range(4):
        assert np.allclose(got.loc[got["component"] == k + 1, "explained"], values[k] / values.sum(), rtol=1e-12)
    dev = {i: sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for i, x in kept}
    one = got[got["component"] == 1]
    assert all(dev[None if math.isnan(i) else int(i)] == v for i, v in zip(one["vec_id"].astype(float), one["deviation"], strict=True))
    want = {i: (np.array(x) - np.array(total) / n) @ axes[:, :4] / np.sqrt(values[:4]) for i, x in kept}
    sign = np.ones(4)
    for i, part in got.dropna(subset=["vec_id"]).groupby("vec_id"):
        row = part.sort_values("component")["whitened"].to_numpy()[-4:] if len(part) == 4 else part.drop_duplicates("component").sort_values("component")["whitened"].to_numpy()
        if i == 0:
            sign = np.sign(row * want[0])
        assert np.allclose(row * sign, want[int(i)], atol=1e-9)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(0, None)], [(0, [])], [(0, [1.0, 2.0]), (1, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [k / 256, 3 * k / 256]) for k in range(5)], schema)).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1) and np.allclose(sorted(np.abs(line["whitened"])), [0, *[math.sqrt(0.5)] * 2, *[math.sqrt(2)] * 2])


def test_factor_and_rotation():
    r = np.random.default_rng(5)
    for n, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (33, 33)):
        b = r.normal(size=(n, rank)) * 10.0 ** r.integers(-3, 3, rank)
        a = b @ b.T
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-10 * a.max())
        values, axes = whitening.principal(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], rtol=1e-9, atol=1e-12 * a.max())
        assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-9)
    assert len(whitening.principal(np.zeros((3, 3)))[0]) == 0


def test_exact_deviations_and_limits():
    x = np.array([[0, 5], [2**40, -3], [2**62, 2**62]], np.int64)
    centre = whitening.Centre(3, [int(c) for c in x.sum(axis=0, dtype=object)])
    want = [sum((3 * int(a) - t) ** 2 for a, t in zip(row, centre.total, strict=True)) for row in x]
    assert centre.deviation(x) == [w if w < 2**63 else None for w in want]
    small = np.array([[3, 1], [4, 1], [9, 2]], np.int64)
    centre = whitening.Centre(3, [16, 4])
    assert centre.deviation(small) == [50, 17, 125]
    assert whitening.whole_numbers(np.array([1e300, -1e300, -0.001]), 256).tolist() == [2**63 - 1, -(2**63), -1]


# The trie.


def nodes(rows, h_of=lambda c: zlib.crc32(str(c).encode()) % 6):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08x}"
            conversations[c].append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in conversations.items()}
    rebuilt = {c: tuple(own.get(c - int(math.fmod(c, 100)), [])[: h_of(c)] + turns[h_of(c) :]) for c, turns in own.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, p in rebuilt.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def talks(seed=0):
    r = random.Random(seed)
    rows = []
    for c in (None, *range(-150, 500)):
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([None, 0, 1, 2, 3, 3]), r.choice([None, "", "user", "bot"]), r.choice([None, "", "x", "é" * 3, "yy\n"])))
    for c in range(1000, 1700):  # a third of the conversations are one
        rows += [(c, 0, "user", "same"), (c, 1, "bot", "same too")]
    rows += [(2003, k, "user", f"turn {k} " + "long " * 500) for k in range(300)]  # and one is long
    return rows + rows[:5]


def test_trie_against_brute_force(spark):
    rows = talks()
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    got = prefix_trie.trie(df.repartition(6), shard_rows=100)
    assert got.columns == prefix_trie.OUT
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[1], r[0])) == nodes(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    only = [(lone, 0, "user", "gone")]  # its first turns come from a conversation that is not there
    assert [tuple(r) for r in prefix_trie.trie(spark.createDataFrame(only, schema)).collect()] == nodes(only) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_ids_of_a_node_in_parts():
    """Ids that pass on in several parts, from several shards, hash like the joined list."""
    path, tail = "a" * 32 + "00000003", "b" * 32 + "00000001"
    ids = list(range(60_000))
    for splitters in ([], [path]):
        shard = prefix_trie.Shard(prefix_trie.Skeleton(splitters), 0)
        for c in ids:
            shard.add(path, c)
        shard.add(path + tail, 70_000)
        shard.end()
        joined_ids = ",".join(map(str, ids)).encode()
        if splitters:
            parts = [r[-1] for r in shard.rows if r[0] == "ends" and r[1] == 1]
            assert len(parts) > 1 and ",".join(parts).encode() == joined_ids
        else:
            assert next(r for r in shard.rows if r[0] == "node" and r[5] == 1)[-1] == hashlib.sha256(joined_ids).hexdigest()


@pytest.mark.parametrize("name", ["op11_token_group_join", "op13_splitter_skeleton_trie"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
