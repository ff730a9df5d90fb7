"""Models and searches against plain re-computations that share no code with them but the fixed definitions."""

import math
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from joulegrid.llm import langid, near_copies, privacy, quality, toxic_features, toxicity
from tests.conftest import DATA

WORDS = {
    "en": "the and of a house river green walks over slowly morning light stone bridge".split(),
    "de": "der und von ein haus fluss grün geht über langsam morgen licht stein brücke".split(),
    "ru": "и дом река зелёный идёт через медленно утро свет камень мост большой".split(),
}


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(3)
    rows = []
    for k in range(240):
        lang = ("en", "de", "ru")[k % 3]
        text = " ".join(r.choice(WORDS[lang]) for _ in range(r.choice([1, 3, 12, 60])))
        rows.append((k, text if k % 17 else text.upper() + " 1234 !?", lang if k % 11 else None))
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34", "en"), (903, rows[5][1], "de"), (904, "the house " * 30_000, "en"), (None, "the house", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), rows


def plain_grams(text, buckets):
    """Buckets of all bigrams and trigrams whose second character is a letter."""
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} "]
    out, mask, shift = [], 2**64 - 1, 64 - buckets.bit_length() + 1
    for k in range(1, len(low) - 1):
        if f" {text} "[k].isalpha():
            a, b, c = (ord(x) for x in low[k - 1 : k + 2])
            out += [(((a << 21 | b) * 0x9E3779B97F4A7C15) & mask) >> shift, (((a << 42 | b << 21 | c | 1 << 63) * 0x9E3779B97F4A7C15) & mask) >> shift]
    return out


def test_language_equals_plain_naive_bayes(spark, tongues):
    df, rows = tongues
    buckets, smoothing = 1 << 12, 0.1
    got = {r["doc_id"]: r for r in langid.identify(df, buckets=buckets, smoothing=smoothing).collect()}
    import zlib

    learn = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and i is not None and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({lang for _, lang in learn})
    counts = {lang: [0] * buckets for lang in langs}
    for t, lang in learn:
        for g in plain_grams(t, buckets):
            counts[lang][g] += 1
    logs = {lang: [math.log((n + smoothing) / (sum(c) + smoothing * buckets)) for n in c] for lang, c in counts.items()}
    prior = {lang: math.log(sum(x == lang for _, x in learn) / len(learn)) for lang in langs}
    for i, t, _ in rows:
        grams = plain_grams(t or "", buckets)
        r = got[i]
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        score = {lang: prior[lang] + sum(logs[lang][g] for g in grams) for lang in langs}
        best = max(langs, key=score.get)
        odds = sum(math.exp(v - score[best]) for v in score.values())
        assert r["score"] == pytest.approx(1 / odds, rel=1e-6)
        if odds < 1.99:
            assert r["lang_pred"] == best


def plain_features(text, lexicon):
    """The dense features by loops over characters and words."""
    kind = lambda c: unicodedata.category(c)
    upper, lower = sum(kind(c) in ("Lu", "Lt") for c in text), sum(kind(c) == "Ll" for c in text)
    marks, digits = sum(kind(c)[0] in "PS" for c in text), sum(kind(c) == "Nd" for c in text)
    words = re.findall(r"[^\W_]+", text.lower())
    weight = lambda w: max([lexicon.get(w, 0.0), *(lexicon.get(w[:n] + "-", 0.0) for n in (4, 5, 6, 7) if len(w) > n)])
    hits = [(k, w) for k, w in enumerate(words) if weight(w) > 0]
    second = [k for k, w in enumerate(words) if w in toxic_features.SECOND]
    n, chars = max(1, len(words)), max(1, len(text))
    capital = [w for w in re.findall(r"[^\W_]+", text) if len(w) > 1 and w.isupper()] if upper else []
    weights = [weight(w) for _, w in hits]
    return [
        len(hits) / n, sum(weights) / n, max(weights, default=0.0), len(hits), sum(weights), len({w for _, w in hits}), sum(x >= 2 for x in weights),
        len(second) / n, sum(any(abs(k - j) <= 5 for j in second) for k, _ in hits) / n, upper / max(1, upper + lower), len(capital) / n,
        sum(weight(w.lower()) > 0 for w in capital) if hits else 0, text.count("!") / chars, text.count("?") / chars, marks / chars,
        len(re.findall(r"[!?.,;:*#%$&]{2,}", text)) / n, len(re.findall(r"[A-Za-z][0-9@$*!]+[A-Za-z]", text)) / n, len(re.findall(r"([a-z])\1\1", text.lower())) / n,
        digits / chars, math.log1p(len(words)), sum(map(len, words)) / n,
    ]


def test_toxic_features_equal_plain_ones():
    lexicon = {"idiot": 2.5, "stup-": 1.5, "дурак": 2.0, "stupid": 3.0}
    r = random.Random(1)
    texts = ["", "YOU IDIOT!!! you st0pid stupidity", "ТЫ ДУРАК, дурак… «ты»", "日本語、テスト。123", "ÀÉ àé ß ª µ ×÷", "aaa bbb you idiot you", "😀😀 идёт ЛЕС"]
    texts += ["".join(r.choice("aA ß!9дД。idiot you") for _ in range(60)) for _ in range(60)]
    made = toxic_features.Features(lexicon)
    for t in texts:
        assert made.of(t) == pytest.approx(plain_features(t, lexicon)), t
    assert made.of(None) == made.of("")
    prose = "это обычный русский текст без всякой пунктуации и заглавных букв"
    assert made.of(prose)[14] == 0 and made.of(prose.upper())[9] == 1.0


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(8)
    clean = lambda: " ".join(r.choice(WORDS["en"]) for _ in range(30))
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        text = clean() + (" you " + r.choice(["vilefool", "dumbrat"]) + "!!!" if toxic else ".")
        rows.append((k, text, int(not toxic), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(1000, None), (1001, ""), (1002, "stone " * 60_000), (3, rows[3][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_equals_trees_and_calibration_by_hand(spark, judged):
    docs, labels = judged
    model = toxicity.train(docs, labels)
    assert model.trees is not None and model.calibration is not None
    got = {(r["doc_id"], r["score"]) for r in toxicity.scored(model, docs, "text", "score").collect()}
    from pyspark.ml.linalg import Vectors

    places, values = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    want = set()
    texts = docs.distinct().where("doc_id % 7 = 0 OR doc_id >= 1000").collect()
    for r in texts:
        x = Vectors.dense(plain_features(r["text"] or "", model.lexicon))
        margin = sum(w * t.predict(x) for t, w in zip(model.trees.trees, model.trees.treeWeights, strict=True))
        want.add((r["doc_id"], min(1.0, max(0.0, float(np.interp(1 / (1 + math.exp(-2 * margin)), places, values))))))
    for i, s in want:
        assert any(i == j and s == pytest.approx(v, abs=1e-9) for j, v in got), i


def plain_attention(model, passages):
    """The gated attention by loops over passages."""
    w = model.weights
    hidden = [np.tanh(np.clip((x - model.mean) / model.scale, -5, 5) @ w["W"] + w["b"]) for x in passages]
    raw = [float((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"]) for h in hidden]
    total = sum(math.exp(x) for x in raw)
    z = sum(math.exp(x) / total * h for x, h in zip(raw, hidden, strict=True))
    return 1 / (1 + math.exp(-float(z @ w["c"] + w["d"])))


def test_quality_equals_plain_attention(spark, judged):
    docs, labels = judged
    model = quality.train(docs, labels)
    table = quality.class_table()
    texts = [r["text"] for r in docs.where("doc_id % 50 = 0 OR doc_id > 999").collect()] + ["one! Two\nthree? 4,5\tsix " * 90, "ж" * 2000, "a b"]
    got = quality.score(model, texts, table)
    for t, s in zip(texts, got, strict=True):
        parts = [(t or "")[k : k + 512] for k in range(0, max(1, len(t or "")), 512)]
        x, counts = quality.encode([t], table)
        assert counts[0] == len(parts)
        assert s == pytest.approx(plain_attention(model, x), abs=1e-5)
        kinds = [[int(table[ord(c)]) for c in p] for p in parts]
        for row, (k, of) in zip(x[:3], enumerate(kinds[:3]), strict=False):
            follow = of + (kinds[k + 1][:1] if k + 1 < len(kinds) else [int(table[10])])  # each text ends with a line feed
            pairs = np.zeros(256)
            for a, b in zip(follow, follow[1:], strict=False):
                pairs[16 * a + b] += 1
            assert row[:256] == pytest.approx(np.sqrt(pairs / max(1, pairs.sum())), abs=1e-6)


def test_added_spans_equal_plain_search(spark):
    r = random.Random(2)
    secret = lambda n: "".join(r.choice("abcdefABCDEF0123456789") for _ in range(n))
    parts = [
        "password: " + secret(32), "token=" + "x" * 260 + "7", "call (030) 555 1234 now", "ssn 123-45-6789", "card 4111 1111 1111 1112", "mail a" + "b" * 80 + " [at] host [dot] example [dot] org [dot] uk [dot] eu [dot] x1",
        "Dr Anna Schmidt", "iban DE89 3704 0044 0532 0130 00", "no numbers here", "a.b@c.org", "version 1.2.3.4", "abcdefghijklmnopqrstuvwxyz", "joe (at) site (dot) com",
    ]
    texts = [" ; ".join(r.choice(parts) for _ in range(r.choice([1, 3, 12]))) for _ in range(150)] + ["", None]
    model = privacy.train(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    chars = r"[A-Za-z0-9_/+-]"
    at, dot, label = r" ?[\[(]at[\])] ?", r" ?[\[(]dot[\])] ?", r"[A-Za-z0-9-]+"
    plain = {
        "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|0?[0-9]{2,4})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "national": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "secret": rf"(?<!{chars}){chars}{{20,}}(?!{chars})", "email": rf"[A-Za-z0-9._%+-]+{at}{label}(?:{dot}{label})+",
    }
    added = 0
    for t in texts:
        base, every = privacy.spans(t, model)
        if not t:
            assert every == []
            continue
        found = [("card", a, b) for a, b in privacy.base_spans(t)[1]]
        for kind, pattern in plain.items():
            found += [(kind, *m.span()) for m in re.finditer(pattern, t) if kind != "secret" or re.search("[0-9]", m.group())]
        found += [("person", *m.span()) for m in re.finditer(r"(?<![^\W_])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?", t)]
        taken = [(a, b) for _, a, b in base]
        want = list(base)
        for kind, a, b in sorted(found, key=lambda c: (privacy.KINDS.index(c[0]), c[1])):
            x = np.array(privacy.describe(kind, t, a, b)[1])
            if 1 / (1 + math.exp(-float(model.weights @ x))) >= 0.5 and all(b <= y or z <= a for y, z in taken):
                want.append((privacy.KINDS.index(kind), a, b))
                taken.append((a, b))
        assert sorted(want) == every, t
        added += len(every) - len(base)
    assert added > 50


def test_near_copies_against_all_pairs(spark):
    """Every pair of the given documents with a Jaccard similarity of 0.8 or more of its five-word shingles; none below."""
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    r = random.Random(4)
    next_id = 10**6
    planted = []
    for _, t in r.sample([x for x in rows if x[1] and 60 < len(x[1].split()) < 400], 120):  # a few words of a copy are changed
        words = t.split()
        for k in r.sample(range(len(words)), max(1, round(len(words) * r.choice([0.005, 0.01, 0.015, 0.02])))):
            words[k] = words[k] + "q"
        planted.append((next_id, " ".join(words)))
        next_id += 1
    rows = [(i, t) for i, t in rows + planted if t and t.split()]
    sets = {}
    for i, t in rows:
        w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t).strip("\x20\x09\x0a\x0b\x0c\x0d"))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    ids = sorted(sets)
    by_shingle: dict = {}
    for i in ids:
        for g in sets[i]:
            by_shingle.setdefault(g, []).append(i)
    pairs = {(a, b) for held in by_shingle.values() if len(held) > 1 for k, b in enumerate(held) for a in held[:k]}
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    true = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in true:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    want = {i: root(i) for i in ids}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked = near_copies.wide_fingerprints(df)
    held = near_copies.verified_classes(df, marked, near_copies.near_copy_classes(marked, 30))
    got = {r["doc_id"]: r["component_id"] for r in marked.join(held, near_copies.MARKS).collect()}
    differ = [(a, b) for a, b in true if sets[a] != sets[b]]
    assert len(differ) > 60
    assert sum(got[a] == got[b] for a, b in differ) >= 0.95 * len(differ)
    assert all(want[i] == want[got[i]] for i in ids)  # nothing is joined that has no chain of true pairs
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, DATA).select("doc_id").collect()}
    assert kept == set(got.values())


def test_long_and_tied_texts(spark):
    rows = [(k, "alpha beta", "en" if k % 2 else "de") for k in range(40)] + [(100, "alpha " * 200_000, "en"), (101, "x" * 1_500_000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len({(r["lang_pred"], r["score"]) for k, r in got.items() if k < 40}) == 1 and all(0 <= r["score"] <= 1 for r in got.values())
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        found = module.classify(df, labels).collect()
        assert len({r["score"] for r in found if r["doc_id"] < 40}) == 1 and all(0 <= r["score"] <= 1 for r in found) and len(found) == 42
    assert df.where(F.length("text") > 10**6).count() == 2


def test_an_id_in_many_rows_is_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, 100, 7, 6).collect()
    assert sorted((r["text"], r["label"]) for r in got) == [("b", 0.0), ("text 0", 1.0)]
