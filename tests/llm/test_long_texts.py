"""Texts of hundreds of kilobytes go whole through the operators, and classes of thousands of near copies keep one text."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from joulegrid.llm import lexicon_bpe, near_copies, packing, seekable, simhash

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
r = random.Random(8)
WORDS = ["".join(r.choice(["an", "thé", "ing", "er", "ou", "st"]) for _ in range(r.randint(1, 5))) for _ in range(4000)]
TEXTS = [" ".join(r.choice(WORDS) for _ in range(60_000)), "short text", "x" * 200_000 + " end", "\n".join(r.choice(WORDS) for _ in range(30_000))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def test_tokens_of_long_texts(docs):
    library = Tokenizer.from_file(BYTE)
    got = {}
    for p in packing.pack(docs, BYTE).collect():
        got.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"]))
    for k, text in enumerate(TEXTS):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert sum(n for _, n, _ in got[k]) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in got[k])


def test_round_trips_of_long_texts(docs):
    library = Tokenizer.from_file(WORD)
    want = []
    for k, text in enumerate(TEXTS):
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, lexicon_bpe.round_trip_digests(docs, WORD, 500).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
    start, files = 0, []
    for k, text in enumerate(TEXTS):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        files.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, seekable.token_files(docs, WORD, 1).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == files


def test_fingerprints_of_long_texts(docs):
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(docs, 2, 3).collect()}
    assert got == {k: (f"{simhash.fingerprint(t, 3):016x}", k) for k, t in enumerate(TEXTS)}


def test_a_class_of_thousands_keeps_one(spark):
    base = [r.choice(WORDS) for _ in range(120)]
    rows = []
    for k in range(3000):  # each with one word of its own: any two share 0.84 of their five-word shingles or more
        words = list(base)
        words[r.randrange(120)] = f"own{k}"
        rows.append((k, " ".join(words)))
    rows += [(5000 + k, " ".join(r.choice(WORDS) for _ in range(90))) for k in range(50)] + [(6000, None), (6001, ""), (6002, TEXTS[0])]
    kept = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 26, 5, Fraction(4, 5))
    ids = sorted(x["doc_id"] for x in kept.collect())
    assert ids == [0, *range(5000, 5050), 6000, 6002]
