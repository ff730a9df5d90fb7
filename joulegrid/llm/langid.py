"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every character is the middle of a trigram and the end of a bigram; n-grams whose place holds no letter are left out.
Counts by language and bucket come from a bounded sample of labelled documents; the log-probability matrix (buckets by
languages) is broadcast, and batches are scored sparsely in numpy: gather rows of the matrix, sum them by document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, id_crc

UNKNOWN = "und"
#: Bytes of text in a batch: numbers for each character take some hundred times as much.
SMALL = 1 << 19


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: log P(bucket | language)
    prior: np.ndarray


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case (space for what is no letter)."""
    known = np.zeros(0x110000, bool)
    lower = np.full(0x110000, 0x20, np.uint32)
    for begin, end in ((0, 0xD800), (0xE000, 0x33480), (0xE0000, 0xE0200)):
        for c in range(begin, end):
            ch = chr(c)
            if ch.isalpha():
                known[c] = True
                low = ch.lower()
                lower[c] = ord(low) if len(low) == 1 else c
    return known, lower


def grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts in order, and how many each text has. buckets is a power of two."""
    known, lower = letters()
    joined = "".join(f" {t or ''} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), sizes)
    low = lower[codes]
    at = np.flatnonzero(known[codes])
    a, b, c = low[at - 1].astype(np.uint64), low[at].astype(np.uint64), low[np.minimum(at + 1, len(low) - 1)].astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    two = ((a << np.uint64(21)) | b) * mix
    three = ((a << np.uint64(42)) | (b << np.uint64(21)) | c | np.uint64(1 << 63)) * mix
    shift = np.uint64(64 - buckets.bit_length() + 1)
    both = np.stack([two >> shift, three >> shift], axis=1).astype(np.int64).ravel()
    return both, 2 * np.bincount(text[at], minlength=len(texts))


def train(docs: DataFrame, may_learn: Column, buckets: int = 1 << 16, sample_rows: int = 20_000, smoothing: float = 0.1) -> Model:
    """Learn from rows with ``may_learn``, a text and a lang: about ``sample_rows`` of them, chosen by a hash of doc_id."""
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.select("lang").count()
    parts = 1_000_000
    share = parts if n <= sample_rows else max(1, parts * sample_rows // n)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)) < share).select("lang", "text")

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            found, sizes = grams(b.column("text").to_pylist(), buckets)
            langs = np.array(b.column("lang").to_pylist(), object)
            names, place = np.unique(langs.astype(str), return_inverse=True)
            counts = np.bincount(np.repeat(place, sizes) * (buckets + 1) + found, minlength=len(names) * (buckets + 1)).reshape(len(names), -1)
            counts[:, buckets] = np.bincount(place, minlength=len(names))  # documents
            x, y = np.nonzero(counts)
            return pa.record_batch([pa.array(names[x].astype(object), pa.string()), pa.array(y.astype(np.int32)), pa.array(counts[x, y])], ["lang", "bucket", "n"])

        return work

    counts = batches(sample, make, "lang string, bucket int, n long", "text", SMALL).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((buckets + 1, len(languages)))
    table[counts["bucket"], np.searchsorted(languages, counts["lang"])] = counts["n"]
    seen, documents = table[:buckets], table[buckets]
    with np.errstate(divide="ignore"):
        weights = np.log((seen + smoothing) / (seen.sum(axis=0) + smoothing * buckets))
        prior = np.log(documents / max(1.0, documents.sum()))
    return Model(languages, weights, prior)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language of each text and its posterior among the learned ones; ties go to the first in alphabetical order."""
    found, sizes = grams(texts, len(model.weights))
    scores = np.zeros((len(texts), len(model.languages)))
    full = np.flatnonzero(sizes)
    if not len(model.languages) or not len(full):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    starts = np.cumsum(sizes) - sizes
    scores[full] = np.add.reduceat(model.weights[found], starts[full], axis=0)
    scores += model.prior
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    best = scores.argmax(axis=1)
    some = sizes > 0
    langs = [model.languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), some.tolist(), strict=True)]
    return langs, np.where(some, odds.max(axis=1) / odds.sum(axis=1), 0.0)


def is_held_out(folds: int = 5, fold: int = 0) -> Column:
    """A null doc_id is not held out, and is not learned from."""
    return F.coalesce(F.pmod(id_crc(), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, folds: int = 5, fold: int = 0, **options) -> Broadcast:
    model = train(docs, F.pmod(id_crc(), F.lit(folds)) != fold, **options)
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, folds: int = 5, fold: int = 0, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score. ``und`` with score 0 where a text is null, empty or without a letter.

    Every row is judged by its own text alone, so repeated rows get equal results and stay rows of their own.
    """
    held = fit(docs, folds, fold, **options)

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = predict(held.value, b.column("text").to_pylist())
            return pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

        return work

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(folds, fold).alias("held_out"), F.col("text").cast("string"))
    return batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double", "text", SMALL)


def keep_identified(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text has a language with at least this posterior.

    Null and empty texts, and those without a letter, have none. Repeated rows stay or go together.
    """
    held = fit(docs, **options)

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = predict(held.value, b.column("text").to_pylist())
            return b.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(langs, scores.tolist(), strict=True)]))

        return work

    return batches(docs, make, docs.schema, "text", SMALL)
