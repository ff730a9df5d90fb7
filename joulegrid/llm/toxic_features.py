"""Dense features of a text for toxicity. Tasks need this module alone, so Spark ML stays out of their memory."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulegrid.llm.common import batches, sliced

WORD = re.compile(r"[^\W_]+")
#: Second person in the languages of the corpus.
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
OBFUSCATED = re.compile(r"[A-Za-z][0-9@$*!]+[A-Za-z]")
LONG_RUN = re.compile(r"([a-z])\1\1")
PUNCTUATION = re.compile(r"[!?.,;:*#%$&]{2,}")
#: Classes of characters by their Unicode categories: capitals, small letters, marks (punctuation and symbols), digits.
KINDS = (("Lu", "Lt"), ("Ll",), ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So"), ("Nd",))
LATIN = tuple(bytes(c for c in range(256) if unicodedata.category(chr(c)) in kind) for kind in KINDS)
HEAD, STEMS = 4, (4, 5, 6, 7)
NAMES = (
    "hit_rate", "hit_weight_rate", "strongest", "hits", "weight", "distinct_hits", "strong_hits", "second_rate", "second_near", "capitals", "capital_words",
    "capital_hits", "exclamations", "questions", "punctuation", "punctuation_runs", "obfuscated", "long_runs", "digits", "log_words", "mean_word",
)


@lru_cache(maxsize=1)
def class_of() -> np.ndarray:
    """Which of the classes each code point has, 4 for none."""
    place = {c: k for k, kind in enumerate(KINDS) for c in kind}
    return np.array([place.get(unicodedata.category(chr(c)), 4) for c in range(0x110000)], np.uint8)


def class_counts(text: str) -> list[int]:
    """Numbers of capitals, small letters, marks and digits."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.bincount(class_of()[codes], minlength=5)[:4].tolist()
    return [len(raw) - len(raw.translate(None, kind)) for kind in LATIN]


def terms(text: str) -> set[str]:
    """Distinct lower-cased words of a text, and their beginnings with a hyphen."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {t.rstrip("-")[:HEAD] for t in lexicon} | {w[:HEAD] for w in SECOND}

    def weight(self, word: str) -> float:
        """The strongest entry that a word or one of its beginnings has."""
        found = [self.lexicon.get(word, 0.0)]
        found += [self.lexicon.get(word[:n] + "-", 0.0) for n in STEMS if len(word) > n]
        return max(found)

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        words = WORD.findall(low)
        n, chars = max(1, len(words)), max(1, len(text))
        heads = self.heads
        near = [(k, w) for k, w in enumerate(words) if w[:HEAD] in heads]
        second = [k for k, w in near if w in SECOND]
        hits = [(k, w, x) for k, w in near if (x := self.weight(w)) > 0]
        weight = sum(x for _, _, x in hits)
        beside = set(second)
        close = sum(any(k + d in beside for d in range(-5, 6)) for k, _, _ in hits)
        upper, lower, marks, digits = class_counts(text)
        capital = [w for w in WORD.findall(text) if len(w) > 1 and w.isupper()] if upper else []
        return [
            len(hits) / n, weight / n, max((x for _, _, x in hits), default=0.0), float(len(hits)), weight, float(len({w for _, w, _ in hits})), float(sum(x >= 2 for _, _, x in hits)),
            len(second) / n, close / n, upper / max(1, upper + lower), len(capital) / n, float(sum(self.weight(w.lower()) > 0 for w in capital)) if hits else 0.0,
            text.count("!") / chars, text.count("?") / chars, marks / chars, len(PUNCTUATION.findall(text)) / n, len(OBFUSCATED.findall(text)) / n, len(LONG_RUN.findall(low)) / n,
            digits / chars, math.log1p(len(words)), sum(map(len, words)) / n,
        ]


def document_counts(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """How many documents hold each term; counted within tasks first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for whole in it:
            for b in sliced(whole, "text"):
                for t in b.column("text").to_pylist():
                    counts.update(terms(t) if only is None else terms(t) & only)
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def with_features(rows: DataFrame, text: str, lexicon: dict[str, float], name: str = "features") -> DataFrame:
    """``rows`` (whose first columns stay) with the dense features of a text column in its place."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon)
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def make():
        features = Features(held.value)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            column = pa.array([features.of(t) for t in b.column(text).to_pylist()], pa.list_(pa.float64()))
            return pa.record_batch([*[b.column(c) for c in keep], column], [*keep, name])

        return work

    return batches(rows, make, schema, text)
