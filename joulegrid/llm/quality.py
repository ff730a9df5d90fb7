"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, windows of its whole text. Every passage is encoded: how often each pair of character
classes follows one another, and how much its words repeat within the passage and the document. A hidden layer, gated
attention over the passages and an output layer are learned from document labels alone, on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, id_crc
from joulegrid.llm.langid import letters

#: Classes of characters; what stands nowhere is 14, and letters beyond Latin-1 are 15.
CLASSES = (" \t\r\x0b\x0c\xa0", "\n", "", "", "0123456789", ".", ",;:", "|", "!", "?", "'\"`´«»", "-_", "()[]{}<>", "%$#&*@+=/\\~^")
N = 16
WIDTH = N * N + 7
SMALL = 1 << 20


def class_table() -> np.ndarray:
    table = np.where(letters()[0], 15, 14).astype(np.uint8)
    for k, chars in enumerate(CLASSES):
        for c in chars:
            table[ord(c)] = k
    for c in range(256):
        if chr(c).isalpha():
            table[c] = 3 if chr(c).isupper() else 2
    return table


def first_seen(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(keys), bool)
    seen[np.unique(keys, return_index=True)[1]] = True
    return seen


def encode(texts: list[str | None], table: np.ndarray, window: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all texts in order, and how many each text has; an empty text has one, without words."""
    codes = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    counts = np.maximum(1, -(-(sizes - 1) // window))
    passage = (np.cumsum(counts) - counts)[doc] + np.minimum((np.arange(len(codes)) - begin[doc]) // window, counts[doc] - 1)
    total = int(counts.sum())
    kind = table[codes].astype(np.int64)
    inside = doc[1:] == doc[:-1]
    pairs = np.bincount((passage[:-1] * N * N + kind[:-1] * N + kind[1:])[inside], minlength=total * N * N).reshape(total, N * N)
    out = np.zeros((total, WIDTH), np.float32)
    out[:, : N * N] = np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True)))
    shape = [np.bincount(passage, minlength=total) / window, np.log1p(np.repeat(counts, counts)) / 3]
    out[:, N * N :] = np.stack([np.full(total, 0.01), *[np.zeros(total)] * 4, *shape], axis=1)
    gap = kind <= 1
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if len(starts):
        length = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]])) - starts
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        values = (codes[np.repeat(starts, length) + place].astype(np.uint64) + np.uint64(1)) * power[place & 63]
        word = np.add.reduceat(values, np.cumsum(length) - length)
        of, owner = passage[starts], doc[starts]
        n = np.maximum(1, np.bincount(of, minlength=total))
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])])
        new = first_seen(word ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        before = [np.where(np.concatenate([np.zeros(k, bool), owner[k:] == owner[:-k]])[: len(word)], np.roll(word, k), np.uint64(0)) for k in (1, 2)]
        three = word + before[0] * np.uint64(3) + before[1] * np.uint64(7)
        novel = first_seen(three ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x165667B19E3779F9))
        mean = lambda x: np.bincount(of, weights=x, minlength=total) / n
        out[:, N * N :] = np.stack([n / 100, mean(length) / 10, mean(same), mean(~new), mean(~novel), *shape], axis=1)
    return out, counts


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Hidden passages, attention within each document, and the document's probability."""
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    a = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "starts": starts}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(w, x, counts)
    h, t, g, a = f["h"], f["t"], f["g"], f["a"]
    out = (f["p"] - y) / len(y)
    dz = np.repeat(out, counts)[:, None] * w["c"]
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), counts))
    dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ out, "d": out.sum()}


def learn(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 12, hidden: int = 24, attention: int = 12, rate: float = 0.01, decay: float = 1e-4, batch: int = 64) -> Model:
    """Adam over documents in random order; seeded, so that equal samples give equal models."""
    rng = np.random.default_rng(5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    x = np.clip((x - mean) / scale, -5, 5)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"W": init(WIDTH, hidden), "b": np.zeros(hidden), "V": init(hidden, attention), "U": init(hidden, attention), "w": init(attention), "c": init(hidden), "d": np.zeros(())}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    begin = np.cumsum(counts) - counts
    step, steps = 0, max(1, epochs * -(-len(y) // batch))
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            rows = np.concatenate([np.arange(begin[k], begin[k] + counts[k]) for k in some])
            grad = gradients(w, x[rows], counts[some], y[some])
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k in w:
                d = grad[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, folds: int = 3, fold: int = 1, bag_passages: int = 32) -> Model | float:
    """Learn from about ``sample_rows`` labelled documents; only their encoded passages reach the driver.

    Of a longer document ``bag_passages`` passages, evenly spread, are learned from (scores are of all). An id that
    stands in several rows is one document, with the least of its texts. With labels of one kind, or none, the result
    is their mean (0.5 with none). Ids whose labels disagree count as 0.
    """
    known = labels.where(F.col("quality").isNotNull() & (F.pmod(id_crc(), F.lit(folds)) != fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("double")).alias("label"))
    n, parts = known.count(), 1_000_000
    share = parts if n <= sample_rows else max(1, parts * sample_rows // n)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(parts)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def make():
        table = class_table()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            x, counts = encode(b.column("text").to_pylist(), table)
            begin = np.cumsum(counts) - counts
            some = [np.unique(np.linspace(0, c - 1, min(c, bag_passages)).round().astype(int)) for c in counts]
            return pa.record_batch([b.column("doc_id"), b.column("label"), pa.array([x[a + s].tobytes() for a, s in zip(begin, some, strict=True)], pa.binary())], ["doc_id", "label", "passages"])

        return work

    rows = sorted((r["doc_id"], r["label"], bytes(r["passages"])) for r in batches(sample, make, "doc_id long, label double, passages binary", "text", SMALL).collect())
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
    return learn(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def score(model: Model | float, texts: list[str | None], table: np.ndarray) -> np.ndarray:
    if isinstance(model, float) or not texts:
        return np.full(len(texts), model if isinstance(model, float) else 0.0)
    x, counts = encode(texts, table)
    return forward(model.weights, np.clip((x - model.mean) / model.scale, -5, 5), counts)["p"]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 3, fold: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Null texts score as empty ones; a null doc_id is not held out.

    Every row is scored by its own text, so repeated rows score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, fold=fold, **options))

    def make():
        table = class_table()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            s = score(held.value, b.column("text").to_pylist(), table)
            return pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.pmod(id_crc(), F.lit(folds)) == fold, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return batches(rows, make, "doc_id long, held_out boolean, score double, predicted int", "text", SMALL)
