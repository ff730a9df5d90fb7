"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of words and word beginnings, the trees and the calibration are learned on a bounded sample of labelled
documents, cross-fitted in two halves. Features are densities and rates of whole texts; features are computed in
Arrow batches, trees and calibration are Spark ML's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import id_crc, settle
from joulegrid.llm.toxic_features import document_counts, with_features


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, folds: int, fold: int) -> DataFrame:
    """text, label and part (0 to 9) of about ``sample_rows`` labelled documents outside the held-out fold.

    Labels of one id that disagree count as toxic; an id in many rows gives one text, the least. The sample's ids are
    bounded by ``sample_rows`` and broadcast.
    """
    known = labels.where(F.col("toxic").isNotNull() & (F.pmod(id_crc(), F.lit(folds)) != fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("double")).alias("label"))
    n, parts = known.count(), 1_000_000
    share = parts if n <= sample_rows else max(1, parts * sample_rows // n)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return settle(once.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(10)).cast("int").alias("part")))


def learn_lexicon(rows: DataFrame, most_terms: int = 4000, least: int = 3, least_weight: float = 1.0, weighed: int = 80_000) -> dict[str, float]:
    """Terms by the log ratio of their shares of toxic and of other documents; the ``most_terms`` with most evidence.

    ``rows`` are the labelled sample. Of its terms in toxic documents the ``weighed`` commonest are weighed, which
    bounds what the driver holds: of 20,000 documents none is left out that has any evidence to speak of.
    """
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not toxic or not other:
        return {}
    found = document_counts(rows.where("label = 1")).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(weighed)
    there = {r["term"]: r["n"] for r in found.collect()}
    elsewhere = {r["term"]: r["n"] for r in document_counts(rows.where("label = 0"), frozenset(there)).collect()}
    weight = {t: math.log((n / toxic) / ((elsewhere.get(t, 0) + 0.5) / other)) for t, n in there.items()}
    strong = sorted((t for t, w in weight.items() if w >= least_weight), key=lambda t: (-there[t] * weight[t], t))
    return {t: weight[t] for t in strong[:most_terms]}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, folds: int = 4, fold: int = 2, rounds: int = 20, depth: int = 4) -> Model:
    """Cross-fitted in two halves, so that few labels go far and nothing is fitted to what it was made from.

    Each half's features come from the other half's lexicon, and its raw scores for the calibration from trees of the
    other half; the final lexicon and trees are learned from both. With labels of one kind the score is their mean.
    """
    sample = labelled_sample(docs, labels, sample_rows, folds, fold)
    base = sample.agg(F.avg("label")).first()[0] or 0.0
    half = [sample.where(F.col("part") % 2 == k) for k in (0, 1)]
    lexicons = [learn_lexicon(h) for h in half]
    made = [with_features(h.select("label", "part", "text"), "text", lexicons[1 - k]) for k, h in enumerate(half)]
    rows = settle(made[0].union(made[1]).select("label", "part", array_to_vector("features").alias("features")).coalesce(4))

    def trees(known: DataFrame) -> GBTClassificationModel | None:
        if known.select("label").distinct().count() < 2:
            return None
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=4, seed=1).fit(known)

    final = trees(rows)
    if final is None:
        return Model({}, None, None, base)
    raw = None
    for k in (0, 1):
        other = trees(rows.where(F.col("part") % 2 == 1 - k))
        if other is not None:
            some = other.transform(rows.where(F.col("part") % 2 == k)).select("label", vector_to_array("probability")[1].alias("raw"))
            raw = some if raw is None else raw.union(some)
    lexicon = learn_lexicon(sample)
    if raw is None or raw.select("label").distinct().count() < 2:
        return Model(lexicon, final, None, base)
    return Model(lexicon, final, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw), base)


def scored(model: Model, rows: DataFrame, text: str, score: str) -> DataFrame:
    """``rows`` with a score from 0 to 1 in place of the text column."""
    features = with_features(rows, text, model.lexicon, "tox_features")
    if model.trees is None:
        return features.drop("tox_features").withColumn(score, F.lit(float(model.base_rate)))
    trees = model.trees.copy().setFeaturesCol("tox_vector").setPredictionCol("tox_class").setProbabilityCol("tox_probability").setRawPredictionCol("tox_margin")
    out = trees.transform(features.withColumn("tox_vector", array_to_vector("tox_features"))).withColumn("tox_raw", vector_to_array("tox_probability")[1])
    if model.calibration is None:
        out = out.withColumn(score, F.col("tox_raw"))
    else:
        out = model.calibration.copy().setFeaturesCol("tox_raw").setPredictionCol(score).transform(out)
    keep = [c for c in rows.columns if c != text]
    return out.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))).alias(score))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Null texts score as empty ones; a null doc_id is not held out.

    Every row is scored by its own text, so repeated rows score alike.
    """
    model = train(docs, labels, folds=folds, fold=fold, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.pmod(id_crc(), F.lit(folds)) == fold, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return scored(model, rows, "text", "score").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, all columns as they are. Null texts score as empty ones."""
    model = train(docs, labels, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("body"))
    return scored(model, rows, "body", "score").where(F.col("score") < threshold).select("row.*")
