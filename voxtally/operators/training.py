"""Fitting a class-weighted classifier over bags of words with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.text import tokenize
from voxtally.operators.features import class_weights
from voxtally.operators.groups import split_by_share
from voxtally.operators.metrics import class_scores, outcome_counts

# Fixed values -----------------------------------------------------------------
VALIDATION_SHARE = 0.2
SPLIT_SEED = 42
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    """One fit with its scores on the validation rows."""

    reg_param: float
    accuracy: float
    f1: float
    model: PipelineModel


def training_rows(df: DataFrame, text: str = "text", label_id: str = "label_id") -> DataFrame:
    words = F.coalesce(tokenize(text), F.array().cast("array<string>"))
    return df.withColumn("words", words).withColumn("target", F.col(label_id).cast("double"))


def split_support(
    df: DataFrame,
    key: str,
    label: str = "label",
    share: float = VALIDATION_SHARE,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """What :func:`train_classifier` fits and validates on: rows of each class on both
    sides of its split, and the weight of the class."""
    split = split_by_share(df.select(key, label), [label], key, share, seed, "_held_out")
    counts = split.groupBy(label).agg(
        F.count_if(~F.col("_held_out")).alias("train_rows"), F.count_if("_held_out").alias("held_out_rows")
    )
    return class_weights(counts, label=label)


def train_classifier(
    df: DataFrame,
    key: str,
    text: str = "text",
    label: str = "label",
    label_id: str = "label_id",
    features: int = 1 << 14,
    reg_params: Sequence[float] = (0.01, 0.1),
    max_iter: int = 20,
    share: float = VALIDATION_SHARE,
    seed: int = SPLIT_SEED,
) -> tuple[Candidate, list[Candidate]]:
    """Fit one model per regularisation and keep the best weighted F1.

    The split is stratified by label and repeatable. Features are hashed, so no
    vocabulary is collected, and the optimiser aggregates gradients in a tree:
    the driver only ever holds one weight vector per class.
    """
    rows = training_rows(class_weights(df, label=label), text, label_id)
    split = split_by_share(rows, [label], key, share, seed, "_held_out")
    words = split.select(key, "words", "target", "weight", "_held_out")
    train_words = words.filter(~F.col("_held_out"))

    # Features do not depend on the candidate: they are computed once for all.
    hashing = HashingTF(inputCol="words", outputCol="counts", numFeatures=features)
    extractor = Pipeline(stages=[hashing, IDF(inputCol="counts", outputCol="features")])
    extractor = extractor.fit(train_words)
    columns = ["features", "target", "weight", "_held_out"]
    ready = extractor.transform(words).select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    train, held_out = ready.filter(~F.col("_held_out")), ready.filter("_held_out")

    fits = []
    try:
        for reg in reg_params:
            model = LogisticRegression(
                labelCol="target",
                weightCol="weight",
                family="multinomial",
                maxIter=max_iter,
                regParam=reg,
            ).fit(train)
            scored = model.transform(held_out).select("target", "prediction")
            report = class_scores(outcome_counts(scored, "target", "prediction"))
            scores = report.agg(
                F.sum("hits").alias("hits"),
                F.sum(F.col("f1") * F.col("support")).alias("f1"),
                F.sum("support").alias("n"),
            ).first()
            whole = PipelineModel(stages=[*extractor.stages, model])
            fits.append(Candidate(reg, scores["hits"] / scores["n"], scores["f1"] / scores["n"], whole))
    finally:
        ready.unpersist()
    return max(fits, key=lambda c: c.f1), fits
