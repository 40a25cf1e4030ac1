"""A class-weighted linear classifier fitted epoch by epoch, with scores after each.

Texts become sparse rows once: a word is a column by its digest, and a text of n words
has 1 / sqrt(n) for each of them. An epoch is one pass in which every map task adds up the
gradient of its rows; the tasks' sums are added in a tree, so the driver receives a
few of them, each as large as the model. After the step the held-out rows are scored. The
model with the best weighted F1 is kept, and the fit ends when it has not been beaten for
some epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.text import tokenize
from voxtally.operators.features import class_weights
from voxtally.operators.groups import split_by_share
from voxtally.operators.metrics import class_scores
from voxtally.operators.training import SPLIT_SEED, VALIDATION_SHARE

# Partial sums that the driver adds up itself.
FAN = 16


@dataclass(frozen=True)
class Epoch:
    """Loss over the training rows before the step, and scores of the held-out rows after it."""

    number: int
    loss: float
    held_out_loss: float
    accuracy: float
    f1: float


@dataclass(frozen=True)
class Fit:
    """The weights of the best epoch, one row per class, and all epochs."""

    weights: np.ndarray
    best: int
    epochs: list[Epoch]


def sparse_rows(df: DataFrame, features: int, text: str = "text", label_id: str = "label_id") -> DataFrame:
    """Adds ``columns`` (one entry per word of the text), and the class as ``target``."""
    digest = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long")
    words = F.coalesce(tokenize(text), F.array().cast("array<string>"))
    columns = F.transform(words, lambda w: (digest(w) % features).cast("int"))
    return df.withColumn("columns", columns).withColumn("target", F.col(label_id).cast("int"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every entry."""
    column = batch.column("columns")
    counts = np.asarray(column.value_lengths()).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    value = np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
    return row, np.asarray(column.flatten()).astype(np.int64), value


def _softmax(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, tuple]:
    entries = row, column, value = _matrix(batch)
    scores = np.zeros((batch.num_rows, len(weights)))
    for c, w in enumerate(weights):
        scores[:, c] = np.bincount(row, w[column] * value, batch.num_rows)
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    return p / p.sum(axis=1, keepdims=True), entries


def _gradient(weights):
    """The sums of one task: gradient, loss, and weight of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        total, loss, mass = np.zeros_like(w), 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            p, (row, column, value) = _softmax(batch, w)
            y, weight = np.asarray(batch.column("target")), np.asarray(batch.column("weight"))
            loss -= float((weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
            mass += float(weight.sum())
            p[np.arange(len(y)), y] -= 1
            p *= weight[:, None]
            for c in range(len(w)):
                total[c] += np.bincount(column, p[row, c] * value, w.shape[1])
        yield _partial(total, loss, mass)

    return run


def _partial(total: np.ndarray, loss: float, mass: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([total.tobytes()], pa.binary()), pa.array([loss]), pa.array([mass])], ["gradient", "loss", "mass"]
    )


_PARTIAL = "gradient binary, loss double, mass double"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, loss, mass = None, 0.0, 0.0
    for batch in batches:
        for g, one, m in zip(*(batch.column(c).to_pylist() for c in ("gradient", "loss", "mass"))):
            g = np.frombuffer(g)
            total = g.copy() if total is None else total + g
            loss, mass = loss + one, mass + m
    if total is not None:
        yield _partial(total, loss, mass)


def gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Mean gradient and mean loss over weighted rows (columns, target, weight), and the sum of their weights."""
    known = rows.sparkSession.sparkContext.broadcast(weights)
    try:
        parts = rows.select("columns", "target", "weight").mapInArrow(_gradient(known), _PARTIAL)
        n = rows.rdd.getNumPartitions()
        while n > FAN:
            n = -(-n // FAN)
            parts = parts.repartition(n).mapInArrow(_added, _PARTIAL)
        got = parts.toArrow()
    finally:
        known.unpersist()
    total, loss, mass = np.zeros(weights.size), 0.0, 0.0
    for g, one, m in zip(*(got.column(c).to_pylist() for c in ("gradient", "loss", "mass"))):
        total, loss, mass = total + np.frombuffer(g), loss + one, mass + m
    mass = mass or 1.0
    return total.reshape(weights.shape) / mass, loss / mass, mass


def _scores(rows: DataFrame, weights: np.ndarray) -> tuple[float, float, float]:
    """Mean loss, accuracy and weighted F1."""
    known = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            p, _ = _softmax(batch, known.value)
            y = np.asarray(batch.column("target"))
            lost = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
            yield pa.RecordBatch.from_arrays(
                [pa.array(y), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(lost * np.asarray(batch.column("weight"))), batch.column("weight")],
                ["target", "prediction", "lost", "weight"],
            )

    try:
        schema = "target int, prediction int, lost double, weight double"
        scored = rows.select("columns", "target", "weight").mapInArrow(run, schema)
        counts = scored.groupBy("target", "prediction").agg(
            F.count("*").alias("n"), F.sum("lost").alias("lost"), F.sum("weight").alias("weight")
        )
        # As many rows as there are pairs of classes.
        counts = rows.sparkSession.createDataFrame(counts.toArrow())
        report = class_scores(counts.select(F.col("target").alias("truth"), F.col("prediction").alias("predicted"), "n"))
        sums = report.agg(
            F.sum("hits").alias("hits"), F.sum(F.col("f1") * F.col("support")).alias("f1"), F.sum("support").alias("n")
        ).first()
        loss = counts.agg(F.sum("lost") / F.sum("weight")).first()[0]
    finally:
        known.unpersist()
    if not sums["n"]:
        return 0.0, 0.0, 0.0
    return loss, sums["hits"] / sums["n"], sums["f1"] / sums["n"]


def fit_by_epochs(
    df: DataFrame,
    key: str,
    classes: int,
    text: str = "text",
    label: str = "label",
    label_id: str = "label_id",
    features: int = 1 << 14,
    epochs: int = 20,
    patience: int = 3,
    step: float = 8.0,
    momentum: float = 0.9,
    share: float = VALIDATION_SHARE,
    seed: int = SPLIT_SEED,
) -> Fit:
    """Gradient descent with momentum over all training rows in every epoch.

    The split is stratified by label, repeatable, and the one of ``train_classifier``. A
    step after which the loss is higher is taken back and halved. ``classes`` is the number
    of label ids; the model has one row of ``features`` weights for each.
    """
    rows = sparse_rows(class_weights(df, label=label), features, text, label_id)
    split = split_by_share(rows, [label], key, share, seed, "_held_out")
    ready = split.select("columns", "target", "weight", "_held_out").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, held_out = ready.filter(~F.col("_held_out")), ready.filter("_held_out")
        weights = np.zeros((classes, features))
        speed = np.zeros_like(weights)
        slope, loss, _ = gradient(train, weights)
        done: list[Epoch] = []
        best, kept = -1, weights
        for number in range(1, epochs + 1):
            speed = momentum * speed - step * slope
            ahead = weights + speed
            new_slope, new_loss, _ = gradient(train, ahead)
            if new_loss > loss:
                step, speed = step / 2, np.zeros_like(speed)
                ahead = weights - step * slope
                new_slope, new_loss, _ = gradient(train, ahead)
            before, weights, slope, loss = loss, ahead, new_slope, new_loss
            done.append(Epoch(number, before, *_scores(held_out, weights)))
            if best < 0 or done[-1].f1 > done[best].f1:
                best, kept = len(done) - 1, weights
            elif len(done) - 1 - best >= patience:
                break
    finally:
        ready.unpersist()
    return Fit(kept, best, done)
