"""What the two classifiers share: folds, the bounded sample that they learn from, and Adam."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, and the longest text among them in characters.
SAMPLE, LONGEST = 6000, 60_000


def fold(id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id: str, text: str, rows: int = SAMPLE) -> pa.Table:
    """(text, label) of at most `rows` labelled documents, those least by a hash of their id.

    Only ids are ordered; their texts are then found by a semi join with these few ids. A
    document with several labels has the largest; null labels and ids are no labels.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).where(learn)
    known = known.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rows)
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    found = texts.join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id").alias("order"))
    return found.toArrow().sort_by([("order", "ascending"), ("text", "ascending")])


class Adam:
    """Steps of Adam over a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit between two neighbours at which the F1 of label 1 is largest; 0 where one label is missing."""
    if not 0 < labels.sum() < len(labels):
        return 0.0
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + labels.sum())
    at = int(np.argmax(f1))
    below = logits[order[at + 1]] if at + 1 < len(order) else logits[order[at]] - 1
    return float(logits[order[at]] + below) / 2
