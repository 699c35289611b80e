"""Quality by attention-based multiple-instance learning, trained in numpy.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its own
text: shares of classes of bytes, word lengths, words that repeat the word before, and counts of
hashed pairs of byte classes, which tell shapes of words and lines. A hidden layer encodes a passage;
gated attention (a tanh gate times a sigmoid gate) weighs the passages of a document; the weighted
sum of their codes is scored by a logistic layer. Only the document has a label, so the attention is
learned from document labels.

Fitting takes a bounded sample (learn.SAMPLE rows of at most learn.LONGEST characters) on the driver;
the broadcast model has a few thousand numbers. Every text is scored whole, on the executors.

Defined cases: null, empty and wordless texts are one passage without words. Without labelled
rows, or with one label only, every score is that share of label 1 (0 without rows). Repeated rows
are scored each. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches
from bankmail.llm.hashing import Words, portions, words_of
from bankmail.llm.learn import Adam, labelled_sample, sigmoid

THRESHOLD = 0.3
PASSAGE = 64
CODE, GATE = 16, 8
EPOCHS, BATCH, RATE = 15, 64, 0.01
#: Classes of bytes: small and capital letters, digits, blanks, line ends, bytes beyond ASCII, and marks one by one in groups.
_CLASS = np.full(256, 15, np.int32)
for _k, _s in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "*", "#%", "&$", "<>=/\\", "-_()[]{}"]):
    _CLASS[[ord(c) for c in _s]] = _k
_CLASS[128:] = 14
CLASSES = 16
PAIRS = 32
_PAIR = (np.arange(CLASSES)[:, None] * 7 + np.arange(CLASSES) * 5) % PAIRS
N_FEATURES = CLASSES + PAIRS + 5


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the bounds of the documents' passages. A text without words is one passage."""
    n = words.counts
    each = np.maximum(-(-n // PASSAGE), 1)
    bounds = np.concatenate([[0], np.cumsum(each)])
    of = np.repeat(np.arange(len(n)), each)
    k = np.arange(len(of)) - bounds[:-1][of]
    first = np.minimum(words.starts[:-1][of] + k * PASSAGE, words.starts[1:][of])
    end = np.minimum(first + PASSAGE, words.starts[1:][of])
    count = end - first
    # bytes from a passage's first word to the next passage's, or to the end of the text
    begin = np.where(k == 0, words.offsets[:-1][of], words.first[np.minimum(first, max(len(words.first) - 1, 0))] if len(words.first) else 0)
    stop = np.append(begin[1:], words.offsets[-1])
    size = stop - begin
    at = np.repeat(np.arange(len(of), dtype=np.int32), size)
    kind = _CLASS[words.data]
    shares = np.bincount(at * CLASSES + kind, minlength=len(of) * CLASSES).reshape(-1, CLASSES)
    own = np.ones(max(len(at) - 1, 0), bool)  # pairs of bytes of one document
    inner = words.offsets[1:-1]
    own[inner[(inner > 0) & (inner < len(at))] - 1] = False
    place = np.flatnonzero(own)
    pairs = np.bincount(at[place] * PAIRS + _PAIR[kind[place], kind[place + 1]], minlength=len(of) * PAIRS).reshape(-1, PAIRS)
    if len(words.hashes):
        again = np.zeros(len(words.hashes) + 1, np.int64)
        again[2:] = np.cumsum(words.hashes[1:] == words.hashes[:-1])
        again2 = np.zeros(len(words.hashes) + 1, np.int64)
        again2[3:] = np.cumsum(words.hashes[2:] == words.hashes[:-2])
        repeats = again[end] - again[np.minimum(first + 1, end)], again2[end] - again2[np.minimum(first + 2, end)]
    else:
        repeats = np.zeros(len(of)), np.zeros(len(of))
    per_byte, per_word = np.maximum(size, 1)[:, None], np.maximum(count, 1)
    rest = np.stack([repeats[0] / per_word, repeats[1] / per_word, size / per_word / 10, count / PASSAGE, count == 0], axis=1)
    return np.concatenate([np.sqrt(shares / per_byte), np.sqrt(pairs / per_byte), rest], axis=1).astype(np.float32), bounds


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - w["mean"]) / w["scale"]
        code = np.tanh(x @ w["code"] + w["code0"])
        t, s = np.tanh(code @ w["gate_t"]), sigmoid(code @ w["gate_s"])
        raw = (t * s) @ w["attend"]
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        power = np.exp(raw - np.maximum.reduceat(raw, bounds[:-1])[of])
        attention = power / np.add.reduceat(power, bounds[:-1])[of]
        bag = np.add.reduceat(attention[:, None] * code, bounds[:-1], axis=0)
        return {"x": x, "code": code, "t": t, "s": s, "attention": attention, "of": of, "bag": bag, "logit": bag @ w["out"] + w["bias"][0]}

    def score(self, words: Words) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words.counts), self.constant)
        return sigmoid(self.forward(*passages(words))["logit"]).astype(np.float64)


def _gradients(model: Model, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    w, f = model.weights, model.forward(x, bounds)
    error = ((sigmoid(f["logit"]) - labels) / len(labels)).astype(np.float32)
    bag = error[:, None] * w["out"]
    to_code = f["attention"][:, None] * bag[f["of"]]
    each = (f["code"] * bag[f["of"]]).sum(1)
    mean = np.add.reduceat(f["attention"] * each, bounds[:-1])
    raw = f["attention"] * (each - mean[f["of"]])
    gate = raw[:, None] * w["attend"]
    dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
    to_code = to_code + dt @ w["gate_t"].T + ds @ w["gate_s"].T
    inner = to_code * (1 - f["code"] ** 2)
    return {
        "out": f["bag"].T @ error, "bias": np.array([error.sum()], np.float32), "attend": (f["t"] * f["s"]).T @ raw,
        "gate_t": f["code"].T @ dt, "gate_s": f["code"].T @ ds, "code": f["x"].T @ inner, "code0": inner.sum(0),
    }


def fit(sample: pa.Table, seed: int = 7) -> Model:
    """A model of (text, label) rows."""
    labels = np.asarray(sample["label"], np.float64)
    if not 0 < labels.sum() < len(labels):
        return Model({}, float(labels.mean()) if len(labels) else 0.0)
    parts = [passages(words_of(b)) for b in portions(sample.select(["text"]).to_batches(), size=1 << 19)]
    x = np.concatenate([f for f, _ in parts])
    bounds = np.cumsum(np.concatenate([[0], *(np.diff(b) for _, b in parts)]))
    rng = np.random.default_rng(seed)
    some = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    learned = {
        "code": some(N_FEATURES, CODE), "code0": np.zeros(CODE, np.float32), "gate_t": some(CODE, GATE), "gate_s": some(CODE, GATE),
        "attend": some(GATE), "out": some(CODE), "bias": np.zeros(1, np.float32),
    }
    model = Model(learned | {"mean": x.mean(0), "scale": x.std(0) + 0.01})
    adam = Adam(learned, RATE)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            n = np.diff(bounds)[docs]
            starts = np.concatenate([[0], np.cumsum(n)])
            place = np.repeat(bounds[:-1][docs] - starts[:-1], n) + np.arange(starts[-1])
            adam.step(_gradients(model, x[place], starts, labels[docs]))
    return model


def quality(docs: DataFrame, labels: DataFrame, learn=None, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, score, predicted. `learn` is the condition on rows of `labels` to learn from."""
    model = fit(labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, id, text))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            score = shared.value.score(words_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], ["id", "score"])

    rows = bounded_batches(docs).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInArrow(scored, f"id {docs.schema[id].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
