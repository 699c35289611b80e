"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is embedded as the sum of two learned vectors, one of its hash and one of the hash of
its first bytes, which carries over to unseen endings. Filters of several widths slide over the
words of the whole text and each keeps its largest answer; a logistic layer scores these. The vectors
of hashes that few documents of the sample have are zero. One embedding dimension starts from the
smoothed log-odds of a hash among the labels, the others and the filters from random numbers.

Thresholds are calibrated by language: the language is guessed from function words in the text
itself. A quarter of all labelled rows, told by a hash of the id, never trains; all of these are scored on the executors, counted by language,
label and score, and the threshold of each language is chosen from the counts. Scores are shifted so that each
language's threshold lies at THRESHOLD; a language with fewer than POSITIVES such rows of either label has the threshold of all.

Fitting takes a bounded sample (learn.SAMPLE rows of at most learn.LONGEST characters) of the others on the driver;
the model, broadcast, is bounded by VOCABULARY vectors. Every text is scored whole, on the executors.

Defined cases: null, empty and wordless texts get the score of the model's bias, below the
threshold. Without labelled rows, or with one label only, every score is that share of label 1 (0
without rows). Repeated rows are scored each. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches, materialize, small
from bankmail.llm.hashing import NOT_ALNUM, U64, Words, portions, text_buffers, words_of
from bankmail.llm.learn import Adam, best_threshold, labelled_sample, sigmoid

THRESHOLD = 0.3
HEAD, WIDTHS, FILTERS, DIMENSIONS = 4, (1, 2, 3), 6, 8
VOCABULARY, LEAST_DOCS, SLOTS = 200_000, 5, 1 << 20
EPOCHS, STEPS, BATCH, RATE, KEPT_BACK = 6, 100, 128, 0.02, 0.25
#: Labelled rows of each label that a language's own threshold needs; bins of a logit, from -EDGE to EDGE.
POSITIVES, BINS, EDGE = 5, 32, 20
#: Function words by which a text's language is guessed.
LANGUAGES = {
    "en": "the of and to in is that for with was from this are on it as",
    "de": "der die das und von zu den mit ist im nicht für auf sich des dem",
    "fr": "le la les et un une du des est dans pour que au avec sur pas",
    "es": "el la los las y del un una por con para que se no su al",
}


def _parsed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    return words.hashes, words.heads(HEAD) ^ U64(0x5851F42D4C957F2D)


def _language_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that belong to one language's list only, and the number of that language."""
    lists = [set(v.split()) for v in LANGUAGES.values()]
    pairs = sorted((w, k) for k, own in enumerate(lists) for w in own if sum(w in x for x in lists) == 1)
    data = " ".join(w for w, _ in pairs).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes, np.array([k for _, k in pairs])


@dataclass
class Model:
    slots: np.ndarray
    hashes: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by hash, the vectors whose slot another one has

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The vector of each hash; 0, a vector of zeros, for unknown ones."""
        at = self.slots[(hashes & U64(SLOTS - 1)).astype(np.int64)]
        other = np.flatnonzero((self.hashes[at] != hashes) & (at > 0))
        at[other] = 0
        if len(self.rest):
            known, wanted = self.hashes[self.rest], hashes[other]
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            found = known[place] == wanted
            at[other[found]] = self.rest[place[found]]
        return at

    def pooled(self, words: np.ndarray, heads: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of every filter in every text, and the answers; texts without words get zeros."""
        w = self.weights
        x = w["embed"][words] + w["embed"][heads]
        answers = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        last = np.zeros(len(x), np.int64)  # words after this one in its text
        full = bounds[:-1] < bounds[1:]
        ends = np.repeat(bounds[1:][full], np.diff(bounds)[full])
        last = ends - np.arange(len(x)) - 1
        for k, width in enumerate(WIDTHS):
            part = x @ w[f"filter{k}_0"]
            for j in range(1, width):
                ahead = np.minimum(np.arange(len(x)) + j, len(x) - 1)
                part += np.where((last >= j)[:, None], x[ahead] @ w[f"filter{k}_{j}"], 0)
            answers[:, k * FILTERS : (k + 1) * FILTERS] = part
        most = np.zeros((len(bounds) - 1, answers.shape[1]), np.float32)
        if full.any():
            most[full] = np.maximum.reduceat(answers, bounds[:-1][full], axis=0)
        return most, answers

    def logits(self, most: np.ndarray) -> np.ndarray:
        return np.maximum(most + self.weights["offset"], 0) @ self.weights["out"] + self.weights["bias"][0]

    def language(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of the language whose function words are most frequent in each text; one past the last without any."""
        known = self.of_language[np.minimum(words, len(self.of_language) - 1)]
        hit = np.flatnonzero(known >= 0)
        text = np.searchsorted(bounds, hit, "right") - 1
        counts = np.bincount(text * len(LANGUAGES) + known[hit], minlength=(len(bounds) - 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        return np.where(counts.max(1, initial=0) > 0, counts.argmax(1), len(LANGUAGES))

    @property
    def of_language(self) -> np.ndarray:
        _, language = _language_hashes()
        return np.concatenate([[-1], language, [-1]])

    def judged(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each text before its language's shift, and its language."""
        a, b = map(self.rows, _parsed(words))
        return self.logits(self.pooled(a, b, words.starts)[0]), self.language(a, words.starts)

    def score(self, words: Words) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words.counts), self.constant)
        logit, language = self.judged(words)
        logit = logit - self.shift[language] + np.log(THRESHOLD / (1 - THRESHOLD))
        return sigmoid(np.where(words.counts > 0, logit, np.minimum(logit, -3)))


def _vocabulary(hashes: list[np.ndarray], bounds: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that enough documents have, and the smoothed log-odds of each among the labels."""
    every = []
    for h, b in zip(hashes, bounds, strict=True):
        docs = np.repeat(np.arange(len(b) - 1, dtype=np.int32), np.diff(b))
        order = np.lexsort((docs, h))
        h, docs = h[order], docs[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
        known, at, n = np.unique(h[new], return_inverse=True, return_counts=True)
        every.append((known, n, np.bincount(at, weights=labels[docs[new]], minlength=len(known))))
    known, n, ones = (np.concatenate(x) for x in zip(*every, strict=True))
    odds = np.log((ones + 0.5) / (labels.sum() + 1)) - np.log((n - ones + 0.5) / (len(labels) - labels.sum() + 1))
    odds *= n / (n + 10)
    keep = np.argsort(-(n * (n >= LEAST_DOCS)), kind="stable")[: min(VOCABULARY, int((n >= LEAST_DOCS).sum()))]
    return known[keep], odds[keep]


def fit(sample: pa.Table, seed: int = 11, kept_back: float = KEPT_BACK) -> Model:
    """A model of (text, label) rows. Its thresholds come from the part of them that is kept from training, if any."""
    labels = np.asarray(sample["label"], np.float64)
    empty = np.zeros(1, np.int64), np.zeros(1, U64)
    if not 0 < labels.sum() < len(labels):
        return Model(*empty, {}, float(labels.mean()) if len(labels) else 0.0)
    parts = [words_of(p, lower=True, between=NOT_ALNUM) for p in portions(sample.select(["text"]).to_batches(), size=1 << 19)]
    starts = np.cumsum(np.concatenate([[0], *(p.counts for p in parts)]))
    a, b = (np.concatenate(x) for x in zip(*map(_parsed, parts), strict=True))
    del parts
    train = int(len(labels) * (1 - kept_back))
    upto, bounds = starts[train], starts[: train + 1]
    known, odds = _vocabulary([a[:upto], b[:upto]], [bounds, bounds], labels[:train])

    first, _ = _language_hashes()
    fresh = ~np.isin(known, first)
    hashes = np.concatenate([np.zeros(1, U64), first, known[fresh]])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (len(hashes), DIMENSIONS)).astype(np.float32)
    embed[:, 0] = np.concatenate([np.zeros(1 + len(first)), odds[fresh]])
    embed[0] = 0
    slots = np.zeros(SLOTS, np.int32)
    own = (hashes & U64(SLOTS - 1)).astype(np.int64)
    slots[own[:0:-1]] = np.arange(len(hashes) - 1, 0, -1)
    rest = np.flatnonzero(slots[own] != np.arange(len(hashes)))
    rest = rest[rest > 0]
    weights = {"embed": embed}
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            f = rng.normal(0, 0.3, (DIMENSIONS, FILTERS)).astype(np.float32)
            f[0] = np.abs(f[0]) + 0.3
            weights[f"filter{k}_{j}"] = f
    n = len(WIDTHS) * FILTERS
    weights |= {"offset": np.full(n, -0.5, np.float32), "out": np.full(n, 0.1, np.float32), "bias": np.array([-2.0], np.float32)}
    model = Model(slots, hashes, weights, rest=rest[np.argsort(hashes[rest])].astype(slots.dtype))
    ra, rb = model.rows(a), model.rows(b)

    adam = Adam(weights, RATE)
    for _ in range(max(EPOCHS, -(-STEPS // -(-train // BATCH)) if train else 0)):
        order = rng.permutation(train)
        for at in range(0, train, BATCH):
            docs = order[at : at + BATCH]
            n_words = starts[docs + 1] - starts[docs]
            own = np.concatenate([[0], np.cumsum(n_words)])
            place = np.repeat(starts[docs] - own[:-1], n_words) + np.arange(own[-1])
            adam.step(_gradients(model, ra[place], rb[place], own, labels[docs]))
    if train == len(labels):
        return model
    left = range(train, len(labels), BATCH)
    most = np.concatenate([model.pooled(ra[starts[k] : starts[e]], rb[starts[k] : starts[e]], starts[k : e + 1] - starts[k])[0] for k in left for e in [min(k + BATCH, len(labels))]])
    logits, kept = model.logits(most), labels[train:]
    language = model.language(ra[upto:], starts[train:] - upto)
    overall = best_threshold(logits, kept)
    model.shift = np.array([
        best_threshold(logits[language == k], kept[language == k]) if 5 <= kept[language == k].sum() < (language == k).sum() else overall
        for k in range(len(LANGUAGES) + 1)
    ])
    return model


def _gradients(model: Model, a: np.ndarray, b: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss; only the word at which a filter answers most learns from a text."""
    w = model.weights
    most, answers = model.pooled(a, b, bounds)
    active = np.maximum(most + w["offset"], 0)
    error = ((sigmoid(active @ w["out"] + w["bias"][0]) - labels) / len(labels)).astype(np.float32)
    back = error[:, None] * w["out"] * (active > 0)
    g = {"out": active.T @ error, "bias": np.array([error.sum()], np.float32), "offset": back.sum(0)}
    g["embed"] = np.zeros_like(w["embed"])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for k, width in enumerate(WIDTHS):
        for j in range(width):
            g[f"filter{k}_{j}"] = np.zeros_like(w[f"filter{k}_{j}"])
        for f in range(FILTERS):
            c = k * FILTERS + f
            hits = np.flatnonzero(answers[:, c] >= most[text, c])
            docs, first = np.unique(text[hits], return_index=True)
            docs, at = docs[back[docs, c] != 0], hits[first[back[docs, c] != 0]]
            for j in range(width):
                ok = at + j < bounds[1:][docs]
                place, e = at[ok] + j, back[docs[ok], c]
                x = w["embed"][a[place]] + w["embed"][b[place]]
                g[f"filter{k}_{j}"][:, f] += x.T @ e
                push = e[:, None] * w[f"filter{k}_{j}"][:, f]
                np.add.at(g["embed"], a[place], push)
                np.add.at(g["embed"], b[place], push)
    g["embed"][0] = 0
    return g


def _thresholds(counts: np.ndarray) -> np.ndarray:
    """From rows counted by language, label and bin: the logit of each language at which the F1 of label 1 is largest."""

    def best(zeros: np.ndarray, ones: np.ndarray) -> float:
        if not ones.sum() or not zeros.sum():
            return 0.0
        hit, told = np.cumsum(ones[::-1])[::-1], np.cumsum((zeros + ones)[::-1])[::-1]
        f1 = 2 * hit / (told + ones.sum())
        first = int(np.argmax(f1))
        same = np.flatnonzero(f1[first:] != f1[first])
        last = first + (int(same[0]) if len(same) else len(f1) - first) - 1  # the middle of the bins that tell alike
        return (first + last) / 2 / BINS - EDGE

    overall = best(*counts.sum(0))
    return np.array([best(*own) if own.sum(1).min() >= POSITIVES else overall for own in counts])


def _fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id: str, text: str) -> Model:
    """A model of a sample, with thresholds from all labelled rows that never train."""
    part = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit("calibrate")), F.lit(round(1 / KEPT_BACK)))
    model = fit(labelled_sample(docs, labels, label, learn & (part != 0), id, text), kept_back=0)
    if model.constant is not None:
        return model
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).where(learn & (part == 0))
    known = known.groupBy(F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    rows = bounded_batches(docs).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(small(materialize(known, "calibrate")), F.col("id") == F.col("_id")).select("text", "label")
    shared, size = docs.sparkSession.sparkContext.broadcast(model), 2 * EDGE * BINS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES) + 1) * 2 * size, np.int64)
        for batch in portions(batches):
            logit, language = shared.value.judged(words_of(batch, lower=True, between=NOT_ALNUM))
            at = np.clip((logit + EDGE) * BINS, 0, size - 1).astype(np.int64)
            one = np.asarray(batch.column("label")) == 1
            np.add.at(total, (language * 2 + one) * size + at, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = rows.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(LANGUAGES) + 1) * 2 * size, np.int64)
    counts[np.asarray(cells["cell"])] = np.asarray(cells["n"])
    model.shift = _thresholds(counts.reshape(len(LANGUAGES) + 1, 2, size))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, learn=None, label: str = "toxic", id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, score, predicted. `learn` is the condition on rows of `labels` to learn from."""
    model = _fitted(docs, labels, label, F.lit(True) if learn is None else learn, id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            score = shared.value.score(words_of(batch, lower=True, between=NOT_ALNUM))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], ["id", "score"])

    rows = bounded_batches(docs).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInArrow(scored, f"id {docs.schema[id].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns; a filter as they are read."""
    model = _fitted(docs, labels, label, F.lit(True), id, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            score = shared.value.score(words_of(batch, text, lower=True, between=NOT_ALNUM))
            yield batch.filter(pa.array(score < THRESHOLD))

    return bounded_batches(docs).mapInArrow(clean, docs.schema)
