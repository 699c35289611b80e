"""Personal data, fingerprints, classifiers: against plain versions and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bankmail.llm import pii
from bankmail.llm import quality as q
from bankmail.llm import toxicity as t
from bankmail.llm.fingerprints import containment, fingerprint, likeness, merged, neighbours, sketch_of, sketches
from bankmail.llm.hashing import NOT_ALNUM, U64, Words, shingles, text_buffers
from bankmail.llm.pii import KINDS, base_spans, luhn, personal_data

from compare import TESTDATA

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    ok = [
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
        lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m)), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if ok[k](m[0]))


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    pieces = ["a@b.co", "@", ".", "-", "+", " ", "1", "12", "255.", "256", "0", "4539 5787 6362 1486", "4539578763621486", "+49 (30) 1234-5678", "x", "é", "10.0.0.1", "00010.1.2.3", "\n", "a.b@c-d.e.f", "²"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert base_spans(text) == plain_spans(text), text


def test_contexts_discover_what_the_patterns_miss(spark):
    cards = ["4539578763621486", "4556737586899855", "4916338506082832", "4024007198964305"]
    rows = [(k, f"pay with Card number: {c} today") for k, c in enumerate(cards)]
    rows += [(10, "wrong Card number: 4539578763621487 here"), (11, "in the year 4539578763621487 of long numbers"), (12, None), (13, "")]
    rows += [(20 + k, f"mail is at the door of the house at a{k}@b.org and at the time") for k in range(4)] + [(30, "at root@localhost it ended")]
    found = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    assert [tuple(s) for s in found[10].added] == [(19, 2, 35)]
    assert not found[11].added and not found[30].added  # "at" and "year" are no patterns of identifiers
    assert found[0].base[0].kind == KINDS.index("card") and not found[12].base


CARDS = ["4539578763621486", "4556737586899855", "4916338506082832", "4024007198964305"]


def test_a_common_word_is_no_pattern(spark):
    rows = [(k, f"{k} mine {c} on Account {c}") for k, c in enumerate(CARDS)]
    rows += [(100, "99 mine 4539578763621487 then"), (101, "on account 4539578763621487 then")]
    rows += [(200 + k, "a gold mine is no mine of data") for k in range(40)]  # no digit or @
    found = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not found[100].added  # "mine" mostly stands elsewhere
    assert [tuple(s) for s in found[101].added] == [(11, 2, 27)]


def test_candidates_in_groups():
    def found(text):
        return {(text[s:e], KINDS[k]) for s, e, kinds, _ in pii._document(text)[1] for k in kinds}

    assert found("Card number: 4539 5787 6362 1487 2024") >= {("4539 5787 6362 1487", "card")}
    assert found("call 030 1234 5678.") == {("030 1234 5678", "phone")}
    assert ("(017) 555-7713", "phone") in found("phone: (017) 555-7713, or")
    assert ["<phone:", ">,"] in [c for s, e, _, c in pii._document("phone: (017) 555-7713 , or")[1]]
    assert found("host 1.2.3.400 up") == {("1.2.3.400", "ip")} and ("1.2.3.400", "ip") in found("host:1.2.3.400")
    assert found("at 10.0.0.1 030 1234 5678 a@b.co") == {("030 1234 5678", "phone")}  # next to base spans
    assert not found("of 12 34 and 5.6 x1234567 1.2.3")


def test_grouped_identifiers_are_discovered(spark):
    rows = [(k, f"pay with Card number: {c} today") for k, c in enumerate(CARDS)] + [(10, "wrong Card number: 4539 5787 6362 1487 here")]
    found = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[10].added] == [(19, 2, 38)]


def test_occurrences_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "PATTERNS", 2)  # several passes
    rows = spark.createDataFrame([("Mine is\tno mine",), ("no",), ("mine",), ("",), ("x no  MINE then",)], "text string").repartition(3)
    wanted = spark.createDataFrame([("mine",), ("no mine",), ("is",), ("then",), ("of a",), ("no",)], "pattern string")
    assert dict(map(tuple, pii.occurrences(rows, wanted).collect())) == {"mine": 4, "no mine": 2, "is": 1, "then": 1, "no": 3}
    assert not pii.occurrences(rows, wanted.where("false")).collect()


def test_personal_data_of_odd_rows(odd, rows, none):
    found = personal_data(odd).collect()
    expected = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(x or "")] for _, x, _ in rows]
    assert sorted(r.base_sha256 for r in found) == sorted(hashlib.sha256(",".join(x).encode()).hexdigest() for x in expected)
    assert personal_data(none).count() == 0


def test_fingerprints_of_odd_rows(odd, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [x or "" for _, x, _ in order]
    edited = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for x, y in zip(texts, [*texts[1:], texts[0]], strict=True)]
    own = [fingerprint(s) for s in sketches(pa.array(texts))]
    expected = sorted((str(d), len(x), hashlib.sha256(e.encode()).hexdigest(), f) for (d, _, _), x, e, f in zip(order, texts, edited, own, strict=True))
    found = neighbours(odd).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint) for r in found) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert neighbours(none).count() == 0


def test_one_document_follows_itself(spark):
    row = neighbours(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert row.near_next == 1.0


def test_sketches_estimate_similarity():
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(6000)]
    whole, part, other = " ".join(words), " ".join(words[:1500]), " ".join(words[1000:7000] + ["x"])
    a, b, c = sketches(pa.array([whole, part, other]))
    assert a[0] == 8 and len(a[1]) == pytest.approx(6000 / 8, rel=0.15)
    assert containment(b, a) == 1 and containment(a, b) == pytest.approx(0.25, abs=0.04)
    assert likeness(a, c) == pytest.approx(5 / 6, abs=0.05)
    short = sketches(pa.array([" ".join(words[:60])]))[0]
    assert short[0] == 1 and containment(short, a) == 1
    assert fingerprint(sketch_of(fingerprint(a))) == fingerprint(a)
    assert (merged(a, b)[1] == a[1]).all()


def test_sketches_of_repeated_lines():
    lines = [" ".join(f"w{n}_{k}" for k in range(8)) for n in range(60)]
    texts = [" ".join([line] * 200) for line in lines] + [" ".join(lines[:2] * 100)]
    found = sketches(pa.array(texts))
    for text, (scale, hashes) in zip(texts, found, strict=True):
        words = text.split()
        assert scale == 1 and len(hashes) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert len({fingerprint(s) for s in found}) == len(texts)
    assert likeness(found[0], found[1]) == 0 and likeness(found[0], found[0]) == 1
    assert likeness(found[0], found[-1]) == pytest.approx(4 / 20)  # of 8 and 16 shingles, the 4 within the line
    assert likeness((8, found[0][1][:0]), (8, found[1][1][:0])) == 0


def test_hashes_of_words():
    texts = ["one two  one", "", "\tThree ONE\n", "x" * 3_000_000, None]
    plain, low = (Words(*text_buffers(pa.array(texts)), lower=k) for k in (False, True))
    assert plain.counts.tolist() == [3, 0, 2, 1, 0]
    assert plain.hashes[0] == plain.hashes[2] != plain.hashes[4] and low.hashes[0] == low.hashes[4]
    letters = Words(*text_buffers(pa.array(["a-b, ü!", "b"])), between=NOT_ALNUM)
    assert letters.counts.tolist() == [3, 1] and letters.hashes[1] == letters.hashes[3]
    h, of = shingles(low)
    assert of.tolist() == [0, 2, 3] and len(set(h.tolist())) == 3


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    return docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("toxic"), F.col("quality").cast("double").alias("quality")).toArrow()


@pytest.mark.parametrize("module, label, of, rest, how", [(t, "toxic", 4, 2, {"lower": True, "between": NOT_ALNUM}), (q, "quality", 5, 0, {})])
def test_held_out_labels(labelled, module, label, of, rest, how):
    held = np.array([zlib.crc32(str(d).encode()) % of == rest for d in labelled["doc_id"].to_pylist()])
    rows = labelled.select(["text", label]).rename_columns(["text", "label"])
    model, test = module.fit(rows.filter(pa.array(~held))), rows.filter(pa.array(held))
    score, y = model.score(Words(*text_buffers(test["text"]), **how)), np.asarray(test["label"]) > 0
    assert ((score >= module.THRESHOLD) == y).mean() > 0.97
    again = model.score(Words(*text_buffers(test["text"].slice(7, 1)), **how))
    assert again[0] == pytest.approx(score[7], abs=1e-5)  # a score depends on its own text only


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(100, 140)] + [(None, 1, True), (100, None, None), (101, 0, None)], "doc_id long, toxic int, quality boolean")
    labels = labels.withColumn("quality", F.col("quality").cast("int"))
    for run in (lambda d, x: t.toxicity(d, x), lambda d, x: q.quality(d, x)):
        scored = run(odd, labels).collect()
        assert len(scored) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
        assert {r.score for r in run(odd, labels.where("false")).collect()} == {0.0}
        assert run(none, labels).count() == 0
    assert t.without_toxic(odd, labels.where("false")).columns == odd.columns
    assert t.without_toxic(odd, labels.where("false")).count() == odd.count()


def test_words_of_one_slot_keep_their_vectors(monkeypatch):
    monkeypatch.setattr(t, "SLOTS", 8)
    rows = [(" ".join(f"w{(k * j) % 40}" for j in range(30)), float(k % 2)) for k in range(60)]
    model = t.fit(pa.table({"text": [r[0] for r in rows], "label": [r[1] for r in rows]}))
    known = model.hashes[1:]
    assert len(known) > 8 and (model.rows(known) == np.arange(1, len(model.hashes))).all()
    assert (model.rows(known ^ U64(1 << 40)) == 0).all()


def _card(k):
    """A number of 16 digits that passes the check, or, for odd k, just fails it."""
    digits = f"4539{k:011d}"
    last = next(c for c in range(10) if luhn(f"{digits}{c}"))
    return f"{digits}{(last + k % 2) % 10}"


def test_found_instances_support_new_patterns(spark):
    rows = [(k, f"the card number: {_card(2 * k)} was given") for k in range(80)]
    rows += [(100 + k, f"his card number: {_card(2 * k + 1)} too") for k in range(8)]
    rows += [(200 + k, f"see vaultref {_card(2 * k + 1)} there") for k in range(8)] + [(300, f"in vaultref {_card(4001)} as well")]
    rows += [(400, "his card number:" + " " * 90 + f"{_card(5001)} far off"), (401, f"{'x' * 300} card number: {_card(5003)}"), (402, f"card number:\n{_card(5005)} on a new line")]
    rows += [(500 + k, f"order {_card(2 * k + 6001)} is done") for k in range(40)] + [(600 + k, f"order {_card(2 * k + 6000)} is done") for k in range(4)]
    found = {r.doc_id: r.added for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(found[k]) == 1 for k in [*range(100, 108), *range(200, 208), 300, 400, 401])
    assert not found[402] and not any(found[500 + k] for k in range(40))  # by chance some orders pass the check


def test_as_many_candidates_as_seeds(spark):
    rows = [(k, f"pan {_card(k)}") for k in range(8)]
    found = {r.doc_id: r.added for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(found[k]) for k in range(8)] == [0, 1] * 4


def plain_patterns(edges):
    """The rounds over rows (kind, pattern, instance, seed, n, seen) in Python."""
    known, size = {}, -1
    while size < len(known):
        size, good = len(known), {}
        for key in {e[:2] for e in edges}:
            own = [(1.0 if seed else known.get((k, i), 0.0), n, seen) for k, p, i, seed, n, seen in edges if (k, p) == key]
            held = sum(score * n for score, n, _ in own)
            confidence = held / (held + pii.UNKNOWN * sum(n * (1 - score) for score, n, _ in own) + max(0, max(x[2] for x in own) - sum(x[1] for x in own)) + pii.DOUBT)
            if confidence >= pii.CONFIDENT and sum(score >= pii.CONFIDENT for score, _, _ in own) >= pii.SEEDS:
                good[key] = confidence
        doubt = {}
        for k, p, i, seed, _, _ in edges:
            if not seed and (k, p) in good:
                doubt[k, i] = doubt.get((k, i), 1.0) * (1 - 0.999 * good[k, p])
        known = {key: 1 - d for key, d in doubt.items()}
    return good


def test_scores_equal_a_plain_version(spark):
    rng, several = random.Random(8), 0
    for _ in range(4):
        edges, seen = {}, {}
        for _ in range(500):
            p = int(25 * rng.random() ** 2)
            i = rng.randrange(8) + 4 * p if rng.random() < 0.8 else rng.randrange(120)
            k = rng.randrange(2)
            seen.setdefault((k, p), rng.randrange(30))
            edges[k, f"p{p}", f"i{i}", i % 3 == 0] = edges.get((k, f"p{p}", f"i{i}", i % 3 == 0), 0) + 1
        rows = [(*e, n, seen[e[0], int(e[1][1:])]) for e, n in edges.items()]
        found = {(r.kind, r.pattern): r.confidence for r in pii.patterns(spark.createDataFrame(rows, "kind int, pattern string, instance string, seed boolean, n long, seen long")).collect()}
        plain = plain_patterns(rows)
        assert set(found) == set(plain) and all(abs(found[k] - plain[k]) < 1e-9 for k in plain)
        several += len(plain)
    assert several > 4


def test_fingerprints_equal_a_plain_version(spark):
    """Shingles as sets of words; the hash of each comes from a text of its own."""
    rng, n = random.Random(12), [3, 8, 40, 140, 500, 1500]
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "eee", "f"]) for _ in range(rng.choice(n))) for _ in range(40)] + ["", "x", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4] for k, t in enumerate(texts)]

    def plain(text):
        words = text.split()
        parts = sorted({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}) if words else []
        hashes = [int(shingles(Words(*text_buffers(pa.array([p]))))[0][0]) for p in parts]
        below = [h for h in hashes if h < (1 << 64) // 8]
        return (1, set(hashes)) if len(hashes) <= 128 or not below else (8, set(below))

    def like(a, b):
        if a[0] != b[0]:
            a, b = ((s, {h for h in hs if h < (1 << 64) // 8}) for s, hs in (a, b))
        return len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] | b[1] else 1.0

    own, other = [plain(t) for t in texts], [plain(t) for t in edited]
    assert {s for s, _ in own} == {1, 8}
    for r in neighbours(docs).collect():
        k = r.doc_id
        assert r.fingerprint == f"{own[k][0]}:" + "".join(f"{h:016x}" for h in sorted(own[k][1]))
        assert r.edited_fingerprint == f"{other[k][0]}:" + "".join(f"{h:016x}" for h in sorted(other[k][1]))
        assert r.near_edited == pytest.approx(like(own[k], other[k])) and r.near_next == pytest.approx(like(own[k], own[(k + 1) % len(texts)]))


def test_thresholds_from_counts():
    rng = np.random.default_rng(3)
    logits, language = rng.normal(0, 3, 4000), rng.integers(0, 3, 4000)
    labels = (logits + rng.normal(0, 1, 4000) > language).astype(int)
    size = 2 * t.EDGE * t.BINS
    counts = np.zeros((len(t.LANGUAGES) + 1, 2, size), np.int64)
    np.add.at(counts, (language, labels, ((logits + t.EDGE) * t.BINS).astype(int)), 1)
    counts[3, 1, 700] = 2  # too few for a threshold of its own
    found = t._thresholds(counts)
    for k in range(3):
        own, y = logits[language == k], labels[language == k]
        f1 = lambda x: 2 * y[own >= x].sum() / ((own >= x).sum() + y.sum())
        assert f1(found[k]) >= max(map(f1, own)) - 0.01
    assert found[3] == found[4] and found[0] < found[1] < found[2]


def test_pooling_equals_a_plain_forward_pass():
    rng = random.Random(5)
    rows = [" ".join(rng.choice(["bad", "good", "so", "very", "x", "yes", "no"]) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    model = t.fit(pa.table({"text": rows, "label": [float("bad" in r) for r in rows]}))
    for text in [*rows[:20], "", "bad"]:
        words = Words(*text_buffers(pa.array([text])), lower=True, between=NOT_ALNUM)
        a, b = map(model.rows, t._parsed(words))
        w = model.weights
        x = [w["embed"][i] + w["embed"][j] for i, j in zip(a, b)]
        active = []
        for k, width in enumerate(t.WIDTHS):
            for f in range(t.FILTERS):
                answers = [sum(float(x[at + j] @ w[f"filter{k}_{j}"][:, f]) for j in range(width) if at + j < len(x)) for at in range(len(x))]
                active.append(max(0.0, max(answers, default=0.0) + float(w["offset"][k * t.FILTERS + f])))
        logit = float(np.dot(active, w["out"]) + w["bias"][0])
        assert model.judged(words)[0][0] == pytest.approx(logit, abs=1e-4)
