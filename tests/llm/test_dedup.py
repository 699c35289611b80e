"""Exact dedup, substring dedup and the n-gram join against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bankmail.llm import exact_dedup, ngram_join
from bankmail.llm.components import components
from bankmail.llm.exact_dedup import exact_duplicates, without_duplicates
from bankmail.llm.hashing import mix
from bankmail.llm.ngram_join import jaccard_components, one_of_each
from bankmail.llm.recompression import anchors
from bankmail.llm.substring_dedup import without_repeats


def exact_plain(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        stays = False
        for d in ids:
            kept, stays = d == keep and not stays, stays or d == keep
            out.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("max_cells", [1 << 28, 64])
def test_exact(odd, rows, max_cells, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_CELLS", 64)  # 64 cells: most rows look repeated, none is lost
    assert Counter(map(tuple, exact_duplicates(odd, max_cells=max_cells).collect())) == exact_plain(rows)


def test_exact_passes_most_rows_by(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.greatest("id", F.lit(10))).alias("text"))
    cells = exact_dedup.cells_for(5000)
    bitmaps = exact_dedup.repeated_cells(docs.select(F.xxhash64("text").alias("h")), cells)
    hit = bitmaps.select(F.sum(F.bitmap_count("bits"))).first()[0]
    assert 2 <= hit < 0.2 * cells
    assert exact_duplicates(docs).where("group_size > 1").count() == 11


def test_filter_keeps_one_row_of_each_text(odd, rows):
    left = without_duplicates(odd)
    assert left.columns == odd.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in rows})


def substring_plain(rows, window):
    first, words = {}, []
    for d, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append(w)
        for i in range(len(w) - window + 1):
            key, rank = tuple(w[i : i + window]), (d is None, d or 0)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for (d, _, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d is None, d or 0):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize("crowd", [10_000, 3])
def test_substring(odd, rows, crowd, monkeypatch):
    from bankmail.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "CROWD", crowd)  # 3: most anchors take the way of crowded ones
    assert Counter(map(tuple, without_repeats(odd).collect())) == substring_plain(rows, 50)


def test_substring_by_shuffle(odd, rows, monkeypatch):
    from bankmail.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BROADCAST", 0)
    assert Counter(map(tuple, without_repeats(odd).collect())) == substring_plain(rows, 50)


@pytest.mark.parametrize("vocabulary", [2, 3, 40, 1000])
def test_anchors_depend_on_the_window_only(vocabulary):
    rng = np.random.default_rng(vocabulary)
    shared = rng.integers(0, vocabulary, 300)
    texts = [np.concatenate([rng.integers(0, vocabulary, rng.integers(30)), shared[rng.integers(60) : rng.integers(120, 300)], rng.integers(0, vocabulary, 40)]) for _ in range(20)]
    texts += [np.array([1] * n + [0] * m) for n, m in ((60, 0), (90, 40), (45, 130))] + [np.array([1, 0] * 60), np.array([0, 0, 1] * 50)]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    words = mix(np.concatenate(texts).astype(np.uint64) + np.uint64(9))
    anchor, seen = anchors(words, bounds, 50), {}
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        assert (anchors(words[lo:hi], np.array([0, hi - lo]), 50) == anchor[lo:hi]).all()
        for i in range(lo, hi - 49):
            assert anchor[i] and seen.setdefault(tuple(words[i : i + 50]), anchor[i]) == anchor[i]


def test_anchors_of_short_periods_alone_and_together():
    rng = np.random.default_rng(4)
    texts = [mix(np.tile(rng.integers(0, 1 << 40, rng.integers(1, 6)), 80)[: rng.integers(60, 80)].astype(np.uint64)) for _ in range(200)]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    together = anchors(np.concatenate(texts), bounds, 50)
    for text, lo, hi in zip(texts, bounds, bounds[1:], strict=False):
        assert (anchors(text, np.array([0, len(text)]), 50) == together[lo:hi]).all()


def join_plain(rows):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return Counter((d, len(sets[k]), least.get(find(k))) for k, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("often, large", [(32, 256), (3, 256), (1000, 4), (1, 2)])
def test_join(odd, rows, often, large, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", often)  # small: nearly all shingles are frequent
    monkeypatch.setattr(ngram_join, "LARGE", large)  # small: fragments pass their groups on
    assert Counter(map(tuple, jaccard_components(odd).collect())) == join_plain(rows)


@pytest.mark.parametrize("n", [4, 60, 600])
def test_join_of_many_near_copies(spark, n):
    base = [f"b{k}" for k in range(90)]
    rows = [(k, " ".join(base[:k] + [f"e{k}"] + base[k + 1 :]), None) for k in range(n)]
    rows += [(1000 + k, " ".join(base[:30] + [f"o{k}_{i}" for i in range(60)]), None) for k in range(n)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    assert Counter(map(tuple, jaccard_components(docs).collect())) == join_plain(rows)


def test_pairs_of_one_component_do_not_meet(spark, monkeypatch):
    """Near copies of one text that also share rare shingles in tens: stars link them, and no fragment pairs them again."""
    rng = random.Random(6)
    base, edits = [f"b{k}" for k in range(100)], [f"e{k}" for k in range(8)]
    texts = []
    for _ in range(300):
        words = list(base)
        words[rng.randrange(10, 20)] = rng.choice(edits)
        texts.append(words)
    rows = [(k, " ".join(t), None) for k, t in enumerate(texts)]
    met = []
    plain = ngram_join._meeting
    monkeypatch.setattr(ngram_join, "_meeting", lambda *a: met.append(plain(*a)) or met[-1])
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    assert Counter(map(tuple, jaccard_components(docs).collect())) == join_plain(rows)
    assert met[0].where("y is not null").count() < 300


def test_pairs_that_hold_too_few_common_shingles_are_not_made(spark):
    """Forty sets share one frequent shingle of ten; the last two share nine."""
    sets = [[0, *range(9 * k + 1, 9 * k + 10)] for k in range(40)]
    sets[39] = [*sets[38][:9], 999]
    lists = [mix(np.array(s, np.uint64)) for s in sets]
    bounds = np.arange(0, 401, 10)
    held = spark.createDataFrame(list(enumerate(ngram_join._held(np.concatenate(lists), bounds).to_pylist())), "node long, held array<long>")
    hot = [(int(h), k, 10, 10, True) for k, s in enumerate(lists) for h in s.view(np.int64)]
    hot = spark.createDataFrame(hot, "h long, node long, n long, n_hot long, first boolean")
    made = ngram_join._crossing(hot, spark.createDataFrame([], "node long, root long"), held).distinct().collect()
    assert (38, 39, 10, 10) in made and len(made) < 5  # 780 pairs share the one


def test_one_of_each(odd, rows):
    left = one_of_each(odd)
    expected = Counter(d for d, _, c in join_plain(rows).elements() if d is None and c is None or d == c)
    assert left.columns == odd.columns and Counter(r.doc_id for r in left.collect()) == expected


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)]
    links = spark.createDataFrame([*chain, (500, 501), (700, 600), (600, 650), (9, 9)], "a long, b long")
    found = dict(map(tuple, components(links).collect()))
    assert found == {**{k: 0 for k in range(201)}, 500: 500, 501: 500, 600: 600, 650: 600, 700: 600}


@pytest.mark.parametrize("run", [exact_duplicates, without_duplicates, without_repeats, jaccard_components, one_of_each])
def test_empty(none, run):
    assert run(none).count() == 0
