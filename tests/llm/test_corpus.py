"""Mixing, packing, token counts and the pipeline."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bankmail.llm import packing
from bankmail.llm.mixing import mix, mixed
from bankmail.llm.packing import pack
from bankmail.llm.token_counts import at_limits, length_histogram, quantiles
from bankmail.llm.tokens import encoder, vocabulary
from compare import TESTDATA


def plain_targets(sizes):
    """Shares by weight, with the excess dealt again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), Fraction(3 * sum(sizes.values()), 2)
    while open_:
        per = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * per >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * per for s in open_}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            rest -= target[s]
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing_of_odd_rows(odd, rows, none):
    sizes = defaultdict(int)
    for _, x, s in rows:
        sizes[s] += words(x)
    goal = plain_targets(sizes)
    found = mix(odd).collect()
    assert len(found) == len(rows) and all(r.taken == r["copies"] * r["size"] and r["copies"] in (0, 1, 2) for r in found)
    source = {(d, words(x)): s for d, x, s in rows}
    taken = Counter()
    for r in found:
        s = source[r.doc_id, r["size"]]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(goal[s]))
    largest = {s: max(words(x) for _, x, o in rows if o == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    assert mix(none).count() == 0 and mixed(none).count() == 0
    out = mixed(odd)
    assert out.columns == odd.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(str(r.doc_id) for r in found for _ in range(r["copies"]))


def test_mixing_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet")
    found = mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"))
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1 for r in found.collect())


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_ids_equal_the_tokenizer(tokenizer, spark):
    texts = ["", " ", "  a  b ", "a\n b", "a \n\n  b\tc ", "it's we'll don 't", "Grüße    x", "<|endoftext|> a", " lead", "trail ", "a\x85 b\x1c c", "日本 語 12 345 6.7!!"]
    texts += [r.text for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").select("text").collect()]
    encode = encoder(vocabulary()).ids
    for x in texts:
        assert np.frombuffer(encode(x), np.uint32).tolist() == tokenizer.encode(x, add_special_tokens=False).ids, x[:80]


def by_value():
    """The workers cannot import this module; what is made inside a function travels whole."""

    def letters(text):
        return b"".join(ord(c).to_bytes(4, "little") for c in text)

    return letters


letters = by_value()


def check_packed(found, rows, ids_of, length):
    """Every document's ids are in its pieces once, and sequences are gapless. Returns the sequences' lengths."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    whole = Counter()
    for (d, total), parts in pieces.items():
        for k in range(sum(s == 0 for s, _ in parts)):
            whole[d, total] += 1
        assert sum(len(i) for _, i in parts) == 4 * total * whole[d, total]
        if whole[d, total] == 1:
            expected = next(x for e, x, _ in rows if e == d and len(ids_of(x or "")) // 4 + 1 == total)
            assert b"".join(i for _, i in sorted(parts)) == ids_of(expected or "") + bytes(4)
    assert sum(whole.values()) == len(rows)
    return [sum(n for _, n in parts) for parts in sequences.values()]


@pytest.mark.parametrize("group", [256, 2])
def test_packing_of_odd_rows(odd, rows, none, group, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", group)  # 2: leftovers are merged over several levels
    lengths = check_packed(pack(odd, length=64, windows=3, ids_of=letters).collect(), rows, letters, 64)
    assert sum(n < 64 for n in lengths) <= 1
    assert pack(none).count() == 0


def test_packing_with_the_vocabulary(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    lengths = check_packed(pack(docs).collect(), rows, encoder(vocabulary()).ids, 1024)
    assert sum(n < 1024 for n in lengths) <= 1


def test_token_counts(odd, rows, none, spark):
    lengths = [len(x or "") for _, x, _ in rows]
    found = length_histogram(odd, ids_of=letters)
    for r in found.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.tokens_truncated == sum(min(x, n) for x in lengths) and r.share_within == pytest.approx(np.mean([x <= n for x in lengths]))
    ordered, n = sorted(lengths), len(lengths)
    at = {q: r.n_tokens for r in found.collect() for q in r.percentiles}
    assert at == {q: ordered[max(1, math.ceil(q / 100 * n)) - 1] for q in range(101)}
    shares = [0.0, 0.001, 0.333, 0.5, 0.999, 1.0]
    assert {r.share: r.n_tokens for r in quantiles(found, shares).collect()} == {q: ordered[max(1, math.ceil(q * n)) - 1] for q in shares}
    limits = spark.createDataFrame([(k,) for k in (0, 1, 17, 512, 10**6)], "limit long")
    for r in at_limits(found, limits).collect():
        assert r.tokens_truncated == sum(min(x, r.limit) for x in lengths) and r.docs_at_least == sum(x >= r.limit for x in lengths)
    assert length_histogram(none).count() == 0


def test_pipeline(spark):
    from test_dedup import join_plain

    sf = f"{TESTDATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: stages[name](spark, rows, sf).cache()

    clean = run("toxicity", docs)
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and np.mean([(d in kept) == (not y) for d, y in labels.items()]) > 0.95
    single = run("exact_dedup", clean)
    largest = {}
    for d in kept:
        largest[before[d].text] = max(d, largest.get(before[d].text, d))
    assert sorted(r.doc_id for r in single.collect()) == sorted(largest.values())
    apart = run("ngram_join", single)
    components = join_plain([(d, before[d].text, None) for d in largest.values()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(d for d, _, c in components if d == c)
    chosen = run("mixing", apart)
    assert chosen.columns == docs.columns and 1.3 < sum(words(r.text) for r in chosen.collect()) / sum(words(r.text) for r in apart.collect()) < 1.7
    pieces = run("packing", chosen)
    ids = encoder(vocabulary()).ids
    assert sum(r.length for r in pieces.collect()) == sum(len(ids(r.text)) // 4 + 1 for r in chosen.collect())


def test_pipeline_of_odd_rows(odd, none, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert (docs.count() > 0) == (docs is not None and bool(docs.take(1)))
