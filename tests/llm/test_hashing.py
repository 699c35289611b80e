"""Hashes of words and of sequences of words, where weaker ones collide."""

import random

import numpy as np
import pyarrow as pa

from bankmail.llm import hashing as H
from bankmail.llm.fingerprints import neighbours
from bankmail.llm.ngram_join import jaccard_components
from bankmail.llm.substring_dedup import without_repeats


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def words(*texts, **how):
    return H.Words(*H.text_buffers(pa.array(texts)), **how)


def test_arithmetic_modulo_the_prime():
    rng = random.Random(1)
    a, b = ([rng.randrange(H.PRIME) for _ in range(300)] + [0, 1, H.PRIME - 1] for _ in range(2))
    assert H.product(np.array(a, H.U64), np.array(b, H.U64)).tolist() == [x * y % H.PRIME for x, y in zip(a, b)]
    values = [rng.randrange(1 << 64) for _ in range(300)]
    total = [0]
    for k, v in enumerate(values):
        total.append((total[-1] + v * pow(H._BASE, k, H.PRIME)) % H.PRIME)
    assert H.prefixes(np.array(values, H.U64)).tolist() == total


def test_equal_stretches_have_equal_hashes():
    one = words("x y z a b c", "b c", "A B C").hashes
    spans = H.spans_hash(one, np.array([3, 4, 6, 0]), np.array([6, 6, 8, 3]))
    assert spans[1] == spans[2] and len(set(spans.tolist())) == 3
    assert words("ÄbC abc", lower=True).hashes[1] == words("abc").hashes[0]


def test_words_of_thue_and_morse():
    for n in (16, 32, 64, 1024, 4096, 16384):
        pair = words(" ".join(thue_morse(n))).hashes
        assert pair[0] != pair[1]
        spread = words(*(" ".join(w) for w in thue_morse(n)))
        spans = H.spans_hash(spread.hashes, spread.starts[:2], spread.starts[1:])
        assert spans[0] != spans[1]


def test_different_words_have_different_hashes():
    rng = random.Random(3)
    made = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(4000)} | {"a" * k for k in range(1, 200)}
    assert len(set(words(" ".join(sorted(made))).hashes.tolist())) == len(made)


def test_operators_tell_such_words_apart(spark):
    w, x = thue_morse(1024)
    filler = " ".join(f"f{k}" for k in range(60))
    rows = [(1, w), (2, x), (3, f"{w} {filler}"), (4, f"{x} {filler}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    components = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert components == {1: 1, 2: 2, 3: 3, 4: 3}  # 3 and 4 share 56 of 58 shingles
    assert {r.doc_id: r.n_removed for r in without_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 60}
    prints = {r.doc_id: r.fingerprint for r in neighbours(docs).collect()}
    assert prints[1] != prints[2]
