"""Periodic runs against a plain search of every period, and the query against a plain rebuilding of its texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bankmail.llm import queries
from bankmail.llm.hashing import words_of
from bankmail.llm.runs import periodic_runs, runs

from compare import TESTDATA


def plain_runs(words, least=6, times=4):
    """(start, length, period) by comparing all words that lie a period apart."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_in(texts, **how):
    words = words_of(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    first, end, q = runs(words.hashes, words.starts, **how)
    rows = np.searchsorted(first, words.starts)
    at = words.starts
    return [[(int(first[i] - at[k]), int(end[i] - first[i]), int(q[i])) for i in range(rows[k], rows[k + 1])] for k in range(len(texts))]


def _text(rng):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind < 0.4:
        return ["a"] * rng.randrange(80)
    out = []
    for _ in range(rng.randrange(1, 6)):
        u = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        out += u * rng.randrange(1, 9) + u[: rng.randrange(len(u) + 1)] + [rng.choice("abcdef") for _ in range(rng.randrange(4))]
    return out * rng.randrange(1, 5) if kind > 0.8 else out


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(400):
        texts = [_text(rng) for _ in range(rng.randrange(1, 6))]
        assert found_in([" ".join(t) for t in texts]) == [plain_runs(t) for t in texts], texts
    for least, times in ((1, 4), (20, 5)):
        texts = [_text(rng) for _ in range(200)]
        assert found_in([" ".join(t) for t in texts], least=least, times=times) == [plain_runs(t, least, times) for t in texts]


def test_edges_of_length_and_exponent():
    assert found_in(["a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "a b c " * 3 + "a b", "a b c " * 4, " \t\n", ""]) == [[], [(0, 6, 1)], [], [(0, 8, 2)], [], [(0, 12, 3)], [], []]
    thue = " ".join("ab"[bin(i).count("1") & 1] for i in range(2048))  # without any cube
    assert found_in([thue, "x " * 5000, "be not " * 900 + "be"]) == [[], [(0, 5000, 1)], [(0, 1801, 2)]]
    with pytest.raises(ValueError):
        periodic_runs(None, times=3)


def test_operator(odd, none, rows):
    got = sorted((r.doc_id is not None, r.doc_id, r.collapsed, tuple(map(tuple, r.runs))) for r in periodic_runs(odd).collect())
    expected = []
    for d, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = plain_runs(words) if len(words) < 20_000 else []
        expected.append((d is not None, d, plain_collapsed(words, found), tuple(found)))
    assert got == sorted(expected)
    assert periodic_runs(none).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, f"{TESTDATA}/sf0.001").collect()}
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for row in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 5000:
            continue
        found, r = plain_runs(words), got[row.doc_id]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
