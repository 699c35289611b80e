"""Search semantics on a small set, and scores against a plain computation."""

import math

import pytest
from pyspark.sql import functions as F

from bankmail.operators import search as Q

ROWS = [
    (1, "Debit Alert", "money paid café", "HDFC"),
    (2, "Offer", "alert debit now", "SBI"),
    (3, "Nothing", "debited alerts", "HDFC"),
]


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame(ROWS, "id long, subject string, body_text string, bank_name string")


def ids(mails, **terms):
    return sorted(r.doc_id for r in Q.search(Q.postings(mails), Q.doc_lengths(mails), **terms).collect())


@pytest.mark.parametrize(
    "terms, want",
    [
        ({"all": ["debit alert"]}, [1, 2]),
        ({"any": ["debit", "debited"]}, [1, 2, 3]),
        ({"all": ["alert"], "none": ["offer"]}, [1]),
        ({"phrase": "debit alert"}, [1]),
        ({"prefix": "deb"}, [1, 2, 3]),
        ({"all": ["hdfc"], "column": "bank_name"}, [1, 3]),
        ({"all": ["cafe"]}, [1]),
        ({"all": ["CAFÉ"]}, [1]),
        ({"near": (["debit", "alert"], 10)}, [1, 2]),
        ({"phrase": "alert money"}, []),
        ({"all": [" ... "]}, []),
        ({}, []),
    ],
)
def test_forms(mails, terms, want):
    assert ids(mails, **terms) == want


def brute_rank(rows, terms):
    """BM25 over the words of all fields, document by document."""
    docs = {r[0]: " ".join(r[1:]).lower().replace("é", "e").split() for r in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for doc, words in docs.items():
        score = 0.0
        for t in terms:
            n = sum(t in w for w in docs.values())
            idf = max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6)
            f = words.count(t)
            score += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if any(t in words for t in terms):
            out[doc] = -score
    return out


def test_scores_and_partitions(spark):
    words = "red green blue loan card bank money alert".split()
    rows = [(i, words[i % 8], " ".join(words[(i * k) % 8] for k in range(1, 3 + i % 9)), words[i % 3]) for i in range(60)]
    want = brute_rank(rows, ["loan", "money"])
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "id long, subject string, body_text string, bank_name string").repartition(parts)
        hits = Q.search(Q.postings(df), Q.doc_lengths(df), any=["loan", "money"], limit=None).collect()
        assert {r.doc_id: pytest.approx(r.rank, abs=1e-12) for r in hits} == want


def near_brute(words, a, b, n):
    """Whether a and b stand with at most n words between them."""
    return any(x == a and y == b and abs(i - j) - 1 <= n for i, x in enumerate(words) for j, y in enumerate(words))


def test_near_and_phrase_against_brute_force(spark):
    alphabet = "a b c d".split()
    rows = [(i, "", " ".join(alphabet[(i * i + k * (i % 5 + 1)) % 4] for k in range(12)), "") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, subject string, body_text string, bank_name string")
    for n in (0, 1, 3):
        want = [r[0] for r in rows if near_brute(r[2].split(), "a", "c", n)]
        assert ids(df, near=(["a", "c"], n), limit=None) == want
    for phrase in ("a b", "a b a", "c c"):
        assert ids(df, phrase=phrase, limit=None) == [r[0] for r in rows if f" {phrase} " in f" {r[2]} "]


def test_stored_index_gives_the_same(spark, mails, tmp_path):
    path = str(tmp_path / "postings")
    Q.index_layout(Q.postings(mails), 2).write.parquet(path)
    stored = spark.read.parquet(path)
    direct = Q.search(Q.postings(mails), Q.doc_lengths(mails), all=["debit"]).collect()
    assert Q.search(stored, Q.doc_lengths(mails), all=["debit"]).collect() == direct
    plan = Q.search(stored, Q.doc_lengths(mails), all=["debit"])._jdf.queryExecution().toString()
    assert "EqualTo(token,debit)" in plan


def test_offer_mails(mails):
    labelled = mails.withColumn("email_type", F.when(F.col("id") == 2, "CREDIT_LOAN_PROMOTION"))
    promotions = labelled.filter("email_type = 'CREDIT_LOAN_PROMOTION'")
    found = Q.search(Q.postings(mails), Q.doc_lengths(mails), all=["debit"], limit=1, among=promotions)
    assert [r.id for r in Q.search_emails(labelled, found).collect()] == [2]
    hits = Q.search(Q.postings(mails), Q.doc_lengths(mails), all=["debit"])
    assert sorted(r.id for r in Q.search_emails(mails, hits).collect()) == [1, 2]


def test_reindexing_from_the_documents_is_reindexing_their_postings(spark, mails):
    after = mails.filter("id <> 3").withColumn("body_text", F.when(F.col("id") == 2, "now now then").otherwise(F.col("body_text")))
    changed = spark.createDataFrame([(2,), (3,), (3,), (9,)], "id long")
    rows = Q.reindexed_from(mails, changed, after, with_distinct=True)
    want = Q.reindexed(Q.postings(mails), changed, after)
    assert sorted(map(tuple, rows.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    counted = rows.groupBy("doc_id", "field").agg(F.count_distinct("token").alias("n"), F.min("field_words").alias("a"), F.max("field_words").alias("b")).collect()
    assert len(counted) == 6 and all(r.n == r.a == r.b for r in counted)
