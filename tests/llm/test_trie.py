"""The trie of conversations against SQL and a plain version, its queue with and without spilling."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from bankmail.llm import queries, trie
from bankmail.llm.trie import Queue, prefix_trie, time_forward, turn_keys

from compare import TESTDATA, difference

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, key1 string, part int"


def plain_trie(convs):
    """Rows of the trie of {conv: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    order = lambda c: (c is not None, c)
    least = {p: min(cs, key=order) for p, cs in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted((c for c in cs if len(convs[c]) == len(p)), key=order)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below if q)
        ids = ",".join("null" if c is None else str(c) for c in ends)
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(cs), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(rng, n, words=("a", "b b", "c c c", "")):
    convs = {}
    for c in range(n):
        if c and rng.random() < 0.5:  # goes on from another, or copies it
            base = convs[rng.randrange(c)]
            convs[c] = [*base[: rng.randrange(len(base) + 1)], *[("user", rng.choice(words)) for _ in range(rng.randrange(3))]]
        else:
            convs[c] = [(rng.choice(("user", "assistant")), rng.choice(words)) for _ in range(rng.randrange(1, 9))]
        convs[c] = convs[c] or [("user", "")]
    return convs


def table(spark, convs):
    rows = [(c, k, role, text, "x", "x", "x", 3) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("cut", [2, 3, 1024])
def test_against_plain(spark, cut):
    convs = conversations(random.Random(cut), 90)
    convs[500] = [("user", f"turn {k // 2}") for k in range(300)]  # longer than a task's share
    convs[501] = convs[500][:250]
    keys = turn_keys(table(spark, convs))
    assert rows_of(prefix_trie(keys, keys.select("conv"), cut)) == plain_trie(convs)


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "no id"), (None, 0, None, None), (3, None, "user", "null turn"), (3, None, "user", "another null"), (3, -1, "user", "b"), (3, -1, "user", "a"), (3, -1, "assistant", "z")]
    rows += [(4, 0, "user", "twice"), (4, 0, "user", "twice"), (5, 0, "", ""), (6, 0, "user", "w " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA)
    convs = {
        None: [("", ""), ("user", "no id")], 3: [("user", "another null"), ("user", "null turn"), ("assistant", "z"), ("user", "a"), ("user", "b")],
        4: [("user", "twice")] * 2, 5: [("", "")], 6: [("user", "w " * 50_000)], 9: [],
    }
    keys = turn_keys(docs)
    members = keys.select("conv").unionByName(spark.createDataFrame([(9,)], "conv long"))
    assert rows_of(prefix_trie(keys, members)) == plain_trie(convs)
    empty = turn_keys(docs.where("false"))
    assert prefix_trie(empty, empty.select("conv")).count() == 0
    alone = prefix_trie(empty, spark.createDataFrame([(9,), (7,)], "conv long")).collect()
    assert [tuple(r)[:7] for r in alone] == [(7, 0, None, 2, 0, 1, 0)] and alone[0].ends_sha256 == hashlib.sha256(b"7,9").hexdigest()


def test_chunks_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    convs = {c: [("user", "same")] for c in range(-20, 400)}
    keys = turn_keys(table(spark, convs))
    assert rows_of(prefix_trie(keys, keys.select("conv"))) == plain_trie(convs)


def test_queue_spills():
    rng = random.Random(4)
    for most in (1, 3, 50, 10_000):
        queue, waiting = Queue(most), defaultdict(list)
        for _ in range(2000):
            key = (-rng.randrange(3), rng.randrange(20), rng.randrange(2))
            queue.push(key, rng.randrange(9), rng.randrange(9))
            waiting[key].append(1)
        for key in sorted(waiting):
            assert queue.pop(key)[0] == len(waiting[key])
        assert queue.pop((1, 0, 0)) == (0, 0, 0)


def test_time_forward_of_a_path_and_a_star():
    names = ["depth", "id1", "id2", "parent1", "parent2", "top", "leaves", "saved"]
    nodes = [(2, 10 + k, 0, 1, 0, False, 1, k) for k in range(50)] + [(1, 1, 0, 0, 0, False, 0, 5), (0, 0, 0, 0, 0, True, 0, 0)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k]]) for k in range(8)], names) for r in nodes]
    done = [b.to_pylist()[0] for b in time_forward(iter(batches), most=4)]
    assert (done[-1]["leaves"], done[-1]["saved"]) == (50, sum(range(50)) + 5)


def test_query_of_turnless_and_missing_sources(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, k if rng.random() < 0.9 else None, rng.choice(("user", None)), rng.choice(("hi", "x y", None, "z"))) for c in [-21, -20, -3, 0, 5, 7, 19, 20, 23, 39, 41, 47, 59] for k in range(rng.randrange(1, 5))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES["op12_prefix_trie"])
    names = [d[0] for d in cur.description]
    assert rows_of(got.select(names)) == sorted(cur.fetchall(), key=repr)


def test_query(spark):
    assert difference(queries.QUERIES["op12_prefix_trie"](spark, f"{TESTDATA}/sf0.01"), queries.ORACLES["op12_prefix_trie"], f"{TESTDATA}/sf0.01") is None
