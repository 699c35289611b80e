"""The trie of conversations by their first turns, with totals of every subtree by time-forward processing.

A node is a distinct sequence of first turns. Its name is a pair of polynomials modulo a prime in the
hashes of its turns (role and text), so a conversation can be cut anywhere: rows are sorted over all tasks, every task sums what it
has, and one row a task carries the sum on to where the conversation goes on. No task needs a whole conversation.

Totals go from children to parents. Nodes of one conversation are plain chains and need no work. The others have a
level, by how many conversations run through them: up to CUT, up to CUT * CUT, and so on. A topmost node of a
level with all nodes of that level below it is a shard; it has at most CUT nodes of any depth. Shards are dealt to tasks whole,
and each task's nodes are sorted externally, deepest first. A node takes the messages waiting for it from a
priority queue, adds its own share, and sends the totals to its parent, which comes later in the order. The queue keeps
QUEUE messages in memory and spills the rest in sorted runs to a file without a name, which no other task sees and which goes with the task. What the
roots of shards send is summed by parent before it shuffles, and waits for the next level's shards.

Defined cases: turns are ordered by the given columns, nulls first; equal ones by role, then text. Null roles and texts are
empty. Rows with a null conversation are one conversation, which comes before all others. Repeated rows are turns of their own. Long texts only
travel in the first sort. A conversation without turns is a member of the root alone. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches, materialize, n_words, small
from bankmail.llm.hashing import PRIME, U64, product, reduced

CUT, QUEUE, CHUNK = 1024, 100_000, 4096
#: Bases of the two polynomials, drawn once at random.
_BASES = (0x13C0D9A1B7F5E263 % PRIME, 0x1A84F3096CE7D1B5 % PRIME)
_STEP = 1 << 16
NODE = ["id1", "id2"]
KEYS = ["conv", "at", "key1", "key2", "words"]


class _Powers:
    """Powers of a base for exponents below 2 ** 32, from two tables."""

    def __init__(self, base: int):
        self.near, self.far = self._table(base), self._table(pow(base, _STEP, PRIME))

    @staticmethod
    def _table(base: int) -> np.ndarray:
        out = np.ones(1, U64)
        while len(out) < _STEP:
            out = np.append(out, product(out, np.full(1, pow(base, len(out), PRIME), U64)))
        return out

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        return product(self.near[exponents % _STEP], self.far[exponents // _STEP])


def _changes(conv: pa.Array, last) -> tuple[np.ndarray, object]:
    """Where a row's conversation is another than the row's before it (`last` before the first)."""
    values = conv.to_pylist()
    before = [last, *values[:-1]]
    return np.array([a != b for a, b in zip(values, before, strict=True)], bool), values[-1]


def _carried(rows: DataFrame, *values: str) -> list[tuple]:
    """For each part of rows sorted by conversation: (part, what its first conversation has of each value in the parts before).

    `rows` is written and has part, n (its place in the part), conv and the running values at each row. One row a part comes to the driver.
    """
    last = F.max_by(F.struct("conv", *values), "n").alias("last")
    ends = rows.groupBy("part").agg(F.min_by(F.struct("conv"), "n").alias("first"), last).orderBy("part").collect()
    out, conv, carry = [], object(), [0] * len(values)
    for row in ends:
        start = carry if row.first.conv == conv else [0] * len(values)
        out.append((row.part, *start))
        own = [row.last[v] for v in values]
        carry = [(a + b) % PRIME for a, b in zip(start, own, strict=True)] if row.last.conv == row.first.conv else own
        conv = row.last.conv
    return out


def _with_carried(rows: DataFrame, *values: str) -> DataFrame:
    """Rows with what their conversation had before this part, as carried_<value>: added to rows of the part's first conversation."""
    carried = rows.sparkSession.createDataFrame(_carried(rows, *values), "_part int, " + ", ".join(f"carried_{v} long" for v in values))
    joined = rows.join(F.broadcast(carried), F.col("part") == F.col("_part")).drop("_part")
    return joined.withColumns({f"carried_{v}": F.when(F.col("leading"), F.col(f"carried_{v}")).otherwise(0) for v in values})


def turn_keys(turns: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn",), role: str = "role", text: str = "text") -> DataFrame:
    """Written: (conv, at, key1, key2, words) of each turn: its place in its conversation, hashes of role and text, words of the text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = lambda k: F.xxhash64(F.lit(k), empty(role), empty(text))
    rows = bounded_batches(turns).select(
        F.col(conv).alias("conv"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(order)], empty(role).alias("role"), empty(text).alias("text"),
        key(1).alias("key1"), key(2).alias("key2"), n_words(F.col(text)).alias("words"),
    )
    by = ["conv", *[f"by{k}" for k in range(len(order))], "role", "text"]
    kind = turns.schema[conv].dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, last, at, leading = TaskContext.get().partitionId(), 0, object(), -1, False
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            change, last = _changes(batch.column("conv"), last)
            leading = n == 0 or leading
            place = np.arange(size)
            start = np.maximum.accumulate(np.where(change, place, -1))
            local = np.where(start < 0, at + 1 + place, place - start)
            first = np.cumsum(change) == (1 if n == 0 else 0) if leading else np.zeros(size, bool)
            leading, at = bool(first[-1]), int(local[-1])
            columns = [pa.array(np.full(size, part, np.int32)), pa.array(n + place), pa.array(first), batch.column("conv"), pa.array(local), *(batch.column(c) for c in KEYS[2:])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "leading", *KEYS])
            n += size

    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", "key1", "key2", "words")
    rows = materialize(rows.mapInArrow(numbered, f"part int, n long, leading boolean, conv {kind}, at long, key1 long, key2 long, words long").withColumn("upto", F.col("at") + 1), "turns")
    return _with_carried(rows, "upto").withColumn("at", F.col("at") + F.col("carried_upto")).select(KEYS)


def _prefixes(keys: DataFrame) -> DataFrame:
    """Written: (conv, depth, id1, id2, parent1, parent2, words) of each turn's node. `keys` has KEYS, `at` from 0 without gaps."""
    kind = keys.schema["conv"].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        powers = [_Powers(b) for b in _BASES]
        part, n, last, leading, held = TaskContext.get().partitionId(), 0, object(), False, [0, 0]
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            change, last = _changes(batch.column("conv"), last)
            start = np.maximum.accumulate(np.where(change, np.arange(size), -1))
            leading = n == 0 or leading
            first = np.cumsum(change) == (1 if n == 0 else 0) if leading else np.zeros(size, bool)
            leading = bool(first[-1])
            at, columns = np.asarray(batch.column("at")), []
            for k, power in enumerate(powers):
                key = reduced(np.asarray(batch.column(f"key{k + 1}")).view(U64))
                terms = product(key, power(at))
                high, low = np.cumsum(terms >> U64(32), dtype=U64), np.cumsum(terms & U64(0xFFFFFFFF), dtype=U64)
                total = reduced(product(reduced(high), np.full(1, 1 << 32, U64)) + reduced(low))
                before = np.append(np.zeros(1, U64), total)
                base = np.where(start < 0, U64((PRIME - held[k]) % PRIME), before[np.maximum(start, 0)])
                sums = reduced(total + U64(PRIME) - base)
                parent = np.where(change, U64(0), reduced(before[:-1] + U64(PRIME) - base))
                held[k] = int(sums[-1])
                columns += [pa.array(sums.view(np.int64)), pa.array(parent.view(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, part, np.int32)), pa.array(n + np.arange(size)), pa.array(first), batch.column("conv"), pa.array(at + 1), columns[0], columns[2], columns[1], columns[3], batch.column("words")],
                ["part", "n", "leading", "conv", "depth", "id1", "id2", "parent1", "parent2", "words"],
            )
            n += size

    rows = bounded_batches(keys).repartitionByRange("conv", "at").sortWithinPartitions("conv", "at")
    rows = rows.mapInArrow(summed, f"part int, n long, leading boolean, conv {kind}, depth long, id1 long, id2 long, parent1 long, parent2 long, words long")
    rows = _with_carried(materialize(rows, "prefixes"), "id1", "id2")
    moved = lambda c, k: ((F.col(c) + F.col(f"carried_id{k}")) % F.lit(PRIME)).alias(c)
    return rows.select("conv", "depth", moved("id1", 1), moved("id2", 2), moved("parent1", 1), moved("parent2", 2), "words")


class Queue:
    """A priority queue of (key, leaves, saved), keys (-depth, id1, id2); beyond `most` messages, sorted runs are in files."""

    ROW = struct.Struct("<qqqqq")

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.heads = most, [], [], []

    def push(self, key: tuple[int, int, int], leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (key, leaves, saved))
        if len(self.heap) > self.most:
            file = tempfile.TemporaryFile()  # noqa: SIM115 - it has no name and goes with the task
            for k, a, b in sorted(self.heap):
                file.write(self.ROW.pack(*k, a, b))
            file.seek(0)
            self.heap = []
            self.runs.append(file)
            self._next(len(self.runs) - 1)

    def _next(self, run: int) -> None:
        raw = self.runs[run].read(self.ROW.size)
        if raw:
            *key, leaves, saved = self.ROW.unpack(raw)
            heapq.heappush(self.heads, (tuple(key), leaves, saved, run))

    def pop(self, key: tuple[int, int, int]) -> tuple[int, int, int]:
        """(messages, leaves, saved) of all messages for this key."""
        n = leaves = saved = 0
        while self.heap and self.heap[0][0] == key:
            _, a, b = heapq.heappop(self.heap)
            n, leaves, saved = n + 1, leaves + a, saved + b
        while self.heads and self.heads[0][0] == key:
            _, a, b, run = heapq.heappop(self.heads)
            n, leaves, saved = n + 1, leaves + a, saved + b
            self._next(run)
        return n, leaves, saved


def time_forward(batches: Iterator[pa.RecordBatch], most: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come deepest first: what waits in the queue and the node's own share go on to its parent."""
    queue = Queue(most)
    for batch in batches:
        depth, id1, id2, up1, up2, top, leaves, saved = (batch.column(c).to_pylist() for c in ("depth", "id1", "id2", "parent1", "parent2", "top", "leaves", "saved"))
        for k in range(batch.num_rows):
            _, a, b = queue.pop((-depth[k], id1[k], id2[k]))
            leaves[k] += a
            saved[k] += b
            if not top[k]:
                queue.push((1 - depth[k], up1[k], up2[k]), leaves[k], saved[k])
        columns = [batch.column(c) for c in ("depth", "id1", "id2", "parent1", "parent2", "top")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], ["depth", "id1", "id2", "parent1", "parent2", "top", "leaves", "saved"])


def _subtrees(inner: DataFrame, rows: DataFrame, cut: int) -> DataFrame:
    """(id1, id2, leaves, saved): totals of the subtree of every node of `inner` (several members), level by level."""
    # the level of a node is 0 up to `cut` members; few nodes have more, and only these are looked up
    level = F.lit(0)
    most = inner.agg(F.max("n_convs")).first()[0] or 0
    bounds = []
    bound = cut
    while bound < most:
        bounds.append(bound)
        level = level + F.when(F.col("n_convs") > bound, 1).otherwise(0)
        bound *= cut
    inner = inner.withColumn("level", level)
    high = small(materialize(inner.where("level > 0").select(*NODE, "level"), "levels"))
    paths = rows.join(high, NODE, "left").select("conv", "depth", *NODE, F.coalesce("level", F.lit(0)).alias("level"))
    tops = paths.groupBy("conv", "level").agg(F.min(F.struct("depth", *NODE)).alias("t"))
    tops = tops.select(F.col("conv").alias("_conv"), F.col("level").alias("_level"), F.col("t.id1").alias("top1"), F.col("t.id2").alias("top2"))
    found = inner.where("depth > 0").join(tops, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("level") == F.col("_level"))).drop("_conv", "_level")
    # the root is a shard of its own
    found = found.unionByName(inner.where("depth = 0").withColumns({"level": F.lit(len(bounds) + 1), "top1": F.lit(0).cast("long"), "top2": F.lit(0).cast("long")}))
    found = materialize(found.withColumn("top", (F.col("id1") == F.col("top1")) & (F.col("id2") == F.col("top2"))), "shards")
    out, sent = None, None
    for k in range(len(bounds) + 2):
        nodes = found.where(F.col("level") == k)
        if sent is not None:
            waiting = sent.groupBy(F.col("parent1").alias("id1"), F.col("parent2").alias("id2")).agg(F.sum("leaves").alias("a"), F.sum("saved").alias("b"))
            nodes = nodes.join(waiting, NODE, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("a", F.lit(0)), "saved": F.col("saved") + F.coalesce("b", F.lit(0))})
        nodes = nodes.select("depth", *NODE, "parent1", "parent2", "top", "leaves", "saved", "top1", "top2")
        nodes = nodes.repartition("top1", "top2").sortWithinPartitions(F.desc("depth"), *NODE)
        schema = "depth long, id1 long, id2 long, parent1 long, parent2 long, top boolean, leaves long, saved long"
        done = materialize(nodes.mapInArrow(time_forward, schema), "totals")
        roots = done.where("top")
        sent = roots if sent is None else sent.unionByName(roots)
        totals = done.select(*NODE, "leaves", "saved")
        out = totals if out is None else out.unionByName(totals)
    return out


def _ends(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(id1, id2, ends_sha256) of nodes at which conversations end: their ids, ascending, joined by commas, hashed.

    Ids are joined in chunks where a sort over all tasks puts them; of a node, only chunks come together, and are hashed one after the other.
    """
    last = rows.groupBy("conv").agg(F.max(F.struct("depth", *NODE)).alias("e")).select(F.col("conv").alias("_conv"), "e.id1", "e.id2")
    ends = members.join(last, F.col("conv").eqNullSafe(F.col("_conv")), "left").select(F.coalesce("id1", F.lit(0)).alias("id1"), F.coalesce("id2", F.lit(0)).alias("id2"), "conv")
    kind = members.schema["conv"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = np.asarray(batch.column("id1")), np.asarray(batch.column("id2"))
            head = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            at = np.unique(np.append(np.flatnonzero(head), np.arange(0, len(a), CHUNK)))
            names = ["null" if c is None else str(c) for c in batch.column("conv").to_pylist()]
            texts = [",".join(names[lo:hi]) for lo, hi in zip(at, [*at[1:], len(a)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), batch.column("conv").take(pa.array(at)), pa.array(texts)], ["id1", "id2", "conv", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("id1", "id2", "ids")), strict=True):
                if (a, b) == node:
                    sha.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(ids.encode())
            yield _sha_rows(out)
        if node is not None:
            yield _sha_rows([(*node, sha.hexdigest())])

    by = [*NODE, "conv"]
    joined = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(chunks, f"id1 long, id2 long, conv {kind}, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*by).mapInArrow(hashed, "id1 long, id2 long, ends_sha256 string")


def _sha_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id1", "id2", "ends_sha256"])


def prefix_trie(keys: DataFrame, members: DataFrame, cut: int = CUT) -> DataFrame:
    """A row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `keys` has the turns as `turn_keys` gives them; `members` has every conversation (conv), also those without turns.
    """
    rows = materialize(_prefixes(keys), "paths")
    members = materialize(members.select("conv").distinct(), "members")
    nodes = rows.groupBy("depth", *NODE).agg(
        F.max("parent1").alias("parent1"), F.max("parent2").alias("parent2"), F.max("words").alias("words"), F.count("*").alias("n_convs"), _least("conv").alias("conv_id")
    )
    no = F.lit(0).cast("long")
    root = members.agg(F.count("*").alias("n_convs"), _least("conv").alias("conv_id")).where("n_convs > 0")
    root = root.withColumns({c: no for c in ("depth", *NODE, "parent1", "parent2", "words")})
    nodes = materialize(nodes.unionByName(root), "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("parent1").alias("id1"), F.col("parent2").alias("id2"))
    children = materialize(children.agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")), "children")
    inner = nodes.where("n_convs > 1 or depth = 0").join(children, NODE, "left")
    leaves = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("single")).cast("long")
    inner = inner.select("depth", *NODE, "parent1", "parent2", "n_convs", "conv_id", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = _subtrees(materialize(inner, "inner"), rows, cut)

    # the least member of the parent: few nodes have very many children, and these are looked up apart
    parents = nodes.join(children, NODE).select(F.col("id1").alias("parent1"), F.col("id2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = small(materialize(parents.where(F.col("n_children") > cut).drop("n_children"), "wide"))
    known = nodes.where("depth > 0").join(wide.withColumn("is_wide", F.lit(True)), ["parent1", "parent2"], "left")
    others = known.where("is_wide is null").drop("parent_conv_id").join(parents.where(F.col("n_children") <= cut).drop("n_children"), ["parent1", "parent2"])
    top = nodes.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast(nodes.schema["conv_id"].dataType)})
    columns = ["depth", *NODE, "n_convs", "conv_id", "parent_conv_id"]
    named = known.where("is_wide").select(columns).unionByName(others.select(columns)).unionByName(top.select(columns))

    out = named.join(children.drop("single"), NODE, "left").join(totals, NODE, "left").join(_ends(rows, members), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", no).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", no).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _least(c: str) -> Column:
    """The least value; null, which comes before all others, if there is one."""
    return F.min(F.struct(c))[c]
