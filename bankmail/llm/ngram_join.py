"""Jaccard self-join on word shingles by vertical partitioning.

Shingles have one global order and every document's set is a sorted list in it: shingles of few
documents first, by hash, then those of more than FREQUENT documents. The order is cut into
fragments (ranges of the hash). A fragment's task sees the parts of all documents' lists that lie in it,
counts the overlap of the pairs that meet there, and Spark sums the fragments' counts per pair.

Sets whose Jaccard similarity reaches 0.75 must share one of the first n - ceil(0.75 n) + 1 shingles, so
that only this front part meets in fragments at first. The sum over its fragments bounds the
whole overlap of a pair from above; pairs within the bound get the counts of all fragments, which
are exact. The order of shingles by frequency only decides how many pairs must be looked at,
never which are found.

Front parts that still hold frequent shingles belong to large groups of near copies. There, documents are first
held against two members of each shingle's group, those with the fewest rare shingles, and the links found make first components.
Only then do rare shingles' documents meet, and two of one component never do. Of the pairs within the bound, each document is first
held against its likeliest partner, then only pairs that the links found so far leave in different components
are compared, and of those that share frequent shingles only those whose bits (`held`) allow enough shared ones. That finds the same components as all pairs would. Equal sets are one node with members.

What moves: one pass counts shingles (as packed arrays that are counted before and after the shuffle), one pass writes front parts, and one pass reads again the
texts of documents in pairs within the bound. The frequent shingles are broadcast, MOST_FREQUENT
at most (8 MB); with more, the others keep their place by hash and are handled as frequent
once a fragment sees more than LARGE documents with one of them.

Defined cases: A-Z count as a-z. A text with fewer than five words has one shingle of all its words; null, empty and
wordless texts have none and link with nothing. Null ids never are a component's id unless all of its
members have none. Repeated rows are rows of their own and link as equal sets. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches, fresh, materialize, small
from bankmail.llm.components import components
from bankmail.llm.fragments import dealt, fragment_bits, gathered, packed
from bankmail.llm.hashing import U64, distinct, mix, portions, released, shingles, words_of

SHINGLE = 5
FREQUENT, MOST_FREQUENT, LARGE = 32, 1_000_000, 256
#: Shingles that a task gathers before it deals them out; fragments in which a pair's exact overlap is counted.
GATHER, FRAGMENTS = 1 << 20, 4
#: Numbers of 64 bits that say which frequent shingles a set holds, by their last bits.
HELD = 8


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = words_of(batch, lower=True)
    return distinct(*shingles(words, SHINGLE), batch.num_rows)


def _front(n: np.ndarray) -> np.ndarray:
    """Length of the front part of a set of n."""
    return np.where(n > 0, n - -(-3 * n // 4) + 1, 0)


def _held(h: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """For each list within the bounds, a bit for the last bits of each hash in it."""
    slot = h & U64(64 * HELD - 1)
    bit = U64(1) << (slot & U64(63))
    out = np.zeros((len(bounds) - 1, HELD), U64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(out)), np.diff(bounds)), (slot >> U64(6)).astype(np.int64)), bit)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, HELD, dtype=np.int32)), pa.array(out.ravel().view(np.int64)))


def frequent(rows: DataFrame, bits: int) -> np.ndarray:
    """The leading bits + 32 bits of shingle hashes that more than FREQUENT documents have, ascending."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            once = counts == 1
            for some, more in ((once, ()), (~once, (np.minimum(counts[~once], 255).astype(np.uint8),))):
                found = dealt((keys[some] >> U64(32)).astype(np.int32), keys[some].astype(np.uint32), *more)
                yield packed([[*row, b""][:3] for row in found], ["fragment", "keys", "counts"])

        for batch in portions(batches):
            h, _ = _sets(batch)
            held.append(h >> U64(32 - bits))
            size += len(h)
            if size > GATHER:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def summed(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "u4") for k in group["keys"].to_pylist()]
        counts = [np.frombuffer(c, "u1") if c else np.ones(len(k), np.uint8) for k, c in zip(keys, group["counts"].to_pylist(), strict=True)]
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        df = np.add.reduceat(counts, first)
        often = df > FREQUENT
        return pa.table([pa.array((key[0].as_py() << 32) + keys[first][often].astype(np.int64)), pa.array(df[often])], names=["h", "df"])

    found = rows.select("text").mapInArrow(counted, "fragment int, keys binary, counts binary").groupBy("fragment").applyInArrow(summed, "h long, df long")
    return np.sort(np.asarray(found.orderBy(F.col("df").desc(), "h").limit(MOST_FREQUENT).select("h").toArrow()["h"]).astype(U64))


def _fronts(rows: DataFrame, often: np.ndarray, bits: int, id_type: str) -> DataFrame:
    """Written: row, id, n, two hashes of the set, n_hot, the front part, rare and frequent, and held.

    n_hot is the number of all frequent shingles if the front part has any, and with it all rare ones; else 0.
    held has bits for all frequent shingles: one that is set here and not there stands for at least one shingle that is here and not there.
    """
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in portions(batches):
            h, bounds = _sets(batch)
            n = np.diff(bounds)
            of = np.repeat(np.arange(len(n)), n)
            key = h >> U64(32 - bits)
            at = np.searchsorted(often, key)
            hot = (often[np.minimum(at, len(often) - 1)] == key) if len(often) else np.zeros(len(h), bool)
            place = np.zeros(len(h), np.int64)
            done = np.zeros(len(n), np.int64)
            for part in (~hot, hot):
                upto = np.cumsum(part)
                before = np.append(0, upto)[bounds[:-1]]
                place = np.where(part, done[of] + upto - 1 - before[of], place)
                done = done + np.append(0, upto)[bounds[1:]] - before
            front = place < _front(n)[of]
            sums = [np.append(np.zeros(1, U64), np.cumsum(mix(h ^ U64(x)))) for x in (0x1234567, 0x89ABCDEF01)]
            signs = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            lists = []
            for part in (front & ~hot, front & hot):
                lists.append((np.append(0, np.cumsum(part))[bounds].astype(np.int32), h[part].view(np.int64)))
            all_hot = np.append(0, np.cumsum(hot))[bounds]
            n_hot = np.diff(all_hot) * (np.diff(lists[1][0]) > 0)
            columns = [batch.column("row"), batch.column("id"), batch.column("mark"), pa.array(n), *map(pa.array, signs), pa.array(n_hot), *(pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in lists), _held(h[hot], all_hot)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "mark", "n", "sign1", "sign2", "n_hot", "rare", "hot", "held"])

    schema = f"row long, id {id_type}, mark long, n long, sign1 long, sign2 long, n_hot long, rare array<long>, hot array<long>, held array<long>"
    return materialize(rows.mapInArrow(fronts, schema), "fronts")


def _meeting(fronts: DataFrame, bits: int) -> DataFrame:
    """Written: from each fragment, pairs (x, y, sizes, c shared rare shingles) of different roots, and with y null the shingles h that too many share.

    A size is n * 2^32 + n_hot. `fronts` has the root of each row's component so far; documents of one component do not meet.
    """

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rare")
            h = np.asarray(lists.flatten()).view(U64)
            each = np.diff(np.asarray(lists.offsets))
            own = [np.repeat(np.asarray(batch.column(c)), each) for c in ("row", "size", "root")]
            yield packed(list(dealt((h >> U64(64 - bits)).astype(np.int32), h, *own)), ["fragment", "h", "node", "size", "root"])
        released()

    def met(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        h, node, size, root = (gathered(group[c], "i8") for c in ("h", "node", "size", "root"))
        order = np.lexsort((node, h))
        h, node, size, root = h[order], node[order], size[order], root[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        mixed = np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first)
        keep = np.repeat(mixed, np.diff(np.append(first, len(h))))
        h, node, size, root = h[keep], node[keep], size[keep], root[keep]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        df = np.diff(np.append(first, len(h)))
        n = size >> 32
        xs, ys = [], []
        for d in np.unique(df[(df > 1) & (df <= LARGE)]):  # groups of one size together
            at = first[df == d]
            i, j = np.triu_indices(d, 1)
            for part in np.array_split(at, max(1, len(at) * len(i) // 250_000)):
                x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                near = (root[x] != root[y]) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))
                xs.append(x[near])
                ys.append(y[near])
        x, y = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (xs, ys))
        order = np.lexsort((node[y], node[x]))
        x, y = x[order], y[order]
        new = np.flatnonzero(np.append(True, (node[x][1:] != node[x][:-1]) | (node[y][1:] != node[y][:-1])))[: len(x)]
        c = np.diff(np.append(new, len(x)))
        x, y = x[new], y[new]
        many = np.flatnonzero(np.repeat(df > LARGE, df))
        none = pa.nulls(len(many), pa.int64())
        both = lambda a, b: pa.concat_arrays([pa.array(a), b])
        return pa.table(
            [both(node[x], pa.array(node[many])), both(node[y], none), both(size[x], pa.array(size[many])), both(size[y], none), both(c.astype(np.int64), none), pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(h[many])])],
            names=["x", "y", "size_x", "size_y", "c", "h"],
        )

    parts = fronts.select("row", "size", "root", "rare").mapInArrow(parted, "fragment int, h binary, node binary, size binary, root binary")
    pairs = parts.groupBy("fragment").applyInArrow(met, "x long, y long, size_x long, size_y long, c long, h long")
    return materialize(pairs, "met")


def _enough(x: str, y: str, hot_x: str, hot_y: str) -> Column:
    """Whether two sets of these sizes can be similar enough if they share frequent shingles only."""
    return 7 * F.least(hot_x, hot_y) >= 3 * (F.col(x) + F.col(y))


def _ordered(pairs: DataFrame, a: str, b: str, n_a: str, n_b: str) -> DataFrame:
    """The pairs as x, y, n_x, n_y with x < y."""
    pick = lambda p, q: F.when(F.col(a) < F.col(b), F.col(p)).otherwise(F.col(q))
    return pairs.select(pick(a, b).alias("x"), pick(b, a).alias("y"), pick(n_a, n_b).alias("n_x"), pick(n_b, n_a).alias("n_y"))


def _links(docs: DataFrame, id: str, text: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written: the pairs (a, b) whose exact overlap reaches the similarity. `pairs` is written and has x, y, n_x, n_y."""
    ends = pairs.select(F.col("x").alias("row")).union(pairs.select("y")).distinct()
    wanted = materialize(nodes.join(ends, "row", "left_semi").select("row", "id", "sign1", "sign2"), "wanted")
    ids = small(materialize(wanted.select(F.col("id").alias("_id")).distinct(), "ids"))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            h, bounds = _sets(batch)
            n = np.diff(bounds)
            sums = [np.append(np.zeros(1, U64), np.cumsum(mix(h ^ U64(x)))) for x in (0x1234567, 0x89ABCDEF01)]
            signs = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            for k in range(FRAGMENTS):
                inside = h >> U64(62) == U64(k)
                offsets = np.append(0, np.cumsum(inside))[bounds].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(pa.array, signs), pa.array(np.full(len(n), k, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[inside].view(np.int64)))], ["sign1", "sign2", "fragment", "part"])

    found = rows.mapInArrow(parts, "sign1 long, sign2 long, fragment int, part array<long>")
    found = materialize(found.join(small(wanted.select("row", "sign1", "sign2")), ["sign1", "sign2"]).select("row", "fragment", "part"), "parts")
    left = pairs.join(found.withColumnRenamed("row", "x"), "x").withColumnRenamed("part", "part_x")
    both = left.join(found.withColumnRenamed("row", "y"), ["y", "fragment"])
    overlap = both.groupBy("x", "y", "n_x", "n_y", "fragment").agg(F.max(F.size(F.array_intersect("part_x", "part"))).alias("c"))
    total = overlap.groupBy("x", "y", "n_x", "n_y").agg(F.sum("c").alias("c"))
    return materialize(total.where(7 * F.col("c") >= 3 * (F.col("n_x") + F.col("n_y"))).select(F.col("x").alias("a"), F.col("y").alias("b")), "linked")


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, n_shingles and component_id, the least id that links reach."""
    return _components(docs, id, text).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def _stars(hot: DataFrame) -> DataFrame:
    """Pairs of each node with two members of the group of each of its frequent shingles: those with the fewest rare ones."""
    by = lambda sign: F.struct(F.col("n_hot") / F.col("n"), (sign * F.xxhash64("node")).alias("tie"), "node", "n", "n_hot")
    centres = hot.groupBy("h").agg(F.max(by(1)).alias("p"), F.max(by(-1)).alias("q"), F.count("*").alias("df")).where("df > 1")
    centres = centres.select("h", F.explode(F.array("p", "q")).alias("c")).distinct()
    centres = materialize(centres.select("h", F.col("c.node").alias("centre"), F.col("c.n").alias("m"), F.col("c.n_hot").alias("m_hot")), "centres")
    stars = hot.join(centres, "h").where("node <> centre").where(_enough("n", "m", "n_hot", "m_hot"))
    return materialize(_ordered(stars, "node", "centre", "n", "m").distinct(), "stars")


def _likely(met: DataFrame, many: DataFrame) -> DataFrame:
    """Written: the pairs (x, y, n_x, n_y, share) whose shared shingles can be enough; `many` has the shingles that no fragment counted."""
    sums = met.where("y is not null").groupBy("x", "y", "size_x", "size_y").agg(F.sum("c").alias("c"))
    n_of, hot_of = (lambda s: F.shiftright(s, 32)), (lambda s: F.col(s).bitwiseAND(F.lit((1 << 32) - 1)))
    sums = sums.withColumns({"n_x": n_of("size_x"), "n_y": n_of("size_y")})
    uncounted = small(materialize(many.groupBy("node").agg(F.count("*").alias("m")), "uncounted"))
    for end in "xy":
        sums = sums.join(uncounted.toDF(end, f"m_{end}"), end, "left")
    # with frequent shingles in both front parts, what is shared of rare ones is known but for uncounted ones; else what lies
    # behind the front part of either set can be shared whole
    few = F.least(hot_of("size_x"), hot_of("size_y"))
    bound = F.col("c") + F.least(F.coalesce("m_x", F.lit(0)), F.coalesce("m_y", F.lit(0))) + F.when(few > 0, few).otherwise(F.ceil(0.75 * F.greatest("n_x", "n_y")) - 1)
    total = F.col("n_x") + F.col("n_y")
    return materialize(sums.where(7 * bound >= 3 * total).select("x", "y", "n_x", "n_y", (bound / total).alias("share")), "likely")


def _shared(hot_x: str, hot_y: str, held_x: str, held_y: str) -> Column:
    """The most frequent shingles that two sets can share: all of one but those that the bits show to be missing in the other."""

    def most(own: str, one: str, other: str) -> Column:
        missing = sum(F.bit_count(F.col(one)[k].bitwiseAND(F.bitwise_not(F.col(other)[k]))) for k in range(HELD))
        return F.col(own) - F.coalesce(missing, F.lit(0))

    return F.least(most(hot_x, held_x, held_y), most(hot_y, held_y, held_x))


def _crossing(hot: DataFrame, roots: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of different components that share a frequent shingle, one of the first of the smaller set, and can share enough of them.

    `held` has the bits of each node's frequent shingles; pairs that they show to be too different are not made.
    """
    apart = hot.join(roots, "node", "left").select("h", "node", "n", "n_hot", F.coalesce("root", "node").alias("root"), "first")
    apart = materialize(apart, "apart")
    mixed = apart.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or("first").alias("first"))
    apart = apart.join(materialize(mixed.where("lo < hi and first").select("h"), "mixed"), "h", "left_semi").join(held, "node", "left")
    # sizes at most 4 / 3 apart lie in one band or the next
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).alias("band")
    one = apart.where("first").select("h", "node", "n", "n_hot", "root", "held", F.explode(F.array(band, band + 1))).toDF("h", "s", "n_s", "hot_s", "root_s", "held_s", "band")
    other = apart.select("h", "node", "n", "n_hot", "root", "held", band).toDF("h", "l", "n_l", "hot_l", "root_l", "held_l", "band")
    met = one.join(other, ["h", "band"]).where("root_s <> root_l and (n_s < n_l or n_s = n_l and s < l)").where(_enough("n_s", "n_l", "hot_s", "hot_l"))
    met = met.where(7 * _shared("hot_s", "hot_l", "held_s", "held_l") >= 3 * (F.col("n_s") + F.col("n_l")))
    return _ordered(met, "s", "l", "n_s", "n_l")


def _components(docs: DataFrame, id: str, text: str) -> DataFrame:
    """For each row: id, a hash of the text as mark, n and component_id."""
    bits = fragment_bits(docs.sparkSession)
    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), _mark(text).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fronts = _fronts(rows, frequent(rows, bits), bits, docs.schema[id].dataType.simpleString())

    classes = fronts.where("n > 0").groupBy("sign1", "sign2", "n").agg(F.min("row").alias("node"))
    classes = materialize(classes, "classes")
    members = materialize(fronts.select("row", "id", "mark", "n", "sign1", "sign2").join(classes, ["sign1", "sign2", "n"], "left").select("row", "id", "mark", "n", F.coalesce("node", "row").alias("node")), "members")
    copies = small(materialize(members.where("row <> node").select("row"), "copies"))
    size = (F.shiftleft("n", 32) + F.col("n_hot")).alias("size")
    nodes = fronts.where("n > 0").join(copies, "row", "left_anti").select("row", "id", "n", "n_hot", "sign1", "sign2", size, "rare", "hot", "held")

    # a pair shares one of the first n - ceil(6 n / 7) + 1 shingles of its smaller set; rare ones come before these
    first = F.col("at") < F.col("n") - F.ceil(6 * F.col("n") / 7) + 1 - (F.col("n") - F.col("n_hot"))
    hot = nodes.where(F.size("hot") > 0).select(F.posexplode("hot").alias("at", "h"), F.col("row").alias("node"), "n", "n_hot")
    hot = materialize(hot.withColumn("first", first).drop("at"), "hot")
    tried = _stars(hot)
    links = _links(docs, id, text, nodes, tried)
    roots = materialize(components(links), "roots")

    known = small(roots.withColumnRenamed("node", "row"))
    met = _meeting(nodes.join(known, "row", "left").withColumn("root", F.coalesce("root", "row")), bits)
    many = met.where("h is not null").select("h", F.col("x").alias("node"), F.shiftright("size_x", 32).alias("n"))
    likely = _likely(met, many)
    # first each node's likeliest partner; most other pairs then lie within a component
    ends = likely.select(F.explode(F.array("x", "y")).alias("node"), F.struct("x", "y", "n_x", "n_y").alias("pair"), F.struct("share", -F.col("x"), -F.col("y")).alias("by"))
    best = ends.groupBy("node").agg(F.max_by("pair", "by").alias("pair")).select("pair.*")
    more = many.withColumns({"n_hot": F.col("n"), "first": F.lit(True)}).select(hot.columns)
    best = materialize(best.union(_stars(more)).distinct().join(tried, ["x", "y"], "left_anti").select("x", "y", "n_x", "n_y"), "best")
    links = links.union(_links(docs, id, text, nodes, best))
    roots = materialize(components(links), "roots")

    # the other pairs, and those of frequent shingles' groups, as far as they are still apart
    root = lambda node: roots.select(F.col("node").alias(node), F.col("root").alias(f"root_{node}"))
    others = likely.join(root("x"), "x", "left").join(root("y"), "y", "left").where(F.coalesce("root_x", "x") != F.coalesce("root_y", "y"))
    pairs = others.select("x", "y", "n_x", "n_y").union(_crossing(hot.unionByName(more), roots, nodes.select(F.col("row").alias("node"), "held"))).distinct()
    pairs = materialize(pairs.join(tried.union(best), ["x", "y"], "left_anti").select("x", "y", "n_x", "n_y"), "crossing")
    if not pairs.isEmpty():
        roots = materialize(components(links.union(_links(docs, id, text, nodes, pairs))), "roots")

    rooted = members.join(roots, "node", "left").select("id", "mark", "n", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return rooted.join(least, "root").select("id", "mark", "n", "component_id")


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the least of their component, with all their columns."""
    own, mark = fresh(docs, "_id", "_mark")
    others = _components(docs, id, text).where(~F.col("component_id").eqNullSafe(F.col("id")))
    others = others.select(F.col("id").alias(own), F.col("mark").alias(mark)).distinct()
    same = F.col(id).eqNullSafe(F.col(own)) & (_mark(text) == F.col(mark))
    return docs.join(small(materialize(others, "others")), same, "left_anti")
