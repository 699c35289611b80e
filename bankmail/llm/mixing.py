"""Mixing sources to target weights by thresholds on a hash, found through nested histograms.

Each document gets a 60-bit hash of its id. Within a source, documents are taken in the order
of that hash until their words reach the source's target, but nothing is sorted: words are
summed by source and hash bucket, the bucket in which the budget runs out is found from the
running sums of the histogram, and only that bucket's documents are summed again in finer
buckets, until a bucket is one hash. What is below the threshold is taken. A target above the
source's size takes every document once and the rest by threshold a second time.

Sizes of histograms: sources x 4096 rows a round, five rounds. The table of documents is read
once; the rounds read the narrow (source, hash, size) table written from it. One row a source
(sums, targets, thresholds) is what the ranking window sees.

Defined cases: null text has size 0; null source is a source of its own, last in order; a null
id hashes as its own value; rows with equal ids share a hash and are taken together; a source
without words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankmail.llm.base import fresh, materialize, n_words, small

WEIGHTS = (5, 2, 1)
BITS, STEP = 60, 12


def document_hash(id: Column) -> Column:
    """60 bits of the MD5 of the id as text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Adds `target` to (source, source_size): share of all words by weight, at most `most` times the source.

    The excess over the limits is shared by weight among the others until none is above: the
    sources that end at their limit are those with the least size per weight, so running sums in that
    order tell which. All sums are whole numbers and each target is one division.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights)).cast("int") + 1)
    ranked = sources.withColumn("weight", weight)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.withColumns({
        "left": share[0] * F.sum("source_size").over(every) - share[1] * most * F.coalesce(F.sum("source_size").over(order), F.lit(0)),
        "per": share[1] * (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0))),
    })
    full = sums.withColumn("full", most * F.col("source_size") * F.col("per") <= F.col("weight") * F.col("left"))
    rest = F.min(F.when(~F.col("full"), F.struct(-F.col("per"), F.col("left"), F.col("per")))).over(every)
    shared = (F.col("weight") * F.col("rest")["left"]).cast("double") / F.col("rest")["per"].cast("double")
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(shared)
    return full.withColumn("rest", rest).select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): hashes below `cut` make up the words nearest to each source's `need`.

    `sizes` has source, h, size; `budgets` has source and need, which is below the source's size.
    """
    found = budgets.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for shift in range(BITS - STEP, -1, -STEP):
        b = small(materialize(found, "boundary")).select(F.col("source").alias("s"), "need", "prefix", "before")
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + STEP) == F.col("prefix"))
        hist = sizes.join(b, inside).groupBy("s", "need", "before", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        over = hist.withColumn("end", F.col("before") + F.sum("size").over(run)).where("end > need")
        first = over.groupBy("s", "need").agg(F.min(F.struct("bucket", "end", "size")).alias("b"))
        found = first.select(F.col("s").alias("source"), "need", F.col("b")["bucket"].alias("prefix"), (F.col("b")["end"] - F.col("b")["size"]).alias("before"), F.col("b")["size"].alias("size"))
    within = 2 * F.col("before") + F.col("size") <= 2 * F.col("need")
    return found.select("source", (F.col("prefix") + F.when(within, 1).otherwise(0)).alias("cut"))


def _planned(docs: DataFrame, id: str, text: str, source: str, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The written sizes of all rows, and the plan of each source: how often all of it is taken, and the cut of one time more."""
    sizes = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), document_hash(F.col(id)).alias("h"))
    sizes = materialize(sizes, "sizes")
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    base = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    goals = materialize(goals.withColumn("base", base).withColumn("need", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    cuts = materialize(thresholds(sizes, goals.where("need < source_size")), "cuts").withColumnRenamed("source", "s")
    plan = goals.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    cut = F.coalesce("cut", F.lit(1 << BITS))  # all of it fits
    return sizes, small(materialize(plan.select(F.col("source").alias("of"), "source_size", "target", "base", cut.alias("cut")), "plan"))


def _copies(h: Column, base: str = "base", cut: str = "cut") -> Column:
    return F.col(base) + F.when(h < F.col(cut), 1).otherwise(0)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each row: id, size, source_size, target, copies (0, 1 or 2 times the document is taken) and taken (words)."""
    sizes, plan = _planned(docs, id, text, source, weights)
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(F.col("h")))
    return out.select(F.col("id").alias(id), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with all their columns.

    A filter by the thresholds of each row's source; documents are not shuffled.
    """
    _, plan = _planned(docs, id, text, source, weights)
    of, base, cut, time = fresh(docs, "_of", "_base", "_cut", "_time")
    plan = plan.select(F.col("of").alias(of), F.col("base").alias(base), F.col("cut").alias(cut))
    rows = docs.join(plan, F.col(source).eqNullSafe(F.col(of)))
    times = F.explode(F.array_repeat(F.lit(0), _copies(document_hash(F.col(id)), base, cut)))
    return rows.withColumn(time, times).drop(of, base, cut, time)
