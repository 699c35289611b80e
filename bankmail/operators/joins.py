"""Join and deduplication shapes that hold up when one key has a third of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 1024
#: Most rows of a limit that are broadcast, with their texts.
LOOKUP = 1000
#: Most rows of a narrow table that are broadcast after a count.
NARROW = 2_000_000


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread_by: str) -> DataFrame:
    """Left outer equi join whose NULL-keyed left rows are spread over the partitions.

    NULL keys match nothing but would all hash to one partition; here they
    carry a second key made from `spread_by`. A hot key that is not NULL is split by
    AQE's skew join (the right side is unique per key, so the splits stay small).
    """
    l_salt = F.when(F.col(left_key).isNull(), F.pmod(F.hash(spread_by), F.lit(SPREAD)) + 1).otherwise(0)
    # always 0, but no constant to the optimizer, so it stays part of the hash key
    r_salt = F.pmod(F.hash("__k"), F.lit(1))
    keyed = right.withColumnRenamed(right_key, "__k").withColumn("__rs", r_salt)
    return (
        left.withColumn("__ls", l_salt)
        .join(keyed, (F.col(left_key) == F.col("__k")) & (F.col("__ls") == F.col("__rs")), "left")
        .drop("__ls", "__rs", "__k")
    )


def bounded_lookup(top: DataFrame, wide: DataFrame, top_key: str, wide_key: str, limit: int) -> DataFrame:
    """Left outer join of a frame that ends in a `limit` to a table of any size.

    The wide table is filtered by the few keys first, so it is scanned once and never shuffled. Up to LOOKUP rows are
    broadcast; how a larger limit is joined is left to Spark.
    """
    few = F.broadcast if limit <= LOOKUP else lambda df: df
    keys = top.select(F.col(top_key).alias("__k")).filter(F.col("__k").isNotNull()).distinct()
    found = wide.join(few(keys), F.col(wide_key) == F.col("__k"), "left_semi")
    found = found.withColumnRenamed(wide_key, "__w")
    return top.join(few(found), F.col(top_key) == F.col("__w"), "left").drop("__w")


def counted(narrow: DataFrame) -> DataFrame:
    """A table of a key and few columns, marked for broadcast if it has at most NARROW rows, so that whole texts do not move to meet it.

    Larger ones are joined as Spark sees fit.
    """
    return F.broadcast(narrow) if narrow.count() <= NARROW else narrow


def first_per_key(
    df: DataFrame, keys: list[str], order: list[Column], without: DataFrame | None = None, stage: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per key: the smallest by `order`. Keys that `without` holds give none; a key with a NULL is never held.

    Keys are counted first, alone. Rows whose key stands once pass straight through and never shuffle; only
    rows of repeated keys are compared, by an aggregate that keeps one row per key in each task before the shuffle, so
    a key with a third of all rows sends one row per task. A key of many repeats is one row of the counted side, which Spark
    broadcasts while it is small. Repeated keys and keys of `without` are settled together, so that where rows do shuffle they do so
    once. Joins compare a hash of the key first: keys that begin alike would make the sorts compare whole texts.

    `stage` may write keys and read them back. Then only hashes are counted, and those that stand twice or are held are themselves
    counted before the rows meet them: few are broadcast whatever Spark's estimate was. Whole keys are compared where the hash is one of these.
    """
    hashed = F.xxhash64(*keys).alias("__h")
    named = [hashed, *[F.col(k).alias(f"__{k}") for k in keys]]
    rows = df.select("*", hashed.alias("__own"))
    same = rows["__own"] == F.col("__h")
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"__{k}"))
    names = ["__h", *[f"__{k}" for k in keys]]
    row = F.struct(*[F.col(c) for c in df.columns])
    least = F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("r")
    n = F.count(F.lit(1)).alias("__n")
    if stage:
        settled = stage(df.groupBy(hashed).agg(n).filter("__n > 1").select("__h"))
        if without is not None:
            held = stage(without.dropna(subset=keys).select(*named).join(df.select(*named), names, "left_semi"))
            settled = settled.unionByName(held.select("__h"))
        settled = counted(settled)
        among = rows["__own"] == F.col("__h")
        rest = rows.join(settled, among, "left_semi")
        if without is not None:
            rest = rest.join(held, same, "left_anti")
        best = rest.groupBy(*named).agg(least)
        return rows.join(settled, among, "left_anti").drop("__own").unionByName(best.select("r.*"))
    tally = df.groupBy(*named).agg(n)
    again = settled = tally.filter("__n > 1").drop("__n")
    best = rows.join(again, same, "left_semi").groupBy(*named).agg(least)
    if without is not None:
        held = without.dropna(subset=keys).select(*named).join(tally.select(*names), names, "left_semi")
        settled, best = again.unionByName(held), best.join(held, names, "left_anti")
    return rows.join(settled, same, "left_anti").drop("__own").unionByName(best.select("r.*"))
