"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only.

Pass 1 reads the texts' hashes, counts how often each cell of a filter of bounded size is
hit (two cells a row) and keeps the cells hit more than once, as bitmaps. Pass 2 reads the
texts again: a row with a cell that nothing else hit is alone and passes straight through;
only rows whose cells were both hit again shuffle, by the SHA-256 of their text. False
positives of the filter cost a shuffled narrow row and never change the result.

The bitmaps are broadcast. Their size is bounded by `max_cells` bits (32 MB); with far more
documents than cells the filter lets most rows pass on to the shuffle of (hash, id), which
stays a small fraction of the texts and stays exact.

Defined cases: a null text counts as empty. A null id ranks below all ids. Rows that repeat
both id and text are told apart only by number: one of them stays. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import fresh, materialize, small

MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 28
CELLS_A_ROW = 16


def cells_for(rows: int, max_cells: int = MAX_CELLS) -> int:
    """A power of two of at least CELLS_A_ROW cells a row, within bounds."""
    return min(max(MIN_CELLS, 1 << (rows * CELLS_A_ROW - 1).bit_length() if rows else 0), max_cells)


def _cells(h: Column, cells: int) -> tuple[Column, Column]:
    """Two cells from 1 to `cells`, which is where the bitmap functions begin to count."""
    return F.pmod(h, F.lit(cells)) + 1, F.pmod(F.xxhash64(h), F.lit(cells)) + 1


def repeated_cells(hashes: DataFrame, cells: int) -> DataFrame:
    """(bucket, bits): bitmaps of the cells that the hashes `h` hit more than once."""
    cell = F.explode(F.array(*_cells(F.col("h"), cells))).alias("cell")
    twice = hashes.select(cell).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    bucket = F.bitmap_bucket_number("cell").alias("bucket")
    return twice.groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def _hit(df: DataFrame, bitmaps: DataFrame, cell: str) -> DataFrame:
    """Adds whether the bit of column `cell` is set, as `<cell>_hit`."""
    bits = bitmaps.select(F.col("bucket").alias(f"{cell}_bucket"), F.col("bits").alias(f"{cell}_bits"))
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(f"{cell}_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn(f"{cell}_bucket", F.bitmap_bucket_number(cell)).join(F.broadcast(bits), f"{cell}_bucket", "left")
    return joined.withColumn(f"{cell}_hit", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(f"{cell}_bucket", f"{cell}_bits")


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """For each row of `docs`: id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cells = cells_for(docs.count(), max_cells)
    bitmaps = repeated_cells(docs.select(F.xxhash64(whole).alias("h")), cells)

    rows = docs.select(F.col(id).alias("id"), F.sha2(whole, 256).alias("sha"), F.xxhash64(whole).alias("h"))
    first, second = _cells(F.col("h"), cells)
    rows = _hit(_hit(rows.withColumns({"a": first, "b": second}), bitmaps, "a"), bitmaps, "b")
    rows = materialize(rows.select("id", "sha", (F.col("a_hit") & F.col("b_hit")).alias("again")), "exact")

    alone = rows.where(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = rows.where("again")
    groups = materialize(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    # rows that repeat id and text meet in one row with their number
    numbered = again.groupBy("sha", "id").agg(F.count("*").alias("n")).join(groups, "sha")
    repeats = numbered.select(
        "id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")
    ).select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), "sha")
    return alone.unionByName(repeats).select(F.col("id").alias(id), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    own, sha, whole = fresh(docs, "_id", "_sha", "_whole")
    decided = exact_duplicates(docs, id, text).select(F.col(id).alias(own), "kept", F.col("text_sha256").alias(sha))
    decided = materialize(decided, "decided")
    several = decided.groupBy(own).agg(F.count("*").alias("n"), F.count_if("kept").alias("stay"))
    several = materialize(several.where("n > stay").select(own, "stay"), "several")
    same = F.col(id).eqNullSafe(F.col(own))
    clear = docs.join(small(several), same, "left_anti")
    if several.where("stay > 0").isEmpty():
        return clear
    # ids of several rows, some of which stay: their texts tell which
    mixed = docs.join(small(several.where("stay > 0")), same, "left_semi").withColumn(whole, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    stay = decided.where("kept").select(own, sha).distinct()
    mixed = mixed.dropDuplicates([id, whole]).join(stay, same & (F.col(whole) == F.col(sha)), "left_semi").drop(whole)
    return clear.unionByName(mixed)
