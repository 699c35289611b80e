"""Which folders of stored mails may hold a key: bitmaps of key hashes, kept with every write and asked before the mails are read.

A filter says yes for every key that its folder holds, and for few others: n keys of a folder share 2 ** 24 places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankmail.schemas import EMAILS, KEY_FILTERS
from bankmail.sources import tables
from bankmail.sources.commits import State, current
from bankmail.sources.tables import Commit

PLACES = 1 << 24


def _place(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(PLACES))


def add_filters(c: Commit, mails: DataFrame, key: list[str]) -> None:
    """Keep the filters of the mails that a commit has written."""
    months = EMAILS.partition_by[0]
    place = _place(key)
    bits = mails.groupBy(F.col(months).alias("__m"), F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    folders = c.folders_of(EMAILS)
    c.add(bits.join(F.broadcast(folders), F.col("__m").eqNullSafe(F.col(months))).select("folder", "bucket", "bits"), KEY_FILTERS)


def folders_with(spark: SparkSession, root: str, batch: DataFrame, key: list[str], state: State | None = None) -> set[str] | None:
    """The folders of stored mails that may hold a key of the batch; None when some folder has no filter, so that all must be read.

    Filters are narrowed to the buckets that the batch's keys fall into. What comes to the driver is a name per folder.
    """
    state = state or current(spark, root)
    filters = tables.read(spark, root, KEY_FILTERS, state)
    place = _place(key)
    probes = batch.select(F.bitmap_bucket_number(place).alias("__b"), F.bitmap_bit_position(place).alias("p")).groupBy("__b").agg(F.collect_set("p").alias("ps"))
    byte = lambda p: F.conv(F.hex(F.substr("bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = F.exists("ps", lambda p: F.shiftright(byte(p), 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (p % 8 + 1).cast("int"))) != 0)
    found = filters.join(probes, F.col("bucket") == F.col("__b"), "left").groupBy("folder").agg(F.coalesce(F.bool_or(has), F.lit(False)).alias("hit")).collect()
    known = {r.folder for r in found}
    if set(state.folders(EMAILS.name)) - known:
        return None
    return {r.folder for r in found if r.hit}


def stored_keys(spark: SparkSession, root: str, batch: DataFrame, key: list[str], state: State | None = None) -> DataFrame:
    """The mails' partition columns and key, of the stored mails that have a key of the batch.

    Filters say yes by chance too, the more so the more keys are asked for; so the keys of the folders that they name are compared.
    """
    state = state or current(spark, root)
    hit = folders_with(spark, root, batch, key, state)
    rows = tables.read(spark, root, EMAILS, state, folders=hit).select(*EMAILS.partition_by, *key)
    return rows.join(batch.select(*key).distinct(), key, "left_semi")
