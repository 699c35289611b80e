"""The day trend of a stream as sums kept by micro-batch, with the rows that came too late beside them.

A micro-batch adds a row per day it has seen, whatever it is repeated; the trend is the sum over batches, so no
state is held between batches and any day can still be corrected. With a `delay`, days that ended so long before the newest row of earlier batches
are closed: rows of such days go to a table of their own. Every row is counted or kept there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bankmail.operators.spending import trend
from bankmail.schemas import DAY_SUMS, MONEY, Table
from bankmail.sources import tables
from bankmail.sources.commits import current
from bankmail.sources.tables import Commit
from bankmail.streaming.mail import per_batch

_FIELD = T.StructField
SUMS = Table("stream_day_sums", DAY_SUMS.schema)
LATE = Table("stream_late_rows", T.StructType([_FIELD("time", T.TimestampType()), _FIELD("amount", MONEY), _FIELD("transaction_type", T.StringType())]))
NEWEST = Table("stream_newest", T.StructType([_FIELD("time", T.TimestampType()), _FIELD("rows_in", T.LongType()), _FIELD("rows_late", T.LongType())]))
#: Micro-batches after which the older ones' folders become one.
FOLDERS = 50
_OLDER = "batch-"  # comes before every batch's own name


def _total(kind: str) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return F.coalesce(F.sum(F.when(F.col("transaction_type") == kind, F.col("amount")).otherwise(zero)), zero)


def _merged(spark: SparkSession, root: str, folders: int) -> None:
    """Once there are many batches, all but the newest become one; only the newest can still be repeated."""
    state = current(spark, root)
    batches = sorted({v["batch"] for v in state.folders(NEWEST.name).values()})
    if len(batches) <= folders:
        return
    with Commit(spark, root, _OLDER) as c:
        for table in (SUMS, LATE, NEWEST):
            rows = tables.read(spark, root, table, state, batches=lambda b: b != batches[-1])
            if table is SUMS:
                rows = rows.groupBy("day").agg(*[F.sum(x).alias(x) for x in ("debits", "credits", "count")])
            elif table is NEWEST:
                rows = rows.agg(F.max("time").alias("time"), F.sum("rows_in").alias("rows_in"), F.sum("rows_late").alias("rows_late"))
            c.add(rows, table)
            c.drop(table, [f for f, v in state.folders(table.name).items() if v["batch"] != batches[-1]])


def into_day_sums(stream: DataFrame, root: str, checkpoint: str, time: str, delay: str | None = None, folders: int = FOLDERS) -> StreamingQuery:
    """Rows with `time`, amount and transaction_type into kept sums. Without `delay` no day is ever closed."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, name: str) -> None:
        rows = batch.select(F.col(time).cast("timestamp").alias("time"), "amount", "transaction_type").persist()
        newest = tables.read(spark, root, NEWEST, batches=lambda b: b < name).agg(F.max("time")).first()[0]
        closed = F.lit(False)
        if delay is not None and newest is not None:
            end = F.date_trunc("day", "time") + F.expr("interval '1' day")
            closed = F.coalesce(end <= F.lit(newest) - F.expr(f"interval {delay}"), F.lit(False))
        marked = rows.withColumn("late", closed)
        with Commit(spark, root, name) as c:
            days = marked.filter(~F.col("late")).groupBy(F.date_format("time", "yyyy-MM-dd").alias("day"))
            c.add(days.agg(_total("debit").alias("debits"), _total("credit").alias("credits"), F.count(F.lit(1)).alias("count")), SUMS)
            c.add(marked.filter("late"), LATE)
            c.add(marked.agg(F.max("time").alias("time"), F.count(F.lit(1)).alias("rows_in"), F.count_if("late").alias("rows_late")), NEWEST)
        rows.unpersist()
        _merged(spark, root, folders)

    return per_batch(stream, handle, checkpoint)


def days(spark: SparkSession, root: str, closed_before: str | None = None) -> DataFrame:
    """(day, debits, credits, count) of all batches; with `closed_before`, a delay, only days that ended so long before the newest row."""
    out = trend(tables.read(spark, root, SUMS))
    if closed_before is None:
        return out
    newest = tables.read(spark, root, NEWEST).agg(F.max("time")).scalar()
    return out.filter(F.col("day").cast("timestamp") + F.expr("interval '1' day") <= newest - F.expr(f"interval {closed_before}"))


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """(time, amount, transaction_type) of rows whose day was closed when they came."""
    return tables.read(spark, root, LATE)


def counts(spark: SparkSession, root: str) -> DataFrame:
    """One row: rows_in, rows_late of all batches."""
    return tables.read(spark, root, NEWEST).agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_late").alias("rows_late"))
