"""Incremental forms: deduplicated arrival, batch-wise sync, day trend kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First delivery of each key; a repeat within `delay` of it is dropped.

    State is kept for `delay` only. For repeats after any time use `into_tables`, whose
    duplicate check reads the stored table.
    """
    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark(keys)
    )


def daily_trend(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """(day, debits, credits, count) per day of arrival, from rows with amount and transaction_type.

    In update mode a day is sent whenever it changed; in append mode once, after it closed.
    """

    def total(kind: str):
        zero = F.lit(0).cast("decimal(18,2)")
        return F.sum(F.when(F.col("transaction_type") == kind, F.col("amount")).otherwise(zero))

    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, delay)
        .groupBy(F.window(time, "1 day"))
        .agg(total("debit").alias("debits"), total("credit").alias("credits"), F.count(F.lit(1)).alias("count"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "debits", "credits", "count")
    )


def into_versions(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every micro-batch to its own folder of `path`; a repeated batch replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What `into_versions` last said of each key."""
    values = [c for c in rows.columns if c not in (*keys, "version")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v"))
    return latest.select(*keys, "v.*")


def per_batch(
    stream: DataFrame, handle: Callable[[DataFrame, str], None], checkpoint: str
) -> StreamingQuery:
    """Run `handle(rows, batch_name)` on every micro-batch of what has landed so far, then stop.

    The name is the same when a batch is repeated after a failure, so a handler that
    writes under it writes once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        handle(batch, f"batch-{batch_id:012d}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
