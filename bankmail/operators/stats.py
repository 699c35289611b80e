"""Counts and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(**tables: DataFrame) -> DataFrame:
    """(table_name, rows) of each table. Only file footers are read."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def sync_stats(runs: DataFrame) -> DataFrame:
    """One row: number of runs, mails fetched by successful ones, and the last run."""
    last = F.max_by(F.struct("id", "sync_started", "folder", "status"), F.struct("sync_started", "id"))
    return runs.agg(
        F.count(F.lit(1)).alias("total_syncs"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("emails_fetched"))), F.lit(0)).alias(
            "total_emails_fetched"
        ),
        last.alias("l"),
    ).select(
        "total_syncs",
        "total_emails_fetched",
        F.col("l.id").alias("last_id"),
        F.col("l.sync_started").alias("last_started"),
        F.col("l.folder").alias("last_folder"),
        F.col("l.status").alias("last_status"),
    )


def dashboard(emails: DataFrame, transactions: DataFrame, offers: DataFrame, runs: DataFrame) -> DataFrame:
    """All headline figures in one row, each a one-row aggregate read as a scalar subquery."""

    def n(df: DataFrame):
        return df.select(F.count(F.lit(1))).scalar()

    return sync_stats(runs).select(
        n(emails).alias("email_count"),
        n(transactions).alias("transaction_count"),
        n(offers).alias("offer_count"),
        "total_syncs",
        "total_emails_fetched",
        "last_id",
        emails.select(F.max("received_date")).scalar().alias("latest_sync_date"),
    )
