"""Filtered, newest-first views of mails, transactions and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail.functions.rules import real_date
from bankmail.functions.text import iso_text, ntz
from bankmail.operators.joins import bounded_lookup, left_join


def recent_emails(emails: DataFrame, limit: int = 50) -> DataFrame:
    return emails.orderBy(F.col("received_date").desc(), "id").limit(limit)


def needing_ocr(emails: DataFrame) -> DataFrame:
    """Flagged mails, newest first."""
    return emails.filter("vision_needed").orderBy(F.col("received_date").desc(), "id")


def _event_time(as_text: bool) -> Column:
    if as_text:
        return F.coalesce(iso_text(F.col("email_received_date")), F.col("transaction_date"))
    return F.coalesce("email_received_date", real_date(F.col("transaction_date")).cast("timestamp_ntz"))


def with_email(transactions: DataFrame, emails: DataFrame) -> DataFrame:
    """Transactions with `email_subject` and `email_received_date`; all transactions stay."""
    side = emails.select(
        F.col("id").alias("__e"), F.col("subject").alias("email_subject"), F.col("received_date").alias("email_received_date")
    )
    return left_join(transactions, side, "email_id", "__e", spread_by="id")


def transactions_where(
    transactions: DataFrame,
    emails: DataFrame,
    bank_name: str | None = None,
    transaction_type: str | None = None,
    days: int | None = None,
    as_of=None,
    as_text: bool = False,
) -> DataFrame:
    """Joined transactions under optional filters; an empty or zero filter value filters nothing.

    `days` counts back from `as_of`. Times are compared as times; `as_text` compares the
    ISO texts instead. All filters reach the files: with a day cut, only mails from the cut on are joined, and of the transactions
    without a dated mail only those whose own date lies behind it are looked at.
    """
    if bank_name:
        transactions = transactions.filter(F.col("bank_name") == bank_name)
    if transaction_type:
        transactions = transactions.filter(F.col("transaction_type") == transaction_type)
    if not days:
        return with_email(transactions, emails).withColumn("event_time", _event_time(as_text))
    cut = ntz(as_of) - F.make_dt_interval(F.lit(days))
    late = (lambda t: iso_text(t) >= iso_text(cut)) if as_text else (lambda t: t >= cut)
    dated = emails.filter(late(F.col("received_date"))).withColumnRenamed("id", "__e")
    by_mail = transactions.join(dated.select("__e", F.col("subject").alias("email_subject"), F.col("received_date").alias("email_received_date")), F.col("email_id") == F.col("__e")).drop("__e")
    own = F.col("transaction_date") >= iso_text(cut) if as_text else real_date(F.col("transaction_date")).cast("timestamp_ntz") >= cut
    with_date = emails.filter(F.col("received_date").isNotNull()).select(F.col("id").alias("__e"))
    alone = transactions.filter(own).join(with_date, F.col("email_id") == F.col("__e"), "left_anti")
    by_own = with_email(alone, emails.filter(F.col("received_date").isNull()))
    return by_mail.unionByName(by_own).withColumn("event_time", _event_time(as_text))


def recent_transactions(transactions: DataFrame, emails: DataFrame, limit: int = 200, **filters) -> DataFrame:
    """Newest transactions by mail time, else by their own date."""
    rows = transactions_where(transactions, emails, **filters)
    return rows.orderBy(F.col("event_time").desc_nulls_last(), "id").limit(limit)


def recent_offers(
    offers: DataFrame, emails: DataFrame, bank_name: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest offers with subject, body, sender and date of their mail.

    The limit comes before the join: only the mails of these offers are looked up.
    """
    if bank_name:
        offers = offers.filter(F.col("bank_name") == bank_name)
    top = offers.orderBy(F.col("extracted_at").desc(), "id").limit(limit)
    side = emails.select(
        F.col("id").alias("__e"),
        F.col("subject").alias("email_subject"),
        F.col("body_text").alias("email_body"),
        F.col("sender").alias("email_sender"),
        F.col("received_date").alias("email_date"),
    )
    joined = bounded_lookup(top, side, "email_id", "__e", limit)
    return joined.orderBy(F.col("extracted_at").desc(), "id")


def offers_with_email(offers: DataFrame, emails: DataFrame) -> DataFrame:
    """Every offer with its mail's columns; all offers stay."""
    side = emails.select(
        F.col("id").alias("__e"),
        F.col("subject").alias("email_subject"),
        F.col("body_text").alias("email_body"),
        F.col("sender").alias("email_sender"),
        F.col("received_date").alias("email_date"),
    )
    return left_join(offers, side, "email_id", "__e", spread_by="id")


def first_offers_per_bank(offers: DataFrame, n: int = 5) -> DataFrame:
    """The n newest offers of every bank.

    Spark cuts each bank to n rows in every task before the shuffle (WindowGroupLimit),
    so a bank with most of the offers is no bottleneck.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("bank_name").orderBy(F.col("extracted_at").desc(), "id")
    return offers.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
