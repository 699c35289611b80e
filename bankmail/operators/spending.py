"""Spending summaries over transactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail import dims
from bankmail.functions.rules import day_text, real_date
from bankmail.operators.joins import left_join


def _is(kind: str) -> Column:
    return F.col("transaction_type") == kind


def _total(kind: str) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return F.sum(F.when(_is(kind), F.col("amount")).otherwise(zero))


def by_category(transactions: DataFrame) -> DataFrame:
    """(category, total, count) of debits, largest first."""
    return _grouped(transactions, "category")


def by_bank(transactions: DataFrame) -> DataFrame:
    """(bank_name, total, count) of debits, largest first."""
    return _grouped(transactions, "bank_name")


def _grouped(transactions: DataFrame, key: str) -> DataFrame:
    return (
        transactions.filter(_is("debit") & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("total").desc_nulls_last(), key)
    )


def totals(transactions: DataFrame) -> DataFrame:
    """One row: total_debits, total_credits, total_count; zeros for an empty table."""
    zero = F.lit(0).cast("decimal(28,2)")
    return transactions.agg(
        F.coalesce(_total("debit"), zero).alias("total_debits"),
        F.coalesce(_total("credit"), zero).alias("total_credits"),
        F.count(F.lit(1)).alias("total_count"),
    )


def with_day(transactions: DataFrame, emails: DataFrame) -> DataFrame:
    """Adds `day`: the mail's day, else the first ten characters of the transaction's date."""
    marks = emails.select("id", "received_date").withColumnRenamed("id", "__e")
    joined = left_join(transactions, marks, "email_id", "__e", spread_by="id")
    return joined.withColumn("day", day_text(F.col("received_date"), F.col("transaction_date")))


def daily(transactions: DataFrame, emails: DataFrame, valid_days_only: bool = False) -> DataFrame:
    """(day, debits, credits, count) in day order; days that are not ten characters are left out.

    A junk date text of ten characters passes, as it always did; `valid_days_only`
    keeps real dates only.
    """
    narrow = transactions.select("id", "email_id", "amount", "transaction_type", "transaction_date")
    days = (
        with_day(narrow, emails)
        .groupBy("day")
        .agg(
            _total("debit").alias("debits"),
            _total("credit").alias("credits"),
            F.count(F.lit(1)).alias("count"),
        )
        .filter((F.col("day") != "Unknown") & (F.length("day") == 10))
    )
    if valid_days_only:
        days = days.filter(real_date(F.col("day")).isNotNull())
    return days.orderBy("day")


def day_sums(transactions: DataFrame, emails: DataFrame) -> DataFrame:
    """(day, debits, credits, count) of every day text, to be kept by batch and added up by `trend`."""
    narrow = transactions.select("id", "email_id", "amount", "transaction_type", "transaction_date")
    sums = [_total("debit").alias("debits"), _total("credit").alias("credits"), F.count(F.lit(1)).alias("count")]
    return with_day(narrow, emails).groupBy("day").agg(*sums)


def trend(sums: DataFrame, valid_days_only: bool = False) -> DataFrame:
    """What `daily` gives, from kept sums: a row per day and batch, whatever is the number of transactions."""
    days = sums.groupBy("day").agg(*[F.sum(c).cast(t).alias(c) for c, t in (("debits", "decimal(28,2)"), ("credits", "decimal(28,2)"), ("count", "bigint"))])
    days = days.filter((F.col("day") != "Unknown") & (F.length("day") == 10) & (F.col("count") != 0))
    if valid_days_only:
        days = days.filter(real_date(F.col("day")).isNotNull())
    return days.orderBy("day")


def monthly(days: DataFrame) -> DataFrame:
    """(month, debits, credits, count) from `daily`; real dates only."""
    return (
        days.filter(real_date(F.col("day")).isNotNull())
        .groupBy(F.date_format(real_date(F.col("day")), "yyyy-MM").alias("month"))
        .agg(F.sum("debits").alias("debits"), F.sum("credits").alias("credits"), F.sum("count").alias("count"))
        .orderBy("month")
    )


def net_outflow(transactions: DataFrame) -> DataFrame:
    return totals(transactions).select((F.col("total_debits") - F.col("total_credits")).alias("net_outflow"))


def category_share(transactions: DataFrame) -> DataFrame:
    """(category, total, count, share) with share in percent of all debits, one decimal."""
    all_debits = totals(transactions).select(F.col("total_debits").cast("double")).scalar()
    share = F.when(all_debits != 0, F.col("total").cast("double") / all_debits * 100).otherwise(0.0)
    return by_category(transactions).withColumn("share", F.round(share, 1))


def rollup(transactions: DataFrame) -> DataFrame:
    """(transaction_type, category, bank_name, total, n): one scan that feeds several summaries.

    The summaries below use conditions inside their sums, not filters: a filter on a group key
    would be pushed under the rollup and make each branch scan for itself, while an
    equal rollup in every branch lets Spark reuse one shuffle.
    """
    return transactions.groupBy("transaction_type", "category", "bank_name").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n")
    )


def rolled_by(roll: DataFrame, key: str) -> DataFrame:
    """`by_category` or `by_bank` out of a rollup."""
    wanted = _is("debit") & F.col(key).isNotNull()
    sums = roll.groupBy(key).agg(
        F.sum(F.when(wanted, F.col("total"))).alias("total"), F.sum(F.when(wanted, F.col("n"))).alias("count")
    )
    return sums.filter(F.col("count") > 0)


def rolled_totals(roll: DataFrame) -> DataFrame:
    """`totals` out of a rollup."""

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(_is(kind), F.col("total"))), F.lit(0).cast("decimal(28,2)"))

    return roll.agg(
        total("debit").alias("total_debits"),
        total("credit").alias("total_credits"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
    )


@dataclass(frozen=True)
class SpendingSummary:
    by_category: DataFrame
    by_bank: DataFrame
    daywise: DataFrame
    totals: DataFrame


def spending_summary(transactions: DataFrame, emails: DataFrame) -> SpendingSummary:
    """The four summaries, each a lazy plan: only what is asked for runs."""
    roll = rollup(transactions)
    return SpendingSummary(
        rolled_by(roll, "category"), rolled_by(roll, "bank_name"), daily(transactions, emails), rolled_totals(roll)
    )


def in_period(days: DataFrame, period: str) -> DataFrame:
    """Days of a preset (1W, 1M, 6M, YTD, 1Y, All), counted back from the last day in the data."""
    unit, n = dims.PERIODS[period]
    if unit == "all":
        return days
    dated = days.withColumn("__d", real_date(F.col("day"))).filter(F.col("__d").isNotNull())
    last = dated.select(F.max("__d")).scalar()
    if unit == "day":
        start = F.date_sub(last, n)
    elif unit == "month":
        start = F.add_months(last, -n)
    else:
        start = F.trunc(last, "year")
    return dated.filter(F.col("__d") >= start).drop("__d")
