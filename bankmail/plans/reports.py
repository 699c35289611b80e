"""Report tables: lines, cards and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from bankmail.functions import text as X
from bankmail.functions.money import format_inr
from bankmail.operators import browse as W
from bankmail.operators import spending as S


def spending_report(transactions: DataFrame, emails: DataFrame) -> DataFrame:
    """(section, label, total, count, share, line), to be read in (section, sort) order.

    Sections: 1 totals, 2 categories by spend, 3 banks by spend, 4 months. `sort` puts the
    lines of a section in order. An empty table gives the zero totals only.
    """
    summary = S.spending_summary(transactions, emails)
    money = "decimal(28,2)"
    net = F.col("total_debits") - F.col("total_credits")
    count = F.col("total_count").cast("string")

    def figure(sort: float, label: str, value, shown):
        return F.struct(
            F.lit(sort).alias("sort"),
            F.lit(label).alias("label"),
            value.cast(money).alias("total"),
            F.concat(F.lit(f"{label}: "), shown).alias("line"),
        )

    debits, credits = F.col("total_debits"), F.col("total_credits")
    head = summary.totals.select(
        "total_count",
        F.inline(
            F.array(
                figure(1.0, "Total Debits", debits, format_inr(debits)),
                figure(2.0, "Total Credits", credits, format_inr(credits)),
                figure(3.0, "Total Transactions", F.lit(None), count),
                figure(4.0, "Net Outflow", net, format_inr(net)),
            )
        ),
    ).select(
        F.lit(1).alias("section"),
        "sort",
        "label",
        "total",
        F.col("total_count").alias("count"),
        F.lit(None).cast("double").alias("share"),
        "line",
    )

    # all columns of the totals, so that the subquery reads the same rollup as the lines above
    all_debits = summary.totals.select(F.struct("*")).scalar()["total_debits"].cast("double")
    share = F.round(F.when(all_debits != 0, F.col("total").cast("double") / all_debits * 100).otherwise(0.0), 1)
    categories = summary.by_category.withColumn("share", share).select(
        F.lit(2).alias("section"),
        (-F.col("total").cast("double")).alias("sort"),
        F.col("category").alias("label"),
        F.col("total").cast(money).alias("total"),
        "count",
        "share",
        F.concat(
            F.lit("  "), "category", F.lit(": "), format_inr(F.col("total")), F.lit(" ("),
            F.col("count").cast("string"), F.lit(" txns, "), F.format_number("share", 1), F.lit("%)"),
        ).alias("line"),
    )
    banks = summary.by_bank.select(
        F.lit(3).alias("section"),
        (-F.col("total").cast("double")).alias("sort"),
        F.col("bank_name").alias("label"),
        F.col("total").cast(money).alias("total"),
        "count",
        F.lit(None).cast("double").alias("share"),
        F.concat(
            F.lit("  "), "bank_name", F.lit(": "), format_inr(F.col("total")), F.lit(" ("),
            F.col("count").cast("string"), F.lit(" txns)"),
        ).alias("line"),
    )
    months = S.monthly(summary.daywise).select(
        F.lit(4).alias("section"),
        F.replace("month", F.lit("-"), F.lit("")).cast("double").alias("sort"),
        F.col("month").alias("label"),
        F.col("debits").cast(money).alias("total"),
        "count",
        F.lit(None).cast("double").alias("share"),
        F.concat(
            F.lit("  "), "month", F.lit(": Debits "), format_inr(F.col("debits")), F.lit(", Credits "),
            format_inr(F.col("credits")),
        ).alias("line"),
    )
    return head.unionByName(categories).unionByName(banks).unionByName(months).orderBy("section", "sort", "label")


def offers_digest(offers: DataFrame, limit: int = 30, per_bank: int = 5, chars: int = 150) -> DataFrame:
    """(place, bank_name, lines): the newest offers by bank, banks in order of first appearance.

    Works on `limit` rows; the windows never see more.
    """
    top = offers.orderBy(F.col("extracted_at").desc(), "id").limit(limit)
    order = [F.col("extracted_at").desc(), F.col("id")]
    numbered = top.withColumn("arrival", F.row_number().over(Window.orderBy(*order)))
    placed = numbered.withColumn("k", F.row_number().over(Window.partitionBy("bank_name").orderBy("arrival")))
    digest = (
        placed.groupBy("bank_name")
        .agg(
            F.min("arrival").alias("place"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("k") <= per_bank,
                        F.struct("k", F.substr(F.coalesce("offer_text", F.lit("")), F.lit(1), F.lit(chars)).alias("t")),
                    )
                )
            ).alias("lines"),
        )
        .select("place", "bank_name", F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("lines"))
    )
    return digest.orderBy("place")


def offer_context(offers: DataFrame, limit: int = 30, chars: int = 200) -> DataFrame:
    """(id, extracted_at, line) of the newest offers: `[bank] [category] (source): text`."""
    top = offers.orderBy(F.col("extracted_at").desc(), "id").limit(limit)
    return top.select(
        "id",
        "extracted_at",
        F.format_string(
            "[%s] [%s] (%s): %s",
            F.coalesce("bank_name", F.lit("Unknown")),
            F.coalesce("category", F.lit("General")),
            F.coalesce("source", F.lit("email_body")),
            F.substr(F.coalesce("offer_text", F.lit("")), F.lit(1), F.lit(chars)),
        ).alias("line"),
    )


def offer_cards(offers: DataFrame, emails: DataFrame, limit: int = 30) -> DataFrame:
    """The newest offers as cards: number, bank, subject, date, category, text, mail preview."""
    rows = W.recent_offers(offers, emails, limit=limit)
    number = F.row_number().over(Window.orderBy(F.col("extracted_at").desc(), "id"))
    return rows.select(
        number.alias("number"),
        F.coalesce("bank_name", F.lit("Unknown")).alias("bank"),
        F.coalesce("email_subject", F.lit("(No Subject)")).alias("subject"),
        F.substr(F.coalesce(X.iso_text(F.col("email_date")), F.lit("")), F.lit(1), F.lit(16)).alias("date"),
        F.coalesce("category", F.lit("General")).alias("category"),
        F.substr(F.coalesce("offer_text", F.lit("")), F.lit(1), F.lit(300)).alias("offer"),
        X.body_preview(F.nullif("email_body", F.lit(""))).alias("preview"),
    )


def email_list(emails: DataFrame, limit: int = 20) -> DataFrame:
    """The newest mails as display lines, newest first."""
    rows = W.recent_emails(emails, limit)
    date = F.substr(X.iso_text(F.col("received_date")), F.lit(1), F.lit(16))
    kind = F.coalesce("email_type", F.lit("unclassified"))
    return rows.select(
        "id",
        "received_date",
        X.label_icon(F.col("email_type")).alias("icon"),
        F.coalesce("bank_name", F.lit("?")).alias("bank"),
        F.coalesce("subject", F.lit("(No Subject)")).alias("subject"),
        date.alias("date"),
        kind.alias("kind"),
        F.format_string(
            "- %s **[%s]** %s  \n  _%s_ | `%s`",
            X.label_icon(F.col("email_type")),
            F.coalesce("bank_name", F.lit("?")),
            F.coalesce("subject", F.lit("(No Subject)")),
            date,
            kind,
        ).alias("line"),
    )


def transaction_table(transactions: DataFrame, emails: DataFrame, limit: int = 30) -> DataFrame:
    """The newest transactions with display texts, newest first."""
    rows = W.recent_transactions(transactions, emails, limit)

    def or_dash(name: str):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("--"))

    return rows.select(
        "id",
        F.coalesce(F.col("email_received_date").cast("date").cast("string"), F.lit("")).alias("email_date"),
        X.short_subject(F.col("email_subject")).alias("subject"),
        F.coalesce("bank_name", F.lit("?")).alias("bank"),
        F.concat_ws(
            " ", X.direction_icon(F.col("transaction_type")), F.coalesce("transaction_type", F.lit("?"))
        ).alias("type"),
        format_inr(F.coalesce("amount", F.lit(0))).alias("amount"),
        or_dash("merchant").alias("merchant"),
        or_dash("category").alias("category"),
    )


def category_chart(transactions: DataFrame, top: int = 8) -> DataFrame:
    """(category, value, share, chart_total, hover) of the largest categories."""
    largest = S.by_category(transactions).limit(top)
    total = largest.select(F.sum("total")).scalar()
    return largest.select(
        "category",
        F.col("total").alias("value"),
        F.round(F.col("total").cast("double") / total.cast("double") * 100, 1).alias("share"),
        total.alias("chart_total"),
        F.concat("category", F.lit("<br>"), format_inr(F.col("total"))).alias("hover"),
    )


def bank_chart(transactions: DataFrame) -> DataFrame:
    """(bank_name, value, hover), smallest first as horizontal bars are drawn."""
    return (
        S.by_bank(transactions)
        .select(
            "bank_name",
            F.col("total").alias("value"),
            F.concat("bank_name", F.lit(": "), format_inr(F.col("total"))).alias("hover"),
        )
        .orderBy(F.col("value").asc_nulls_first(), F.col("bank_name").desc())
    )


def daily_chart(transactions: DataFrame, emails: DataFrame) -> DataFrame:
    """(day, series, value, hover): Debits and Credits in long form."""
    days = S.daily(transactions, emails).select(
        "day", F.col("debits").alias("Debits"), F.col("credits").alias("Credits")
    )
    long = days.unpivot("day", ["Debits", "Credits"], "series", "value")
    return long.withColumn("hover", F.concat("series", F.lit(": "), format_inr(F.col("value"))))
