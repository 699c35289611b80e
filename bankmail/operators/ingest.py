"""From landed mail rows to new e-mail records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail import dims
from bankmail.functions import html as H
from bankmail.functions import text as X
from bankmail.functions.once import once
from bankmail.operators.joins import first_per_key
from bankmail.operators.maintain import errors_by_account
from bankmail.sources.mail import dated

KEY = ["account", "folder", "message_id"]


def with_bank(
    mail: DataFrame, banks: dict[str, str] | None = None, aliases: dict[str, str] | None = None
) -> DataFrame:
    """Adds `sender_domain` and `bank_name`; the bank is NULL for anyone else."""
    domains = once(mail, sender_domain=X.sender_domain(F.col("sender")))
    return once(domains, bank_name=X.bank_of_domain(F.col("sender_domain"), banks, aliases))


def _message_id() -> Column:
    """The mail's own id; without one its sender and time."""
    return F.coalesce(F.nullif("uid", F.lit("")), F.concat_ws("_", F.coalesce("sender", F.lit("")), X.iso_text(F.col("received_date"))))


def email_keys(mail: DataFrame) -> DataFrame:
    """The key of each mail that `email_records` would give, without its texts. Expects `with_bank` and `received_date`."""
    return mail.filter(F.col("bank_name").isNotNull()).select("account", "folder", _message_id().alias("message_id"))


def email_records(
    mail: DataFrame,
    as_of=None,
    max_chars: int | None = None,
    key: list[str] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The e-mail record of every mail from a recognised bank.

    Expects `with_bank`; `received_date` is made from `date` where it is not there yet. The HTML parser sees only mails whose plain part is blank.
    `keep` names extra input columns to carry along; `max_chars` cuts the body.
    """
    key = KEY if key is None else key
    plain = F.coalesce(F.col("text"), F.lit(""))
    html = F.coalesce(F.col("html"), F.lit(""))
    blank = F.length(X.strip(plain)) == 0
    rows = (
        (mail if "received_date" in mail.columns else dated(mail, as_of))
        .filter(F.col("bank_name").isNotNull())
        .withColumn("from_html", H.html_text(F.when(blank & (html != ""), html)))
        .select(
            *keep,
            "account",
            "folder",
            "bank_name",
            "sender_domain",
            "received_date",
            F.coalesce("sender", F.lit("")).alias("sender"),
            _message_id().alias("message_id"),
            F.coalesce(F.nullif("subject", F.lit("")), F.lit(dims.NO_SUBJECT)).alias("subject"),
            X.clean_text(F.coalesce("from_html", plain), max_chars).alias("body_text"),
            html.alias("body_html"),
            (F.coalesce("n_attachments", F.lit(0)) > 0).alias("has_attachments"),
            F.lit(None).cast("string").alias("email_type"),
        )
    )
    return rows.withColumn(
        "vision_needed", H.needs_ocr(F.col("body_text"), F.col("body_html"))
    ).withColumn("id", X.stable_id(*[F.col(k) for k in key]))


def insert_new(
    batch: DataFrame,
    stored: DataFrame,
    key: list[str] | None = None,
    order: list[str] | None = None,
    required: list[str] | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rows of the batch that an insert-or-ignore would add.

    Rows with a NULL in a required column are left out, the first of equal keys
    wins, and keys already stored are left out. Only the key columns of the stored
    table are read; they are first reduced to the batch's own keys, so a small
    batch is broadcast and the stored table is not shuffled. Both are settled on keys alone, before rows are looked at;
    `stage` may write these keys and read them back.
    """
    key = KEY if key is None else key
    order = ["received_date", "id"] if order is None else order
    required = key if required is None else required
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    # rows equal in `order` are told apart by their content, so a rerun keeps the same one
    ties = F.xxhash64(*batch.columns)
    valid = batch.filter(complete)
    return first_per_key(valid, key, [*[F.col(c) for c in order], ties], without=stored, stage=stage)


def rejected(batch: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row: how many rows `insert_new` leaves out for a missing required value."""
    missing = F.lit(False)
    for c in KEY if required is None else required:
        missing = missing | F.col(c).isNull()
    return batch.agg(F.count_if(missing).alias("rejected"))


def high_water_mark(emails: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Newest `received_date`, per account and folder; `per=[]` for one over everything."""
    per = ["account", "folder"] if per is None else per
    return emails.groupBy(*per).agg(F.max("received_date").alias("latest"))


def sync_start(
    emails: DataFrame, as_of, per: list[str] | None = None, days: int = dims.INITIAL_SYNC_DAYS
) -> DataFrame:
    """Where a sync starts: the high-water mark, or `days` before `as_of` where there is none."""
    first = X.ntz(as_of) - F.make_dt_interval(F.lit(days))
    marks = high_water_mark(emails, per)
    return marks.withColumn("since", F.coalesce("latest", first)).drop("latest")


def newer_than_mark(mail: DataFrame, marks: DataFrame, as_of, days: int = dims.INITIAL_SYNC_DAYS, lookback: int = 0) -> DataFrame:
    """Mail rows from the start day of their account and folder on, the boundary day re-read.

    `marks` has one row per account and folder. `lookback` reaches that many days further
    back for mail that arrived late.
    """
    first = X.ntz(as_of) - F.make_dt_interval(F.lit(days))
    start = F.coalesce("latest", first) - F.make_dt_interval(F.lit(lookback))
    return (
        mail.join(marks, ["account", "folder"], "left")
        .filter(F.col("received_date") >= start.cast("date").cast("timestamp_ntz"))
        .drop("latest")
    )


def ingest_summary(scanned: DataFrame, inserted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of a run: scanned, skipped, fetched, flagged for OCR, distinct banks.

    `scanned` is the mail with `bank_name` set or NULL, `inserted` what was added. Both
    are reduced to (group, bank) before they meet.
    """
    by = ["account", "folder"] if by is None else by
    seen = scanned.groupBy(*by, "bank_name").agg(
        F.count(F.lit(1)).alias("scanned"), F.lit(0).cast("bigint").alias("fetched"), F.lit(0).cast("bigint").alias("flagged")
    )
    added = inserted.groupBy(*by, "bank_name").agg(
        F.lit(0).cast("bigint").alias("scanned"), F.count(F.lit(1)).alias("fetched"), F.count_if("vision_needed").alias("flagged")
    )
    return seen.unionByName(added).groupBy(*by).agg(
        F.sum("scanned").alias("emails_scanned"),
        F.coalesce(F.sum(F.when(F.col("bank_name").isNull(), F.col("scanned"))), F.lit(0)).alias("emails_skipped"),
        F.sum("fetched").alias("emails_fetched"),
        F.sum("flagged").alias("vision_flagged"),
        F.count_distinct(F.when(F.col("fetched") > 0, F.col("bank_name"))).alias("banks_found"),
    )


def account_summary(scanned: DataFrame, inserted: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts of a run per account with its errors: also accounts of which no folder could be read, and the number of new ids.

    `runs` are the run's audit rows as `sync_runs` gives them.
    """
    counts = ingest_summary(scanned, inserted, ["account"])
    both = counts.join(errors_by_account(runs).withColumnRenamed("account", "__a"), F.col("account").eqNullSafe(F.col("__a")), "full")
    zero = F.lit(0).cast("bigint")
    numbers = [F.coalesce(c, zero).alias(c) for c in counts.columns if c != "account"]
    none = F.array().cast("array<string>")
    return both.select(F.coalesce("account", "__a").alias("account"), *numbers, F.coalesce("failed", zero).alias("folders_failed"), F.coalesce("errors", none).alias("errors"))


def banks_found(inserted: DataFrame) -> DataFrame:
    return inserted.select("bank_name").filter(F.col("bank_name").isNotNull()).distinct()

