"""A whole sync: landed mail to new mails, image text merged, labelled and read, stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankmail import dims
from bankmail.caps import WHOLE, Caps
from bankmail.functions import html as H
from bankmail.functions.once import once
from bankmail.functions.text import ntz, stable_id
from bankmail.operators import ingest as I
from bankmail.operators import maintain as M
from bankmail.operators import spending as S
from bankmail.plans.extract import Processed, process
from bankmail.plans.index import SearchIndex
from bankmail.plans.keys import add_filters, folders_with
from bankmail.plans.models import Models, process_with
from bankmail.schemas import DAY_SUMS, EMAIL_CHANGES, EMAILS, MARKS, OFFERS, SYNC_EVENTS, TRANSACTIONS
from bankmail.session import remove, work_dir, write
from bankmail.sources import tables
from bankmail.sources.commits import current
from bankmail.sources.mail import dated
from bankmail.sources.tables import Commit


def image_list(emails: DataFrame) -> DataFrame:
    """(email_id, pos, url) of the usable images of each mail, in order."""
    found = once(emails.select(F.col("id").alias("email_id"), "body_html"), urls=H.image_urls(F.col("body_html")))
    return found.select("email_id", F.posexplode("urls").alias("pos", "url"))


@dataclass(frozen=True)
class OcrResult:
    emails: DataFrame
    pending: DataFrame

    def summary(self) -> DataFrame:
        """(processed, texts_extracted, skipped): mails with images, texts merged, mails without."""
        return self.pending.agg(
            F.count_if(F.col("n_images") > 0).alias("processed"),
            F.coalesce(F.sum("n_texts"), F.lit(0)).alias("texts_extracted"),
            F.count_if(F.col("n_images") == 0).alias("skipped"),
        )


def merge_ocr(emails: DataFrame, texts: DataFrame, caps: Caps = WHOLE) -> OcrResult:
    """Image texts (email_id, pos, text) into the mails flagged for them; all flags end up cleared.

    Only flagged mails take part in the join; the others pass through unshuffled.
    """
    flagged = once(emails.filter("vision_needed"), n_images=F.size(H.image_urls(F.col("body_html"))))
    merged = M.merged_ocr(texts, caps.images, caps.image_min, caps.image_chars).select(F.col("id").alias("__k"), F.col("text").alias("__t"), "n_texts")
    read = (
        flagged.join(merged, (F.col("id") == F.col("__k")) & (F.col("n_images") > 0), "left")
        .withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
        .withColumn(
            "body_text",
            F.when(
                F.col("__t").isNotNull(),
                F.concat(F.coalesce("body_text", F.lit("")), F.lit(f"\n{dims.OCR_MARKER}\n"), F.col("__t")),
            ).otherwise(F.col("body_text")),
        )
        .withColumn("vision_needed", F.lit(False))
    )
    rest = emails.filter(~F.coalesce("vision_needed", F.lit(False)))
    return OcrResult(
        emails=read.select(*emails.columns).unionByName(rest),
        pending=read.select("id", "n_images", "n_texts"),
    )


@dataclass(frozen=True)
class SyncResult:
    scanned: DataFrame
    inserted: DataFrame
    ocr: OcrResult | None
    processed: Processed
    folders: tuple[str, ...] = ()

    def release(self) -> None:
        """Remove what `stage` wrote; the result cannot be read after it."""
        for folder in self.folders:
            remove(self.inserted.sparkSession, folder)

    def emails(self) -> DataFrame:
        """The new mails as they are stored: labelled, image text merged."""
        return self.processed.classified.withColumn("email_type", F.col("label")).withColumn(
            "received_month", F.substr(F.col("received_date").cast("string"), F.lit(1), F.lit(7))
        )

    def summary(self, by: list[str] | None = None) -> DataFrame:
        return I.ingest_summary(self.scanned, self.inserted, by)

    def events(self, run: str, as_of) -> DataFrame:
        """Opening and closing audit events, a pair per account and folder."""
        runs = self.summary().select(
            stable_id(F.lit(run), F.col("account"), F.col("folder")).alias("id"),
            "account",
            "folder",
            ntz(as_of).alias("at"),
            "emails_fetched",
            F.lit("success").alias("status"),
        )
        return M.start_run(runs).unionByName(M.complete_run(runs))


def sync(
    mail: DataFrame,
    stored: DataFrame | Callable[[DataFrame], DataFrame],
    as_of,
    marks: DataFrame | None = None,
    read_images: Callable[[DataFrame], DataFrame] | None = None,
    stage: bool = False,
    key: list[str] | None = None,
    caps: Caps = WHOLE,
    models: Models | None = None,
    root: str | None = None,
    **replies: DataFrame,
) -> SyncResult:
    """One run over the mail of any number of accounts.

    `stored` are the mails that are there, or a function that reads those which may have a key of the records it is given.
    `read_images` turns (email_id, pos, url) of the flagged mails into (email_id, pos, text).
    With `marks` (account, folder, latest) only mail from the mark's day on is read. `stage`
    writes the records, the new mails, the image texts, the replies and the labelled mails once to the shared folder, so the duplicate
    check and the several outputs do not repeat the scan, the making of texts, the labels or a costly function; `release` removes these folders.
    New mails are written with their labels where nothing else reads them first, and records and keys go as soon as the new mails are written.
    `caps` cuts texts; whole ones are kept without it. `models` are asked where the plan needs them, each request once;
    their replies are kept in the tables under `root`.
    """
    mail = dated(mail, as_of)
    if marks is not None:
        mail = I.newer_than_mark(mail, marks, as_of)
    scanned = I.with_bank(mail)
    folders = []
    written = lambda df: staged(df, "labelled")

    def staged(df: DataFrame, purpose: str) -> DataFrame:
        if not stage:
            return df
        folders.append(work_dir(df.sparkSession, purpose))
        write(df, folders[-1])
        return df.sparkSession.read.schema(df.schema).parquet(folders[-1])

    def release(count: int) -> None:
        """Remove the first folders; nothing reads them any more."""
        for folder in folders[:count]:
            remove(mail.sparkSession, folder)
        del folders[:count]

    records = staged(I.email_records(scanned, as_of, caps.body, key=key), "records")
    held = stored(records) if callable(stored) else stored
    inserted = I.insert_new(records, held, key, stage=(lambda df: staged(df, "keys")) if stage else None)
    made = len(folders)
    if not read_images and models is None and "new_ids" not in replies:
        replies = {k: staged(v, "replies") if isinstance(v, DataFrame) and k.endswith("_replies") else v for k, v in replies.items()}
        done = process(inserted, as_of=as_of, caps=caps, stage=written, **replies)
        release(made)
        return SyncResult(scanned, done.classified.select(*inserted.columns) if stage else inserted, None, done, tuple(folders))
    inserted = staged(inserted, "new-mails")
    release(made)
    ocr = None
    if read_images:
        texts = staged(read_images(image_list(inserted.filter("vision_needed"))), "image-texts")
        ocr = merge_ocr(inserted, texts, caps)
    if models is not None:
        mails = staged(ocr.emails if ocr else inserted, "mails")
        done = process_with(mail.sparkSession, root, mails, models, as_of=as_of, caps=caps, **replies)
        return SyncResult(scanned, inserted, ocr, done, tuple(folders))
    replies = {k: staged(v, "replies") if isinstance(v, DataFrame) and k.endswith("_replies") else v for k, v in replies.items()}
    done = process(ocr.emails if ocr else inserted, as_of=as_of, caps=caps, stage=written, **replies)
    return SyncResult(scanned, inserted, ocr, done, tuple(folders))


def store(spark: SparkSession, result: SyncResult, root: str, batch: str, as_of) -> None:
    """Add a run to the tables, the marks and the search index; the same `batch` replaces what it stored before.

    All become visible in one step, or nothing does. `result` must not have counted the batch's own rows as
    stored; `sync_batch` sees to that. What is kept of the mails and transactions is made from their rows as written.
    """
    mails = result.emails().withColumn("synced_at", ntz(as_of).cast("timestamp"))
    with Commit(spark, root, batch) as c:
        c.add(result.events(batch, as_of), SYNC_EVENTS)
        c.add(result.processed.transactions, TRANSACTIONS)
        c.add(result.processed.offers, OFFERS)
        c.add(mails, EMAILS)
        mails = c.written(EMAILS)
        add_filters(c, mails, I.KEY)
        c.add(I.high_water_mark(mails), MARKS)
        c.add(S.day_sums(c.written(TRANSACTIONS), mails), DAY_SUMS)
        SearchIndex(spark, root).add(c, mails)


def marks(spark: SparkSession, root: str) -> DataFrame:
    """(account, folder, latest): high-water marks from what each batch noted, without reading the mails."""
    return tables.read(spark, root, MARKS).groupBy("account", "folder").agg(F.max("latest").alias("latest"))


def day_trend(spark: SparkSession, root: str, valid_days_only: bool = False) -> DataFrame:
    """(day, debits, credits, count) in day order, from the sums that each batch kept: no transaction is read."""
    return S.trend(tables.read(spark, root, DAY_SUMS), valid_days_only)


def rebuild_day_sums(spark: SparkSession, root: str, name: str = "rebuilt") -> None:
    """Make the kept sums again from the stored transactions and mails, after these were rewritten by hand."""
    state = current(spark, root)
    with Commit(spark, root, name) as c:
        c.add(S.day_sums(tables.read(spark, root, TRANSACTIONS, state), tables.read(spark, root, EMAILS, state)), DAY_SUMS)
        c.drop(DAY_SUMS, list(state.folders(DAY_SUMS.name)))


def label_emails(spark: SparkSession, root: str, labels: DataFrame, batch: str, order: str | None = None) -> None:
    """Set the label of stored mails, from (id, email_type): one small file, no mail is written again."""
    with Commit(spark, root, batch) as c:
        c.add(M.label_changes(labels, c.sequence, order), EMAIL_CHANGES)


def clear_ocr_flags(spark: SparkSession, root: str, done: DataFrame, batch: str) -> None:
    """Clear `vision_needed` of the stored mails with these ids."""
    with Commit(spark, root, batch) as c:
        c.add(M.flag_changes(done, c.sequence), EMAIL_CHANGES)


def append_texts(spark: SparkSession, root: str, texts: DataFrame, batch: str) -> None:
    """Add the marker line and a text to the bodies of stored mails, from (id, text), and index these mails again."""
    with Commit(spark, root, batch) as c:
        changes = M.text_changes(texts, c.sequence)
        c.add(changes, EMAIL_CHANGES)
        ids = changes.select("id")
        mails = tables.read(spark, root, EMAILS, c.before, unchanged_by=batch).join(ids.withColumnRenamed("id", "__k"), F.col("id") == F.col("__k"), "left_semi")
        SearchIndex(spark, root).replace(c, ids, M.append_text(mails, texts))


def delete_emails(spark: SparkSession, root: str, ids: DataFrame, batch: str) -> None:
    """Delete stored mails by id, and with them their transactions, offers, postings and shares of the day sums."""
    with Commit(spark, root, batch) as c:
        c.add(M.delete_changes(ids, c.sequence), EMAIL_CHANGES)
        SearchIndex(spark, root).remove(c, ids)
        keys = ids.select(F.col("id").alias("__k")).distinct()
        gone = lambda table, key: tables.read(spark, root, table, c.before, unchanged_by=batch).join(keys, F.col(key) == F.col("__k"), "left_semi")
        less = S.day_sums(gone(TRANSACTIONS, "email_id"), gone(EMAILS, "id"))
        c.add(less.select("day", *[(-F.col(x)).alias(x) for x in ("debits", "credits", "count")]), DAY_SUMS)


def tidy(spark: SparkSession, root: str, most: int = 1000) -> None:
    """Keep the number of folders bounded: changes are folded in, and tables of more than `most` folders become one write.

    The mails keep their folders, by which their key filters name them.
    """
    tables.fold(spark, root, EMAILS)
    for table in (SYNC_EVENTS, TRANSACTIONS, OFFERS, MARKS, DAY_SUMS):
        if len(current(spark, root).folders(table.name)) > most:
            tables.merge(spark, root, table)
    index = SearchIndex(spark, root)
    if sum(len(current(spark, root).folders(t.name)) for t in index.tables) > most:
        index.compact()


def sync_batch(spark: SparkSession, mail: DataFrame, root: str, batch: str, as_of, history=None, **options) -> None:
    """One run over `mail`, stored as `batch`. Running it again gives the same tables, audit counts included.

    What the batch itself stored before does not count as stored. Of the other batches' mails, only folders are read whose key
    filters say that they may hold a key of this mail; `history` prunes them further.
    """
    state = current(spark, root)
    key = options.get("key") or I.KEY

    def stored(records: DataFrame) -> DataFrame:
        hit = folders_with(spark, root, records, key, state) if key == I.KEY and state.folders(EMAILS.name) else None
        rows = tables.read(spark, root, EMAILS, state, batches=lambda b: b != batch, folders=hit)
        return rows if history is None else rows.filter(history)

    result = sync(mail, stored, as_of, stage=True, root=root, **options)
    store(spark, result, root, batch, as_of)
    result.release()
