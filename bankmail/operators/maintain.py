"""Changes to stored rows, as functions from old rows and changes to new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankmail import dims


def update_by_id(rows: DataFrame, updates: DataFrame, key: str, columns: list[str], seq: str | None = None) -> DataFrame:
    """Rows with `columns` replaced where an update for their key exists.

    Several updates of one key: the one with the highest `seq` counts, without `seq` the least.
    Updates are reduced to one row per key before the join.
    """
    change = F.struct(*[F.col(c) for c in columns])
    latest = updates.groupBy(F.col(key).alias("__k")).agg(
        (F.max_by(change, F.col(seq)) if seq else F.min(change)).alias("__new")
    )
    joined = rows.join(latest, rows[key] == F.col("__k"), "left")
    keep = [
        F.when(F.col("__k").isNotNull(), F.col(f"__new.{c}")).otherwise(rows[c]).alias(c) if c in columns else rows[c]
        for c in rows.columns
    ]
    return joined.select(*keep)


def merged_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Mails with their changes: the newest value of a column, added texts in order, deleted mails gone.

    `rows` has `seq`, the place of each row's batch in the order of changes; older changes say nothing of the row. Changes are reduced to a
    row per id before the join, and are few between two compactions, so Spark broadcasts them and the mails stay where they are.
    """
    newest = lambda c: F.max_by(F.struct(c, "seq"), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"__{c}")
    added = F.array_sort(F.collect_list(F.when(F.col("body_added").isNotNull(), F.struct("seq", "body_added")))).alias("__added")
    gone = F.max(F.when(F.col("deleted"), F.col("seq"))).alias("__gone")
    latest = changes.groupBy(F.col("id").alias("__k")).agg(newest("email_type"), newest("vision_needed"), added, gone)
    joined = rows.join(latest, F.col("id") == F.col("__k"), "left").filter(F.col("__gone").isNull() | (F.col("__gone") < F.col("seq")))
    value = lambda c: F.when(F.col(f"__{c}.seq") >= F.col("seq"), F.col(f"__{c}.{c}")).otherwise(F.col(c))
    texts = F.transform(F.filter("__added", lambda x: x["seq"] >= F.col("seq")), lambda x: x["body_added"])
    body = F.when(F.size(texts) > 0, F.concat(F.coalesce("body_text", F.lit("")), F.array_join(texts, ""))).otherwise(F.col("body_text"))
    replaced = {"email_type": value("email_type"), "vision_needed": value("vision_needed"), "body_text": body}
    return joined.select(*[replaced[c].alias(c) if c in replaced else c for c in rows.columns])


def without_deleted(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows whose parent has not been deleted since they were written; `rows` has `seq`. A NULL parent key stays."""
    gone = changes.filter("deleted").groupBy(F.col("id").alias("__k")).agg(F.max("seq").alias("__gone"))
    return rows.join(gone, (F.col(key) == F.col("__k")) & (F.col("__gone") >= F.col("seq")), "left_anti")


def label_changes(labels: DataFrame, seq: int, order: str | None = None) -> DataFrame:
    """Changes that set the label, from (id, email_type); of several for one id, that with the highest `order`, without it the least."""
    best = F.max_by("email_type", order) if order else F.min("email_type")
    return labels.groupBy("id").agg(best.alias("email_type")).withColumn("seq", F.lit(seq).cast("long"))


def flag_changes(done: DataFrame, seq: int) -> DataFrame:
    """Changes that clear `vision_needed` for the ids in `done`."""
    return done.select("id", F.lit(False).alias("vision_needed"), F.lit(seq).cast("long").alias("seq")).distinct()


def text_changes(texts: DataFrame, seq: int) -> DataFrame:
    """Changes that add the marker line and a text to the body, from (id, text); of several for one id the least."""
    added = F.concat(F.lit(f"\n{dims.OCR_MARKER}\n"), F.min("text"))
    return texts.groupBy("id").agg(added.alias("body_added")).withColumn("seq", F.lit(seq).cast("long"))


def delete_changes(ids: DataFrame, seq: int) -> DataFrame:
    """Changes that delete mails."""
    return ids.select("id", F.lit(True).alias("deleted"), F.lit(seq).cast("long").alias("seq")).distinct()


def set_email_type(emails: DataFrame, labels: DataFrame, seq: str | None = None) -> DataFrame:
    """`labels` holds (id, email_type)."""
    return update_by_id(emails, labels, "id", ["email_type"], seq)


def mark_ocr_done(emails: DataFrame, done: DataFrame) -> DataFrame:
    """Clears `vision_needed` for the ids in `done`."""
    return update_by_id(emails, done.select("id", F.lit(False).alias("vision_needed")), "id", ["vision_needed"])


def append_text(emails: DataFrame, extracted: DataFrame) -> DataFrame:
    """Adds the marker line and `extracted.text` to the body; of several texts of one id the least."""
    texts = extracted.groupBy(F.col("id").alias("__k")).agg(F.min("text").alias("__t"))
    body = F.when(
        F.col("__t").isNotNull(),
        F.concat(
            F.coalesce("body_text", F.lit("")), F.lit(f"\n{dims.OCR_MARKER}\n"), F.col("__t")
        ),
    ).otherwise(F.col("body_text"))
    return (
        emails.join(texts, F.col("id") == F.col("__k"), "left")
        .withColumn("body_text", body)
        .select(*emails.columns)
    )


def merged_ocr(
    texts: DataFrame,
    first: int | None = None,
    min_chars: int = 0,
    max_chars: int | None = None,
) -> DataFrame:
    """One text per mail from (email_id, pos, text): (id, text, n_texts).

    Texts of `min_chars` or fewer characters are left out, and what lies beyond position `first` or
    `max_chars` where these are given. A mail's images bound its group.
    """
    usable = texts.filter(F.length("text") > min_chars)
    if first is not None:
        usable = usable.filter(F.col("pos") < first)
    text = F.col("text") if max_chars is None else F.substr("text", F.lit(1), F.lit(max_chars))
    usable = usable.select(F.col("email_id").alias("id"), "pos", text.alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return usable.groupBy("id").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_texts"),
    )


def prune_orphans(child: DataFrame, parents: DataFrame, key: str = "email_id", parent_key: str = "id") -> DataFrame:
    """Child rows whose parent still exists; a NULL parent key stays, as in a foreign key.

    The two cases are apart so that NULL keys are not shuffled at all.
    """
    ids = parents.select(F.col(parent_key).alias("__p"))
    kept = child.filter(F.col(key).isNotNull()).join(ids, F.col(key) == F.col("__p"), "left_semi")
    return kept.unionByName(child.filter(F.col(key).isNull()))


def start_run(runs: DataFrame) -> DataFrame:
    """Opening events from (id, folder, at)."""
    return runs.select(
        "id",
        F.col("at").alias("event_time"),
        "folder",
        F.lit(0).cast("bigint").alias("emails_fetched"),
        F.lit("in_progress").alias("status"),
        *_noted(runs),
    )


def complete_run(runs: DataFrame) -> DataFrame:
    """Closing events from (id, folder, at, emails_fetched, status)."""
    return runs.select("id", F.col("at").alias("event_time"), "folder", "emails_fetched", "status", *_noted(runs))


def _noted(runs: DataFrame) -> list[str]:
    """The account and the error text, where a run says them."""
    return [c for c in ("account", "error") if c in runs.columns]


def run_status(error) -> object:
    """Status of a folder from its error text: none is success, a missing folder is skipped."""
    missing = F.contains(F.upper(error), F.lit("NONEXISTENT")) | F.contains(error, F.lit("PATH_NOT_FOUND"))
    return (
        F.when(error.isNull(), F.lit("success"))
        .when(missing, F.lit("skipped"))
        .otherwise(F.lit("failed"))
    )


def sync_runs(events: DataFrame) -> DataFrame:
    """Current state of every run from its events: opened, closed, count, status."""
    closed = F.col("status") != "in_progress"
    noted = _noted(events)
    latest = F.max_by(F.struct("folder", "emails_fetched", "status", *noted), F.struct("event_time", closed.alias("c")))
    return (
        events.groupBy("id")
        .agg(
            F.min("event_time").alias("sync_started"),
            F.max(F.when(closed, F.col("event_time"))).alias("sync_completed"),
            latest.alias("r"),
        )
        .select("id", "sync_started", "sync_completed", "r.folder", "r.emails_fetched", "r.status", *[f"r.{c}" for c in noted])
    )


def first_errors(runs: DataFrame, limit: int = 5) -> DataFrame:
    """(account, folder, error) of failed runs, the earliest first; `runs` as `sync_runs` gives them."""
    failed = runs.filter(F.col("status") == "failed")
    return failed.orderBy("sync_started", "id").select("account", "folder", "error").limit(limit)


def errors_by_account(runs: DataFrame) -> DataFrame:
    """(account, failed, errors): how many folders of each account failed, and their errors as "folder: error", by start."""
    line = F.concat_ws(": ", "folder", F.coalesce("error", F.lit("unknown")))
    listed = F.array_sort(F.collect_list(F.struct("sync_started", "id", line.alias("line"))))
    failed = runs.filter(F.col("status") == "failed").groupBy("account")
    return failed.agg(F.count(F.lit(1)).alias("failed"), F.transform(listed, lambda x: x["line"]).alias("errors"))
