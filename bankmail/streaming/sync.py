"""The sync as a stream: each micro-batch of landed mail goes through the batch plan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bankmail.functions.text import ntz, stable_id
from bankmail.operators.maintain import run_status
from bankmail.plans.sync import sync_batch
from bankmail.schemas import SYNC_EVENTS
from bankmail.sources import tables
from bankmail.sources.mail import stream_mail
from bankmail.streaming.mail import per_batch


def into_tables(
    mail: DataFrame, root: str, checkpoint: str, as_of, history: Column | None = None, name: str = "", **options
) -> StreamingQuery:
    """Landed mail into the tables under `root`, each file once, each mail once.

    The stored mails are the memory of what was seen, for any length of history; the file
    source's checkpoint is the high-water mark. A repeated micro-batch first removes what
    its earlier attempt stored from the duplicate check, then replaces it. `name` tells the batches of several streams into
    the same tables apart.

    Each batch reads the key columns of the stored mails. Where repeats are known to come
    within a time, `history`, e.g. `F.col("received_month") >= "2025-05"`, prunes that scan to
    the folders it names; without it the check covers everything ever stored.
    """
    spark = mail.sparkSession

    def handle(rows: DataFrame, batch: str) -> None:
        sync_batch(spark, rows, root, f"{name}{batch}", as_of, history, **options)

    return per_batch(mail, handle, checkpoint)


@dataclass(frozen=True)
class Folder:
    """Landed mail of one folder of an account."""

    account: str
    folder: str
    path: str

    @property
    def key(self) -> str:
        return f"{self.account}/{self.folder}"


def sync_folders(
    spark: SparkSession, folders: Iterable[Folder], root: str, checkpoint: str, as_of, run: str, at_once: int = 4, format: str = "parquet", max_files: int | None = None, **options
) -> dict[str, str]:
    """Every folder into the tables as a stream of its own; the folders that could be read are stored whatever becomes of the others.

    `at_once` streams run side by side, each with a checkpoint of its own, so a folder that failed goes on
    where it stood at the next run. A folder that cannot be read leaves an audit row with the error's text: skipped when it is missing, else failed.
    Returns the error of each folder that had one, by account/folder.
    """
    waiting, running, errors = list(folders)[::-1], [], {}

    def noted(folder: Folder, error: Exception) -> None:
        text = str(error)
        errors[folder.key] = text
        failed_run(spark, root, run, folder.folder, as_of, text, folder.account)

    while waiting or running:
        while waiting and len(running) < at_once:
            folder = waiting.pop()
            try:
                mail = stream_mail(spark, folder.path, format, max_files)
                name = f"{folder.key}/"
                running.append((folder, into_tables(mail, root, f"{checkpoint}/{_safe(folder.key)}", as_of, name=name, **options)))
            except PySparkException as error:
                noted(folder, error)
        if running:
            folder, query = running.pop(0)
            try:
                query.awaitTermination()
            except PySparkException as error:
                noted(folder, error)
    return errors


def _safe(name: str) -> str:
    """A folder name that tells all names apart."""
    return "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in name)


def failed_run(spark: SparkSession, root: str, batch: str, folder: str, as_of, error: str, account: str | None = None) -> None:
    """Audit row of a folder that could not be read; the other folders go on."""
    row = spark.range(1).select(
        stable_id(F.lit(batch), F.lit(account), F.lit(folder)).alias("id"),
        ntz(as_of).alias("event_time"),
        F.lit(account).cast("string").alias("account"),
        F.lit(folder).alias("folder"),
        F.lit(0).cast("bigint").alias("emails_fetched"),
        run_status(F.lit(error)).alias("status"),
        F.lit(error).alias("error"),
    )
    tables.append(row, root, SYNC_EVENTS, f"{batch}/{account or ''}/{folder}")
