"""What the operators of this subpackage share."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankmail import session

#: A word, in Java's and in Python's pattern language.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a few numbers that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Bytes of texts that a Python worker is handed at a time; a longer text comes alone.
BATCH_BYTES = "2m"

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "WORD", "bounded_batches", "documents", "forget", "fresh", "materialize", "n_words", "small"]

_written = threading.local()


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """`df`, written to the shared folder and read again; `forget` removes what this thread has written so."""
    path = session.work_dir(df.sparkSession, purpose)
    _written.paths = [*getattr(_written, "paths", ()), path]
    return session.materialize(df, purpose, path)


def forget(spark: SparkSession) -> None:
    """Remove the tables that operators have written in this thread; for when results that read them are written elsewhere."""
    paths, _written.paths = getattr(_written, "paths", ()), ()
    for path in paths:
        session.remove(spark, path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a written table of narrow rows, marked for broadcast if it has no more than `rows` rows.

    Beyond that Spark joins by a shuffle and splits skewed keys at run time.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's Arrow batches bounded by bytes, so that long texts do not fill a worker's memory.

    The setting (BATCH_BYTES) stays in the session; results do not depend on it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
