"""Reading landed mail exports: folders, start date, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankmail import dims
from bankmail.functions.once import array_of, map_of
from bankmail.functions.text import naive_timestamp, ntz
from bankmail.schemas import RAW_MAIL_SCHEMA


def read_mail(
    spark: SparkSession, path: str | list[str], format: str = "parquet", repartition: int | None = None
) -> DataFrame:
    """Landed mail with its declared schema; several paths are read as one table.

    Any format Spark reads works: parquet, orc, json, csv, avro where it is installed.
    `repartition` deals the rows out to so many tasks, for a few files that cannot be split
    (gzip exports, one row group); it moves whole mails, so it is only done when asked for.
    """
    mail = spark.read.schema(RAW_MAIL_SCHEMA).format(format).load(path)
    return mail.repartition(repartition) if repartition else mail


def stream_mail(
    spark: SparkSession, path: str, format: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """The same folder as a stream: each landed file is read once."""
    reader = spark.readStream.schema(RAW_MAIL_SCHEMA).format(format)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def folders_of(provider: Column) -> Column:
    """Folders read for a provider, as an array; INBOX alone for an unknown one."""
    table = map_of(dims.PROVIDER_FOLDERS)
    return F.coalesce(F.try_element_at(table, provider), array_of(dims.DEFAULT_FOLDERS))


def in_provider_folders(mail: DataFrame) -> DataFrame:
    """Rows whose folder belongs to the folder list of their `provider`."""
    return mail.filter(F.array_contains(folders_of(F.col("provider")), F.col("folder")))


def since(df: DataFrame, start, column: str = "received_date") -> DataFrame:
    """Rows from the day of `start` on, that whole day included.

    `start` is a datetime, or a one-row one-column DataFrame such as `sync_start(...)`;
    either way the comparison is on the bare column, so it is pushed to the files.
    """
    mark = start.scalar() if isinstance(start, DataFrame) else ntz(start)
    return df.filter(F.col(column) >= mark.cast("date").cast("timestamp_ntz"))


def dated(mail: DataFrame, as_of=None, convert_to: str | None = None) -> DataFrame:
    """Adds `received_date` from the mail's date text; `as_of` stands in where there is none."""
    received = naive_timestamp(F.col("date"), convert_to)
    if as_of is not None:
        received = F.coalesce(received, ntz(as_of))
    return mail.withColumn("received_date", received)
