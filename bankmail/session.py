"""Session settings this package relies on, and the shared work folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a join key holding a third of the rows is split at run time
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

#: How tables and the rows of a sync are written. Half of a posting is its id, random digits that the default codec keeps at full length.
STORED = {"compression": "zstd"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "bankmail", **settings: str) -> SparkSession:
    """Session with the settings above; master and sizes come from spark-submit or `settings`."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="bankmail-")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared `spark.checkpoint.dir`.

    Without that setting a folder of this machine is made if Spark runs on this machine only
    (master `local`, as in tests); on a cluster it is an error, as executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/bankmail/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of `work_dir` whose rows nobody reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write(df, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write rows as tables and the steps of a sync have them. The shuffles that made them are removed at once, not when the driver next collects its garbage."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**STORED).mode("error").partitionBy(*partition_by).parquet(path)
    finally:
        # a thread that finds it set leaves it so for the one that set it
        if before != "true":
            conf.set(CLEANUP, before)


def materialize(df, purpose: str, path: str | None = None):
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage so that several consumers do not recompute it, survives the
    loss of executors, and gives Catalyst true sizes for its join choices. Who passes
    `path`, from `work_dir`, can `remove` it once the rows are used.
    """
    path = path or work_dir(df.sparkSession, purpose)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
