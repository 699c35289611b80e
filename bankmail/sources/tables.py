"""Parquet tables on shared storage, changed by commits: append, replace, change, rewrite of touched folders.

A batch is identified by the caller (`batch`), which makes its write repeatable: writing it
again replaces all its rows and no others. Each write has a folder of its own under the table, with the table's
partitions below it, and counts from its commit on; several tables can be written for one commit
(`Commit`). A table may have changes: narrow rows by key that are merged into its rows as they are read, and
folded into them by `fold`.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankmail.operators.maintain import merged_changes, without_deleted
from bankmail.schemas import CHANGES, KEPT, TABLES, Table, conform
from bankmail.session import materialize, remove, work_dir, write
from bankmail.sources import commits
from bankmail.sources.commits import State, current

_NONE = "__HIVE_DEFAULT_PARTITION__"


class Commit:
    """Writes of one batch that become visible together, when the `with` block ends without an error.

        with Commit(spark, root, batch) as c:
            c.add(mails, EMAILS)
            c.add(offers, OFFERS)

    The batch's earlier rows in each written table are replaced. `sequence` orders batches; a batch that is run again keeps its place.
    """

    def __init__(self, spark: SparkSession, root: str, batch: str):
        self.spark, self.root, self.batch = spark, root, batch
        self.added: dict[str, list[str]] = {}
        self.dropped: dict[str, set[str]] = {}
        self.before = current(spark, root)
        self.sequence = self.before.sequence(batch)

    def __enter__(self) -> Commit:
        return self

    def add(self, df: DataFrame, table: Table) -> None:
        """Write rows, with defaults filled in."""
        rows, name = conform(df, table), f"w={uuid.uuid4().hex}"
        if table.partition_by:
            # a folder per value gets a few well-sized files instead of one from every task
            rows = rows if table.dealt else rows.hint("rebalance", *[F.col(c) for c in table.partition_by])
            rows = rows.sortWithinPartitions(*table.partition_by, *table.sort_by)
        path = f"{self.root}/{table.name}/{name}"
        write(rows, path, table.partition_by)
        folders = [f"{name}/{c}" for c in commits.children(self.spark, path) if "=" in c] if table.partition_by else [name]
        self.added.setdefault(table.name, []).extend(folders)

    def written(self, table: Table, since: int = 0) -> DataFrame:
        """The rows that this commit has written to a table so far, but for its first `since` folders, as they lie there."""
        return stored(self.spark, self.root, table, self.added.get(table.name, [])[since:])

    def folders_of(self, table: Table) -> DataFrame:
        """(folder, and the table's partition columns) of what this commit has written to a table so far."""
        names = ["folder", *table.partition_by]
        rows = [(f, *_values(table, f)) for f in self.added.get(table.name, ())]
        return self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))

    def drop(self, table: Table, folders: list[str]) -> None:
        """Folders of a table that no longer count, as far as they were there when the commit began."""
        self.dropped.setdefault(table.name, set()).update(folders)
        self.added.setdefault(table.name, [])

    def _folders(self, state: State) -> dict[str, dict[str, dict]]:
        out = {}
        for name, new in self.added.items():
            gone = self.dropped.get(name)
            kept = {f: v for f, v in state.folders(name).items() if (f not in gone if gone is not None else v["batch"] != self.batch)}
            out[name] = kept | {f: self._mark(f) for f in new}
        return out

    def _mark(self, folder: str) -> dict:
        return {"batch": self.batch, "seq": self.sequence}

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            commits.commit(self.spark, self.root, self._folders)


class _Rewrite(Commit):
    """A commit whose new folders keep the batch of the rows in them."""

    def __init__(self, spark: SparkSession, root: str, marks: dict[str, dict]):
        super().__init__(spark, root, "")
        self.marks = marks

    def _mark(self, folder: str) -> dict:
        return self.marks[folder.split("/")[0]]


def reset_tables(spark: SparkSession, root: str, tables: list[Table]) -> None:
    """Remove all rows of the tables, keep their schemas. Their changes go too; with the mails, all that is kept of them is emptied, the search index too."""
    names = {t.name for t in tables}
    names |= {CHANGES[n].name for n in names if n in CHANGES} | ({t.name for t in KEPT} if "emails" in names else set())
    commits.commit(spark, root, lambda state: {n: {} for n in names})


def create(spark: SparkSession, root: str, table: Table) -> None:
    """An empty table. Existing rows are dropped."""
    reset_tables(spark, root, [table])


def _folders(spark: SparkSession, root: str, table: Table, folders: list[str]) -> DataFrame:
    """The rows of some folders of a table as they were written, with their write as `w`."""
    schema = T.StructType([*table.schema.fields, T.StructField("w", T.StringType())])
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{root}/{table.name}")
    return reader.parquet(*[_path(root, table, f) for f in folders])


def stored(spark: SparkSession, root: str, table: Table, folders: list[str]) -> DataFrame:
    """The rows of some folders of a table as they were written, in its declared columns."""
    return _folders(spark, root, table, folders).select(table.schema.names)


def _path(root: str, table: Table, folder: str) -> str:
    """Path of a folder for a reader, which takes some characters as patterns."""
    return root + "".join(f"\\{c}" if c in "*?[]{}" else c for c in f"/{table.name}/{folder}")


def _ordered(spark: SparkSession, root: str, table: Table, folders: dict[str, dict]) -> DataFrame:
    """Rows with `seq`, the place of their batch among changes."""
    seqs = {f.split("/")[0].removeprefix("w="): v["seq"] for f, v in folders.items()}
    place = F.element_at(F.create_map(*[F.lit(x) for item in seqs.items() for x in item]), F.col("w")) if seqs else F.lit(0)
    return _folders(spark, root, table, list(folders)).select(*table.schema.names, place.cast("long").alias("seq"))


def read(
    spark: SparkSession, root: str, table: Table, state: State | None = None, batches=None, unchanged_by: str | None = None, folders: set[str] | None = None
) -> DataFrame:
    """All committed rows of a table, or those of the batches that `batches` says yes to, with its changes merged in.

    Changes made by the batch `unchanged_by` are left out. With `folders`, only rows in these are read.
    """
    state = state or current(spark, root)
    wanted = {f: v for f, v in state.folders(table.name).items() if (batches is None or batches(v["batch"])) and (folders is None or f in folders)}
    own = CHANGES.get(table.name)
    above = CHANGES.get(table.parent[1]) if table.parent else None
    noted = own or above
    notes = [f for f, v in state.folders(noted.name).items() if v["batch"] != unchanged_by] if noted else []
    if not notes:
        return stored(spark, root, table, list(wanted))
    rows, changes = _ordered(spark, root, table, wanted), stored(spark, root, noted, notes)
    rows = merged_changes(rows, changes) if noted is own else without_deleted(rows, changes, table.parent[0])
    return rows.select(table.schema.names)


def read_others(spark: SparkSession, root: str, table: Table, batch: str) -> DataFrame:
    """All batches but one: what was stored before that batch, also when it is run again."""
    return read(spark, root, table, batches=lambda b: b != batch)


def append(df: DataFrame, root: str, table: Table, batch: str) -> None:
    """Add one batch with defaults filled in; the same batch id replaces all its own rows and no others."""
    with Commit(df.sparkSession, root, batch) as c:
        c.add(df, table)


def _values(table: Table, folder: str) -> list[str | None]:
    """The value of each partition column in a folder's name."""
    values = dict(part.split("=", 1) for part in folder.split("/")[1:])
    return [None if values[c] == _NONE else unquote(values[c]) for c in table.partition_by]


def rewrite(spark: SparkSession, root: str, table: Table, change, touched: Column | None = None) -> None:
    """Replace the rows of the touched folders by `change(rows)`.

    `touched` is a predicate on the partition columns (`batch` and the table's own); only
    those folders are read and written. `change` sees and keeps the column `batch`.
    """
    state = current(spark, root)
    folders = state.folders(table.name)
    names = ["folder", "batch", *table.partition_by]
    known = spark.createDataFrame([(f, v["batch"], *_values(table, f)) for f, v in folders.items()], ", ".join(f"{n} string" for n in names))
    chosen = [r.folder for r in (known if touched is None else known.filter(touched)).collect()]
    by_batch: dict[str, list[str]] = {}
    for f in chosen:
        by_batch.setdefault(folders[f]["batch"], []).append(f)
    rows = None
    for batch, own in by_batch.items():
        part = stored(spark, root, table, own).withColumn("batch", F.lit(batch))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return
    folder = work_dir(spark, f"rewrite-{table.name}")
    aside = materialize(change(rows).select(*rows.columns), "rewrite", folder)
    marks: dict[str, dict] = {}
    with _Rewrite(spark, root, marks) as c:
        for batch, own in by_batch.items():
            before = len(c.added.get(table.name, ()))
            c.add(aside.filter(F.col("batch") == batch), table)
            for f in c.added[table.name][before:]:
                marks[f.split("/")[0]] = folders[own[0]]
        c.drop(table, chosen)
    remove(spark, folder)


def merge(spark: SparkSession, root: str, table: Table, name: str = "merged") -> None:
    """Make one write of all batches of a table, so that many small folders become few. These batches can no longer be replaced."""
    state = current(spark, root)
    with Commit(spark, root, name) as c:
        c.add(read(spark, root, table, state), table)
        c.drop(table, list(state.folders(table.name)))


def fold(spark: SparkSession, root: str, table: Table) -> None:
    """Write a table's changes into its rows, and deletions into the rows of its children, in one commit.

    Only folders that hold a changed row are written again; they are found by their ids, one narrow column.
    """
    state, changes = current(spark, root), CHANGES[table.name]
    noted = list(state.folders(changes.name))
    if not noted:
        return
    notes = stored(spark, root, changes, noted)
    children = [t for t in TABLES.values() if t.parent and t.parent[1] == table.name]
    marks: dict[str, dict] = {}
    with _Rewrite(spark, root, marks) as c:
        for one, key, ids in ((table, "id", notes), *((t, t.parent[0], notes.filter("deleted")) for t in children)):
            folders = state.folders(one.name)
            keys = ids.select(F.col("id").alias("__k")).distinct()
            hit = _folders(spark, root, one, list(folders)).select(key, "w").join(keys, F.col(key) == F.col("__k"), "left_semi") if folders else None
            writes = {r.w for r in hit.select("w").distinct().collect()} if folders else set()
            for write in sorted(writes):
                own = {f: v for f, v in folders.items() if f.split("/")[0] == f"w={write}"}
                rows = _ordered(spark, root, one, own)
                rows = merged_changes(rows, notes) if one is table else without_deleted(rows, notes, key)
                before = len(c.added.get(one.name, ()))
                c.add(rows, one)
                marks |= {f.split("/")[0]: next(iter(own.values())) for f in c.added[one.name][before:]}
                c.drop(one, list(own))
        c.drop(changes, noted)


def by_key(df: DataFrame, value, key: str = "id") -> DataFrame:
    """Point lookup; the equality is pushed to the files."""
    return df.filter(F.col(key) == F.lit(value))
