"""A search index on shared storage, kept in step with documents by the commits that change them.

Segments of postings are only ever added. Each row carries the place of its batch in the order of changes; a document that is changed or
deleted is noted as removed at such a place, and its older rows no longer count. Postings lie in folders by a hash of their word, sorted
by word within, so a query reads the folders and row groups of its own words. The empty word stands once in each document of a
segment: the documents' lengths are read from its rows as written, so that texts are split once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankmail.operators import search as Q
from bankmail.schemas import Table, index_tables
from bankmail.sources import tables
from bankmail.sources.commits import current
from bankmail.sources.tables import Commit


@dataclass(frozen=True)
class SearchIndex:
    """The index under `root` over `fields` of documents whose id has the type `id_type`."""

    spark: SparkSession
    root: str
    id_type: T.DataType = T.StringType()
    fields: tuple[str, ...] = Q.FIELDS
    buckets: int = Q.BUCKETS
    name: str = "index"

    @property
    def tables(self) -> tuple[Table, Table, Table]:
        return index_tables(self.id_type, self.name)

    def add(self, c: Commit, docs: DataFrame, id_col: str = "id") -> None:
        """Index new documents in a commit."""
        postings, lengths, _ = self.tables
        seq = F.lit(c.sequence).cast("long").alias("seq")
        before = len(c.added.get(postings.name, ()))
        rows = Q.bucketed_postings(docs, id_col, self.fields, self.buckets)
        c.add(rows.select("token", "doc_id", "field", "pos", "doc_len", seq, "bucket"), replace(postings, dealt=True))
        empty = c.written(postings, before).filter((F.col("bucket") == Q.bucket(F.lit(""), self.buckets)) & (F.col("token") == ""))
        c.add(empty.select("doc_id", "doc_len", "seq"), lengths)

    def remove(self, c: Commit, ids: DataFrame, id_col: str = "id") -> None:
        """Take documents out in a commit."""
        c.add(ids.select(F.col(id_col).alias("doc_id"), F.lit(c.sequence).cast("long").alias("seq")).distinct(), self.tables[2])

    def replace(self, c: Commit, ids: DataFrame, docs: DataFrame, id_col: str = "id") -> None:
        """Index documents again in a commit: `ids` are those that changed, `docs` what they are now; ids gone from it lose their postings."""
        self.remove(c, ids, id_col)
        known = ids.select(F.col(id_col).alias("__k")).distinct()
        self.add(c, docs.join(known, docs[id_col] == F.col("__k"), "left_semi"), id_col)

    def _living(self, table: Table) -> DataFrame:
        state = current(self.spark, self.root)
        rows = tables.read(self.spark, self.root, table, state)
        if table.name == self.tables[0].name:
            rows = rows.filter("token <> ''")
        if not state.folders(self.tables[2].name):
            return rows
        gone = tables.read(self.spark, self.root, self.tables[2], state).groupBy(F.col("doc_id").alias("__k")).agg(F.max("seq").alias("__gone"))
        return rows.join(gone, (F.col("doc_id") == F.col("__k")) & (F.col("seq") < F.col("__gone")), "left_anti")

    def postings(self) -> DataFrame:
        """(doc_id, field, doc_len, pos, token, bucket) of the documents as they are now."""
        return self._living(self.tables[0]).select("doc_id", "field", "doc_len", "pos", "token", "bucket")

    def lengths(self) -> DataFrame:
        return self._living(self.tables[1]).select("doc_id", "doc_len")

    def search(self, **terms) -> DataFrame:
        """(doc_id, rank); the terms are those of `operators.search.search`."""
        return Q.search(self.postings(), self.lengths(), buckets=self.buckets, **terms)

    def compact(self, name: str = "compacted") -> None:
        """Merge all segments into one, without the rows that no longer count."""
        postings, lengths, removed = self.tables
        state = current(self.spark, self.root)
        with Commit(self.spark, self.root, name) as c:
            for table in (postings, lengths):
                c.add(self._living(table), table)
                c.drop(table, list(state.folders(table.name)))
            c.drop(removed, list(state.folders(removed.name)))
