"""Removal of word passages that an earlier document has, by recompression.

Every window of WINDOW words gets an anchor (recompression.anchors): the longest symbol of its locally
consistent parse, equal for equal windows everywhere. Neighbouring windows share anchors, so a document is
some stretches of windows, about one for every nine words, each with its anchor and a hash of all its words.
Spark groups stretches by anchor. An anchor of one document only holds no repeat. Where all stretches of an anchor
are equal, their windows repeat as a whole and the least id is known. The others, at the edges of repeats, are
compared window by window: their texts are read again and hashes of their windows grouped under the
anchor. Both the anchor and the hash of a window's words must be equal, 128 bits in all.

Anchors of up to CROWD stretches meet in fragments, as packed arrays; those of more, such as the edges of a passage that
very many documents share, are grouped and joined as rows, which Spark aggregates before it shuffles and
splits when skewed. Tables that are broadcast are counted first and joined by a shuffle beyond BROADCAST entries.

Defined cases: null and empty texts have no words. Rows are told apart by id and text; rows that repeat both get the
same result, and rows with equal ids do not remove from each other. A null id is larger than any. Windows are
judged on the input. An empty table gives an empty result. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches, materialize, small
from bankmail.llm.fragments import dealt, fragment_bits, gathered, packed
from bankmail.llm.hashing import U64, mix, portions, spans_hash, words_of
from bankmail.llm.recompression import anchors

WINDOW = 50
CROWD = 10_000
BROADCAST = 3_000_000
LAST_ID = (1 << 63) - 1


def _stretches(rows: DataFrame, window: int) -> DataFrame:
    """Written: id, mark, anchor, hash of the words, first window and number of windows of every stretch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            words = words_of(batch)
            n = len(words.hashes)
            if not n:
                continue
            anchor = anchors(words.hashes, words.starts, window)
            text = np.repeat(np.arange(batch.num_rows), words.counts)
            head = np.ones(n, bool)
            head[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(head)
            m = np.diff(np.append(at, n))
            at, m = at[anchor[at] != 0], m[anchor[at] != 0]
            own = text[at]
            columns = [np.asarray(batch.column(c))[own] for c in ("id", "mark")]
            columns += [anchor[at].view(np.int64), spans_hash(words.hashes, at, at + m + window - 1).view(np.int64)]
            columns += [(at - words.starts[:-1][own]).astype(np.int32), m.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "mark", "anchor", "content", "w", "m"])

    return materialize(rows.mapInArrow(found, "id long, mark long, anchor long, content long, w int, m int"), "stretches")


def _listed(places: DataFrame, *columns: str) -> DataFrame:
    """Written: the places of every document in arrays, marked for broadcast when there are few in all."""
    lists = places.groupBy("id", "mark").agg(F.collect_set(F.struct(*columns)).alias("places"))
    lists = materialize(lists.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), *[F.col(f"places.{c}").alias(c) for c in columns]), "places")
    few = (lists.agg(F.sum(F.size(columns[0]))).first()[0] or 0) <= BROADCAST
    return F.broadcast(lists) if few else lists


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, hash of the words, id, mark, place) of every window of the listed stretches."""
    for batch in portions(batches):
        words = words_of(batch)
        each = np.diff(np.asarray(batch.column("w").offsets))
        w, m, anchor = (np.asarray(batch.column(c).flatten()) for c in ("w", "m", "anchor"))
        m = m.astype(np.int64)
        own = np.repeat(np.repeat(np.arange(batch.num_rows), each), m)
        place = np.repeat(w, m) + np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)
        first = words.starts[:-1][own] + place
        content = spans_hash(words.hashes, first, first + window).view(np.int64)
        yield np.repeat(anchor, m), content, np.asarray(batch.column("id"))[own], np.asarray(batch.column("mark"))[own], place.astype(np.int32)


def _met(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Ranges of windows whose anchor and words a smaller id has."""
    anchor, content, id, mark, w = (gathered(group[c], k) for c, k in (("anchor", "i8"), ("content", "i8"), ("id", "i8"), ("mark", "i8"), ("w", "i4")))
    order = np.lexsort((id, content, anchor))
    a, c, i = anchor[order], content[order], id[order]
    head = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
    least = i[np.flatnonzero(head)][np.cumsum(head) - 1]
    gone = order[i > least]
    id, mark, w = id[gone], mark[gone], w[gone]
    order = np.lexsort((w, mark, id))
    id, mark, w = id[order], mark[order], w[order]
    head = np.ones(len(w), bool)
    head[1:] = (id[1:] != id[:-1]) | (mark[1:] != mark[:-1]) | (w[1:] > w[:-1] + 1)
    at = np.flatnonzero(head)
    end = np.append(at[1:], len(w)) - 1
    last = w[end] if len(at) else w[:0]
    return pa.table([pa.array(id[at]), pa.array(mark[at]), pa.array(w[at]), pa.array((last - w[at] + 1).astype(np.int32))], names=["id", "mark", "w", "m"])


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranges (id, mark, w, m): m windows from word w on that start in a document of smaller id too. `rows` has id, mark, text."""
    bits = fragment_bits(rows.sparkSession)
    stretches = _stretches(rows, window)
    shared = stretches.groupBy("anchor").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.min("content").alias("c1"), F.max("content").alias("c2"), F.count("*").alias("n")
    ).where("least < most")
    kind = F.when(F.col("c1") == F.col("c2"), 0).when(F.col("n") <= CROWD, 1).otherwise(2)
    shared = materialize(shared.select("anchor", "least", kind.alias("kind")), "shared")
    found = materialize(stretches.join(small(shared, BROADCAST), "anchor").where("kind > 0 or id > least"), "found")
    ranges = found.where("kind = 0").select("id", "mark", "w", "m")

    def read(kind: int) -> DataFrame:
        lists = _listed(found.where(F.col("kind") == kind), "w", "m", "anchor")
        same = (F.col("id") == F.col("_id")) & (F.col("mark") == F.col("_mark"))
        return rows.join(lists, same).select("id", "mark", "text", "w", "m", "anchor")

    def as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _windows(batches, window):
            fragment = (mix(columns[0].view(U64)) >> U64(64 - bits)).astype(np.int32)
            yield packed(list(dealt(fragment, *columns)), ["fragment", "anchor", "content", "id", "mark", "w"])

    def as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _windows(batches, window):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "content", "id", "mark", "w"])

    parts = read(1).mapInArrow(as_arrays, "fragment int, anchor binary, content binary, id binary, mark binary, w binary")
    ranges = ranges.union(parts.groupBy("fragment").applyInArrow(_met, "id long, mark long, w int, m int"))
    if not found.where("kind = 2").isEmpty():
        windows = materialize(read(2).mapInArrow(as_rows, "anchor long, content long, id long, mark long, w int"), "windows")
        first = windows.groupBy("anchor", "content").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
        first = materialize(first.drop("most"), "first")
        ranges = ranges.union(windows.join(first, ["anchor", "content"]).where("id > least").select("id", "mark", "w", F.lit(1).alias("m")))
    return ranges


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row: id, n_words, n_removed, and kept_text: the words that stay, joined by single spaces."""
    whole = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.col(id).cast("long"), F.lit(LAST_ID))
    rows = bounded_batches(docs).select(number.alias("id"), F.xxhash64(number, whole).alias("mark"), whole.alias("text"))
    lists = _listed(repeated_windows(rows, window), "w", "m")
    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("own"), number.alias("id"), F.xxhash64(number, whole).alias("mark"), whole.alias("text"))
    out = out.join(lists, (F.col("id") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("own", "text", "w", "m")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            n, gone, texts = [], [], []
            for t, w, m in zip(*(batch.column(c) for c in ("text", "w", "m")), strict=True):
                words = t.as_py().encode().split()
                n.append(len(words))
                if w.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    first, length = np.asarray(w.values), np.asarray(m.values) + window - 1
                    np.add.at(change, first, 1)
                    np.add.at(change, first + length, -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(stay)]
                gone.append(n[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["own", "n_words", "n_removed", "kept_text"]
            )

    return out.mapInArrow(kept, f"own {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("own", id)
