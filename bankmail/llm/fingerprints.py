"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction.

A shingle is five consecutive words (all of a shorter text's). Every hash below 2^64 / SCALE is
kept, so a sketch grows with its text and two sketches say how much of one text is in the
other however unequal they are; sketches of parts merge by union. A text of up to SMALL different shingles,
however often they are repeated, keeps all its hashes, which hold those below the fraction, and so does one
without any below it; sketches of different scale compare below the lower fraction. A fingerprint is the scale, a colon and the ascending hashes in hex.

`neighbours` compares each document with an edited copy, whose last quarter is the beginning of
the next document by id, and with that next document. Documents are dealt into ranges of ids by
bounds taken from the narrow id column, one shuffle of the texts; the first document of each
range also goes to the range before it, so that every document meets the next. Tasks
stream through their sorted range and hold a portion of it.

Defined cases: a null text counts as empty, and an empty text has an empty sketch. Null ids come first; equal
ids are ordered by text, and a document that is alone follows itself. Two texts without shingles are
alike (1); empty sketches that do not hold all hashes say nothing and are not (0). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bankmail.llm.base import bounded_batches
from bankmail.llm.hashing import U64, Words, distinct, portions, shingles, text_buffers

SCALE, SMALL, SHINGLE = 8, 128, 5


def sketches(texts: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(scale, ascending hashes) of every text."""
    h, of = shingles(Words(*text_buffers(texts)), SHINGLE)
    h, bounds = distinct(h, of, len(texts))
    below = np.append(0, np.cumsum(h < U64((1 << 64) // SCALE)))[bounds]
    few = np.diff(below)  # hashes are ascending, so those below the fraction come first
    full = (np.diff(bounds) <= SMALL) | (few == 0)
    upto = np.where(full, bounds[1:], bounds[:-1] + few)
    return [(1 if full[k] else SCALE, h[bounds[k] : upto[k]].copy()) for k in range(len(texts))]


def fingerprint(sketch: tuple[int, np.ndarray]) -> str:
    return f"{sketch[0]}:{sketch[1].astype('>u8').tobytes().hex()}"


def sketch_of(fingerprint: str) -> tuple[int, np.ndarray]:
    scale, _, hashes = fingerprint.partition(":")
    return int(scale), np.frombuffer(bytes.fromhex(hashes), ">u8").astype(U64)


def _common(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if a[0] == b[0]:
        return a[1], b[1]
    scale = max(a[0], b[0])
    return tuple(h[: np.searchsorted(h, U64((1 << 64) // scale))] if s != scale else h for s, h in (a, b))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated Jaccard similarity of two texts' shingles."""
    x, y = _common(a, b)
    if not len(x) and not len(y):
        return float(a[0] == b[0] == 1)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of a's shingles that b has."""
    x, y = _common(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else float(a[0] == b[0] == 1 and not len(y))


def merged(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both texts' shingles together."""
    return max(a[0], b[0]), np.union1d(*_common(a, b))


def _ranges(docs: DataFrame, id: str, n: int) -> tuple[Column, list]:
    """The number of each row's range of ids, and the first id of every range. Bounds are one id a range."""
    dealt = docs.select(F.col(id).alias("id")).repartitionByRange(n, "id").select("id", F.spark_partition_id().alias("p"))
    found = dealt.groupBy("p").agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()
    firsts = sorted({r["first"] for r in found if r["first"] is not None})
    upper = firsts[1:]

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """By bisection among the ranges."""
        return ids.map(lambda x: bisect_right(upper, x)).astype("int32")

    # without nulls, ids keep their type on their way; null ids are in the first range
    at = F.when(F.col(id).isNull(), 0).otherwise(place(F.coalesce(id, F.lit(upper[0])))) if upper else F.lit(0)
    if any(r["nulls"] for r in found):
        firsts = [None, *firsts[1:]]
    return at, firsts


def neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    at, firsts = _ranges(docs, id, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = max(len(firsts), 1)
    first = F.coalesce(F.col(id).isin([x for x in firsts if x is not None]), F.lit(None in firsts))
    rows = bounded_batches(docs).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), at.alias("at"), first.alias("first"))
    goes = F.when(F.col("first"), F.array(F.struct(F.col("at"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("at") - 1, F.lit(n)).alias("at"), F.lit(True).alias("guest"))))
    goes = F.explode(F.coalesce(goes, F.array(F.struct(F.col("at"), F.lit(False).alias("guest")))))
    rows = rows.select("id", "text", goes.alias("to")).select("id", "text", "to.at", "to.guest")
    rows = rows.repartitionById(n, F.col("at").cast("int")).sortWithinPartitions("guest", F.col("id").asc_nulls_first(), "text").drop("at")

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in portions(batches):
            guests = batch.column("guest").to_pylist()
            over = True in guests
            upto = guests.index(True) + 1 if over else len(guests)
            ids += batch.column("id").to_pylist()[:upto]
            texts += batch.column("text").to_pylist()[:upto]
            if len(texts) > 1:
                yield table(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
            if over:
                return

    kind = docs.schema[id].dataType
    arrow = to_arrow_type(kind)

    def table(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All rows but the last, which is the next of the one before it."""
        edited = []
        for one, following in zip(texts, texts[1:], strict=False):
            q = len(one) // 4
            edited.append(one[: len(one) - q] + following[:q])
        own, other = sketches(pa.array(texts, pa.large_string())), sketches(pa.array(edited, pa.large_string()))
        columns = [
            pa.array(ids[:-1], arrow), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([fingerprint(s) for s in own[:-1]]), pa.array([fingerprint(s) for s in other]),
            pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(compared, schema).withColumnRenamed("id", id)
