"""Token counts of a corpus from one exact histogram of encoded lengths.

Documents are encoded once and only their lengths are kept, counted by length with a partial
sum in every task. Sums from the longest length down then answer, for every context limit that
is a length in the corpus: documents and tokens at or above it, tokens that remain when every
document is cut at the limit, and the share of documents that fit. Between two lengths the answers
follow by one multiplication. The percentiles whose rank lies in a row of the histogram are its quantiles; any others are found the same way.

The running sums go over blocks of lengths and then within each block, so that no task orders
all lengths; the blocks' own sums are one row per BLOCK lengths.

Defined cases: a null text counts as empty and has length 0, as an empty one. Ids are not read;
repeated rows count each time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bankmail.llm.base import bounded_batches, materialize
from bankmail.llm.hashing import portions
from bankmail.llm.tokens import encoder, vocabulary

BLOCK = 1024


def token_lengths(docs: DataFrame, text: str = "text", ids_of: Callable[[str], bytes] | None = None, path: str | None = None) -> DataFrame:
    """The encoded length of every row, as `n_tokens`."""
    path = path or vocabulary()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of or encoder(path).ids
        for batch in portions(batches, size=1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) // 4 for t in batch.column("text").to_pylist()], pa.int64())], ["n_tokens"])

    return bounded_batches(docs).select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """A row for each length: n_tokens, n_docs, docs_at_least, tokens_at_least, tokens_truncated, share_within, percentiles.

    tokens_truncated: all tokens left when documents are cut at n_tokens. share_within: documents no longer than that.
    percentiles: the whole percents, 0 to 100, whose quantile this length is; each percent stands in one row.
    """
    counted = token_lengths(docs, text, **how).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    hist = materialize(counted, "lengths").withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    sums = [F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t")]
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = hist.groupBy("block").agg(*sums).select(
        "block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"]
    )
    down = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    at_least = lambda c, x: F.col(f"{c}_above") + F.sum(x).over(down)
    rows = hist.join(blocks, "block").withColumns({
        "docs_at_least": at_least("d", F.col("n_docs")), "tokens_at_least": at_least("t", F.col("n_docs") * F.col("n_tokens")),
    })
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all")).alias("share_within"),
        F.filter(F.sequence(F.lit(0), F.lit(100)), lambda q: _inside(q / 100, F.col("d_all"))).alias("percentiles"),
    )


def _inside(share: Column, docs: Column) -> Column:
    """Whether the document of this share's rank, the least that holds it, is one of the row's."""
    rank, upto = F.greatest(F.lit(1), F.ceil(share * docs)), docs - F.col("docs_at_least") + F.col("n_docs")
    return (rank <= upto) & (rank > upto - F.col("n_docs"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens) for shares of the documents from 0 to 1: the shortest length within which that many lie."""
    all_docs = histogram.agg(F.sum("n_docs")).first()[0]
    asked = F.array(*[F.lit(float(q)) for q in sorted(set(shares))])
    return histogram.select(F.explode(F.filter(asked, lambda q: _inside(q, F.lit(all_docs)))).alias("share"), "n_tokens")


def at_limits(histogram: DataFrame, limits: DataFrame, limit: str = "limit") -> DataFrame:
    """Answers for any context limits: documents cut and tokens left, for each row of `limits`.

    Both sides are small: the histogram has a row per length, and each limit needs the shortest length at or above it.
    """
    ordered = histogram.select(F.col("n_tokens").alias("at"), "docs_at_least", "tokens_at_least", (F.col("tokens_truncated") + F.col("tokens_at_least") - F.col("n_tokens") * F.col("docs_at_least")).alias("all_tokens"))
    both = limits.select(F.col(limit).alias("at"), F.lit(None).cast("long").alias("docs_at_least"), F.lit(None).cast("long").alias("tokens_at_least"), F.lit(None).cast("long").alias("all_tokens"), F.lit(True).alias("asked"))
    rows = ordered.withColumn("asked", F.lit(False)).unionByName(both)
    ahead = Window.orderBy(F.col("at").desc(), F.col("asked"))
    total = F.max("all_tokens").over(Window.partitionBy())
    look = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.lit(0))
    out = rows.select("at", "asked", look("docs_at_least").alias("docs_at_least"), (total - look("tokens_at_least") + F.col("at") * look("docs_at_least")).alias("tokens_truncated"))
    return out.where("asked").select(F.col("at").alias(limit), "docs_at_least", "tokens_truncated")
