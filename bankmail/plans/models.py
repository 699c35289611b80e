"""Models inside the plan: each request is asked once, its reply kept, failures noted, rules where there is no reply.

Replies are kept by a hash of what was asked. Before a model is called, requests with a kept reply, and those that
failed for good, are left out, and equal requests become one; so a batch that is run again calls no model.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankmail import dims
from bankmail.caps import WHOLE, Caps
from bankmail.plans import extract as E
from bankmail.schemas import Table
from bankmail.sources import tables

REPLIES = Table(
    "model_replies",
    T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("request_hash", T.StringType(), False), T.StructField("response_text", T.StringType()), T.StructField("error", T.StringType())]),
    partition_by=("kind",),
)


@dataclass(frozen=True)
class Model:
    """`answer` gives a text for each text of a batch; `request` is what it is asked about a mail."""

    answer: Callable[[list[str]], list[str]]
    request: Column | None = None
    retries: int = 3


@dataclass(frozen=True)
class Models:
    """The models that a run may ask: for the label of a mail, a transaction the rules cannot read, an offer's summary."""

    label: Model | None = None
    transaction: Model | None = None
    offer: Model | None = None


def _mail() -> Column:
    return F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body_text", F.lit("")))


def kept_replies(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(request_hash, response_text, error): one row for each request of a kind that was answered, or failed for good."""
    rows = tables.read(spark, root, REPLIES).filter(F.col("kind") == kind)
    return rows.groupBy("request_hash").agg(F.min("response_text").alias("response_text"), F.min("error").alias("error"))


def failures(spark: SparkSession, root: str) -> DataFrame:
    """(kind, request_hash, error) of requests that no attempt answered."""
    return tables.read(spark, root, REPLIES).filter("response_text is null").select("kind", "request_hash", "error").distinct()


def asked(spark: SparkSession, root: str, kind: str, requests: DataFrame, model: Model, again: bool = False) -> DataFrame:
    """Replies (email_id, response_text) to (email_id, request), from what is kept and, for the rest, from the model.

    The new replies are stored before they are used. `again` asks once more what has failed before.
    """
    hashed = requests.select("email_id", "request", F.sha2("request", 256).alias("request_hash")).filter(F.col("request").isNotNull())
    known = kept_replies(spark, root, kind)
    known = known.filter("response_text is not null") if again else known
    open_ = hashed.groupBy("request_hash").agg(F.min("request").alias("request")).join(known.select("request_hash"), "request_hash", "left_anti")
    replies = E.ask(open_.withColumnRenamed("request_hash", "email_id"), model.answer, model.retries)
    new = replies.select(F.lit(kind).alias("kind"), F.col("email_id").alias("request_hash"), "response_text", "error")
    tables.append(new, root, REPLIES, f"{kind}/{uuid.uuid4().hex}")
    answers = kept_replies(spark, root, kind).filter("response_text is not null").select("request_hash", "response_text")
    return hashed.select("email_id", "request_hash").join(answers, "request_hash").select("email_id", "response_text")


def process_with(
    spark: SparkSession, root: str, emails: DataFrame, models: Models, as_of=None, strict: bool = False, validate: bool = True, caps: Caps = WHOLE, again: bool = False
) -> E.Processed:
    """`extract.process` with models: labels of all mails, transactions of those that the rules cannot read, offers of promotions.

    `emails` is read several times; let it be a written table.
    """

    def replies(kind: str, model: Model | None, rows: DataFrame, request: Column) -> DataFrame | None:
        if model is None:
            return None
        request = request if model.request is None else model.request
        return asked(spark, root, kind, rows.select(F.col("id").alias("email_id"), request.alias("request")), model, again)

    labels = replies("label", models.label, emails, _mail())
    done = E.classify(emails, labels, validate)
    read = replies("transaction", models.transaction, E.unread(done, strict), F.col("body_text"))
    promotions = done.filter((F.col("label") == dims.PROMOTION_LABEL) & (F.length("body_text") >= dims.MIN_OFFER_CHARS))
    summaries = replies("offer", models.offer, promotions, F.col("body_text"))
    return E.process(emails, None, labels, read, summaries, as_of, strict, validate, caps)
