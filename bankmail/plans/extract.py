"""Label mails, read transactions and offers out of them.

Rules run as native expressions. Replies of a model can come as a DataFrame
(email_id, response_text) or from a batch function; they are joined, parsed natively, and
rules stand in where a reply is missing or broken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankmail import dims
from bankmail.caps import WHOLE, Caps
from bankmail.functions import html as H
from bankmail.functions import rules as R
from bankmail.functions import text as X
from bankmail.functions.once import once


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substr(text, F.lit(1), F.lit(chars))


LABEL_REPLY = "category string, bank_or_platform string, amount_inr string"
TXN_REPLY = (
    "amount string, transaction_type string, merchant string, card_last4 string,"
    " category string, transaction_date string, payment_mode string"
)


REPLY_TYPE = (
    "struct<amount:decimal(18,2),transaction_type:string,merchant:string,card_last4:string,"
    "category:string,transaction_date:string,payment_mode:string>"
)


def ask(requests: DataFrame, model: Callable[[list[str]], list[str]], retries: int = 3) -> DataFrame:
    """Replies (email_id, response_text, error) of `model` for (email_id, request).

    `model` takes a batch of texts and gives a text each. A batch that fails, or gives another
    number of texts, is tried again up to `retries` times; then it is halved, so that in the end
    only the rows that fail alone carry the error instead of a reply.
    """

    def answered(texts: list[str]) -> list[tuple[str | None, str | None]]:
        error = ""
        for _ in range(retries):
            try:
                replies = list(model(texts))
                if len(replies) == len(texts):
                    return [(r, None) for r in replies]
                error = f"{len(replies)} replies to {len(texts)} requests"
            except Exception as e:  # noqa: BLE001 - reported as data
                error = str(e)
        if len(texts) < 2:
            return [(None, error)] * len(texts)
        half = len(texts) // 2
        return answered(texts[:half]) + answered(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = answered(batch["request"].tolist())
            reply, error = ([f[k] for f in found] for k in (0, 1))
            yield pd.DataFrame({"email_id": batch["email_id"].array, "response_text": pd.array(reply, object), "error": pd.array(error, object)})

    kind = requests.schema["email_id"].dataType.simpleString()
    return requests.select("email_id", "request").mapInPandas(
        run, schema=f"email_id {kind}, response_text string, error string"
    )


def one_per_mail(replies: DataFrame, columns: list[str]) -> DataFrame:
    """One reply a mail: replies come at least once, and repeated ones must not multiply mails.

    Of different replies the least in the order of their columns counts, on every run.
    """
    least = F.min(F.struct(*columns)).alias("r")
    return replies.groupBy("email_id").agg(least).select("email_id", "r.*")


def parsed_label_replies(replies: DataFrame, validate: bool = True) -> DataFrame:
    """(email_id, label, bank_or_platform, amount_inr) of replies that hold a category.

    The outermost braces are read. `validate` drops labels that are none of the known ones.
    """
    body = F.nullif(F.regexp_extract("response_text", r"(?s)\{.*\}", 0), F.lit(""))
    reply = F.from_json(body, LABEL_REPLY)
    parsed = replies.select("email_id", reply.alias("r")).filter(F.col("r.category").isNotNull())
    out = parsed.select(
        "email_id",
        F.upper("r.category").alias("label"),
        "r.bank_or_platform",
        F.col("r.amount_inr").alias("amount_inr"),
    )
    if validate:
        out = out.filter(F.col("label").isin([*dims.LABEL_KEYWORDS, dims.OTHER_LABEL]))
    return out


def parsed_txn_replies(replies: DataFrame) -> DataFrame:
    """(email_id, amount, ...) of replies that hold an amount other than zero."""
    body = F.nullif(F.regexp_extract("response_text", r"(?s)\{[^}]+\}", 0), F.lit(""))
    parsed = replies.select("email_id", F.from_json(body, TXN_REPLY).alias("r")).select("email_id", "r.*")
    return parsed.withColumn("amount", R.parse_money(F.col("amount"))).filter(F.col("amount") != 0)


def classify(
    emails: DataFrame,
    replies: DataFrame | None = None,
    validate: bool = True,
    whole_words: bool = False,
) -> DataFrame:
    """Adds `label`, and `reply_bank` and `reply_amount` where a model gave them."""
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body_text", F.lit("")))
    staged = once(emails.withColumn("low", F.lower(text)), rule_label=R.label(F.col("low"), whole_words))
    if replies is None:
        out = staged.withColumn("label", F.col("rule_label")).withColumns(
            {"reply_bank": F.lit(None).cast("string"), "reply_amount": F.lit(None).cast("string")}
        )
    else:
        r = one_per_mail(parsed_label_replies(replies, validate), ["label", "bank_or_platform", "amount_inr"]).select(
            F.col("email_id").alias("__k"), F.col("label").alias("__l"),
            F.col("bank_or_platform").alias("reply_bank"), F.col("amount_inr").alias("reply_amount"),
        )
        out = staged.join(r, F.col("id") == F.col("__k"), "left").withColumn("label", F.coalesce("__l", "rule_label"))
    return out.select(*emails.columns, "label", "reply_bank", "reply_amount")


def rule_transactions(
    emails: DataFrame,
    strict: bool = False,
    whole_words: bool = False,
    keep: tuple[str, ...] = (),
    max_raw: int | None = None,
) -> DataFrame:
    """One row per mail whose body gives a direction and an amount other than zero.

    (email_id, bank_name, amount, transaction_type, merchant, card_last4, category,
    transaction_date, txn_date, payment_mode, raw_text). Cheap tests come first, so the
    pattern work is done on the rows that pass them.
    """
    low = F.col("low")
    staged = emails.filter(F.coalesce("body_text", F.lit("")) != "").select(
        F.col("id").alias("email_id"), "bank_name", "body_text", F.lower("body_text").alias("low"), *keep
    )
    staged = once(staged, transaction_type=R.direction(low, whole_words)).filter(F.col("transaction_type").isNotNull())
    staged = once(staged, amount=R.amount(low, strict)).filter(F.col("amount") != 0)
    staged = once(staged, merchant=R.merchant(F.col("body_text")), token=R.date_token(low, strict))
    return staged.select(
        "email_id",
        "bank_name",
        "amount",
        "transaction_type",
        "merchant",
        R.card_last4(low, strict).alias("card_last4"),
        R.spending_category(low, F.col("merchant"), whole_words).alias("category"),
        R.normalize_date(F.col("token"), strict).alias("transaction_date"),
        R.payment_mode(low, whole_words).alias("payment_mode"),
        _cut(F.col("body_text"), max_raw).alias("raw_text"),
        *keep,
    )


def transactions(
    classified: DataFrame,
    txn_replies: DataFrame | None = None,
    strict: bool = False,
    whole_words: bool = False,
    max_raw: int | None = None,
) -> DataFrame:
    """Transactions of the mails labelled as money moved; expects `classify`.

    Rules first, a model's reply where they found none, then a bare record; the amount
    of the label reply only where nothing else gave one. The label sets the direction and
    a missing date is the mail's own. Rows without an amount are left out.

    All of it is one pass over the mails; only replies are joined.
    """
    low, by_rule = F.col("low"), F.col("by_rule")
    rows = (
        classified.filter(F.col("label").isin(dims.CREDIT_LABEL, dims.DEBIT_LABEL))
        .select(
            F.col("id").alias("email_id"), "bank_name", "received_date", "label", "reply_bank", "reply_amount",
            F.coalesce("body_text", F.lit("")).alias("body_text"), F.lower(F.coalesce("body_text", F.lit(""))).alias("low"),
        )
    )
    rows = once(rows, found=R.amount(low, strict), moved=R.direction(low, whole_words).isNotNull())
    rows = rows.withColumn("by_rule", F.col("moved") & F.coalesce(F.col("found") != 0, F.lit(False)))
    if txn_replies is None:
        rows = rows.withColumn("r", F.lit(None).cast(REPLY_TYPE)).withColumn("by_reply", F.lit(False))
    else:
        parts = [f.split()[0] for f in TXN_REPLY.split(", ")]
        parsed = one_per_mail(parsed_txn_replies(txn_replies), parts).select(F.col("email_id").alias("__k"), F.struct(*parts).alias("r"))
        rows = rows.join(parsed, F.col("email_id") == F.col("__k"), "left").withColumn(
            "by_reply", ~by_rule & F.col("__k").isNotNull()
        )
    given = R.parse_money(F.col("reply_amount"))
    rows = once(
        rows,
        amount=F.when(by_rule, F.col("found")).otherwise(
            F.coalesce(F.when(F.col("by_reply"), F.col("r.amount")), F.when(given > 0, given))
        ),
    ).filter(F.col("amount").isNotNull())
    rows = once(
        rows,
        r_merchant=F.when(by_rule, R.merchant(F.col("body_text"))),
        token=F.when(by_rule, R.date_token(low, strict)),
    )

    def pick(rule, name: str, bare=None):
        return (
            F.when(by_rule, rule).when(F.col("by_reply"), F.col(f"r.{name}")).otherwise(F.lit(bare).cast("string")).alias(name)
        )

    read = by_rule | F.col("by_reply")
    out = rows.select(
        X.stable_id(F.col("email_id")).alias("id"),
        "email_id",
        F.when(read, F.col("bank_name")).otherwise(F.coalesce("reply_bank", "bank_name")).alias("bank_name"),
        "amount",
        F.lit("INR").alias("currency"),
        F.when(F.col("label") == dims.CREDIT_LABEL, "credit").otherwise("debit").alias("transaction_type"),
        pick(R.spending_category(low, F.col("r_merchant"), whole_words), "category", "Other"),
        pick(F.col("r_merchant"), "merchant", "Unknown"),
        pick(R.card_last4(low, strict), "card_last4"),
        F.coalesce(
            F.nullif(pick(R.normalize_date(F.col("token"), strict), "transaction_date"), F.lit("")),
            X.iso_text(F.col("received_date")),
        ).alias("transaction_date"),
        pick(R.payment_mode(low, whole_words), "payment_mode", "Other"),
        F.when(read, _cut(F.col("body_text"), max_raw)).alias("raw_text"),
    )
    return out.withColumn("txn_date", R.real_date(F.col("transaction_date")))


def offers(
    classified: DataFrame,
    replies: DataFrame | None = None,
    as_of=None,
    caps: Caps = WHOLE,
) -> DataFrame:
    """Offers of the promotion mails; expects `classify`. Bodies under 20 characters give none.

    The text is the body, cut by `caps`, or a model's summary from `replies` (email_id, response_text)
    unless it says NO_OFFER; then the receipt line and the links follow.
    """
    promos = classified.filter(
        (F.col("label") == dims.PROMOTION_LABEL) & (F.length("body_text") >= dims.MIN_OFFER_CHARS)
    )
    raw = _cut(F.col("body_text"), caps.offer)
    text, basis = raw, raw
    if replies is not None:
        given = replies.filter(F.col("response_text").isNotNull())
        r = one_per_mail(given, ["response_text"]).select(F.col("email_id").alias("__k"), F.col("response_text").alias("__r"))
        promos = promos.join(r, F.col("id") == F.col("__k"), "left")
        usable = F.when(
            (F.coalesce("__r", F.lit("")) != "") & ~F.contains(F.upper("__r"), F.lit("NO_OFFER")), F.col("__r")
        )
        text, basis = F.coalesce(X.strip(usable), raw), F.coalesce(usable, raw)
    found = F.col("found")
    promos = once(promos, found=F.array_join(H.links(F.col("body_html"), caps.links, caps.link_chars), "\n"))
    tail = F.concat(
        F.lit("\n\nValid From/Received: "),
        F.coalesce(X.iso_text(F.col("received_date")), F.lit("Unknown Date")),
        F.when(found != "", F.concat(F.lit("\nLinks:\n"), found)).otherwise(F.lit("")),
    )
    rows = promos.select(
        "id", "bank_name", text.alias("text"), tail.alias("tail"), F.lower(basis).alias("low")
    )
    at = F.lit(None).cast("timestamp_ntz") if as_of is None else X.ntz(as_of)
    return rows.select(
        X.stable_id(F.col("id")).alias("id"),
        F.col("id").alias("email_id"),
        "bank_name",
        F.concat("text", "tail").alias("offer_text"),
        F.lit("email_body").alias("source"),
        R.offer_category(F.col("low")).alias("category"),
        F.lit(None).cast("timestamp_ntz").alias("valid_until"),
        at.alias("extracted_at"),
    )


@dataclass(frozen=True)
class Processed:
    """Result of one batch: the mails with `label`, and what was read out of them."""

    classified: DataFrame
    transactions: DataFrame
    offers: DataFrame

    def summary(self) -> DataFrame:
        """(classified, transactions_extracted, offers_extracted) as one row."""

        def n(df: DataFrame):
            return df.select(F.count(F.lit(1))).scalar()

        return self.classified.agg(F.count(F.lit(1)).alias("classified")).select(
            "classified",
            n(self.transactions).alias("transactions_extracted"),
            n(self.offers).alias("offers_extracted"),
        )


def process(
    emails: DataFrame,
    new_ids: DataFrame | None = None,
    label_replies: DataFrame | None = None,
    txn_replies: DataFrame | None = None,
    offer_replies: DataFrame | None = None,
    as_of=None,
    strict: bool = False,
    validate: bool = True,
    caps: Caps = WHOLE,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> Processed:
    """Label and read a batch; with `new_ids` (column `id`) only those mails. `caps` cuts what is kept.

    `stage` may write the labelled mails and read them back, so that transactions and offers do not label them again.
    """
    if new_ids is not None:
        emails = emails.join(new_ids.select("id"), "id", "left_semi")
    done = classify(emails, label_replies, validate)
    done = stage(done) if stage else done
    return Processed(done, transactions(done, txn_replies, strict, max_raw=caps.raw), offers(done, offer_replies, as_of, caps))


def unread(emails: DataFrame, strict: bool = False) -> DataFrame:
    """Mails labelled as money moved from which the rules read nothing: the ones to ask a model about."""
    low = F.col("low")
    moved = emails.filter(F.col("label").isin(dims.CREDIT_LABEL, dims.DEBIT_LABEL))
    staged = once(
        moved.withColumn("low", F.lower(F.coalesce("body_text", F.lit("")))),
        read=R.direction(low).isNotNull() & F.coalesce(R.amount(low, strict) != 0, F.lit(False)),
    )
    return staged.filter(~F.col("read")).drop("low", "read")
