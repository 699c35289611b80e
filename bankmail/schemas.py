"""Table schemas, defaults and constraint checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


@dataclass(frozen=True)
class Table:
    """A table: its columns, what must be unique, and values used when a column is missing.

    `parent` is (own column, table): rows go when the row of that table with this id is deleted. Rows that are `dealt` come by the table's
    partitions already, and a write only sorts them.
    """

    name: str
    schema: T.StructType
    unique: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None
    dealt: bool = False


EMAILS = Table(
    "emails",
    _struct(
        ("id", T.StringType(), False),
        ("account", T.StringType(), True),
        ("message_id", T.StringType(), False),
        ("sender", T.StringType(), False),
        ("sender_domain", T.StringType(), False),
        ("bank_name", T.StringType(), True),
        ("subject", T.StringType(), True),
        ("body_text", T.StringType(), True),
        ("body_html", T.StringType(), True),
        ("received_date", T.TimestampNTZType(), False),
        ("folder", T.StringType(), True),
        ("has_attachments", T.BooleanType(), True),
        ("email_type", T.StringType(), True),
        ("vision_needed", T.BooleanType(), True),
        ("synced_at", T.TimestampType(), True),
        ("received_month", T.StringType(), True),
    ),
    unique=("account", "folder", "message_id"),
    defaults={"has_attachments": False, "vision_needed": False},
    partition_by=("received_month",),
    sort_by=("received_date",),
)

TRANSACTIONS = Table(
    "transactions",
    _struct(
        ("id", T.StringType(), False),
        ("email_id", T.StringType(), True),
        ("bank_name", T.StringType(), True),
        ("amount", MONEY, True),
        ("currency", T.StringType(), True),
        ("transaction_type", T.StringType(), True),
        ("category", T.StringType(), True),
        ("merchant", T.StringType(), True),
        ("card_last4", T.StringType(), True),
        ("transaction_date", T.StringType(), True),
        ("txn_date", T.DateType(), True),
        ("payment_mode", T.StringType(), True),
        ("raw_text", T.StringType(), True),
    ),
    unique=("id",),
    defaults={"currency": "INR"},
    parent=("email_id", "emails"),
)

OFFERS = Table(
    "offers",
    _struct(
        ("id", T.StringType(), False),
        ("email_id", T.StringType(), True),
        ("bank_name", T.StringType(), True),
        ("offer_text", T.StringType(), True),
        ("source", T.StringType(), True),
        ("category", T.StringType(), True),
        ("valid_until", T.TimestampNTZType(), True),
        ("extracted_at", T.TimestampNTZType(), True),
    ),
    unique=("id",),
    defaults={"source": "email_body"},
    parent=("email_id", "emails"),
)

# One row per state change of a run; `sync_runs` folds them into the current state.
SYNC_EVENTS = Table(
    "sync_events",
    _struct(
        ("id", T.StringType(), False),
        ("event_time", T.TimestampNTZType(), False),
        ("folder", T.StringType(), True),
        ("emails_fetched", T.LongType(), True),
        ("status", T.StringType(), True),
        ("account", T.StringType(), True),
        ("error", T.StringType(), True),
    ),
    defaults={"emails_fetched": 0, "status": "in_progress"},
)

# What was changed of stored mails, a row per mail and change; a null says nothing of its column. `seq` orders changes.
EMAIL_CHANGES = Table(
    "email_changes",
    _struct(
        ("id", T.StringType(), False),
        ("seq", T.LongType(), False),
        ("email_type", T.StringType(), True),
        ("vision_needed", T.BooleanType(), True),
        ("body_added", T.StringType(), True),
        ("deleted", T.BooleanType(), True),
    ),
    unique=("id", "seq"),
)

# Newest mail per account and folder of a batch; the high-water mark is the greatest over batches.
MARKS = Table(
    "sync_marks",
    _struct(("account", T.StringType(), True), ("folder", T.StringType(), True), ("latest", T.TimestampNTZType(), False)),
)

# Sums per day of each batch's transactions; a deletion adds negative ones.
DAY_SUMS = Table(
    "day_sums",
    _struct(("day", T.StringType(), True), ("debits", T.DecimalType(28, 2), False), ("credits", T.DecimalType(28, 2), False), ("count", T.LongType(), False)),
)

# Which keys the mails of a folder may have: bitmaps of a hash of the key, in buckets.
KEY_FILTERS = Table("key_filters", _struct(("folder", T.StringType(), False), ("bucket", T.LongType(), False), ("bits", T.BinaryType(), False)))


def index_tables(id_type: T.DataType, name: str = "index") -> tuple[Table, Table, Table]:
    """Tables of a search index: postings in buckets of the word, document lengths, and ids whose older rows no longer count."""
    postings = Table(
        f"{name}_postings",
        _struct(
            ("token", T.StringType(), False), ("doc_id", id_type, False), ("field", T.StringType(), False), ("pos", T.IntegerType(), False),
            ("doc_len", T.IntegerType(), False), ("seq", T.LongType(), False), ("bucket", T.IntegerType(), False),
        ),
        partition_by=("bucket",),
        sort_by=("token",),
    )
    lengths = Table(f"{name}_lengths", _struct(("doc_id", id_type, False), ("doc_len", T.IntegerType(), False), ("seq", T.LongType(), False)))
    removed = Table(f"{name}_removed", _struct(("doc_id", id_type, False), ("seq", T.LongType(), False)))
    return postings, lengths, removed


INDEX_TABLES = index_tables(T.StringType())
CHANGES = {"emails": EMAIL_CHANGES}
#: Kept with the mails by `plans.sync.store`, and emptied with them.
KEPT = (MARKS, DAY_SUMS, KEY_FILTERS, *INDEX_TABLES)

RAW_MAIL_SCHEMA = _struct(
    ("account", T.StringType(), True),
    ("folder", T.StringType(), True),
    ("uid", T.StringType(), True),
    ("sender", T.StringType(), True),
    ("subject", T.StringType(), True),
    ("text", T.StringType(), True),
    ("html", T.StringType(), True),
    ("date", T.StringType(), True),
    ("n_attachments", T.IntegerType(), True),
)

TABLES = {t.name: t for t in (EMAILS, TRANSACTIONS, OFFERS, SYNC_EVENTS)}


def conform(df: DataFrame, table: Table) -> DataFrame:
    """Exactly the table's columns and types; missing columns and NULLs take their defaults."""

    def column(f: T.StructField) -> Column:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in table.defaults:
            value = F.coalesce(value, F.lit(table.defaults[f.name]).cast(f.dataType))
        return value.alias(f.name)

    return df.select([column(f) for f in table.schema])


def not_null_violation(table: Table, only: list[str] | None = None) -> Column:
    """True where a row breaks one of the table's NOT NULL columns."""
    bad = F.lit(False)
    for f in table.schema:
        if not f.nullable and (only is None or f.name in only):
            bad = bad | F.col(f.name).isNull()
    return bad


def violations(df: DataFrame, required: list[str], unique: list[str]) -> DataFrame:
    """Rows per broken rule: (rule, rows). A duplicate counts every row after the first."""
    nulls = df.select(
        F.explode(
            F.filter(
                F.array(*[F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in required]),
                lambda r: r.isNotNull(),
            )
        ).alias("rule")
    ).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))
    dups = (
        df.groupBy(*unique)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .agg(F.sum(F.col("n") - 1).alias("rows"))
        .filter(F.col("rows").isNotNull())
        .select(F.lit("unique:" + ",".join(unique)).alias("rule"), "rows")
    )
    return nulls.unionByName(dups)
