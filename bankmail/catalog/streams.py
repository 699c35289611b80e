"""Queries: the incremental forms, run over what has landed and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankmail.catalog.ingest import AS_OF, RECORDS
from bankmail.catalog.registry import check, num
from bankmail.schemas import EMAILS, OFFERS, RAW_MAIL_SCHEMA, SYNC_EVENTS, TABLES, TRANSACTIONS
from bankmail.operators import maintain as M
from bankmail.plans.sync import sync_batch
from bankmail.session import materialize, work_dir
from bankmail.sources import tables
from bankmail.sources.derived import view
from bankmail.sources.mail import stream_mail
from bankmail.streaming import mail as V
from bankmail.streaming.sync import into_tables


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def movements(stream, *keep: str):
    kind = F.when(F.col("event_type") == "purchase", "credit").otherwise("debit")
    return stream.select("ts", F.col("value").cast("decimal(18,2)").alias("amount"), kind.alias("transaction_type"), *keep)


def _run(stream, spark, purpose: str, mode: str):
    path = work_dir(spark, purpose)
    V.into_versions(stream, path, f"{path}-checkpoint", mode).awaitTermination()
    return spark.read.parquet(path)


@check("r2_stream_deduplicated", "select event_id, user_id from events")
def _(spark, sf):
    twice = event_stream(spark, sf).unionByName(event_stream(spark, sf))
    once = V.deduplicated(twice, ["event_id"], "ts", "40 days").select("event_id", "user_id")
    return _run(once, spark, "stream-dedupe", "append").drop("version")


_DAYS = """days as (select cast(cast(ts as date) as varchar) as day,
  sum(case when event_type <> 'purchase' then cast(value as decimal(18,2)) else 0 end)::double as debits,
  sum(case when event_type = 'purchase' then cast(value as decimal(18,2)) else 0 end)::double as credits, count(*) as count from events group by 1)"""


@check("r4_stream_day_trend", f"with {_DAYS} select day, debits, credits, count from days")
def _(spark, sf):
    rows = _run(V.daily_trend(movements(event_stream(spark, sf)), "ts"), spark, "stream-days", "update")
    return V.latest_versions(rows, ["day"]).select("day", num("debits").alias("debits"), num("credits").alias("credits"), "count")


@check("r3_closed_days_only", f"with {_DAYS} select day, debits, credits, count from days where cast(day as timestamp) + interval 1 day <= (select max(ts) from events) - interval 1 day")
def _(spark, sf):
    rows = _run(V.daily_trend(movements(event_stream(spark, sf)), "ts"), spark, "stream-closed", "append")
    return rows.select("day", num("debits").alias("debits"), num("credits").alias("credits"), "count")


def landed(spark, sf) -> str:
    """The landed mail as files in the shared folder, one folder per account."""
    path = work_dir(spark, "landed")
    names = RAW_MAIL_SCHEMA.names
    view(spark, sf, "raw_mail").select(*names).repartition(3, "account").write.parquet(path)
    return path


@check("r6_stream_into_tables", f"{RECORDS} select distinct account, folder, message_id from ids")
def _(spark, sf):
    root = work_dir(spark, "tables")
    tables.reset_tables(spark, root, list(TABLES.values()))
    stream = stream_mail(spark, landed(spark, sf), max_files=1)
    into_tables(stream, root, f"{root}-checkpoint", AS_OF).awaitTermination()
    return tables.read(spark, root, EMAILS).select("account", "folder", "message_id")


@check("s14_tables_reset", "select t as table_name, case when t = 'emails' then (select count(*) from orders) else 0 end as rows_before, 0 as rows_after from (values ('emails'), ('transactions'), ('offers'), ('sync_events')) v(t)")
def _(spark, sf):
    """Rows per table before and after a reset, with the schemas still there."""
    root = work_dir(spark, "reset")
    all_tables = [EMAILS, TRANSACTIONS, OFFERS, SYNC_EVENTS]
    tables.reset_tables(spark, root, all_tables)
    rows = view(spark, sf, "emails").withColumn("sender_domain", F.lit("x")).withColumn("received_month", F.substr(F.col("received_date").cast("string"), F.lit(1), F.lit(7)))
    tables.append(rows, root, EMAILS, "b1")

    def counts(name: str):
        out = None
        for t in all_tables:
            one = tables.read(spark, root, t).agg(F.count(F.lit(1)).alias(name)).select(F.lit(t.name).alias("table_name"), name)
            out = one if out is None else out.unionByName(one)
        return materialize(out, "counts")

    before = counts("rows_before")
    tables.reset_tables(spark, root, all_tables)
    return before.join(counts("rows_after"), "table_name")


ODD = "2025-06-20T10:00 [x]/y=1%"


def _mails(spark, sf):
    month = F.substr(F.col("received_date").cast("string"), F.lit(1), F.lit(7))
    # a NULL month is a folder like any other
    return view(spark, sf, "emails").withColumn("sender_domain", F.lit("x")).withColumn("received_month", F.when(F.col("id") % 7 != 0, month))


@check("s6_batch_replayed", "select cast(o_orderkey as varchar) as id, 1::bigint as n from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def _(spark, sf):
    """A batch is stored whole, then again with fewer rows and months, and another is emptied: only the last versions are left."""
    root = work_dir(spark, "replay")
    tables.reset_tables(spark, root, [EMAILS])
    rows = _mails(spark, sf)
    tables.append(rows, root, EMAILS, ODD)
    tables.append(rows.filter("id % 2 = 1 and id % 3 = 0"), root, EMAILS, "other")
    tables.append(rows, root, EMAILS, "emptied")
    tables.append(rows.filter("id % 2 = 0"), root, EMAILS, ODD)
    tables.append(rows.filter("false"), root, EMAILS, "emptied")
    return tables.read(spark, root, EMAILS).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@check("s15_rewrite_to_empty", "select cast(o_orderkey as varchar) as id from orders where o_orderkey % 2 = 1")
def _(spark, sf):
    """All rows of one batch are removed, whatever its name."""
    root = work_dir(spark, "rewrite")
    tables.reset_tables(spark, root, [EMAILS])
    rows = _mails(spark, sf)
    tables.append(rows.filter("id % 2 = 0"), root, EMAILS, ODD)
    tables.append(rows.filter("id % 2 = 1"), root, EMAILS, "plain")
    tables.rewrite(spark, root, EMAILS, lambda r: r.filter("id % 2 = 1"), F.col("batch") == ODD)
    return tables.read(spark, root, EMAILS).select("id")


@check("s13_audit_after_replay", f"{RECORDS} select account, folder, count(distinct message_id) as emails_fetched from ids group by all")
def _(spark, sf):
    """The audit counts of a batch that was run twice."""
    root = work_dir(spark, "audit")
    tables.reset_tables(spark, root, list(TABLES.values()))
    mail = view(spark, sf, "raw_mail").select(*RAW_MAIL_SCHEMA.names)
    for _ in range(2):
        sync_batch(spark, mail, root, "b1", AS_OF)
    counts = tables.read(spark, root, EMAILS).groupBy("account", "folder").agg(F.count(F.lit(1)).alias("stored"))
    fetched = M.sync_runs(tables.read(spark, root, SYNC_EVENTS)).groupBy("folder").agg(F.sum("emails_fetched").alias("in_events"))
    same = counts.groupBy("folder").agg(F.sum("stored").alias("in_table")).join(fetched, "folder").filter("in_table = in_events")
    return counts.join(same, "folder", "left_semi").select("account", "folder", F.col("stored").alias("emails_fetched"))
