"""Queries: tables as they are stored, changes merged on read, the search index kept in step, models inside the plan."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankmail.catalog import search as C
from bankmail.catalog.ingest import AS_OF, RECORDS
from bankmail.catalog.maintain import _IMAGES
from bankmail.catalog.registry import ORACLES, check, num, sql_label, txt
from bankmail.catalog.streams import movements
from bankmail.catalog.text import _AMOUNT, _DIRECTION, _STEPS
from bankmail.operators import ingest as I
from bankmail.operators import maintain as M
from bankmail.plans import models as L
from bankmail.plans import sync as Y
from bankmail.plans.index import SearchIndex
from bankmail.plans.keys import add_filters, stored_keys
from bankmail.schemas import EMAIL_CHANGES, EMAILS, RAW_MAIL_SCHEMA, SYNC_EVENTS, TABLES
from bankmail.session import materialize, work_dir
from bankmail.sources import tables
from bankmail.sources.derived import base, ctes, view
from bankmail.sources.tables import Commit
from bankmail.streaming.sync import Folder, sync_folders
from bankmail.streaming.trend import days, into_day_sums, late_rows


def _stored_mails(spark, sf, purpose: str) -> str:
    """The mails of the view as tables in the shared folder."""
    root = work_dir(spark, purpose)
    month = F.substr(F.col("received_date").cast("string"), F.lit(1), F.lit(7))
    tables.append(view(spark, sf, "emails").withColumn("sender_domain", F.lit("x")).withColumn("received_month", month), root, EMAILS, "all")
    return root


def _as_text(name: str, columns: str) -> str:
    """SQL of another query with the id as text, as stored mails have it."""
    return f"select cast(id as varchar) as id, {columns} from ({ORACLES[name]})"


@check("s9_labels_changed_on_read", _as_text("s9_labels_updated", "email_type"))
def _(spark, sf):
    root = _stored_mails(spark, sf, "labels")
    labels = base(spark, sf, "lineitem").filter("l_discount < 0.05").select(
        F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_quantity") >= 25, "OTHER").otherwise("REGULATORY_KYC_NOTICE").alias("email_type"), "l_quantity"
    )
    Y.label_emails(spark, root, labels, "c1", order="l_quantity")
    return tables.read(spark, root, EMAILS).select("id", "email_type")


@check("s10_flags_changed_and_folded", _as_text("s10_ocr_flags_cleared", "vision_needed"))
def _(spark, sf):
    root = _stored_mails(spark, sf, "flags")
    done = base(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").cast("string").alias("id"))
    Y.clear_ocr_flags(spark, root, done, "c1")
    tables.fold(spark, root, EMAILS)
    return tables.read(spark, root, EMAILS).select("id", "vision_needed")


@check("s11_texts_changed_on_read", _as_text("s11_text_appended", "body_text"))
def _(spark, sf):
    root = _stored_mails(spark, sf, "texts")
    merged = M.merged_ocr(view(spark, sf, "ocr_texts"), *_IMAGES).withColumn("id", F.col("id").cast("string"))
    with Commit(spark, root, "c1") as c:
        c.add(M.text_changes(merged, c.sequence), EMAIL_CHANGES)
    return tables.read(spark, root, EMAILS).select("id", "body_text")


@check("s15_mails_deleted", f"{ctes('emails')} select cast(id as varchar) as id from emails where id not in (select l_orderkey from lineitem where l_quantity >= 49)")
def _(spark, sf):
    root = _stored_mails(spark, sf, "deleted")
    Y.delete_emails(spark, root, base(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").cast("string").alias("id")), "c1")
    return tables.read(spark, root, EMAILS).select("id")


def _synced(spark, sf, purpose: str) -> str:
    """The landed mail synced as two batches, the earlier years first."""
    root = work_dir(spark, purpose)
    mail = view(spark, sf, "raw_mail").select(*RAW_MAIL_SCHEMA.names)
    early = F.col("date") < "1996"
    for batch, rows in (("b1", mail.filter(early)), ("b2", mail.filter(~early))):
        Y.sync_batch(spark, rows, root, batch, AS_OF)
    return root


_MARKS = "marks as (select account, folder, cast(max(received_date) as varchar) as latest from firsts group by account, folder)"


@check("a6_marks_kept_by_batches", f"{RECORDS}, {_MARKS} select account, folder, latest from marks")
def _(spark, sf):
    return Y.marks(spark, _synced(spark, sf, "marks")).select("account", "folder", txt("latest").alias("latest"))


@check("a3_day_trend_kept", f"""{RECORDS}, low as (select *, lower(body_text) as low, lower(subject || ' ' || body_text) as whole from firsts),
  done as (select *, {sql_label('whole')} as label, {_AMOUNT} as amount, {_DIRECTION} as direction from low),
  txns as (select *, case when label = 'FUNDS_CREDITED_ALERT' then 'credit' else 'debit' end as kind from done
    where label in ('FUNDS_CREDITED_ALERT', 'FUNDS_DEBITED_ALERT') and direction is not null and amount <> 0)
  select cast(cast(received_date as date) as varchar) as day, sum(case when kind = 'debit' then amount else 0 end)::double as debits,
    sum(case when kind = 'credit' then amount else 0 end)::double as credits, count(*) as count from txns group by 1""")
def _(spark, sf):
    """The trend from the sums that two batches kept, of mails in the tables."""
    return Y.day_trend(spark, _synced(spark, sf, "trend")).select("day", num("debits").alias("debits"), num("credits").alias("credits"), "count")


def _landed_events(spark, sf, parts: int) -> str:
    """The events as files that land one after the other, each with rows of all days."""
    path = work_dir(spark, "landed-events")
    events = movements(base(spark, sf, "events").withColumn("part", F.col("event_id") % parts), "part")
    for k in range(parts):
        events.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def _kept_days(spark, sf, delay):
    root, path = work_dir(spark, "kept-days"), _landed_events(spark, sf, 3)
    stream = spark.readStream.schema("ts timestamp_ntz, amount decimal(18,2), transaction_type string").option("maxFilesPerTrigger", 1).parquet(path)
    into_day_sums(stream, root, f"{root}-checkpoint", "ts", delay, folders=2).awaitTermination()
    return root


_MOVES = """moves as (select event_id % 3 as part, ts, cast(value as decimal(18,2)) as amount, event_type = 'purchase' as credit from events)"""


@check("r4_day_sums_kept", f"""with {_MOVES} select cast(cast(ts as date) as varchar) as day, sum(case when credit then 0 else amount end)::double as debits,
  sum(case when credit then amount else 0 end)::double as credits, count(*) as count from moves group by 1""")
def _(spark, sf):
    return days(spark, _kept_days(spark, sf, None)).select("day", num("debits").alias("debits"), num("credits").alias("credits"), "count")


@check("r3_late_rows_kept", f"""with {_MOVES}, newest as (select part, max(ts) as newest from moves group by part),
  before as (select m.*, (select max(newest) from newest n where n.part < m.part) as newest from moves m)
  select cast(cast(ts as date) as varchar) as day, count(*) filter (not coalesce(date_trunc('day', ts) + interval 1 day <= newest - interval 1 day, false)) as counted,
    count(*) filter (date_trunc('day', ts) + interval 1 day <= newest - interval 1 day) as late from before group by 1""")
def _(spark, sf):
    """Rows of each day that were counted, and those that came after their day was closed."""
    root = _kept_days(spark, sf, "1 day")
    counted = days(spark, root).select("day", F.col("count").alias("counted"), F.lit(0).cast("bigint").alias("late"))
    late = late_rows(spark, root).select(F.date_format("time", "yyyy-MM-dd").alias("day"), F.lit(0).cast("bigint").alias("counted"), F.lit(1).cast("bigint").alias("late"))
    return counted.unionByName(late).groupBy("day").agg(F.sum("counted").alias("counted"), F.sum("late").alias("late"))


@check("j6_keys_of_known_folders", f"{RECORDS} select count(*) as folders from (select distinct substr(cast(received_date as varchar), 1, 7) from firsts where strftime(received_date, '%Y') = '1997')")
def _(spark, sf):
    """Folders of stored mails that hold a key of the mails of 1997: the filters rule out most others, their keys the rest."""
    root = work_dir(spark, "filters")
    mails = Y.sync(view(spark, sf, "raw_mail").select(*RAW_MAIL_SCHEMA.names), tables.read(spark, root, EMAILS), AS_OF).emails()
    with Commit(spark, root, "all") as c:
        c.add(mails, EMAILS)
        add_filters(c, mails, I.KEY)
    known = tables.read(spark, root, EMAILS)
    held = stored_keys(spark, root, known.filter(F.year("received_date") == 1997), I.KEY)
    return held.agg(F.count_distinct("received_month").alias("folders"))


@functools.cache
def _indexed(spark, sf: str) -> str:
    """The documents' search index in the shared folder, made once in a session."""
    root = work_dir(spark, "search")
    with Commit(spark, root, "all") as c:
        SearchIndex(spark, root, T.LongType()).add(c, C.docs(spark, sf))
    return root


def index_of(spark, sf) -> SearchIndex:
    return SearchIndex(spark, _indexed(spark, sf), T.LongType())


def _found(spark, sf, **terms):
    return index_of(spark, sf).search(**terms).select("doc_id", F.round("rank", 8).alias("rank"))


@check("x2_stored_all_words", ORACLES["x2_search_all_words"])
def _(spark, sf):
    return _found(spark, sf, all=["Elle", "ement"])


@check("t4_stored_top", ORACLES["t4_search_top"])
def _(spark, sf):
    return _found(spark, sf, all=["nicht"], limit=5)


@check("x4_stored_any_word", ORACLES["x4_search_any_word"])
def _(spark, sf):
    return _found(spark, sf, any=["license", "mentre", "ouer"])


@check("x4_stored_without_word", ORACLES["x4_search_without_word"])
def _(spark, sf):
    return _found(spark, sf, all=["nicht"], none=["ensch"], limit=None)


@check("x4_stored_phrase", ORACLES["x4_search_phrase"])
def _(spark, sf):
    return _found(spark, sf, phrase="der die", limit=None)


@check("x4_stored_prefix", ORACLES["x4_search_prefix"])
def _(spark, sf):
    return _found(spark, sf, prefix="Licen", limit=None)


@check("x4_stored_near", ORACLES["x4_search_near"])
def _(spark, sf):
    return _found(spark, sf, near=(["nicht", "ein"], 5), limit=None)


@check("j4_stored_hits_with_mail", ORACLES["j4_search_hits_with_mail"])
def _(spark, sf):
    hits = index_of(spark, sf).search(all=["elle"], limit=20)
    return C.Q.search_emails(C.docs(spark, sf), hits).select("id", "subject", "body_text", F.round("rank", 8).alias("rank"))


@check("p13_stored_hits_of_one_label", ORACLES["p13_hits_of_one_label"])
def _(spark, sf):
    hits = index_of(spark, sf).search(all=["reing"], limit=None)
    offers = C.labelled(spark, sf).filter(F.col("email_type") == "CREDIT_LOAN_PROMOTION").select("id")
    return offers.join(hits, F.col("id") == F.col("doc_id")).select("id", F.round("rank", 8).alias("rank"))


@check("s17_index_kept_in_step", ORACLES["s17_reindexed_documents"])
def _(spark, sf):
    """All documents are indexed; then some change and some are deleted, in one commit."""
    root = work_dir(spark, "kept-in-step")
    index, before = SearchIndex(spark, root, T.LongType()), C.docs(spark, sf)
    with Commit(spark, root, "all") as c:
        index.add(c, before)
    marks = base(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    text = F.when(F.col("quality") == 1, F.concat(F.lit("changed now "), "body_text")).otherwise(F.col("body_text"))
    after = before.join(marks, "id", "left").filter("quality is null or quality = 1").withColumn("body_text", text).drop("quality")
    with Commit(spark, root, "changed") as c:
        index.replace(c, marks, after)
    return index.postings().groupBy("doc_id", "field").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"), F.count_distinct("token").alias("words"), F.max("doc_len").cast("bigint").alias("doc_len")
    )


@check("s14_index_emptied", f"with {C._tok()} select 'index_postings' as table_name, (select count(*) from tok) as rows_before, 0 as rows_after union all select 'index_lengths', (select count(*) from documents), 0")
def _(spark, sf):
    """Rows of the index before and after a reset of the mails."""
    root = work_dir(spark, "emptied")
    index = SearchIndex(spark, root, T.LongType())
    with Commit(spark, root, "all") as c:
        index.add(c, C.docs(spark, sf))

    def counts(name: str):
        parts = [df.select(F.lit(t.name).alias("table_name")) for t, df in zip(index.tables, (index.postings(), index.lengths()))]
        known = spark.createDataFrame([(t.name,) for t in index.tables[:2]], "table_name string")
        rows = parts[0].unionByName(parts[1]).groupBy("table_name").agg(F.count(F.lit(1)).alias(name))
        return materialize(known.join(rows, "table_name", "left").select("table_name", F.coalesce(name, F.lit(0)).alias(name)), "counts")

    before = counts("rows_before")
    tables.reset_tables(spark, root, list(TABLES.values()))
    return before.join(counts("rows_after"), "table_name")


def _runs(spark, sf):
    """Audit events of the runs of the log, with an account and the text of what went wrong."""
    log = view(spark, sf, "sync_log").withColumn("account", F.concat(F.lit("user"), F.col("id") % 3))
    error = F.when(F.col("status") == "failed", F.concat(F.lit("timeout "), F.col("id"))).when(F.col("status") == "skipped", "[NONEXISTENT]")
    at = F.col("sync_started").alias("at")
    closed = log.select("id", "account", "folder", at, "emails_fetched", "status", error.alias("error"))
    return M.sync_runs(M.start_run(closed).unionByName(M.complete_run(closed)))


_FAILED = f"{ctes('sync_log')}, f as (select *, 'user' || (id % 3) as account, 'timeout ' || id as error from sync_log where status = 'failed')"


@check("t7_first_errors", f"{_FAILED} select account, folder, error from f order by sync_started, id limit 5")
def _(spark, sf):
    return M.first_errors(_runs(spark, sf))


@check("a17_errors_per_account", f"{_FAILED} select account, count(*) as failed, md5(string_agg(folder || ': ' || error, chr(10) order by sync_started, id)) as errors from f group by account")
def _(spark, sf):
    return M.errors_by_account(_runs(spark, sf)).select("account", "failed", F.md5(F.array_join("errors", "\n")).alias("errors"))


@check("r5_folders_fail_alone", f"""{RECORDS} select account, folder, 'success' as status, count(distinct message_id) as emails_fetched from ids group by account, folder
  union all select 'user0@mail.example', 'Broken', 'failed', 0 union all select 'user0@mail.example', 'Gone', 'skipped', 0""")
def _(spark, sf):
    """A stream for each account's landed mail, one for a folder that holds no Parquet and one for a missing folder."""
    root, path = work_dir(spark, "isolated"), work_dir(spark, "exports")
    mail = view(spark, sf, "raw_mail").select(*RAW_MAIL_SCHEMA.names)
    accounts = [f"user{k}@mail.example" for k in range(3)]
    for k, account in enumerate(accounts):
        mail.filter(F.col("account") == account).write.parquet(f"{path}/{k}")
    mail.select(F.concat_ws(" ", "account", "folder").alias("value")).limit(1).coalesce(1).write.text(f"{path}/broken")
    folders = [Folder(accounts[0], "Broken", f"{path}/broken"), *[Folder(a, "All", f"{path}/{k}") for k, a in enumerate(accounts)], Folder(accounts[0], "Gone", f"{path}/gone")]
    sync_folders(spark, folders, root, f"{root}-checkpoints", AS_OF, "r1")
    return M.sync_runs(tables.read(spark, root, SYNC_EVENTS)).select("account", "folder", "status", "emails_fetched")


# a model that labels by the length of what it is asked, gives no label for some, and fails for others
_ASKED = "length(coalesce(subject, '') || chr(10) || coalesce(body_text, ''))"


def _model() -> L.Model:
    # a local function travels to the executors with its code, wherever this package is installed
    def answer(texts: list[str]) -> list[str]:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("no answer")
        return ['{"category": "OTP_SECURITY_ALERT"}' if len(t) % 3 == 0 else "no idea" for t in texts]

    return L.Model(answer, retries=1)


@check("g1_labels_by_model", f"""{ctes('emails')}, low as (select *, lower(coalesce(subject, '') || ' ' || coalesce(body_text, '')) as whole, {_ASKED} as n from emails)
  select id, case when n % 7 <> 0 and n % 3 = 0 then 'OTP_SECURITY_ALERT' else {sql_label('whole')} end as label from low""")
def _(spark, sf):
    models = L.Models(label=_model())
    return L.process_with(spark, work_dir(spark, "model"), view(spark, sf, "emails"), models).classified.select("id", "label")


@check("g2_unread_asked_once", f"""{_STEPS} select distinct 'transaction' as kind, sha256(body_text) as request_hash, length(body_text) % 7 = 0 as failed
  from labels where rule_label in ('FUNDS_CREDITED_ALERT', 'FUNDS_DEBITED_ALERT') and not coalesce(by_rule, false)""")
def _(spark, sf):
    """What a model was asked in two runs over the same mails: texts that the rules could not read, each once."""
    root = work_dir(spark, "unread")
    for _ in range(2):
        L.process_with(spark, root, view(spark, sf, "emails"), L.Models(transaction=_model()))
    return tables.read(spark, root, L.REPLIES).select("kind", "request_hash", F.col("response_text").isNull().alias("failed"))
