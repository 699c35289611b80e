"""Queries: landed mail to e-mail records (sources, filters, lookups, dedupe, sync marks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankmail import dims, schemas
from bankmail.caps import PARITY
from bankmail.catalog.registry import SQL_BANKS, check, quoted, sql_bank, txt
from bankmail.functions import html as H
from bankmail.functions import text as X
from bankmail.operators import ingest as I
from bankmail.operators.joins import first_per_key
from bankmail.plans import sync as Y
from bankmail.session import materialize
from bankmail.sources import mail as M
from bankmail.sources import tables
from bankmail.sources.derived import base, ctes, view

AS_OF = "2001-01-01 00:00:00"
HISTORY_END = "1996-01-01 00:00:00"

_DOMAIN = r"lower(regexp_extract(coalesce(sender, ''), '@([\w.-]+)', 1))"
_IMAGES = r"""list_filter(regexp_extract_all(html, '<img [^>]*>'), lambda t: regexp_matches(t, 'src="http')
  and not regexp_matches(t, '(width|height)="[01]"'))"""

# the e-mail records of the landed mail, step by step
RECORDS = f"""{ctes('raw_mail')}, {SQL_BANKS},
domains as (select *, {_DOMAIN} as sender_domain from raw_mail),
scanned as (select *, {sql_bank('sender_domain')} as bank_name,
  cast(substr(date, 1, 19) as timestamp) as received_date from domains),
bodies as (select *, trim(regexp_replace(case when trim(text) = '' and html <> ''
    then regexp_replace(html, '<[^>]*>', ' ', 'g') else text end, '\\s+', ' ', 'g')) as body_text
  from scanned where bank_name is not null),
records as (select seq, account, folder, bank_name, sender_domain, received_date, coalesce(sender, '') as sender,
  coalesce(uid, coalesce(sender, '') || '_' || replace(cast(received_date as varchar), ' ', 'T')) as message_id,
  coalesce(nullif(subject, ''), '(No Subject)') as subject, substr(body_text, 1, 10000) as body_text, html as body_html,
  n_attachments > 0 as has_attachments,
  length(trim(body_text)) < 50 and len({_IMAGES}) > 0 as vision_needed from bodies),
ids as (select *, substr(sha256(account || chr(31) || folder || chr(31) || message_id), 1, 32) as id from records),
firsts as (select * from ids qualify row_number() over (partition by account, folder, message_id order by received_date) = 1),
inserted as (select * from firsts f where not exists (select 1 from ids s where s.received_date < timestamp '{HISTORY_END}'
  and s.account = f.account and s.folder = f.folder and s.message_id = f.message_id))"""


def records(spark, sf):
    return I.email_records(I.with_bank(M.dated(view(spark, sf, "raw_mail", costly=True))), max_chars=PARITY.body, keep=("seq",))


def stored(spark, sf):
    """Mail of the years before, as already stored."""
    return records(spark, sf).filter(F.col("received_date") < X.ntz(HISTORY_END))


def inserted(spark, sf):
    """The mail that is not stored yet. Records are made once and written; the check for repeated and stored keys reads them there."""
    made = materialize(records(spark, sf), "records")
    return I.insert_new(made, made.filter(F.col("received_date") < X.ntz(HISTORY_END)))


@check("s1_landed_mail_of_folders", f"{ctes('emails')} select id, folder, subject from emails where folder in ('INBOX', 'Bulk Mail')")
def _(spark, sf):
    return view(spark, sf, "emails").filter(F.col("folder").isin("INBOX", "Bulk Mail")).select("id", "folder", "subject")


@check(
    "s2_folders_of_provider",
    f"""{ctes('raw_mail')}, f(provider, folder) as (values {", ".join(f"({quoted(p)}, {quoted(x)})" for p, xs in dims.PROVIDER_FOLDERS.items() for x in xs)})
    select seq, provider, folder from raw_mail m where exists (select 1 from f where f.provider = m.provider and f.folder = m.folder)
      or (provider not in (select provider from f) and folder = 'INBOX')""",
)
def _(spark, sf):
    return M.in_provider_folders(view(spark, sf, "raw_mail", costly=True)).select("seq", "provider", "folder")


@check("s3_since_day", f"{ctes('emails')} select id, cast(received_date as varchar) as received from emails where received_date >= timestamp '1997-06-15 00:00:00'")
def _(spark, sf):
    rows = M.since(view(spark, sf, "emails"), "1997-06-15 17:45:00")
    return rows.select("id", txt("received_date").alias("received"))


@check("s4_email_by_id", f"{ctes('emails')} select id, sender, subject, body_text from emails where id = 1234")
def _(spark, sf):
    return tables.by_key(view(spark, sf, "emails"), 1234).select("id", "sender", "subject", "body_text")


@check("s5_all_emails", f"{ctes('emails')} select id, message_id, sender, subject, body_text, cast(received_date as varchar) as received from emails")
def _(spark, sf):
    return view(spark, sf, "emails").select(
        "id", "message_id", "sender", "subject", "body_text", txt("received_date").alias("received")
    )


_RECORD_COLUMNS = [
    "account", "folder", "bank_name", "sender_domain", "sender", "message_id", "subject",
    "body_text", "body_html", "has_attachments", "vision_needed", "id",
]


@check("p1_email_records", f"{RECORDS} select seq, cast(received_date as varchar) as received, {', '.join(_RECORD_COLUMNS)} from ids")
def _(spark, sf):
    return records(spark, sf).select("seq", txt("received_date").alias("received"), *_RECORD_COLUMNS)


@check("p2_bank_senders_and_skipped", f"{RECORDS} select bank_name, count(*) as mails from scanned group by bank_name")
def _(spark, sf):
    return I.with_bank(view(spark, sf, "raw_mail", costly=True)).groupBy("bank_name").agg(F.count(F.lit(1)).alias("mails"))


@check("p3_mails_needing_ocr", f"{ctes('emails')} select id, cast(received_date as varchar) as received from emails where vision_needed order by received_date desc, id")
def _(spark, sf):
    from bankmail.operators.browse import needing_ocr

    return needing_ocr(view(spark, sf, "emails")).select("id", txt("received_date").alias("received"))


@check("p4_ocr_needed", f"{ctes('emails')} select id, length(trim(body_text)) < 50 and len({_IMAGES.replace('html', 'body_html')}) > 0 as needed from emails")
def _(spark, sf):
    return view(spark, sf, "emails").select("id", H.needs_ocr(F.col("body_text"), F.col("body_html")).alias("needed"))


@check(
    "p16_usable_images",
    f"""{ctes('images')} select image_id, url from images where content_type like 'image/%'
    and (content_length <= 0 or content_length between 1000 and 10000000) and width >= 50 and height >= 50""",
)
def _(spark, sf):
    ok = H.usable_image(F.col("content_type"), F.col("content_length"), F.col("width"), F.col("height"))
    return view(spark, sf, "images").filter(ok).select("image_id", "url")


@check("j5_bank_of_domain", f"{RECORDS} select seq, sender_domain, bank_name from scanned")
def _(spark, sf):
    return I.with_bank(view(spark, sf, "raw_mail", costly=True)).select("seq", "sender_domain", "bank_name")


@check("w1_first_of_message_id", f"{ctes('emails')} select id, message_id, subject from emails qualify row_number() over (partition by message_id order by received_date, id) = 1")
def _(spark, sf):
    rows = view(spark, sf, "emails").select("id", "message_id", "subject", "received_date")
    return first_per_key(rows, ["message_id"], [F.col("received_date"), F.col("id")]).select("id", "message_id", "subject")


@check("s6_insert_or_ignore", f"{RECORDS} select id, account, folder, message_id, subject, cast(received_date as varchar) as received from inserted")
def _(spark, sf):
    return inserted(spark, sf).select("id", "account", "folder", "message_id", "subject", txt("received_date").alias("received"))


@check("s6_rejected_rows", f"{ctes('raw_mail')} select count(*) as rejected from raw_mail where uid is null or sender is null")
def _(spark, sf):
    return I.rejected(view(spark, sf, "raw_mail", costly=True), ["uid", "sender"])


@check(
    "j6_not_yet_stored",
    f"""{ctes('emails')}, old as (select message_id from emails where received_date < timestamp '{HISTORY_END}')
    select message_id from emails where message_id not in (select message_id from old) group by message_id""",
)
def _(spark, sf):
    rows = view(spark, sf, "emails").select("message_id", "received_date", "id")
    old = rows.filter(F.col("received_date") < X.ntz(HISTORY_END))
    return I.insert_new(rows, old, key=["message_id"]).select("message_id")


@check("a6_high_water_mark", f"{ctes('emails')} select account, folder, cast(max(received_date) as varchar) as latest from emails group by account, folder")
def _(spark, sf):
    return I.high_water_mark(view(spark, sf, "emails")).select("account", "folder", txt("latest").alias("latest"))


@check("a6_high_water_mark_over_all", f"{ctes('emails')} select cast(max(received_date) as varchar) as latest from emails")
def _(spark, sf):
    return I.high_water_mark(view(spark, sf, "emails"), per=[]).select(txt("latest").alias("latest"))


@check(
    "a7_sync_start",
    f"""{ctes('emails')} select 'stored' as kind, cast(max(received_date) as varchar) as since from emails
    union all select 'first', cast(coalesce(max(received_date), timestamp '{AS_OF}' - interval 3 day) as varchar) from emails where received_date > timestamp '2900-01-01'""",
)
def _(spark, sf):
    em = view(spark, sf, "emails")
    none = em.filter(F.col("received_date") > X.ntz("2900-01-01 00:00:00"))
    return I.sync_start(em, AS_OF, per=[]).select(F.lit("stored").alias("kind"), txt("since").alias("since")).unionByName(
        I.sync_start(none, AS_OF, per=[]).select(F.lit("first").alias("kind"), txt("since").alias("since"))
    )


_SUMMARY = """emails_scanned, emails_skipped, emails_fetched, vision_flagged, banks_found"""
_SUMMARY_SQL = """select {k}, sum(scanned)::bigint as emails_scanned, sum(skipped)::bigint as emails_skipped, sum(fetched)::bigint as emails_fetched,
  sum(flagged)::bigint as vision_flagged, count(distinct bank) as banks_found from (
  select account, folder, 1 as scanned, cast(bank_name is null as int) as skipped, 0 as fetched, 0 as flagged, null as bank from scanned
  union all select account, folder, 0, 0, 1, cast(vision_needed as int), bank_name from inserted) group by {k}"""


@check("a10_ingest_summary", RECORDS + _SUMMARY_SQL.format(k="account, folder"))
def _(spark, sf):
    scanned = I.with_bank(view(spark, sf, "raw_mail", costly=True))
    return I.ingest_summary(scanned, inserted(spark, sf))


@check("a17_summary_per_account", RECORDS + _SUMMARY_SQL.format(k="account"))
def _(spark, sf):
    scanned = I.with_bank(view(spark, sf, "raw_mail", costly=True))
    return I.ingest_summary(scanned, inserted(spark, sf), by=["account"])


@check("u2_banks_found", f"{RECORDS} select distinct bank_name from inserted")
def _(spark, sf):
    return I.banks_found(inserted(spark, sf))


@check("u1_folders_in_one_table", f"{ctes('emails')} select folder, count(*) as mails, count(distinct account) as accounts from emails group by folder")
def _(spark, sf):
    em = view(spark, sf, "emails")
    parts = [em.filter(F.col("folder") == f) for f in ("INBOX", "[Gmail]/Promotions", "Promotions", "Bulk Mail")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("mails"), F.count_distinct("account").alias("accounts"))


@check(
    "r1_delta_since_mark",
    f"""{RECORDS}, marks as (select account, folder, max(received_date) as latest from ids
      where received_date < timestamp '{HISTORY_END}' group by account, folder)
    select seq, i.account, i.folder from ids i left join marks m on m.account = i.account and m.folder = i.folder
    where received_date >= date_trunc('day', coalesce(latest, timestamp '{AS_OF}' - interval 3 day))""",
)
def _(spark, sf):
    marks = I.high_water_mark(stored(spark, sf))
    return I.newer_than_mark(records(spark, sf), marks, AS_OF).select("seq", "account", "folder")


@check(
    "s16_schema_violations",
    f"""{ctes('raw_mail')} select * from (
      select 'not_null:uid' as rule, count(*) as rows from raw_mail where uid is null
      union all select 'not_null:sender', count(*) from raw_mail where sender is null
      union all select 'not_null:subject', count(*) from raw_mail where subject is null
      union all select 'unique:account,folder,uid', cast(sum(n - 1) as bigint) from (
        select count(*) as n from raw_mail group by account, folder, uid having count(*) > 1)) where rows > 0""",
)
def _(spark, sf):
    return schemas.violations(view(spark, sf, "raw_mail", costly=True), ["uid", "sender", "subject"], ["account", "folder", "uid"])


@check(
    "j8_images_of_mails",
    rf"""{ctes('emails')}, l as (select id as email_id, list_transform({_IMAGES.replace('html', 'body_html')}, lambda t: regexp_extract(t, 'src="([^"]*)"', 1)) as urls from emails)
    select email_id, cast(i - 1 as int) as pos, urls[i] as url from (select email_id, urls, unnest(generate_series(1, len(urls))) as i from l)""",
)
def _(spark, sf):
    return Y.image_list(view(spark, sf, "emails"))
