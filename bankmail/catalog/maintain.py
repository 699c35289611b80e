"""Queries: changes to stored rows, image text, audit rows, the whole sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankmail import dims, schemas
from bankmail.caps import PARITY
from bankmail.catalog import ingest as G
from bankmail.catalog.registry import check, num, sql_label, txt
from bankmail.catalog.text import _AMOUNT, _DIRECTION
from bankmail.operators import maintain as M
from bankmail.plans import sync as Y
from bankmail.sources.derived import base, ctes, view

_IMAGES = (PARITY.images, PARITY.image_min, PARITY.image_chars)


@check("s7_transaction_defaults", f"{ctes('transactions')} select cast(id as varchar) as id, coalesce(currency, 'INR') as currency, amount::double as amount, bank_name from transactions")
def _(spark, sf):
    rows = schemas.conform(view(spark, sf, "transactions").drop("currency"), schemas.TRANSACTIONS)
    return rows.select("id", "currency", num("amount").alias("amount"), "bank_name")


@check("s8_offer_defaults", f"{ctes('offers')} select cast(id as varchar) as id, bank_name, 'email_body' as source, category, cast(extracted_at as varchar) as extracted_at from offers")
def _(spark, sf):
    rows = schemas.conform(view(spark, sf, "offers").drop("source"), schemas.OFFERS)
    return rows.select("id", "bank_name", "source", "category", txt("extracted_at").alias("extracted_at"))


@check("s9_labels_updated", f"""{ctes('emails')}, u as (select l_orderkey as id, arg_max(new_label, l_quantity) as label from
  (select l_orderkey, l_quantity, case when l_quantity >= 25 then 'OTHER' else 'REGULATORY_KYC_NOTICE' end as new_label from lineitem where l_discount < 0.05) group by 1)
  select e.id, case when u.id is not null then u.label else e.email_type end as email_type from emails e left join u on u.id = e.id""")
def _(spark, sf):
    updates = base(spark, sf, "lineitem").filter("l_discount < 0.05").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_quantity") >= 25, "OTHER").otherwise("REGULATORY_KYC_NOTICE").alias("email_type"),
        "l_quantity",
    )
    return M.set_email_type(view(spark, sf, "emails"), updates, seq="l_quantity").select("id", "email_type")


@check("s10_ocr_flags_cleared", f"{ctes('emails')} select id, vision_needed and id not in (select l_orderkey from lineitem where l_quantity >= 49) as vision_needed from emails")
def _(spark, sf):
    done = base(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("id"))
    return M.mark_ocr_done(view(spark, sf, "emails"), done).select("id", "vision_needed")


_MERGED = """merged as (select email_id as id, string_agg(substr(text, 1, 500), chr(10) order by pos, text) as text, count(*) as n_texts
  from ocr_texts where pos < 5 and length(text) > 10 group by email_id)"""


@check("f24_image_texts_merged", f"{ctes('ocr_texts')}, {_MERGED} select id, text, n_texts from merged")
def _(spark, sf):
    return M.merged_ocr(view(spark, sf, "ocr_texts"), *_IMAGES)


@check("s11_text_appended", f"""{ctes('emails', 'ocr_texts')}, {_MERGED} select e.id, case when m.id is null then body_text else coalesce(body_text, '') || chr(10) || '[VISION EXTRACTED]' || chr(10) || m.text end as body_text
  from emails e left join merged m on m.id = e.id""")
def _(spark, sf):
    return M.append_text(view(spark, sf, "emails"), M.merged_ocr(view(spark, sf, "ocr_texts"), *_IMAGES)).select("id", "body_text")


@check("g3_mails_with_image_text", f"""{ctes('emails', 'ocr_texts')}, {_MERGED} select e.id, false as vision_needed,
  case when m.id is null or not vision_needed then body_text else body_text || chr(10) || '[VISION EXTRACTED]' || chr(10) || m.text end as body_text
  from emails e left join merged m on m.id = e.id""")
def _(spark, sf):
    out = Y.merge_ocr(view(spark, sf, "emails"), view(spark, sf, "ocr_texts"), PARITY)
    return out.emails.select("id", "vision_needed", "body_text")


_OCR_SUMMARY = f"""{ctes('emails', 'ocr_texts')}, {_MERGED} select count(*) as processed, coalesce(sum(n_texts), 0)::bigint as texts_extracted, 0 as skipped
  from emails e left join merged m on m.id = e.id where vision_needed"""


@check("a12_ocr_summary", _OCR_SUMMARY)
def _(spark, sf):
    return Y.merge_ocr(view(spark, sf, "emails"), view(spark, sf, "ocr_texts"), PARITY).summary()


@check("c3_ocr_phase", f"""{ctes('emails', 'ocr_texts')}, {_MERGED} select e.id, 1 as n_images, coalesce(n_texts, 0) as n_texts
  from emails e left join merged m on m.id = e.id where vision_needed""")
def _(spark, sf):
    return Y.merge_ocr(view(spark, sf, "emails"), view(spark, sf, "ocr_texts"), PARITY).pending.select("id", "n_images", "n_texts")


def run_events(spark, sf):
    """Opening events of every run, closing events of those that were not skipped."""
    log = view(spark, sf, "sync_log")
    opened = M.start_run(log.select("id", "folder", F.col("sync_started").alias("at")))
    closed = log.filter(F.col("status") != "skipped").select(
        "id", "folder", (F.col("sync_started") + F.expr("interval '90' second")).alias("at"), "emails_fetched", "status"
    )
    return opened, M.complete_run(closed)


@check("s12_runs_opened", f"{ctes('sync_log')} select id, folder, 'in_progress' as status, 0 as emails_fetched from sync_log")
def _(spark, sf):
    return run_events(spark, sf)[0].select("id", "folder", "status", "emails_fetched")


@check("s13_runs_closed", f"""{ctes('sync_log')} select id, folder, cast(sync_started as varchar) as sync_started,
  case when status <> 'skipped' then cast(sync_started + interval 90 second as varchar) end as sync_completed,
  case when status <> 'skipped' then emails_fetched else 0 end as emails_fetched, case when status = 'skipped' then 'in_progress' else status end as status from sync_log""")
def _(spark, sf):
    opened, closed = run_events(spark, sf)
    runs = M.sync_runs(opened.unionByName(closed))
    return runs.withColumn("sync_started", txt("sync_started")).withColumn("sync_completed", txt("sync_completed"))


@check("r5_run_status", """select event_id, case when event_type = 'error' then 'failed' when event_type = 'click' then 'skipped' else 'success' end as status from events""")
def _(spark, sf):
    kind = F.col("event_type")
    error = F.when(kind == "error", "timeout").when(kind == "click", "[NonExistent] Unknown Mailbox")
    return base(spark, sf, "events").select("event_id", M.run_status(error).alias("status"))


@check("s15_orphans_pruned", f"{ctes('transactions', 'emails')} select id, email_id from transactions where email_id is null or email_id in (select id from emails)")
def _(spark, sf):
    return M.prune_orphans(view(spark, sf, "transactions"), view(spark, sf, "emails")).select("id", "email_id")


_SYNC = f"""{G.RECORDS},
ocr as (select *, {G._IMAGES} as tags from inserted),
src as (select * exclude (html, tags), list_transform(tags, lambda t: 'BANNER ' || regexp_extract(t, 'src="([^"]*)"', 1)) as banners from
  (select *, null as html from ocr)),
low as (select *, lower(body_text) as low, lower(subject || ' ' || body_text) as whole from (select * exclude (body_text),
  case when vision_needed then body_text || chr(10) || '[VISION EXTRACTED]' || chr(10) || array_to_string(banners, chr(10)) else body_text end as body_text from src)),
done as (select *, {sql_label('whole')} as label, {_AMOUNT} as amount, {_DIRECTION} as direction from low)
select measure, value from (
  select 'fetched ' || account as measure, count(*) as value from inserted group by account
  union all select 'flagged', count(*) from inserted where vision_needed
  union all select 'skipped', count(*) from scanned where bank_name is null
  union all select 'label ' || label, count(*) from done group by label
  union all select 'transactions', count(*) from done where label in ('FUNDS_CREDITED_ALERT', 'FUNDS_DEBITED_ALERT') and direction is not null and amount <> 0
  union all select 'offers', count(*) from done where label = 'CREDIT_LOAN_PROMOTION' and length(body_text) >= 20)"""
_SYNC = _SYNC.replace(f"{G._IMAGES} as tags", G._IMAGES.replace("html", "body_html") + " as tags").replace(
    "* exclude (html, tags)", "* exclude (tags)"
).replace("(select *, null as html from ocr)", "ocr")


@check("c2_whole_sync", _SYNC)
def _(spark, sf):
    def read_images(urls):
        return urls.select("email_id", "pos", F.concat(F.lit("BANNER "), "url").alias("text"))

    out = Y.sync(view(spark, sf, "raw_mail", costly=True), G.stored(spark, sf), G.AS_OF, read_images=read_images, stage=True, caps=PARITY)
    one = F.count(F.lit(1)).alias("value")
    # one summary for the three measures, so that the landed mail is read for them once
    named = {"flagged": "vision_flagged", "skipped": "emails_skipped"}
    measures = [F.struct(F.concat(F.lit("fetched "), "account").alias("measure"), F.col("emails_fetched").alias("value"))]
    measures += [F.struct(F.lit(name).alias("measure"), F.col(c).alias("value")) for name, c in named.items()]
    summary = out.summary(by=["account"]).select(F.inline(F.array(*measures))).groupBy("measure").agg(F.sum("value").alias("value"))
    labels = out.processed.classified.groupBy(F.concat(F.lit("label "), "label").alias("measure")).agg(one)
    return (
        summary.unionByName(labels)
        .unionByName(out.processed.transactions.agg(one).select(F.lit("transactions").alias("measure"), "value"))
        .unionByName(out.processed.offers.agg(one).select(F.lit("offers").alias("measure"), "value"))
    )
