"""Queries: spending summaries, counts, browsing views and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankmail.catalog.registry import check, num, sql_inr, txt
from bankmail.functions import rules as R
from bankmail.functions import text as X
from bankmail.operators import browse as W
from bankmail.operators import spending as S
from bankmail.operators import stats as N
from bankmail.plans import reports as P
from bankmail.sources.derived import ctes, view

AS_OF = "2001-08-01 00:00:00"


def txns(spark, sf):
    return view(spark, sf, "transactions")


def mails(spark, sf):
    return view(spark, sf, "emails")


def offers(spark, sf):
    return view(spark, sf, "offers")


def offer_mails(spark, sf):
    return view(spark, sf, "offer_emails")


_DAY = "coalesce(cast(cast(e.received_date as date) as varchar), substr(t.transaction_date, 1, 10), 'Unknown')"
_DAYS = f"""days as (select {_DAY} as day,
  sum(case when transaction_type = 'debit' then amount else 0 end) as debits,
  sum(case when transaction_type = 'credit' then amount else 0 end) as credits, count(*) as n
  from transactions t left join emails e on t.email_id = e.id group by 1
  having {_DAY} <> 'Unknown' and length({_DAY}) = 10),
real_days as (select *, try_cast(day as date) as d from days where regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') and try_cast(day as date) is not null)"""
_BY_CATEGORY = """cat as (select category, sum(amount) as total, count(*) as n from transactions
  where transaction_type = 'debit' and category is not null group by category)"""
_BY_BANK = """bank as (select bank_name, sum(amount) as total, count(*) as n from transactions
  where transaction_type = 'debit' and bank_name is not null group by bank_name)"""
_TOTALS = """tot as (select coalesce(sum(case when transaction_type = 'debit' then amount else 0 end), 0) as d,
  coalesce(sum(case when transaction_type = 'credit' then amount else 0 end), 0) as c, count(*) as n from transactions)"""
_T, _TE = ctes("transactions"), ctes("transactions", "emails")


@check("a1_spend_by_category", f"{_T}, {_BY_CATEGORY} select category, total::double as total, n as count from cat order by total desc, category")
def _(spark, sf):
    return S.by_category(txns(spark, sf)).select("category", num("total").alias("total"), "count")


@check("a2_spend_by_bank", f"{_T}, {_BY_BANK} select bank_name, total::double as total, n as count from bank order by total desc, bank_name")
def _(spark, sf):
    return S.by_bank(txns(spark, sf)).select("bank_name", num("total").alias("total"), "count")


@check("a3_day_trend", f"{_TE}, {_DAYS} select day, debits::double as debits, credits::double as credits, n as count from days order by day")
def day_trend(spark, sf):
    days = S.daily(txns(spark, sf), mails(spark, sf))
    return days.select("day", num("debits").alias("debits"), num("credits").alias("credits"), "count")


@check("a3_day_trend_real_days", f"{_TE}, {_DAYS} select day, debits::double as debits, credits::double as credits, n as count from real_days order by day")
def _(spark, sf):
    days = S.daily(txns(spark, sf), mails(spark, sf), valid_days_only=True)
    return days.select("day", num("debits").alias("debits"), num("credits").alias("credits"), "count")


@check("a4_totals", f"{_T}, {_TOTALS} select d::double as total_debits, c::double as total_credits, n as total_count from tot")
def _(spark, sf):
    return S.totals(txns(spark, sf)).select(
        num("total_debits").alias("total_debits"), num("total_credits").alias("total_credits"), "total_count"
    )


@check(
    "a5_row_counts",
    f"""{ctes('emails', 'transactions', 'offers')} select 'emails' as table_name, count(*) as rows from emails
    union all select 'transactions', count(*) from transactions union all select 'offers', count(*) from offers""",
)
def _(spark, sf):
    return N.row_counts(emails=mails(spark, sf), transactions=txns(spark, sf), offers=offers(spark, sf))


_STATS = """st as (select count(*) as total_syncs,
  coalesce(sum(case when status = 'success' then emails_fetched end), 0)::bigint as total_emails_fetched,
  (select id from sync_log order by sync_started desc, id desc limit 1) as last_id from sync_log)"""


@check(
    "a8_sync_stats",
    f"""{ctes('sync_log')}, {_STATS} select total_syncs, total_emails_fetched, last_id, cast(sync_started as varchar) as last_started,
    folder as last_folder, status as last_status from st join sync_log on id = last_id""",
)
def _(spark, sf):
    out = N.sync_stats(view(spark, sf, "sync_log"))
    return out.withColumn("last_started", txt("last_started"))


@check(
    "a9_dashboard",
    f"""{ctes('emails', 'transactions', 'offers', 'sync_log')}, {_STATS} select (select count(*) from emails) as email_count,
    (select count(*) from transactions) as transaction_count, (select count(*) from offers) as offer_count,
    total_syncs, total_emails_fetched, last_id, (select cast(max(received_date) as varchar) from emails) as latest_sync_date from st""",
)
def _(spark, sf):
    out = N.dashboard(mails(spark, sf), txns(spark, sf), offers(spark, sf), view(spark, sf, "sync_log"))
    return out.withColumn("latest_sync_date", txt("latest_sync_date"))


@check(
    "a13_category_share",
    f"{_T}, {_BY_CATEGORY}, {_TOTALS} select category, total::double as total, cat.n as count, round(total::double / d::double * 100, 1) as share from cat, tot",
)
def _(spark, sf):
    return S.category_share(txns(spark, sf)).withColumn("total", num("total"))


@check("a14_net_outflow", f"{_T}, {_TOTALS} select (d - c)::double as net_outflow from tot")
def _(spark, sf):
    return S.net_outflow(txns(spark, sf)).select(num("net_outflow").alias("net_outflow"))


_MONTHS = """months as (select strftime(d, '%Y-%m') as month, sum(debits) as debits, sum(credits) as credits,
  sum(n)::bigint as n from real_days group by 1)"""


@check("a15_month_trend", f"{_TE}, {_DAYS}, {_MONTHS} select month, debits::double as debits, credits::double as credits, n as count from months order by month")
def _(spark, sf):
    out = S.monthly(S.daily(txns(spark, sf), mails(spark, sf)))
    return out.select("month", num("debits").alias("debits"), num("credits").alias("credits"), "count")


@check("p7_debits_with_category", f"{_T} select id, category, amount::double as amount from transactions where transaction_type = 'debit' and category is not null")
def _(spark, sf):
    rows = txns(spark, sf).filter((F.col("transaction_type") == "debit") & F.col("category").isNotNull())
    return rows.select("id", "category", num("amount").alias("amount"))


@check("p14_debit_credit_columns", f"""{_T} select id, case when transaction_type = 'debit' then amount::double else 0 end as debit,
  case when transaction_type = 'credit' then amount::double else 0 end as credit from transactions""")
def _(spark, sf):
    def side(kind):
        return F.when(F.col("transaction_type") == kind, num("amount")).otherwise(0.0).alias(kind)

    return txns(spark, sf).select("id", side("debit"), side("credit"))


@check("p12_successful_runs", f"{ctes('sync_log')} select id, folder, emails_fetched from sync_log where status = 'success'")
def _(spark, sf):
    return view(spark, sf, "sync_log").filter(F.col("status") == "success").select("id", "folder", "emails_fetched")


@check("w4_latest_run", f"{ctes('sync_log')} select id, folder, status from sync_log order by sync_started desc, id desc limit 1")
def _(spark, sf):
    return N.sync_stats(view(spark, sf, "sync_log")).select(
        F.col("last_id").alias("id"), F.col("last_folder").alias("folder"), F.col("last_status").alias("status")
    )


# event time of a transaction: the mail's time, else its own real date
_EVENT = """coalesce(e.received_date, case when regexp_matches(t.transaction_date, '^\\d{4}-\\d{2}-\\d{2}')
  then cast(try_cast(substr(t.transaction_date, 1, 10) as date) as timestamp) end)"""
_EVENT_TEXT = "coalesce(replace(cast(e.received_date as varchar), ' ', 'T'), t.transaction_date)"
_JOIN = "from transactions t left join emails e on t.email_id = e.id"


@check("p5_transactions_filtered", f"""{_TE} select t.id, e.subject as email_subject, cast({_EVENT} as varchar) as event_time {_JOIN}
  where t.bank_name = 'SBI' and t.transaction_type = 'debit' and {_EVENT} >= timestamp '{AS_OF}' - interval 400 day""")
def _(spark, sf):
    rows = W.transactions_where(txns(spark, sf), mails(spark, sf), "SBI", "debit", 400, AS_OF)
    return rows.select("id", "email_subject", txt("event_time").alias("event_time"))


@check("p5_transactions_filtered_as_text", f"""{_TE} select t.id, {_EVENT_TEXT} as event_time {_JOIN}
  where {_EVENT_TEXT} >= '2000-06-27T00:00:00'""")
def _(spark, sf):
    rows = W.transactions_where(txns(spark, sf), mails(spark, sf), days=400, as_of=AS_OF, as_text=True)
    return rows.select("id", "event_time")


@check("p6_offers_of_bank", f"{ctes('offers')} select id, bank_name, category from offers where bank_name = 'src7' order by extracted_at desc, id limit 100")
def _(spark, sf):
    rows = W.recent_offers(offers(spark, sf), offer_mails(spark, sf), bank_name="src7")
    return rows.select("id", "bank_name", "category")


@check("p15_event_time", f"{_TE} select t.id, cast({_EVENT} as varchar) as event_time {_JOIN}")
def _(spark, sf):
    rows = W.transactions_where(txns(spark, sf), mails(spark, sf))
    return rows.select("id", txt("event_time").alias("event_time"))


@check("f25_day_of_transaction", f"{_TE} select t.id, {_DAY} as day {_JOIN}")
def _(spark, sf):
    return S.with_day(txns(spark, sf), mails(spark, sf)).select("id", "day")


@check("p8_days_of_ten_characters", f"{_TE}, {_DAYS} select day from days")
def _(spark, sf):
    return S.daily(txns(spark, sf), mails(spark, sf)).select("day")


@check("j1_transactions_with_email", f"""{_TE} select t.id, t.email_id, e.subject as email_subject, cast(e.received_date as varchar) as received {_JOIN}""")
def _(spark, sf):
    rows = W.with_email(txns(spark, sf), mails(spark, sf))
    return rows.select("id", "email_id", "email_subject", txt("email_received_date").alias("received"))


@check("j2_transactions_with_day", f"{_TE} select t.id, t.amount::double as amount, cast(e.received_date as varchar) as received {_JOIN}")
def _(spark, sf):
    rows = S.with_day(txns(spark, sf), mails(spark, sf))
    return rows.select("id", num("amount").alias("amount"), txt("received_date").alias("received"))


@check("j3_offers_with_email", f"""{ctes('offers', 'offer_emails')} select o.id, o.bank_name, e.subject as email_subject, e.sender as email_sender,
  length(e.body_text) as body_chars, cast(e.received_date as varchar) as email_date from offers o left join offer_emails e on o.email_id = e.id""")
def _(spark, sf):
    rows = W.offers_with_email(offers(spark, sf), offer_mails(spark, sf))
    return rows.select(
        "id", "bank_name", "email_subject", "email_sender",
        F.length("email_body").cast("bigint").alias("body_chars"), txt("email_date").alias("email_date"),
    )


@check("j7_new_mails_only", f"{ctes('emails')} select id, subject from emails where id in (select l_orderkey from lineitem where l_quantity >= 49)")
def _(spark, sf):
    from bankmail.sources.derived import base

    new = base(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("id"))
    return mails(spark, sf).join(new, "id", "left_semi").select("id", "subject")


@check("t1_recent_emails", f"{ctes('emails')} select id, cast(received_date as varchar) as received from emails order by received_date desc, id limit 50")
def _(spark, sf):
    return W.recent_emails(mails(spark, sf)).select("id", txt("received_date").alias("received"))


@check("t2_recent_transactions", f"""{_TE} select t.id, e.subject as email_subject, t.amount::double as amount {_JOIN}
  order by {_EVENT} desc nulls last, t.id limit 200""")
def _(spark, sf):
    rows = W.recent_transactions(txns(spark, sf), mails(spark, sf))
    return rows.select("id", "email_subject", num("amount").alias("amount"))


@check("t3_recent_offers", f"""{ctes('offers', 'offer_emails')}, top as (select * from offers order by extracted_at desc, id limit 100)
  select o.id, o.bank_name, e.subject as email_subject, e.body_text as email_body from top o left join offer_emails e on o.email_id = e.id""")
def _(spark, sf):
    rows = W.recent_offers(offers(spark, sf), offer_mails(spark, sf))
    return rows.select("id", "bank_name", "email_subject", "email_body")


@check("t5_groups_by_total", f"{_T}, {_BY_CATEGORY} select category, total::double as total from cat order by total desc, category")
def _(spark, sf):
    return S.by_category(txns(spark, sf)).select("category", num("total").alias("total"))


@check("t6_top_categories", f"{_T}, {_BY_CATEGORY} select category, total::double as total from cat order by total desc, category limit 8")
def _(spark, sf):
    return S.by_category(txns(spark, sf)).limit(8).select("category", num("total").alias("total"))


@check("t7_first_failed_runs", f"{ctes('sync_log')} select id, folder from sync_log where status = 'failed' order by sync_started, id limit 5")
def _(spark, sf):
    failed = view(spark, sf, "sync_log").filter(F.col("status") == "failed")
    return failed.orderBy("sync_started", "id").limit(5).select("id", "folder")


@check("w2_first_offers_per_bank", f"""{ctes('offers')} select bank_name, id, place from (select *,
  row_number() over (partition by bank_name order by extracted_at desc, id) as place from offers) where place <= 5""")
def _(spark, sf):
    return W.first_offers_per_bank(offers(spark, sf)).select("bank_name", "id", F.col("place").cast("bigint").alias("place"))


@check("a16_offers_by_bank", f"""{ctes('offers')}, f as (select *, row_number() over (partition by bank_name order by extracted_at desc, id) as place from offers)
  select bank_name, string_agg(substr(offer_text, 1, 150), '|' order by place) as texts from f where place <= 5 group by bank_name""")
def _(spark, sf):
    rows = W.first_offers_per_bank(offers(spark, sf))
    texts = F.array_sort(F.collect_list(F.struct("place", F.substr("offer_text", F.lit(1), F.lit(150)).alias("t"))))
    return rows.groupBy("bank_name").agg(F.array_join(F.transform(texts, lambda x: x["t"]), "|").alias("texts"))


_REPORT = f"""{_TE}, {_DAYS}, {_MONTHS}, {_BY_CATEGORY}, {_BY_BANK}, {_TOTALS}
select 1 as section, 'Total Debits' as label, d::double as total, n as count, null::double as share, 'Total Debits: ' || {sql_inr('d')} as line from tot
union all select 1, 'Total Credits', c::double, n, null, 'Total Credits: ' || {sql_inr('c')} from tot
union all select 1, 'Total Transactions', null, n, null, 'Total Transactions: ' || n from tot
union all select 1, 'Net Outflow', (d - c)::double, n, null, 'Net Outflow: ' || {sql_inr('(d - c)')} from tot
union all select 2, category, total::double, cat.n, round(total::double / d::double * 100, 1),
  '  ' || category || ': ' || {sql_inr('total')} || ' (' || cat.n || ' txns, ' || printf('%.1f', round(total::double / d::double * 100, 1)) || '%)' from cat, tot
union all select 3, bank_name, total::double, n, null, '  ' || bank_name || ': ' || {sql_inr('total')} || ' (' || n || ' txns)' from bank
union all select 4, month, debits::double, n, null, '  ' || month || ': Debits ' || {sql_inr('debits')} || ', Credits ' || {sql_inr('credits')} from months"""


@check("c4_spending_report", _REPORT)
def _(spark, sf):
    rows = P.spending_report(txns(spark, sf), mails(spark, sf))
    return rows.select("section", "label", num("total").alias("total"), "count", "share", "line")


_TOP30 = "top30 as (select *, row_number() over (order by extracted_at desc, id) as arrival from offers order by extracted_at desc, id limit 30)"


@check("c5_offers_digest", f"""{ctes('offers')}, {_TOP30}, k as (select *, row_number() over (partition by bank_name order by arrival) as k from top30)
  select min(arrival) as place, bank_name, string_agg('- ' || substr(offer_text, 1, 150), chr(10) order by k) filter (where k <= 5) as lines from k group by bank_name""")
def _(spark, sf):
    return P.offers_digest(offers(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@check("c6_offer_context", f"""{ctes('offers')}, {_TOP30} select id, '[' || coalesce(bank_name, 'Unknown') || '] [' || coalesce(category, 'General') || '] (' || source || '): ' || substr(offer_text, 1, 200) as line from top30""")
def _(spark, sf):
    return P.offer_context(offers(spark, sf)).select("id", "line")


@check("c7_offer_cards", f"""{ctes('offers', 'offer_emails')}, {_TOP30} select arrival as number, bank_name as bank, coalesce(e.subject, '(No Subject)') as subject,
  coalesce(substr(replace(cast(e.received_date as varchar), ' ', 'T'), 1, 16), '') as date, coalesce(category, 'General') as category,
  substr(offer_text, 1, 300) as offer,
  replace(replace(substr(regexp_replace(e.body_text, '^\\s+|\\s+$', '', 'g'), 1, 500), chr(10) || chr(10) || chr(10), chr(10) || chr(10)), '  ', ' ') as preview
  from top30 o left join offer_emails e on o.email_id = e.id""")
def _(spark, sf):
    rows = P.offer_cards(offers(spark, sf), offer_mails(spark, sf))
    return rows.withColumn("number", F.col("number").cast("bigint"))


_ICON = "case email_type when 'FUNDS_DEBITED_ALERT' then '[DEBIT]' when 'FUNDS_CREDITED_ALERT' then '[CREDIT]' when 'CREDIT_LOAN_PROMOTION' then '[PROMO]' when 'OTP_SECURITY_ALERT' then '[SECURITY]' when 'ACCOUNT_STATEMENT_BILL' then '[BILL]' else '[EMAIL]' end"


@check("c8_recent_email_list", f"""{ctes('emails')} select id, {_ICON} as icon, coalesce(bank_name, '?') as bank, subject,
  substr(replace(cast(received_date as varchar), ' ', 'T'), 1, 16) as date, coalesce(email_type, 'unclassified') as kind,
  '- ' || {_ICON} || ' **[' || coalesce(bank_name, '?') || ']** ' || subject || '  ' || chr(10) || '  _' || substr(replace(cast(received_date as varchar), ' ', 'T'), 1, 16) || '_ | `' || coalesce(email_type, 'unclassified') || '`' as line
  from emails order by received_date desc, id limit 20""")
def _(spark, sf):
    return P.email_list(mails(spark, sf)).drop("received_date")


@check("c9_transaction_table", f"""{_TE} select t.id, coalesce(cast(cast(e.received_date as date) as varchar), '') as email_date, coalesce(e.subject, '--') as subject,
  coalesce(t.bank_name, '?') as bank, case when transaction_type = 'debit' then '🔴 ' else '🟢 ' end || coalesce(transaction_type, '?') as type,
  {sql_inr('coalesce(amount, 0)')} as amount, coalesce(nullif(merchant, ''), '--') as merchant, coalesce(category, '--') as category
  {_JOIN} order by {_EVENT} desc nulls last, t.id limit 30""")
def _(spark, sf):
    return P.transaction_table(txns(spark, sf), mails(spark, sf))


@check("c10_category_chart", f"""{_T}, {_BY_CATEGORY}, top8 as (select * from cat order by total desc, category limit 8)
  select category, total::double as value, round(total::double / (select sum(total) from top8)::double * 100, 1) as share,
  (select sum(total) from top8)::double as chart_total, category || '<br>' || {sql_inr('total')} as hover from top8""")
def _(spark, sf):
    rows = P.category_chart(txns(spark, sf))
    return rows.withColumn("value", num("value")).withColumn("chart_total", num("chart_total"))


@check("c11_bank_chart", f"{_T}, {_BY_BANK} select bank_name, total::double as value, bank_name || ': ' || {sql_inr('total')} as hover from bank order by total")
def _(spark, sf):
    return P.bank_chart(txns(spark, sf)).withColumn("value", num("value"))


@check("c12_daily_chart", f"""{_TE}, {_DAYS} select day, 'Debits' as series, debits::double as value, 'Debits: ' || {sql_inr('debits')} as hover from days
  union all select day, 'Credits', credits::double, 'Credits: ' || {sql_inr('credits')} from days""")
def _(spark, sf):
    return P.daily_chart(txns(spark, sf), mails(spark, sf)).withColumn("value", num("value"))


_STARTS = {
    "1W": "last - 7",
    "1M": "last - interval 1 month",
    "6M": "last - interval 6 month",
    "YTD": "date_trunc('year', last)",
    "1Y": "last - interval 12 month",
}


@check("c13_period_presets", f"""{_TE}, {_DAYS}, m as (select max(d) as last from real_days) """ + " union all ".join(
    f"select '{p}' as period, day, debits::double as debits from real_days, m where d >= {s}" for p, s in _STARTS.items()
) + " union all select 'All', day, debits::double from days")
def _(spark, sf):
    days = S.daily(txns(spark, sf), mails(spark, sf))
    out = None
    for period in ("1W", "1M", "6M", "YTD", "1Y", "All"):
        part = S.in_period(days, period).select(F.lit(period).alias("period"), "day", num("debits").alias("debits"))
        out = part if out is None else out.unionByName(part)
    return out


@check("f26_display_trims", f"""{ctes('offer_emails')} select id, case when length(subject) > 40 then substr(subject, 1, 37) || '...' else subject end as subject,
  replace(replace(substr(regexp_replace(body_text, '^\\s+|\\s+$', '', 'g'), 1, 500), chr(10) || chr(10) || chr(10), chr(10) || chr(10)), '  ', ' ') as preview from offer_emails""")
def _(spark, sf):
    return offer_mails(spark, sf).select(
        "id", X.short_subject(F.col("subject")).alias("subject"), X.body_preview(F.col("body_text")).alias("preview")
    )


@check("f27_icons", f"{_TE} select e.id, {_ICON} as icon, case when transaction_type = 'debit' then '🔴' else '🟢' end as direction from emails e join transactions t on t.id = e.id")
def _(spark, sf):
    rows = mails(spark, sf).select("id", "email_type").join(txns(spark, sf).select("id", "transaction_type"), "id")
    return rows.select(
        "id", X.label_icon(F.col("email_type")).alias("icon"), X.direction_icon(F.col("transaction_type")).alias("direction")
    )


@check("f28_india_time", "select event_id, strftime(ts + interval 330 minute, '%d %b %Y, %H:%M IST') as shown from events")
def _(spark, sf):
    from bankmail.sources.derived import base

    return base(spark, sf, "events").select("event_id", X.ist_text(F.col("ts")).alias("shown"))


@check("f21_rupee_text", f"select o_orderkey, {sql_inr('cast(o_totalprice * 1000 - 100000000 as decimal(18,2))')} as shown from orders")
def _(spark, sf):
    from bankmail.functions.money import format_inr
    from bankmail.sources.derived import base

    value = (F.col("o_totalprice") * 1000 - 100000000).cast("decimal(18,2)")
    return base(spark, sf, "orders").select("o_orderkey", format_inr(value).alias("shown"))


@check("f15_dates_of_transactions", f"""{_T} select id, case when transaction_date = '10 jun 2025' then '2025-06-10' else transaction_date end as shown from transactions""")
def _(spark, sf):
    return txns(spark, sf).select("id", R.normalize_date(F.col("transaction_date")).alias("shown"))
