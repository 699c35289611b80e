"""Mail-shaped views over the star-schema test tables.

One SQL text per view serves Spark and DuckDB; `{ts}` and `{minutes}` are the two
places where the dialects differ. A view is a plain projection of its base table, so
its size grows with it and Catalyst prunes and pushes through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: number of tasks that tables for heavy work per row are dealt out to; unset, they are not moved.
REPARTITION = "spark.bankmail.repartition"

# view -> (base table, SQL with {base}, {ts}, {minutes})
_MESSAGE_ID = "concat('M', cast(o_orderkey - (case when o_orderkey % 50 = 7 then 1 else 0 end) as string))"
_SENDER = """case o_custkey % 7 when 0 then 'alerts@hdfcbank.net' when 1 then 'info@mail.sbicard.com'
    when 2 then 'no-reply@alerts.hdfc.bank.in' when 3 then 'x@kotak.com'
    when 4 then 'promo@shop.example.com' when 5 then 'AMEX <a@AEXP.COM>' else 'plainname' end"""
_SUBJECT = """case o_orderkey % 6 when 0 then 'Debit Alert' when 1 then 'Credit Alert'
    when 2 then 'Pre Approved loan offer' when 3 then 'Your OTP' when 4 then 'e-Statement' else 'Hello' end"""
# own wording; amount, card, date, merchant and mode vary from row to row
_PAID = "cast(cast(o_totalprice as decimal(18,2)) as string)"
_CARD = "cast(1000 + o_custkey % 9000 as string)"
_DAY = "concat(lpad(cast(1 + o_orderkey % 28 as string), 2, '0'), '/', lpad(cast(1 + o_custkey % 12 as string), 2, '0'), '/', cast(2019 + o_orderkey % 7 as string))"
_BODY = f"""case o_orderkey % 6
    when 0 then case o_custkey % 4
      when 0 then concat('A sum of Rs.', {_PAID}, ' was debited on ', {_DAY}, ' by upi from card XX', {_CARD}, '. It went to SWIGGY STORE. Thank you')
      when 1 then concat('Purchase of INR ', {_PAID}, ' at DMART KOTHRUD on ', {_DAY}, '. Debited from account XX', {_CARD})
      when 2 then concat('We debited ₹', {_PAID}, ' on ', {_DAY}, ' for an emi. Card ending ', {_CARD})
      else concat('Debit, amount: ', {_PAID}, ' by imps, info: UBER*TRIP. Account XX', {_CARD}) end
    when 1 then case o_custkey % 3
      when 0 then concat('INR ', {_PAID}, ' was credited by neft on ', {_DAY}, ' to savings XX', {_CARD}, '.')
      when 1 then concat('Refund of Rs. ', {_PAID}, ' from MYNTRA was credited. Card XX', {_CARD})
      else concat('Salary credited by rtgs: ', {_PAID}, ' INR, account XX', {_CARD}) end
    when 2 then 'Fuel up for less: 7% cashback at every pump with bonus points.'
    when 3 then concat('The otp for this login is ', cast(100000 + o_orderkey % 900000 as string))
    when 4 then 'The statement of this month is ready, bill due soon' else 'Hi' end"""
_HTML = """case o_orderkey % 6
    when 2 then concat('<p>Fuel for less</p><a href="http://h.example/o', cast(o_custkey % 40 as string),
      '">go</a><a href="http://h.example/Unsubscribe">u</a><a href="/rel">r</a><a href="http://h.example/o',
      cast(o_custkey % 40 as string), '">again</a><a href="http://h.example/terms">t</a>',
      '<img src="http://i.example/p', cast(o_orderkey % 40 as string), '.png" width="', cast(o_custkey % 3 as string), '">')
    when 5 then concat('<div>Hi</div><img src="http://i.example/b', cast(o_orderkey % 9 as string),
      '.png"><img src="http://i.example/dot.png" height="1">')
    else '' end"""
_ACCOUNT = "concat('user', cast(o_custkey % 3 as string), '@mail.example')"
_FOLDER = "case o_orderkey % 4 when 0 then 'INBOX' when 1 then '[Gmail]/Promotions' when 2 then 'Promotions' else 'Bulk Mail' end"

VIEWS: dict[str, tuple[str, str]] = {
    "emails": (
        "orders",
        f"""select o_orderkey as id, {_MESSAGE_ID} as message_id, {_SENDER} as sender,
  {_SUBJECT} as subject, {_BODY} as body_text, {_HTML} as body_html, o_orderdate as received_date,
  {_ACCOUNT} as account, {_FOLDER} as folder,
  case o_custkey % 5 when 0 then 'HDFC' when 1 then 'SBI' when 2 then 'Kotak' when 3 then 'AMEX' end as bank_name,
  case o_orderkey % 6 when 0 then 'FUNDS_DEBITED_ALERT' when 1 then 'FUNDS_CREDITED_ALERT'
    when 2 then 'CREDIT_LOAN_PROMOTION' when 3 then 'OTP_SECURITY_ALERT' when 4 then 'ACCOUNT_STATEMENT_BILL' end as email_type,
  o_orderkey % 6 = 5 as vision_needed
from {{base}}""",
    ),
    "raw_mail": (
        "orders",
        f"""select {_ACCOUNT} as account,
  case o_custkey % 3 when 0 then 'Gmail' when 1 then 'Outlook' else 'Fastmail' end as provider,
  {_FOLDER} as folder,
  case when o_orderkey % 10 = 3 then null else {_MESSAGE_ID} end as uid,
  case when o_orderkey % 70 = 9 then null else {_SENDER} end as sender,
  case when o_orderkey % 12 = 5 then '' when o_orderkey % 12 = 11 then null else {_SUBJECT} end as subject,
  case when o_orderkey % 12 = 5 then '  ' else {_BODY} end as text,
  {_HTML} as html,
  concat(substr(cast(o_orderdate as string), 1, 10), 'T10:', lpad(cast(o_orderkey % 60 as string), 2, '0'), ':00+05:30') as date,
  cast(o_orderkey % 3 as int) as n_attachments,
  o_orderkey as seq
from {{base}}""",
    ),
    "transactions": (
        "orders",
        """select o_orderkey as id,
  case when o_orderkey % 11 = 0 then null
    else o_orderkey + 100000000 * (case when o_orderkey % 13 = 0 then 1 else 0 end) end as email_id,
  case o_custkey % 5 when 0 then 'HDFC' when 1 then 'SBI' when 2 then 'Kotak' when 3 then 'AMEX' end as bank_name,
  case when o_orderkey % 17 = 0 then null else cast(o_totalprice as decimal(18,2)) end as amount,
  'INR' as currency,
  case o_orderstatus when 'F' then 'debit' when 'O' then 'credit' end as transaction_type,
  case o_orderkey % 6 when 0 then 'Shopping' when 1 then 'Travel' when 2 then 'EMI'
    when 3 then 'Other' when 4 then 'Transfer' end as category,
  case o_orderkey % 5 when 0 then 'Amazon' when 1 then 'Zomato' when 2 then '' end as merchant,
  case o_orderkey % 4 when 0 then '2025-06-14' when 1 then '10 jun 2025' when 2 then '10/06/202' end as transaction_date
from {base}""",
    ),
    "offers": (
        "documents",
        """select doc_id as id, doc_id as email_id, source as bank_name, text as offer_text,
  'email_body' as source, case when doc_id % 9 = 0 then null else lang end as category,
  {ts} '2025-01-01 00:00:00' + {minutes} as extracted_at
from {base}""",
    ),
    # mails an offer came from, keyed like `documents`
    "offer_emails": (
        "documents",
        """select doc_id as id, concat('About ', lang, ' ', source) as subject, text as body_text,
  concat(source, '@h.example') as sender, {ts} '2025-01-01 00:00:00' + {minutes} as received_date
from {base} where doc_id % 10 <> 4""",
    ),
    "sync_log": (
        "events",
        """select event_id as id, ts as sync_started, cast(floor(value) as bigint) as emails_fetched,
  event_type as folder,
  case when event_id % 10 = 0 then 'failed' when event_id % 7 = 0 then 'skipped' else 'success' end as status
from {base}""",
    ),
    "html_pages": (
        "pages",
        """select page_id, url, concat(replace(html, 'href="/', 'href="http://h.example/'),
  '<a href="http://h.example/unsubscribe">u</a><a href="http://h.example/The">d</a>',
  '<img src="http://i.example/', cast(page_id % 40 as string), '.png" width="',
  cast(page_id % 3 as string), '"><img src="http://i.example/b.png">',
  case when page_id % 5 = 0 then '<img src="data:image/png;base64,AA"><img src="http://i.example/c.png" width="10" height="1">' else '' end) as html
from {base}""",
    ),
    # text read from the images of the mails that need it: up to seven per mail
    "ocr_texts": (
        "lineitem",
        """select l_orderkey as email_id, cast(l_linenumber - 1 as int) as pos,
  case when l_partkey % 4 = 0 then 'short' when l_partkey % 4 = 1 then ''
    else concat('BANNER ', cast(l_partkey as string), ' ', repeat('save more ', cast(l_suppkey % 70 as int))) end as text
from {base}""",
    ),
    # replies of a classifying model, clean and broken
    "label_replies": (
        "orders",
        """select o_orderkey as email_id,
  case o_custkey % 8
    when 0 then concat('{"thought_process": "t", "category": "funds_debited_alert", "bank_or_platform": "HDFC Bank", "amount_inr": ', cast(cast(o_totalprice as decimal(18,2)) as string), '}')
    when 1 then concat('Sure: {"category": "FUNDS_CREDITED_ALERT", "bank_or_platform": "SBI", "amount_inr": "1,', cast(100 + o_custkey % 900 as string), '"} done')
    when 2 then '{"category": "CREDIT_LOAN_PROMOTION", "amount_inr": null}'
    when 3 then '{"bank_or_platform": "Kotak"}'
    when 4 then '{"category": "OTP_SECURITY_ALERT", '
    when 5 then '{"category": "WEATHER"}'
    when 6 then 'no idea' end as response_text
from {base}""",
    ),
    "txn_replies": (
        "orders",
        """select o_orderkey as email_id,
  case o_custkey % 5
    when 0 then concat('{"amount": ', cast(cast(o_totalprice as decimal(18,2)) as string), ', "transaction_type": "debit", "merchant": "Chai Point", "card_last4": "7718", "category": "Food & Dining", "transaction_date": "12-Jun-25", "payment_mode": "UPI"}')
    when 1 then 'Here: {"amount": "2,100.50", "merchant": null} ok'
    when 2 then '{"amount": null, "merchant": "X"}'
    when 3 then '{"amount": 0}' end as response_text
from {base}""",
    ),
    "images": (
        "part",
        """select p_partkey as image_id, concat('http://i.example/', cast(p_partkey as string), '.png') as url,
  case p_partkey % 4 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'text/html' end as content_type,
  cast(case p_partkey % 5 when 0 then 0 when 1 then 999 when 2 then 1000 when 3 then 10000000 else 10000001 end as bigint) as content_length,
  cast(40 + p_partkey % 21 as int) as width, cast(45 + p_partkey % 11 as int) as height
from {base}""",
    ),
}

_SPARK = {
    "ts": "timestamp_ntz",
    "minutes": "make_dt_interval(0, 0, cast(doc_id % 97 as int), 0)",
}
_DUCKDB = {"ts": "timestamp", "minutes": "interval '1' minute * (doc_id % 97)"}


def _fill(sql: str, **parts: str) -> str:
    for name, value in parts.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


def base(spark: SparkSession, sf_dir: str, table: str, costly: bool = False) -> DataFrame:
    """A test table; with `costly`, work that is heavy per row, the session may ask for more tasks."""
    scan = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    tasks = spark.conf.get(REPARTITION, None) if costly else None
    return scan.repartition(int(tasks)) if tasks else scan


def view(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """The named view as a DataFrame."""
    table, sql = VIEWS[name]
    alias = f"bankmail_{table}"
    base(spark, sf_dir, table, costly).createOrReplaceTempView(alias)
    return spark.sql(_fill(sql, base=alias, **_SPARK))


def ctes(*names: str) -> str:
    """The named views as the head of a DuckDB statement: `with a as (...), b as (...)`."""
    parts = [f"{n} as ({_fill(VIEWS[n][1], base=VIEWS[n][0], **_DUCKDB)})" for n in names]
    return "with " + ",\n".join(parts)
