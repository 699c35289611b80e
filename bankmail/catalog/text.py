"""Queries: column functions, rules and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankmail import dims
from bankmail.caps import PARITY
from bankmail.catalog.registry import check, num, quoted, sql_any, sql_first, sql_label, txt
from bankmail.functions import html as H
from bankmail.functions import rules as R
from bankmail.functions import text as X
from bankmail.functions.once import once
from bankmail.plans import extract as E
from bankmail.sources.derived import base, ctes, view


def mails(spark, sf):
    """Mails with the lower-cased body at hand."""
    return view(spark, sf, "emails", costly=True).withColumn("low", F.lower("body_text"))


def process(spark, sf, **kw):
    return E.process(view(spark, sf, "emails", costly=True), caps=PARITY, **kw)


_E = ctes("emails")
_MODES = {m: [w] for m, w in dims.PAYMENT_MODES.items()}
_DIRECTION = f"case when {sql_any('low', dims.DEBIT_WORDS)} then 'debit' when {sql_any('low', dims.CREDIT_WORDS)} then 'credit' end"


def _re(pattern: str) -> str:
    return f"nullif(regexp_extract(low, {quoted(pattern)}, 1), '')"


_AMOUNT = "coalesce(" + ", ".join(f"try_cast(replace({_re(p)}, ',', '') as decimal(18,2))" for p in R.AMOUNT_PATTERNS) + ")"
_CARD = _re(R.CARD_PATTERN)
_TOKEN = "coalesce(" + ", ".join(_re(p) for p in R.DATE_PATTERNS) + ")"


def _merchant(pattern: str) -> str:
    name = f"trim(regexp_extract(body_text, {quoted(pattern)}, 1, 'i'))"
    return f"case when length({name}) between 4 and 49 then {name} end"


_MERCHANT = "coalesce(" + ", ".join(_merchant(p) for p in R.MERCHANT_PATTERNS) + ")"
_DATE = "coalesce(cast(try_strptime(token, ['%d/%m/%Y', '%d/%m/%y', '%d-%m-%Y', '%d-%m-%y', '%d %b %Y'])::date as varchar), token)"
_CATEGORY = sql_first("(low || ' ' || coalesce(lower(merchant), 'none'))", dims.SPENDING_KEYWORDS, "Other")

# rule extraction, step by step
_STEPS = f"""{_E},
low as (select *, lower(body_text) as low, lower(subject || ' ' || body_text) as whole from emails),
parts as (select *, {_DIRECTION} as direction, {_AMOUNT} as amount, {_MERCHANT} as merchant, {_CARD} as card_last4, {_TOKEN} as token from low),
rules as (select *, {_CATEGORY} as category, {_DATE} as rule_date, {sql_first('low', _MODES, 'Other')} as payment_mode,
  direction is not null and amount <> 0 as by_rule from parts),
labels as (select *, {sql_label('whole')} as rule_label from rules)"""


@check("f1_sender_domain", rf"{ctes('raw_mail')} select seq, lower(regexp_extract(coalesce(sender, ''), '@([\w.-]+)', 1)) as domain from raw_mail")
def _(spark, sf):
    return view(spark, sf, "raw_mail").select("seq", X.sender_domain(F.col("sender")).alias("domain"))


@check("f2_bank_in_names", r"""select c_custkey, upper(substr(w, 1, 1)) || lower(substr(w, 2)) || ' Bank' as bank
  from (select c_custkey, c_mktsegment as w from customer)""")
def _(spark, sf):
    domain = F.concat(F.lit("alerts."), F.lower("c_mktsegment"), F.lit(".bank.in"))
    return base(spark, sf, "customer").select("c_custkey", X.bank_of_domain(domain).alias("bank"))


_CLEAN = r"""regexp_replace(trim(regexp_replace(text, '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')),
  '(?is)This (email|message) (is|was|has been).*$', '')"""


@check("f3_clean_text", f"select doc_id, substr({_CLEAN}, 1, 10000) as body from documents")
def _(spark, sf):
    return base(spark, sf, "documents", costly=True).select("doc_id", X.clean_text(F.col("text"), PARITY.body).alias("body"))


@check("f3_clean_text_uncapped", f"select doc_id, {_CLEAN} as body from documents")
def _(spark, sf):
    return base(spark, sf, "documents", costly=True).select("doc_id", X.clean_text(F.col("text"), max_chars=None).alias("body"))


_UNESCAPED = "p"
for _escape, _char in {
    "&middot;": "·", "&copy;": "©", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&",
}.items():
    _UNESCAPED = f"replace({_UNESCAPED}, {quoted(_escape)}, {quoted(_char)})"
# an ampersand may lack its semicolon
_UNESCAPED = f"regexp_replace({_UNESCAPED}, '&amp;?', '&', 'g')"
_HTML_TEXT = rf"""{ctes('html_pages')}, t as (select page_id, string_split_regex(regexp_replace(regexp_replace(html,
    '(?is)<(script|style)\b.*?</(script|style)>', chr(1), 'g'), '<[^>]*>', chr(1), 'g'), chr(1)) as parts from html_pages),
  u as (select page_id, list_transform(parts, lambda p: {_UNESCAPED}) as parts from t)
  select page_id, array_to_string(list_filter(list_transform(parts,
    lambda p: regexp_replace(p, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')), lambda p: p <> ''), ' ') as body from u"""


@check("f4_html_text", _HTML_TEXT)
def _(spark, sf):
    return view(spark, sf, "html_pages", costly=True).select("page_id", H.html_text(F.col("html")).alias("body"))


_PAGES = ctes("html_pages")


@check("f5_image_urls", rf"""{_PAGES} select page_id, array_to_string(list_transform(list_filter(regexp_extract_all(html, '<img [^>]*>'),
  lambda t: regexp_matches(t, 'src="http') and not regexp_matches(t, '(width|height)="[01]"')),
  lambda t: regexp_extract(t, 'src="([^"]*)"', 1)), ' ') as images from html_pages""")
def _(spark, sf):
    return view(spark, sf, "html_pages", costly=True).select("page_id", F.array_join(H.image_urls(F.col("html")), " ").alias("images"))


_ALL_LINKS = r"""list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: starts_with(h, 'http') and not contains(lower(h), 'unsubscribe') and length(h) < 150)"""


@check("f6_first_links", f"""{_PAGES}, l as (select page_id, {_ALL_LINKS} as l from html_pages)
  select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], ' ') as links from l""")
def _(spark, sf):
    return view(spark, sf, "html_pages", costly=True).select("page_id", F.array_join(H.links(F.col("html"), PARITY.links, PARITY.link_chars), " ").alias("links"))


@check("u3_distinct_links_in_order", f"""{_PAGES}, l as (select page_id, {_ALL_LINKS} as l from html_pages)
  select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as links from l""")
def _(spark, sf):
    return view(spark, sf, "html_pages", costly=True).select("page_id", F.array_join(H.links(F.col("html"), max_chars=PARITY.link_chars), " ").alias("links"))


@check("w3_first_images", rf"""{_PAGES} select page_id, array_to_string(list_transform(list_filter(regexp_extract_all(html, '<img [^>]*>'),
  lambda t: regexp_matches(t, 'src="http') and not regexp_matches(t, '(width|height)="[01]"'))[1:5],
  lambda t: regexp_extract(t, 'src="([^"]*)"', 1)), ' ') as images from html_pages""")
def _(spark, sf):
    images = F.slice(H.image_urls(F.col("html")), 1, dims.MAX_IMAGES)
    return view(spark, sf, "html_pages", costly=True).select("page_id", F.array_join(images, " ").alias("images"))


@check("f7_wall_clock", f"{ctes('raw_mail')} select seq, replace(substr(date, 1, 19), 'T', ' ') as received from raw_mail")
def _(spark, sf):
    return view(spark, sf, "raw_mail").select("seq", txt(X.naive_timestamp(F.col("date"))).alias("received"))


@check("f8_rule_label", f"{_STEPS} select id, rule_label as label from labels")
def _(spark, sf):
    return E.classify(view(spark, sf, "emails", costly=True)).select("id", "label")


@check("f8_rule_label_of_documents", f"select doc_id, {sql_label('low')} as label from (select doc_id, lower(text) as low from documents)")
def _(spark, sf):
    rows = base(spark, sf, "documents", costly=True).select("doc_id", F.lower("text").alias("low"))
    return rows.select("doc_id", R.label(F.col("low")).alias("label"))


@check("f9_direction", f"{_STEPS} select id, direction from labels")
def _(spark, sf):
    return mails(spark, sf).select("id", R.direction(F.col("low")).alias("direction"))


@check("f10_payment_mode", f"{_STEPS} select id, payment_mode as mode from labels")
def _(spark, sf):
    return mails(spark, sf).select("id", R.payment_mode(F.col("low")).alias("mode"))


@check("f11_amount", f"{_STEPS} select id, amount::double as amount from labels")
def _(spark, sf):
    return mails(spark, sf).select("id", num(R.amount(F.col("low"))).alias("amount"))


@check("f12_card_digits", f"{_STEPS} select id, card_last4 as card from labels")
def _(spark, sf):
    return mails(spark, sf).select("id", R.card_last4(F.col("low")).alias("card"))


@check("f13_merchant", f"{_STEPS} select id, merchant from labels")
def _(spark, sf):
    return mails(spark, sf).select("id", R.merchant(F.col("body_text")).alias("merchant"))


@check("f13_merchant_of_documents", f"select doc_id, {_MERCHANT} as merchant from (select doc_id, {_CLEAN} as body_text from documents)")
def _(spark, sf):
    rows = base(spark, sf, "documents", costly=True).select("doc_id", X.clean_text(F.col("text"), None).alias("body_text"))
    return rows.select("doc_id", R.merchant(F.col("body_text")).alias("merchant"))


@check("f14_date_token", f"{_STEPS} select id, token from labels")
def _(spark, sf):
    return mails(spark, sf).select("id", R.date_token(F.col("low")).alias("token"))


@check("f15_normalized_date", f"{_STEPS} select id, rule_date from labels")
def _(spark, sf):
    rows = once(mails(spark, sf), token=R.date_token(F.col("low")))
    return rows.select("id", R.normalize_date(F.col("token")).alias("rule_date"))


@check("f16_spending_category", f"{_STEPS} select id, category from labels")
def _(spark, sf):
    rows = once(mails(spark, sf), merchant=R.merchant(F.col("body_text")))
    return rows.select("id", R.spending_category(F.col("low"), F.col("merchant")).alias("category"))


@check("f16_spending_category_of_documents", f"""select doc_id, {sql_first("(low || ' none')", dims.SPENDING_KEYWORDS, 'Other')} as category
  from (select doc_id, lower(text) as low from documents)""")
def _(spark, sf):
    rows = base(spark, sf, "documents", costly=True).select("doc_id", F.lower("text").alias("low"))
    return rows.select("doc_id", R.spending_category(F.col("low"), F.lit(None).cast("string")).alias("category"))


@check("f17_offer_category", f"select doc_id, {sql_first('low', dims.OFFER_KEYWORDS, 'General')} as category from (select doc_id, lower(text) as low from documents)")
def _(spark, sf):
    rows = base(spark, sf, "documents", costly=True).select("doc_id", F.lower("text").alias("low"))
    return rows.select("doc_id", R.offer_category(F.col("low")).alias("category"))


@check("f18_rule_record", f"""{_STEPS} select id as email_id, bank_name, amount::double as amount, direction as transaction_type, merchant, card_last4,
  category, rule_date as transaction_date, payment_mode, substr(body_text, 1, 500) as raw_text from labels where by_rule""")
def _(spark, sf):
    return E.rule_transactions(view(spark, sf, "emails", costly=True), max_raw=PARITY.raw).withColumn("amount", num("amount"))


_RULES_ONLY = """final as (select *, rule_label as label from labels),
txns as (select id as email_id, bank_name, amount, case when label = 'FUNDS_CREDITED_ALERT' then 'credit' else 'debit' end as transaction_type,
  merchant, card_last4, category, coalesce(rule_date, replace(cast(received_date as varchar), ' ', 'T')) as transaction_date, payment_mode
  from final where label in ('FUNDS_CREDITED_ALERT', 'FUNDS_DEBITED_ALERT') and by_rule)"""


@check("f19_final_transaction", f"{_STEPS}, {_RULES_ONLY} select email_id, bank_name, amount::double as amount, transaction_type, merchant, card_last4, category, transaction_date, payment_mode from txns")
def _(spark, sf):
    return process(spark, sf).transactions.select(
        "email_id", "bank_name", num("amount").alias("amount"), "transaction_type", "merchant",
        "card_last4", "category", "transaction_date", "payment_mode",
    )


_OFFERS = rf"""promo as (select *, {_ALL_LINKS.replace('html', 'body_html')} as l from labels where rule_label = 'CREDIT_LOAN_PROMOTION' and length(body_text) >= 20),
offer_rows as (select id as email_id, bank_name, substr(body_text, 1, 1000) || chr(10) || chr(10) || 'Valid From/Received: ' || replace(cast(received_date as varchar), ' ', 'T')
  || case when len(l) > 0 then chr(10) || 'Links:' || chr(10) || array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], chr(10)) else '' end as offer_text,
  {sql_first('low', dims.OFFER_KEYWORDS, 'General')} as category from promo)"""


@check("f20_offer_record", f"{_STEPS}, {_OFFERS} select email_id, bank_name, offer_text, category from offer_rows")
def _(spark, sf):
    return process(spark, sf).offers.select("email_id", "bank_name", "offer_text", "category")


@check("p10_routed_by_label", f"""{_STEPS} select id, case when rule_label in ('FUNDS_CREDITED_ALERT', 'FUNDS_DEBITED_ALERT') then 'transaction'
  when rule_label = 'CREDIT_LOAN_PROMOTION' then 'offer' end as route from labels""")
def _(spark, sf):
    label = F.col("label")
    route = F.when(label.isin(dims.CREDIT_LABEL, dims.DEBIT_LABEL), "transaction").when(label == dims.PROMOTION_LABEL, "offer")
    return E.classify(view(spark, sf, "emails", costly=True)).select("id", route.alias("route"))


@check("p11_loaded_rows", f"{_STEPS}, {_RULES_ONLY}, {_OFFERS} select email_id, 'transaction' as kind from txns where amount <> 0 union all select email_id, 'offer' from offer_rows where offer_text <> ''")
def _(spark, sf):
    done = process(spark, sf)
    return done.transactions.select("email_id", F.lit("transaction").alias("kind")).unionByName(
        done.offers.select("email_id", F.lit("offer").alias("kind"))
    )


_LABEL_REPLIES = """replied as (select email_id, json_extract_string(j, '$.bank_or_platform') as reply_bank,
    json_extract_string(j, '$.amount_inr') as reply_amount, upper(json_extract_string(j, '$.category')) as reply_label
  from (select email_id, case when json_valid(b) then b::json end as j from (select email_id, regexp_extract(response_text, '(?s)\\{.*\\}') as b from label_replies))
  where json_extract_string(j, '$.category') is not null)"""
_KNOWN = ", ".join(quoted(x) for x in [*dims.LABEL_KEYWORDS, dims.OTHER_LABEL])


@check("f22_parsed_label_replies", f"""{ctes('label_replies')}, {_LABEL_REPLIES} select email_id, reply_label as label, reply_bank as bank_or_platform,
  try_cast(replace(reply_amount, ',', '') as decimal(18,2))::double as amount from replied""")
def _(spark, sf):
    rows = E.parsed_label_replies(view(spark, sf, "label_replies"), validate=False)
    return rows.select("email_id", "label", "bank_or_platform", num(R.parse_money(F.col("amount_inr"))).alias("amount"))


_TXN_REPLIES = """treplied as (select email_id, try_cast(replace(json_extract_string(j, '$.amount'), ',', '') as decimal(18,2)) as amount,
    json_extract_string(j, '$.merchant') as merchant, json_extract_string(j, '$.card_last4') as card_last4, json_extract_string(j, '$.category') as category,
    json_extract_string(j, '$.transaction_date') as transaction_date, json_extract_string(j, '$.payment_mode') as payment_mode
  from (select email_id, case when json_valid(b) then b::json end as j from (select email_id, regexp_extract(response_text, '(?s)\\{[^}]+\\}') as b from txn_replies))),
tgood as (select * from treplied where amount <> 0)"""


@check("f22_parsed_txn_replies", f"{ctes('txn_replies')}, {_TXN_REPLIES} select email_id, amount::double as amount, merchant, card_last4, category, transaction_date, payment_mode from tgood")
def _(spark, sf):
    rows = E.parsed_txn_replies(view(spark, sf, "txn_replies"))
    return rows.drop("transaction_type").withColumn("amount", num("amount"))


@check("f23_model_amounts", f"""{ctes('label_replies')}, {_LABEL_REPLIES}, a as (select email_id, try_cast(replace(reply_amount, ',', '') as decimal(18,2)) as a from replied)
  select email_id, a::double as amount from a where a > 0""")
def _(spark, sf):
    rows = E.parsed_label_replies(view(spark, sf, "label_replies"), validate=False)
    amount = R.parse_money(F.col("amount_inr"))
    return rows.select("email_id", num(amount).alias("amount")).filter(F.col("amount") > 0)


_MODEL = f"""{ctes('emails', 'label_replies', 'txn_replies')}, {_STEPS[len(_E) + 1:]},
{_LABEL_REPLIES}, {_TXN_REPLIES},
final as (select labels.*, coalesce(reply_label, rule_label) as label, reply_bank, reply_amount from labels
  left join (select * from replied where reply_label in ({_KNOWN})) r on r.email_id = labels.id),
joined as (select f.*, t.email_id is not null as has_reply, t.amount as t_amount, t.merchant as t_merchant, t.card_last4 as t_card,
    t.category as t_category, t.transaction_date as t_date, t.payment_mode as t_mode,
    try_cast(replace(reply_amount, ',', '') as decimal(18,2)) as given
  from final f left join tgood t on t.email_id = f.id where label in ('FUNDS_CREDITED_ALERT', 'FUNDS_DEBITED_ALERT')),
txns as (select id as email_id, case when by_rule or has_reply then bank_name else coalesce(reply_bank, bank_name) end as bank_name,
  case when by_rule then amount when has_reply then t_amount when given > 0 then given end as amount,
  case when label = 'FUNDS_CREDITED_ALERT' then 'credit' else 'debit' end as transaction_type,
  case when by_rule then merchant when has_reply then t_merchant else 'Unknown' end as merchant,
  case when by_rule then card_last4 when has_reply then t_card end as card_last4,
  case when by_rule then category when has_reply then t_category else 'Other' end as category,
  coalesce(nullif(case when by_rule then rule_date when has_reply then t_date end, ''), replace(cast(received_date as varchar), ' ', 'T')) as transaction_date,
  case when by_rule then payment_mode when has_reply then t_mode else 'Other' end as payment_mode from joined)"""


def with_models(spark, sf):
    return process(
        spark, sf, label_replies=view(spark, sf, "label_replies"), txn_replies=view(spark, sf, "txn_replies")
    )


@check("g1_labels_with_model_replies", f"{_MODEL} select id, label from final")
def _(spark, sf):
    return with_models(spark, sf).classified.select("id", "label")


@check("g2_transactions_with_model_replies", f"{_MODEL} select email_id, bank_name, amount::double as amount, transaction_type, merchant, card_last4, category, transaction_date, payment_mode from txns where amount is not null")
def _(spark, sf):
    return with_models(spark, sf).transactions.select(
        "email_id", "bank_name", num("amount").alias("amount"), "transaction_type", "merchant",
        "card_last4", "category", "transaction_date", "payment_mode",
    )


@check("g2_mails_to_ask_about", f"{_MODEL} select id from final where label in ('FUNDS_CREDITED_ALERT', 'FUNDS_DEBITED_ALERT') and not coalesce(by_rule, false)")
def _(spark, sf):
    return E.unread(with_models(spark, sf).classified).select("id")


@check("g4_batch_model_with_retries", f"""{_STEPS} select id, case when contains(low, 'otp') or contains(lower(subject), 'otp') then 'OTP_SECURITY_ALERT' else rule_label end as label from labels""")
def _(spark, sf):
    # a local function travels to the executors with its code, wherever this package is installed
    def model(texts: list[str]) -> list[str]:
        return ['{"category": "OTP_SECURITY_ALERT"}' if "otp" in t.lower() else "none" for t in texts]

    em = view(spark, sf, "emails", costly=True)
    request = X.request_text("Subject: {subject}\nBody: {body}", subject=(F.col("subject"), 200), body=(F.col("body_text"), 600))
    replies = E.ask(em.select(F.col("id").alias("email_id"), request.alias("request")), model)
    return E.classify(em, replies).select("id", "label")


@check("f29_request_texts", f"{_E} select id, 'Subject: ' || substr(subject, 1, 200) || chr(10) || 'Body: ' || substr(body_text, 1, 600) as request from emails")
def _(spark, sf):
    request = X.request_text("Subject: {subject}\nBody: {body}", subject=(F.col("subject"), 200), body=(F.col("body_text"), 600))
    return view(spark, sf, "emails", costly=True).select("id", request.alias("request"))


@check("a11_batch_summary", f"{_STEPS}, {_RULES_ONLY}, {_OFFERS} select (select count(*) from labels) as classified, (select count(*) from txns) as transactions_extracted, (select count(*) from offer_rows) as offers_extracted")
def _(spark, sf):
    return process(spark, sf).summary()


@check("c1_classified_and_loaded", f"""{_STEPS}, {_RULES_ONLY}, {_OFFERS} select rule_label as label, count(*) as mails, count(t.email_id) as transactions, count(o.email_id) as offers,
  coalesce(sum(t.amount), 0)::double as amount from labels l left join txns t on t.email_id = l.id left join offer_rows o on o.email_id = l.id group by 1""")
def _(spark, sf):
    done = process(spark, sf)
    zero, none = F.lit(0), F.lit(0).cast("decimal(18,2)")
    rows = done.classified.select("id", "label", zero.alias("t"), zero.alias("o"), none.alias("amount"))
    t = done.transactions.select(
        F.col("email_id").alias("id"), F.lit(None).cast("string").alias("label"), F.lit(1).alias("t"), zero.alias("o"), "amount"
    )
    o = done.offers.select(
        F.col("email_id").alias("id"), F.lit(None).cast("string").alias("label"), zero.alias("t"), F.lit(1).alias("o"), none.alias("amount")
    )
    per_mail = rows.unionByName(t).unionByName(o).groupBy("id").agg(
        F.max("label").alias("label"), F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum("amount").alias("amount")
    )
    return per_mail.groupBy("label").agg(
        F.count(F.lit(1)).alias("mails"), F.sum("t").alias("transactions"), F.sum("o").alias("offers"), num(F.sum("amount")).alias("amount")
    )


@check("p9_new_mails_processed", f"{_STEPS} select id, rule_label as label from labels where received_date >= timestamp '1999-01-01'")
def _(spark, sf):
    em = view(spark, sf, "emails", costly=True)
    new = em.filter(F.col("received_date") >= X.ntz("1999-01-01 00:00:00")).select("id")
    return process(spark, sf, new_ids=new).classified.select("id", "label")
