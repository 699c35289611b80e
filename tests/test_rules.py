"""Golden rows: labels, extraction, dates, amounts, rupee text."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bankmail.functions import rules as R
from bankmail.functions import text as X
from bankmail.functions.money import format_inr
from bankmail.plans import extract as E

# (id, subject, body, label, direction, amount, card, merchant, token, mode, category)
GOLDEN = [
    ("C1", "A transfer reached you", "Rs. 75 /- was credited by upi to savings account XX6104 this morning, sent from rita@okbank.",
     "FUNDS_CREDITED_ALERT", "credit", "75", "6104", None, None, "UPI", "Transfer"),
    ("C2", "Your debit card was used", "INR 2,340.00 debited from A/c **7718 on 03-Feb-27. Info: BIGBASKET*PUNE. Balance left: INR 610.",
     "FUNDS_DEBITED_ALERT", "debit", "2340", None, None, None, "Other", "Grocery"),
    ("C3", "Money back", "The refund of \u20b91,205 for shoes bought at Ajio was credited today to Axis Bank Credit Card ending 5530",
     "FUNDS_CREDITED_ALERT", "credit", "1205", "5530", None, None, "Card", "Shopping"),
    ("T1", "", "Rs.312.40 debited from A/c XX2256 on 08-Mar-26. UPI Ref: 990011223344. Txn to CHAI POINT CAFE. Left: Rs.87",
     "FUNDS_DEBITED_ALERT", "debit", "312.40", "2256", "CHAI POINT CAFE", None, "UPI", "Food & Dining"),
    ("T2", "", "Kotak Credit Card XX1147 has been used for INR 6,499 at FLIPKART HOME on 21/09/2024",
     "OTHER", None, "6499", "1147", "FLIPKART HOME", "21/09/2024", "Card", "Shopping"),
    ("T3", "", "INR 58,000.00 credited to savings account XX9038 via NEFT by NORTH MILL LTD. Ref N2024A77",
     "FUNDS_CREDITED_ALERT", "credit", "58000", "9038", "savings account XX9038", None, "NEFT", "Transfer"),
]
LABEL_ONLY = [
    ("A pre-approved card waits", "The Sapphire credit card is yours: you are eligible without a single paper. Apply now and spend up to Rs. 80,000.", "CREDIT_LOAN_PROMOTION"),
    ("More room on your card", "The credit limit of the card that ends in 4410 was enhanced to Rs. 1,20,000.", "CREDIT_LIMIT_CARD_MANAGEMENT"),
    ("Fly more", "Upgrade to the Horizon credit card before Friday and 9000 bonus reward points are yours.", "CREDIT_LOAN_PROMOTION"),
    ("Good morning", "", "OTHER"),
]


def one(spark, values, expr, kind="string"):
    """Column `x` of the values through `expr`, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_golden_rows(spark):
    df = spark.createDataFrame([(g[0], g[1], g[2]) for g in GOLDEN], "id string, subject string, body_text string")
    low = F.lower("body_text")
    rows = df.select(
        "id", R.label(F.lower(F.concat_ws(" ", "subject", "body_text"))), R.direction(low), R.amount(low), R.card_last4(low),
        R.merchant(F.col("body_text")), R.date_token(low), R.payment_mode(low), R.spending_category(low, R.merchant(F.col("body_text"))),
    ).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    for g in GOLDEN:
        want = (g[3], g[4], Decimal(g[5]), *g[6:])
        assert got[g[0]] == want, g[0]


def test_labels(spark):
    df = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(LABEL_ONLY)], "id int, subject string, body_text string")
    got = {r.id: r.label for r in E.classify(df).select("id", "label").collect()}
    assert [got[i] for i in range(len(LABEL_ONLY))] == [x[2] for x in LABEL_ONLY]


def test_amount_edges(spark):
    texts = ["dear users, rs 99 paid", "paid rs 0 at shop.", "1,23,456.78 inr", "amount: 500", "₹1,2,3", "rs."]
    assert one(spark, texts, R.amount) == [None, 0, Decimal("123456.78"), 500, 123, None]
    assert one(spark, texts[:1], lambda c: R.amount(c, strict=True)) == [99]
    assert E.rule_transactions(
        spark.createDataFrame([(1, "HDFC", "Paid Rs 0 at Shop."), (2, "HDFC", None)], "id int, bank_name string, body_text string")
    ).count() == 0


@pytest.mark.parametrize(
    "token, want",
    [
        ("25-06-14", "2014-06-25"), ("31/02/2025", "31/02/2025"), ("10/06/202", "10/06/202"), ("10/06/69", "1969-06-10"),
        ("10/06/68", "2068-06-10"), ("10 june 2025", "2025-06-10"), ("10 sept 2025", "10 sept 2025"), ("10  jun  25", "2025-06-10"),
        ("12-Jun-25", "2025-06-12"), ("12-jun-2025", "2025-06-12"), ("1/2/2025", "2025-02-01"), ("10-06/2025", "10-06/2025"),
        ("12-June-25", "12-June-25"), ("00/01/2025", "00/01/2025"), (None, None),
    ],
)
def test_dates(spark, token, want):
    assert one(spark, [token], R.normalize_date) == [want]


def test_strict_dates(spark):
    texts = ["paid on 2025-06-14 at", "on 12-jun-25 for"]
    tokens = one(spark, texts, lambda c: R.date_token(c, strict=True))
    assert tokens == ["2025-06-14", "12-jun-25"]
    assert one(spark, tokens, lambda c: R.normalize_date(c, strict=True)) == ["2025-06-14", "2025-06-12"]
    assert one(spark, texts[:1], R.date_token) == ["25-06-14"]


RUPEES = [
    (0.125, "₹0.12"), (2.675, "₹2.67"), (999.0, "₹999.00"), (1000.0, "₹1,000.00"), (99999.5, "₹99,999.50"),
    (123456.78, "₹1,23,456.78"), (1234567890.12, "₹1,23,45,67,890.12"), (-1234.5, "-₹1,234.50"), (-0.001, "-₹0.00"),
]


def test_rupee_text(spark):
    assert one(spark, [r[0] for r in RUPEES], format_inr, "double") == [r[1] for r in RUPEES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(min_value=-10**13, max_value=10**13, places=2), min_size=1, max_size=30))
def test_rupee_text_strips_back(spark, values):
    shown = one(spark, values, format_inr, "decimal(18,2)")
    assert [Decimal(s.replace("₹", "").replace(",", "")) for s in shown] == values


def test_whole_words(spark):
    assert one(spark, ["your company residue", "pan card"], lambda c: R.label(c, whole_words=True)) == ["OTHER", "REGULATORY_KYC_NOTICE"]
    assert one(spark, ["your company residue"], R.label) == ["REGULATORY_KYC_NOTICE"]


def test_replies(spark):
    mails = spark.createDataFrame(
        [(i, "Debit Alert", "money moved", "SBI", "2025-01-02 03:04:05", "") for i in range(6)],
        "id int, subject string, body_text string, bank_name string, at string, body_html string",
    ).withColumn("received_date", X.naive_timestamp(F.col("at")))
    label = '{"thought_process": "x", "category": "FUNDS_DEBITED_ALERT", "bank_or_platform": "HDFC Bank", "amount_inr": "1,250"}'
    replies = spark.createDataFrame(
        [(0, label), (1, "```json\n" + label + "\n```"), (2, label[:40]), (3, '{"bank_or_platform": "X"}'), (4, '{"category": "WEATHER"}'), (5, None)],
        "email_id int, response_text string",
    )
    done = E.process(mails, label_replies=replies)
    assert {r.id: r.label for r in done.classified.collect()} == {
        0: "FUNDS_DEBITED_ALERT", 1: "FUNDS_DEBITED_ALERT", 2: "OTHER", 3: "OTHER", 4: "OTHER", 5: "OTHER"
    }
    txns = {r.email_id: r for r in done.transactions.collect()}
    assert set(txns) == {0, 1}
    assert (txns[0].bank_name, txns[0].amount, txns[0].merchant, txns[0].transaction_date, txns[0].raw_text) == (
        "HDFC Bank", Decimal("1250.00"), "Unknown", "2025-01-02T03:04:05", None
    )
    unchecked = E.process(mails, label_replies=replies, validate=False).classified
    assert {r.id: r.label for r in unchecked.collect()}[4] == "WEATHER"


def test_model_batches_retry_and_report(spark):
    asked = spark.range(4).select(F.col("id").alias("email_id"), F.lit("q").alias("request")).coalesce(1)

    class Flaky:
        calls = 0

        def __call__(self, texts):
            Flaky.calls += 1
            if Flaky.calls < 3:
                raise RuntimeError("busy")
            return ["a"] * len(texts)

    def broken(texts):
        raise RuntimeError("down")

    flaky = Flaky()
    assert [r.response_text for r in E.ask(asked, flaky).collect()] == ["a"] * 4
    assert {r.error for r in E.ask(asked, broken).collect()} == {"down"}


def test_poison_rows_lose_only_themselves(spark):
    asked = spark.range(100).select(F.col("id").alias("email_id"), F.col("id").cast("string").alias("request")).coalesce(1)

    def model(texts):
        if "13" in texts:
            raise RuntimeError("poison")
        return texts[:-1] if "77" in texts else texts

    rows = {r.email_id: r for r in E.ask(asked, model, retries=1).collect()}
    assert {k for k, r in rows.items() if r.error} == {13, 77} and all(r.response_text == str(k) for k, r in rows.items() if k not in (13, 77))


def test_repeated_replies_multiply_nothing(spark):
    mails = spark.createDataFrame([(1, "Debit", "nothing to read"), (2, "Offer", "cashback offer for every purchase")], "id int, subject string, body_text string")
    mails = mails.withColumns({"body_html": F.lit(""), "bank_name": F.lit("SBI"), "received_date": X.ntz("2025-01-02 03:04:05")})
    label = '{"category": "FUNDS_DEBITED_ALERT", "amount_inr": "%d"}'
    replies = spark.createDataFrame([(1, label % 7), (1, label % 7), (1, label % 9), (2, "Deal"), (2, "Deal")], "email_id int, response_text string")
    done = E.process(mails, label_replies=replies, offer_replies=replies)
    assert done.classified.count() == 2 and [r.amount for r in done.transactions.collect()] == [7] and done.offers.count() == 1


def test_offer_texts(spark):
    mails = spark.createDataFrame(
        [(1, "Offer", "Get 5% cashback on every order", "<a href='http://a/1'>x</a><a href='http://a/1'>y</a>"), (2, "Offer", "short offer", "")],
        "id int, subject string, body_text string, body_html string",
    ).withColumn("bank_name", F.lit("SBI")).withColumn("received_date", X.ntz("2025-06-14 10:15:00"))
    rules = E.process(mails).offers.collect()
    assert [r.offer_text for r in rules] == [
        "Get 5% cashback on every order\n\nValid From/Received: 2025-06-14T10:15:00\nLinks:\nhttp://a/1"
    ]
    replies = spark.createDataFrame([(1, " Fuel deal "), ], "email_id int, response_text string")
    model = E.process(mails, offer_replies=replies).offers.collect()
    assert model[0].offer_text.startswith("Fuel deal\n\nValid From") and model[0].category == "Fuel"
    none = spark.createDataFrame([(1, "no_offer")], "email_id int, response_text string")
    assert E.process(mails, offer_replies=none).offers.collect()[0].category == "Cashback"
