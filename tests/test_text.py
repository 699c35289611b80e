"""Addresses, cleaning, HTML, images, links, times."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bankmail.caps import PARITY
from bankmail.functions import html as H
from bankmail.functions import text as X
from test_rules import one


def test_banks(spark):
    domains = ["mail.hdfcbank.net", "sbicard.com", "a.b.rbl.bank", "notsbicard.com", "", "bank.in", "my-bank.bank.in", "x.hdfc.bank.in"]
    assert one(spark, domains, X.bank_of_domain) == ["HDFC", "SBI", "RBL", None, None, None, "My-Bank Bank", "Hdfc Bank"]
    assert one(spark, ["x.hdfc.bank.in"], lambda c: X.bank_of_domain(c, aliases={"Hdfc Bank": "HDFC"})) == ["HDFC"]


def test_domains(spark):
    senders = ["AMEX <a@AEXP.COM>", "plain", None, "a@b.c <d@e.f>"]
    assert one(spark, senders, X.sender_domain) == ["aexp.com", "", "", "b.c"]


def test_clean(spark):
    texts = ["a  b\t\nc ", "Hi. This  email\nwas sent to you", None, "x" * 10_001, "This message is yours"]
    assert one(spark, texts, X.clean_text) == ["a b c", "Hi. ", "", "x" * 10_001, ""]
    assert one(spark, texts[3:4], lambda c: X.clean_text(c, PARITY.body)) == ["x" * 10_000]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tThis email was.", max_size=80), min_size=1, max_size=10))
def test_cleaning_twice_is_cleaning_once(spark, texts):
    once = one(spark, texts, lambda c: F.trim(X.clean_text(c)))
    assert one(spark, once, lambda c: F.trim(X.clean_text(c))) == once


IMAGES = [
    ('<img src="http://a/1.png">', ["http://a/1.png"]),
    ("<IMG alt='x>y' SRC='http://a/2.png' width=50>", ["http://a/2.png"]),
    ('<img src=http://a/3.png width="1">', []),
    ('<img src="http://a/4.png" height="0"><img src="http://a/5.png" height="1px">', ["http://a/5.png"]),
    ('<img src="data:image/png;base64,AA">', []),
    ('<!-- <img src="http://a/6.png"> --><img data-src="http://a/7.png">', []),
    ('<img src="http://a/8.png?a=1&amp;b=2">', ["http://a/8.png?a=1&b=2"]),
    ('<script>var t = "<img src=\'http://a/9.png\'>";</script>', []),
    (None, []),
]


@pytest.mark.parametrize("html, want", IMAGES)
def test_images(spark, html, want):
    assert one(spark, [html], H.image_urls) == [want]


def test_links(spark):
    long149, long150 = "http://a/" + "x" * 140, "http://a/" + "x" * 141
    html = f'<a href="http://a/1">1</a><a href="/rel">r</a><a href="http://a/UNSUBSCRIBE">u</a><a href="http://a/1">again</a><a href="{long149}">l</a><a href="{long150}">too long</a><a>none</a>'
    assert one(spark, [html], lambda c: H.links(c, PARITY.links, PARITY.link_chars)) == [["http://a/1", long149]]
    assert one(spark, [html], H.links) == [["http://a/1", long149, long150]]
    four = "".join(f'<a href="http://a/{i}">x</a>' for i in range(4))
    assert one(spark, [four], lambda c: H.links(c, PARITY.links)) == [["http://a/0", "http://a/1", "http://a/2"]]


def test_html_text(spark):
    html = '<html><head><title>T &amp; U</title><style>p{}</style><script>var x="</p>";</script></head><body><!-- no --><p> One <b>two</b>&nbsp;</p>three</body></html>'
    assert one(spark, [html, None, ""], H.html_text) == ["T & U One two three", None, ""]


def test_ocr_needed(spark):
    image = '<img src="http://a/1.png">'
    rows = spark.createDataFrame([("x" * 49, image), ("x" * 50, image), ("x" * 49, ""), (None, image)], "b string, h string")
    assert [r[0] for r in rows.select(H.needs_ocr(F.col("b"), F.col("h"))).collect()] == [True, False, False, True]


def test_usable_images(spark):
    rows = [("image/png", 0, 50, 50), ("image/png", 999, 50, 50), ("image/png", 1000, 50, 50), ("image/png", 10_000_000, 50, 50),
            ("image/png", 10_000_001, 50, 50), ("text/html", 5000, 50, 50), ("image/png", 5000, 49, 50), (None, 5000, 50, 50)]
    df = spark.createDataFrame(rows, "t string, n long, w int, h int")
    ok = df.select(H.usable_image(F.col("t"), F.col("n"), F.col("w"), F.col("h"))).collect()
    assert [r[0] for r in ok] == [True, False, True, True, False, False, False, False]


def test_times(spark):
    shown = one(spark, ["2025-06-14T10:15:00+05:30", "junk", None], lambda c: X.iso_text(X.naive_timestamp(c)))
    assert shown == ["2025-06-14T10:15:00", None, None]
    assert one(spark, ["2025-06-14T10:15:00+05:30"], lambda c: X.iso_text(X.naive_timestamp(c, convert_to="UTC"))) == ["2025-06-14T04:45:00"]
    assert one(spark, ["2025-06-14T10:15:00", None], lambda c: X.ist_text(X.naive_timestamp(c))) == ["14 Jun 2025, 15:45 IST", "Never"]


def test_display(spark):
    assert one(spark, ["s" * 40, "s" * 41, "", None], X.short_subject) == ["s" * 40, "s" * 37 + "...", "--", "--"]
    assert one(spark, ["  a\n\n\n\nb   c "], X.body_preview) == ["a\n\n\nb  c"]


ESCAPED = ["http://a/?x=1&amp;y=2", "http://a/?x=1&#38;y=2", "http://a/?x=1&#x26;y=2", "http://a/&#X2F;b&#47c", "&amp;#38;&#38;lt;", "&#128;&#x1F600;&#0;&#xD800;&#99999999;", "a&b&&unknown;&lt;&gt;&quot;&apos;&#39;", "plain", "", "&", "&#;&#x;", "\u00e4&#228;"]


def test_escapes_are_decoded_once(spark):
    import html

    assert one(spark, ESCAPED, H.unescaped) == [html.unescape(t) for t in ESCAPED]
    assert one(spark, [f'<img src="{t}">' for t in ESCAPED[:4]], H.image_urls) == [[html.unescape(t)] for t in ESCAPED[:4]]
