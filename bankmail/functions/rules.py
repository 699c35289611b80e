"""Rules that label a mail and read a money movement out of its text.

Columns named `low` are lower-cased bodies: callers lower the text once in a select
of its own and pass that column to every rule. All rules are native expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bankmail import dims
from bankmail.functions.once import array_of, let, map_of


def _hit(text: Column, word: str, whole_words: bool = False) -> Column:
    if whole_words:
        return F.rlike(text, F.lit(rf"(?<!\w){re.escape(word)}(?!\w)"))
    return text.contains(word)


def _any(text: Column, words: list[str], whole_words: bool = False) -> Column:
    found = _hit(text, words[0], whole_words)
    for word in words[1:]:
        found = found | _hit(text, word, whole_words)
    return found


def _first_of(text: Column, table: dict[str, list[str]], default: str, whole_words: bool) -> Column:
    chain = None
    for name, words in table.items():
        hit = _any(text, words, whole_words)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(default)


def label(low: Column, whole_words: bool = False) -> Column:
    """Label with the most distinct keywords present; the earlier one on ties; OTHER on none.

    `low` is the lower-cased subject, a blank, and the lower-cased body.
    """
    n = len(dims.LABEL_KEYWORDS)
    names = list(dims.LABEL_KEYWORDS)
    codes = []
    for place, words in enumerate(dims.LABEL_KEYWORDS.values()):
        score = sum((_hit(low, w, whole_words).cast("int") for w in words[1:]), _hit(low, words[0], whole_words).cast("int"))
        codes.append(score * n + (n - 1 - place))
    # score and place in one number: the highest score wins, then the earliest place
    most = max(len(w) for w in dims.LABEL_KEYWORDS.values())
    by_code = [dims.OTHER_LABEL] * n + [names[n - 1 - c % n] for c in range(n, n * (most + 1))]
    return F.get(array_of(by_code), F.greatest(*codes))


def direction(low: Column, whole_words: bool = False) -> Column:
    """'debit' by a debit word, else 'credit' by a credit word, else NULL."""
    return F.when(_any(low, dims.DEBIT_WORDS, whole_words), F.lit("debit")).when(
        _any(low, dims.CREDIT_WORDS, whole_words), F.lit("credit")
    )


def payment_mode(low: Column, whole_words: bool = False) -> Column:
    return _first_of(low, {m: [w] for m, w in dims.PAYMENT_MODES.items()}, "Other", whole_words)


# Amount, card, merchant and date patterns, tried in this order.
AMOUNT_PATTERNS = [
    r"(?:₹|rs\.?|inr)\s*([\d,]+(?:\.\d{1,2})?)",
    r"([\d,]+(?:\.\d{1,2})?)\s*(?:₹|rs\.?|inr)",
    r"amount[:\s]*(?:₹|rs\.?|inr)?\s*([\d,]+(?:\.\d{1,2})?)",
]
CARD_PATTERN = r"(?:card|xx|ending)\s*(?:with|in|no\.?)?\s*(\d{4})"
MERCHANT_PATTERNS = [
    r"(?:at|to|from|merchant|towards)\s+([A-Za-z0-9\s&'-]+?)(?:\s+on|\s+via|\s+for|\.|\n)",
    r"(?:info|details?):\s*([A-Za-z0-9\s&'-]+?)(?:\s*$|\n)",
]
DATE_PATTERNS = [
    r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"(\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+\d{2,4})",
]

# The same with word edges and a leading digit asked for.
STRICT_AMOUNT_PATTERNS = [
    r"(?:₹|(?<!\w)rs\.?|(?<!\w)inr)\s*(\d[\d,]*(?:\.\d{1,2})?)",
    r"(?<![\w.,])(\d[\d,]*(?:\.\d{1,2})?)\s*(?:₹|(?:rs|inr)(?!\w))",
    r"(?<!\w)amount[:\s]*(?:₹|rs\.?|inr)?\s*(\d[\d,]*(?:\.\d{1,2})?)",
]
STRICT_CARD_PATTERN = r"(?:card|xx|ending|\*\*)\s*(?:with|in|no\.?)?\s*[x*]*(\d{4})(?!\d)"
STRICT_DATE_PATTERNS = [
    r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)",
    r"(?<!\d)(\d{1,2}[-/]\d{1,2}[-/](?:\d{4}|\d{2}))(?!\d)",
    r"(?<!\d)(\d{1,2}[-\s]+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-\s]+(?:\d{4}|\d{2}))(?!\d)",
]


def _extract(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parse_money(text: Column) -> Column:
    """Commas dropped, DECIMAL(18,2); NULL when it is no number."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def amount(low: Column, strict: bool = False) -> Column:
    """Amount of the first pattern whose first match parses. `strict` asks for word edges."""
    patterns = STRICT_AMOUNT_PATTERNS if strict else AMOUNT_PATTERNS
    return F.coalesce(*[parse_money(_extract(low, p)) for p in patterns])


def card_last4(low: Column, strict: bool = False) -> Column:
    return _extract(low, STRICT_CARD_PATTERN if strict else CARD_PATTERN)


def merchant(body: Column) -> Column:
    """First of the two forms whose stripped match has 4 to 49 characters."""
    from bankmail.functions.text import strip

    def gated(pattern: str) -> Column:
        name = strip(F.regexp_extract(body, "(?id)" + pattern, 1))
        return _extract(name, r"(?s)^(.{4,49})\z")

    return F.coalesce(*[gated(p) for p in MERCHANT_PATTERNS])


def date_token(low: Column, strict: bool = False) -> Column:
    patterns = STRICT_DATE_PATTERNS if strict else DATE_PATTERNS
    return F.coalesce(*[_extract(low, p) for p in patterns])


def normalize_date(token: Column, strict: bool = False) -> Column:
    """ISO date of a day-first numeric or month-name token; the token itself when it is none.

    Built from parts and one `try_cast`, so a bad token raises nothing inside a task.
    Two-digit years 69 to 99 belong to the 1900s.
    """
    from bankmail.functions.text import strip

    token = strip(token)
    year = r"(?:\d{4}|\d{2})"
    # one separator throughout; dashes go with short month names only
    forms = [
        rf"\d{{1,2}}/\d{{1,2}}/{year}",
        rf"\d{{1,2}}-\d{{1,2}}-{year}",
        rf"\d{{1,2}}\s+[a-z]+\s+{year}",
        rf"\d{{1,2}}-[a-z]{{3}}-{year}",
    ]
    months = {m[:3]: i for i, m in enumerate(dims.MONTHS, 1)} | {m: i for i, m in enumerate(dims.MONTHS, 1)}
    table = map_of({name: str(i) for name, i in months.items()})

    def built(p: Column) -> Column:
        short = F.length(p[2]) == 2
        century = F.when(short & (p[2] >= "69"), "19").when(short, "20").otherwise("")
        month = F.coalesce(F.try_element_at(table, p[1]), p[1])
        return F.concat(century, p[2], F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(p[0], 2, "0"))

    parts = F.split(F.lower(token), r"[-/\s]+")
    fits = F.rlike(F.lower(token), F.lit("^(?:" + "|".join(forms) + r")\z"))
    text = F.when(fits, let(parts, built))
    iso = F.when(~text.startswith("0000"), text).try_cast("date").cast("string")
    if strict:
        own = F.when(F.rlike(token, F.lit(r"^\d{4}-\d{2}-\d{2}\z")), token)
        iso = F.coalesce(own.try_cast("date").cast("string"), iso)
    return F.coalesce(iso, token)


def spending_category(low: Column, merchant_name: Column, whole_words: bool = False) -> Column:
    text = F.concat(low, F.lit(" "), F.coalesce(F.lower(merchant_name), F.lit("none")))
    return _first_of(text, dims.SPENDING_KEYWORDS, "Other", whole_words)


def offer_category(low: Column, whole_words: bool = False) -> Column:
    return _first_of(low, dims.OFFER_KEYWORDS, "General", whole_words)


def day_text(received: Column, text: Column) -> Column:
    """Day a movement counts for: the mail's day, else the first ten characters, else Unknown."""
    return F.coalesce(
        received.cast("date").cast("string"), F.substr(text, F.lit(1), F.lit(10)), F.lit("Unknown")
    )


def real_date(text: Column) -> Column:
    """DATE of text that starts with an ISO date, else NULL (`2025` alone is no date)."""
    head = F.substr(text, F.lit(1), F.lit(10))
    return F.when(F.rlike(head, F.lit(r"^\d{4}-\d{2}-\d{2}$")), head.try_cast("date"))
