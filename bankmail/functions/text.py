"""Text columns: addresses, clean bodies, dates as text, display trims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bankmail import dims
from bankmail.functions.once import map_of


def strip(text: Column) -> Column:
    """Drop whitespace of every kind at both ends (`trim` drops blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper, the rest lower ('my-bank' -> 'My-Bank')."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def sender_domain(sender: Column) -> Column:
    """Lower-cased domain after the first `@` that has one, '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(sender, F.lit("")), r"(?U)@([\w.-]+)", 1))


def bank_of_domain(
    domain: Column,
    banks: dict[str, str] | None = None,
    aliases: dict[str, str] | None = None,
) -> Column:
    """Bank of a sender domain, NULL for any other sender.

    An exact domain wins, then the `<bank>.bank.in` naming rule, then the first
    listed domain that the sender's domain is a subdomain of. The table is part of
    the expression, so the lookup stays inside the scan stage: no join, no shuffle.
    `aliases` renames results, e.g. {"Hdfc Bank": "HDFC"}.
    """
    banks = dims.BANK_DOMAINS if banks is None else banks
    exact = map_of(banks)
    suffix = F.coalesce(*[F.when(domain.endswith("." + d), b) for d, b in banks.items()])
    own_name = F.element_at(F.split(F.split(domain, r"\.bank\.in", 2)[0], r"\."), -1)
    bank = F.coalesce(
        F.try_element_at(exact, domain),
        F.when(F.endswith(domain, F.lit(".bank.in")), F.concat(title_case(own_name), F.lit(" Bank"))),
        suffix,
    )
    if aliases:
        bank = F.coalesce(F.try_element_at(map_of(aliases), bank), bank)
    return bank


def clean_text(text: Column, max_chars: int | None = None) -> Column:
    """One space between words, footer from 'This email/message is...' on dropped, capped."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    body = F.regexp_replace(flat, r"(?is)This (email|message) (is|was|has been).*\z", "")
    return body if max_chars is None else F.substr(body, F.lit(1), F.lit(max_chars))


def naive_timestamp(text: Column, convert_to: str | None = None) -> Column:
    """Mail date as TIMESTAMP_NTZ: the offset is dropped and the wall clock kept.

    With `convert_to` (a zone such as 'UTC') the offset is honoured instead.
    """
    if convert_to is None:
        return text.try_cast("timestamp_ntz")
    return F.convert_timezone(
        F.current_timezone(), F.lit(convert_to), text.try_cast("timestamp").cast("timestamp_ntz")
    )


def ntz(value) -> Column:
    """Literal wall-clock time from a datetime or text, whatever zone this process runs in."""
    return F.lit(str(value)).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """`2025-06-14T10:15:00`, with a fraction only where there is one."""
    return F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))


def ist_text(ts: Column) -> Column:
    """Shift UTC to India time and render as `14 Jun 2025, 15:45 IST`; 'Never' for NULL."""
    shifted = ts + F.expr("INTERVAL '05:30' HOUR TO MINUTE")
    return F.coalesce(F.date_format(shifted, "dd MMM yyyy, HH:mm 'IST'"), F.lit("Never"))


def short_subject(subject: Column) -> Column:
    """'--' when missing; over 40 characters, the first 37 and '...'."""
    s = F.coalesce(F.nullif(subject, F.lit("")), F.lit("--"))
    return F.when(F.length(s) > 40, F.concat(F.substr(s, F.lit(1), F.lit(37)), F.lit("..."))).otherwise(s)


def body_preview(body: Column) -> Column:
    """First 500 characters, with triple newlines and double blanks each replaced once over."""
    cut = F.substr(strip(body), F.lit(1), F.lit(500))
    return F.replace(F.replace(cut, F.lit("\n\n\n"), F.lit("\n\n")), F.lit("  "), F.lit(" "))


def label_icon(label: Column) -> Column:
    return F.coalesce(F.try_element_at(map_of(dims.LABEL_ICONS), label), F.lit(dims.DEFAULT_ICON))


def direction_icon(transaction_type: Column) -> Column:
    return F.when(transaction_type == "debit", F.lit("🔴")).otherwise(F.lit("🟢"))


def request_text(template: str, **parts: tuple[Column, int | None]) -> Column:
    """Fill `{name}` places of a template with columns, each cut to its length.

    `request_text("Subject: {subject}\\nBody: {body}", subject=(F.col("subject"), 200),
    body=(F.col("body_text"), 600))` gives the text to send to a model.
    """
    out = F.lit(template)
    for name, (value, length) in parts.items():
        value = F.coalesce(value, F.lit(""))
        if length is not None:
            value = F.substr(value, F.lit(1), F.lit(length))
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def stable_id(*keys: Column) -> Column:
    """32 hex digits of the SHA-256 of the keys: the same row gets the same id in every run."""
    parts = [F.coalesce(k.cast("string"), F.lit("\u0000")) for k in keys]
    return F.substr(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(1), F.lit(32))
