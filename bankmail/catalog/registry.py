"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankmail import dims

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def num(c: str | Column) -> Column:
    """Money as DOUBLE: decimals of different precision compare equal after it."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def txt(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(text: str, words: list[str]) -> str:
    """SQL: one of the words is in the text."""
    return "(" + " or ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def sql_first(text: str, table: dict[str, list[str]], default: str) -> str:
    """SQL: name of the first list with a word in the text."""
    whens = " ".join(f"when {sql_any(text, words)} then {quoted(name)}" for name, words in table.items())
    return f"(case {whens} else {quoted(default)} end)"


def sql_label(text: str) -> str:
    """SQL: the rule label of a lower-cased text."""
    scores = [
        " + ".join(f"cast(contains({text}, {quoted(w)}) as int)" for w in words) for words in dims.LABEL_KEYWORDS.values()
    ]
    best = "greatest(" + ", ".join(scores) + ")"
    whens = " ".join(f"when ({s}) = {best} then {quoted(n)}" for n, s in zip(dims.LABEL_KEYWORDS, scores))
    return f"(case when {best} = 0 then 'OTHER' {whens} end)"


def sql_inr(x: str) -> str:
    """SQL: Indian grouping of a decimal below 10^12, pair by pair."""
    plain = f"cast(cast(abs({x}) as decimal(28,2)) as varchar)"
    whole, cents = f"split_part({plain}, '.', 1)", f"split_part({plain}, '.', 2)"
    n = f"length({whole})"
    groups = [f"case when {n} > {k} then substr({whole}, greatest({n} - {k + 1}, 1), least(2, {n} - {k})) || ',' else '' end" for k in (9, 7, 5, 3)]
    return f"(case when {x} < 0 then '-₹' else '₹' end || {' || '.join(groups)} || right({whole}, 3) || '.' || {cents})"


SQL_BANKS = "banks(pos, domain, bank) as (values " + ", ".join(
    f"({i}, {quoted(d)}, {quoted(b)})" for i, (d, b) in enumerate(dims.BANK_DOMAINS.items())
) + ")"


def sql_bank(domain: str) -> str:
    """SQL: bank of a sender domain, with `banks` in scope."""
    own = f"split_part(split_part({domain}, '.bank.in', 1), '.', -1)"
    return f"""coalesce((select bank from banks b where b.domain = {domain}),
      case when ends_with({domain}, '.bank.in') then upper(substr({own}, 1, 1)) || lower(substr({own}, 2)) || ' Bank' end,
      (select arg_min(bank, pos) from banks b where ends_with({domain}, '.' || b.domain)))"""
