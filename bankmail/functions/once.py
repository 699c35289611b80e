"""Evaluate costly columns once, and whole constant tables in one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`withColumns`, with each column computed exactly once per row.

    Catalyst pushes filters through projections and repeats the column's expression in
    them; for a chain of regular expressions that doubles the work at every step. Here the
    columns come out of a one-row `inline`, which no filter is pushed through.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, for use inside array functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def array_of(values) -> Column:
    """Constant array."""
    return F.expr(f"array({', '.join(_literal(v) for v in values)})")


def map_of(table: dict) -> Column:
    """Constant map; a list as value becomes an array."""

    def value(v) -> str:
        return f"array({', '.join(map(_literal, v))})" if isinstance(v, list) else _literal(v)

    return F.expr(f"map({', '.join(f'{_literal(k)}, {value(v)}' for k, v in table.items())})")
