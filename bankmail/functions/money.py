"""Rupee amounts as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_inr(amount: Column) -> Column:
    """`₹1,23,456.78`: sign first, two decimals, groups of two above the last three digits."""
    size = F.abs(amount)
    plain = F.replace(F.format_number(size, 2), F.lit(","), F.lit(""))
    whole = F.substring_index(plain, ".", 1)
    grouped = F.concat(
        F.regexp_replace(F.left(whole, F.length(whole) - 3), r"(\d)(?=(\d\d)+$)", "$1,"),
        F.lit(","),
        F.right(whole, F.lit(3)),
    )
    sign = F.when(amount < 0, F.lit("-₹")).otherwise(F.lit("₹"))
    return F.concat(
        sign,
        F.when(F.length(whole) > 3, grouped).otherwise(whole),
        F.lit("."),
        F.substring_index(plain, ".", -1),
    )
