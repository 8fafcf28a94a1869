"""Numeric clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col


def clean_price(text: Column | str) -> Column:
    """First unsigned number of a price text such as ``$1,234.56``; NULL if there is none."""
    digits = F.regexp_extract(F.replace(col(text), F.lit(","), F.lit("")), r"[0-9]+\.?[0-9]*", 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def finite_number(value: Column | str, low: float = -1e10, high: float = 1e10) -> Column:
    """The value as a double when it parses and lies in ``low..high``, else NULL."""
    number = col(value).try_cast("double")
    return F.when(number.between(low, high) & ~F.isnan(number), number)
