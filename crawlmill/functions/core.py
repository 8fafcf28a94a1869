"""Small building blocks shared by the other expression modules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One text per pattern, valid for both Java regular expressions and RE2.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"  # what str.split() treats as white space, inside [...]
WORDCHAR = r"\p{L}\p{N}_"  # Unicode \w, inside [...]
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

FINDING = "struct<field:string,rule_type:string,message:string,value:string>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used several times inside array lambdas would otherwise be evaluated again
    for every element; binding it to a lambda variable keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_to(x: Column | str, digits: int) -> Column:
    """Round half up on the decimal form, as a double; NULL for NaN and infinities.

    Doubles from 1e15 on have no digits that rounding could drop, and may not fit the decimal: they stay as they are.
    """
    value = col(x).cast("double")
    whole = (F.abs(value) >= 1e15) & (F.abs(value) < float("inf"))
    return F.when(whole, value).otherwise(F.round(col(x).try_cast("decimal(38,10)"), digits).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def match_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def finding(condition: Column, field, rule_type: str, message, value: Column | None = None) -> Column:
    """A finding struct where ``condition`` holds, else NULL."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    shown = F.lit(None) if value is None else value
    row = F.struct(
        as_col(field).alias("field"),
        F.lit(rule_type).alias("rule_type"),
        as_col(message).alias("message"),
        shown.cast("string").alias("value"),
    )
    return F.when(F.coalesce(condition, F.lit(False)), row)


def findings(items: Iterable[Column]) -> Column:
    """All non-NULL findings in the given order."""
    items = list(items)
    if not items:
        return F.array().cast(f"array<{FINDING}>")
    return F.array_compact(F.array(*items))


def messages(pairs: Iterable[tuple[Column, Column | str]]) -> Column:
    """The messages whose condition holds, in the given order."""
    rows = [
        F.when(F.coalesce(cond, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for cond, m in pairs
    ]
    return F.array_compact(F.array(*rows))


def blank(x: Column) -> Column:
    """NULL, empty or only white space."""
    return x.isNull() | ~F.coalesce(x.rlike(f"[^{SPACE}]"), F.lit(False))


def strip(x: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")
