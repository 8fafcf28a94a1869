"""Items drawn from pages by patterns, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, strip


@dataclass(frozen=True)
class Target:
    """What to draw from a page: each match of the pattern ``selector`` is an item, ``fields`` name patterns inside it.

    A pattern is a Java regular expression; the value is its first group, or the match if it has none.
    """

    name: str
    url: str
    selector: str
    fields: Mapping[str, str] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict)


def plain_text(text: Column | str) -> Column:
    """The text without white space around it, the four common entities decoded."""
    text = strip(col(text))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _first(item: Column, pattern: Column) -> Column:
    # a pattern without a group gives the whole match
    return F.coalesce(F.get(F.regexp_extract_all(item, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(2)), F.lit(0)), F.lit(""))


def extract_items(pages: DataFrame, targets: Sequence[Target], keys: Sequence[str], html: str = "html") -> DataFrame:
    """One row per item: keys, ``target``, ``pos`` (from 0 in page order) and the ``fields`` map.

    Items are found and cut up in the row of their page. A field's pattern has one group, its value; a target without
    fields gives ``text``, the item without its tags. A null page has no items.
    """

    def values(item: Column, fields: Mapping[str, str]) -> Column:
        if not fields:
            return F.create_map(F.lit("text"), plain_text(F.regexp_replace(item, "<[^>]*>", "")))
        return F.create_map(*[x for k, p in fields.items() for x in (F.lit(k), plain_text(_first(item, F.lit(p))))])

    def items_of(t: Target) -> Column:
        found = F.regexp_extract_all(F.col(html), F.lit(t.selector), F.lit(0))
        named = F.lit(t.name).alias("target")
        return F.transform(found, lambda m, i: F.struct(named, i.cast("bigint").alias("pos"), values(m, t.fields).alias("fields")))

    items = [items_of(t) for t in targets]
    each = pages.select(*keys, F.explode(F.concat(*items)).alias("__item"))
    return each.select(*keys, "__item.target", "__item.pos", "__item.fields")


def extract_by_url(pages: DataFrame, targets: DataFrame, keys: Sequence[str], html: str = "html", on: Sequence[str] = ("url",)) -> DataFrame:
    """``extract_items`` with the targets of each page's URL from a table (name, url, selector, fields).

    ``on`` names what a page shares with its targets: a URL that several pages have gives each of them all its targets,
    unless further columns of both tables tell them apart. Nulls are equal.
    """
    wanted = targets.select(
        F.col("name").alias("target"), F.col("selector").alias("__selector"), F.col("fields").alias("__fields"), *[F.col(c).alias(f"__on_{c}") for c in on]
    )
    joined = pages.join(wanted, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]))
    found = joined.select(*keys, "target", "__fields", F.posexplode(F.regexp_extract_all(html, F.col("__selector"), F.lit(0))).alias("pos", "__item"))
    text = F.create_map(F.lit("text"), plain_text(F.regexp_replace("__item", "<[^>]*>", "")))
    named = F.transform_values("__fields", lambda _, p: plain_text(_first(F.col("__item"), p)))
    fields = F.when(F.size("__fields") > 0, named).otherwise(text)
    return found.select(*keys, "target", F.col("pos").cast("bigint").alias("pos"), fields.alias("fields"))
