"""Profile of JSON records whose keys differ from record to record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ratio, round_to
from ..session import cut_lineage
from .quality import DATE_PATTERN


def _fields(records: DataFrame, record: str) -> DataFrame:
    """``key, value`` of every field of every readable record."""
    parsed = records.select(F.try_parse_json(F.col(f"`{record}`")).alias("v"))
    fields = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.try_variant_get("v", "$", "map<string,variant>"))
    return parsed.select(F.explode(fields).alias("key", "value"))


def value_counts(records: DataFrame, record: str) -> DataFrame:
    """How often each value stands under each key: ``key, value`` and counts by kind, combined before the shuffle.

    ``value`` is the text form, by which values are told apart; null values have one row with ``value`` null.
    """
    kind = F.schema_of_variant("value")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    text = F.when(nested, F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    kept = _fields(records, record).select("key", F.when(kind != "VOID", text).alias("value"), kind.alias("kind"), number.alias("number"))
    return kept.groupBy("key", "value").agg(
        F.count_if(F.col("kind") != "VOID").alias("filled"),
        F.count_if(F.col("kind") == "BOOLEAN").alias("booleans"),
        F.count_if("number").alias("numbers"),
        F.count_if(F.col("kind") == "STRING").alias("texts"),
    )


def record_counts(records: DataFrame, record: str) -> DataFrame:
    """One row: ``records``, ``readable`` (JSON objects) and ``unreadable`` ones (null, no JSON, or no object)."""
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(f"`{record}`"))).startswith("OBJECT"), F.lit(False))
    return records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(readable).alias("readable"), F.count_if(~readable).alias("unreadable")
    )


def _totals(records: DataFrame, record: str) -> Column:
    """``record_counts`` as a scalar struct."""
    return record_counts(records, record).select(F.struct("*")).scalar()


def profile_records(records: DataFrame, record: str) -> DataFrame:
    """One row per key of JSON objects: label, nulls, different values, and range, mean and sample deviation by label.

    A key that a readable record does not have counts as null there, like an explicit null; unreadable records count
    only in ``unreadable``, which every row repeats. The label is boolean, numeric, string, date (more than half of its texts
    look like dates), mixed, or unknown without values. Numbers have ``min_value``, ``max_value``, ``mean`` and ``std`` (0 for
    one value); strings have ``min_text`` and ``max_text``. Of a key that stands twice in a record one value counts, the last.

    Records are parsed once and exploded; counts per key and value are summed in each task before they are shuffled, so
    neither a frequent value nor a key in every record fills one task. The deviation is summed around the mean in a
    second step over these counts. No readable record: an empty result.
    """
    counts = cut_lineage(value_counts(records, record))
    total = _totals(records, record)
    seen, value, x = F.col("filled") > 0, F.col("value"), F.col("value").try_cast("double")
    measured = counts.withColumn("x", F.when(F.col("numbers") > 0, x))
    amount = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    keys = measured.groupBy("key").agg(
        amount("filled").alias("filled"),
        amount("booleans").alias("booleans"),
        amount("numbers").alias("numbers"),
        amount("texts").alias("texts"),
        amount(F.when(value.rlike(DATE_PATTERN), F.col("texts"))).alias("dates"),
        F.count_if(seen).alias("unique_count"),
        F.min(F.when(seen, value)).alias("least"),
        F.max(F.when(seen, value)).alias("most"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
        (F.sum(F.col("x") * F.col("numbers")) / F.sum(F.when(F.col("x").isNotNull(), F.col("numbers")))).alias("mean"),
    )
    keys = cut_lineage(keys)
    spread = measured.join(keys.select("key", F.col("mean").alias("centre")), "key").groupBy("key").agg(
        F.sum(F.col("numbers") * F.pow(F.col("x") - F.col("centre"), 2)).alias("squares")
    )
    all_are = lambda c: F.col(c) == F.col("filled")
    label = (
        F.when(F.col("filled") == 0, "unknown")
        .when(all_are("booleans"), "boolean")
        .when(all_are("numbers"), "numeric")
        .when(all_are("texts") & (F.col("dates") > F.col("texts") * 0.5), "date")
        .when(all_are("texts"), "string")
        .otherwise("mixed")
    )
    out = keys.join(spread, "key").withColumn("readable", total["readable"]).withColumn("unreadable", total["unreadable"]).withColumn("dtype", label)
    number, text = F.col("dtype") == "numeric", F.col("dtype") == "string"
    deviation = F.when(F.col("numbers") == 1, 0.0).otherwise(F.sqrt(F.col("squares") / (F.col("numbers") - 1)))
    return out.select(
        "key",
        "dtype",
        F.col("readable").alias("row_count"),
        "unreadable",
        (F.col("readable") - F.col("filled")).alias("null_count"),
        ratio(F.col("readable") - F.col("filled"), F.col("readable")).alias("null_ratio"),
        "unique_count",
        F.coalesce(ratio(F.col("unique_count"), F.col("filled")), F.lit(0.0)).alias("cardinality_ratio"),
        *[F.when(number, F.col(c)).alias(c) for c in ("min_value", "max_value", "mean")],
        F.when(number, deviation).alias("std"),
        F.when(text, F.col("least")).alias("min_text"),
        F.when(text, F.col("most")).alias("max_text"),
    )


def completeness_of_records(records: DataFrame, record: str) -> DataFrame:
    """One row: ``records``, ``readable``, ``unreadable``, ``keys``, ``filled`` cells and their share of all, four decimals.

    No readable record or no key: 1.0.
    """
    keys = value_counts(records, record).agg(F.count_distinct("key").alias("keys"), F.coalesce(F.sum("filled"), F.lit(0)).cast("bigint").alias("filled"))
    total = _totals(records, record)
    both = keys.select(*[total[c].alias(c) for c in ("records", "readable", "unreadable")], "keys", "filled")
    cells = F.col("readable") * F.col("keys")
    return both.withColumn("completeness", F.when(cells > 0, round_to(F.col("filled") / cells, 4)).otherwise(1.0))
