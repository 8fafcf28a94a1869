"""Changes between two scrapes of the same target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_fields(fields: Column | str) -> Column:
    """A map as text that does not depend on the order of its entries."""
    entries = F.sort_array(F.map_entries(fields))
    return F.to_json(F.transform(entries, lambda e: F.array(e["key"], e["value"])))


def item_hash(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """16 hex digits over the ordered items of each scrape, with the number of items.

    Every item is hashed with its position where it lies; what is gathered per scrape is two sums of
    those hashes, so the size of a scrape does not matter.
    """
    digest = F.sha2(F.concat_ws("\u0001", F.col("pos").cast("string"), F.to_json("fields")), 256)
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")
    sums = items.groupBy(*keys).agg(
        F.sum(part(1)).alias("__a"), F.sum(part(16)).alias("__b"), F.count(F.lit(1)).alias("item_count")
    )
    text = F.concat_ws("|", F.col("__a").cast("string"), F.col("__b").cast("string"), F.col("item_count"))
    return sums.select(*keys, "item_count", F.substring(F.sha2(text, 256), 1, 16).alias("items_hash"))


def item_changes(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items only in the current scrape (``added``) and only in the previous one (``removed``).

    Copies of an item are kept. Rows of one scrape are told apart by ``keys``.
    """
    cur = current.withColumn("__item", canonical_fields("fields"))
    prev = previous.withColumn("__item", canonical_fields("fields"))
    on = [*keys, "__item"]

    def missing(left: DataFrame, right: DataFrame, change: str) -> DataFrame:
        # the right side is reduced to distinct items first; a frequent item on the left can be split
        return left.join(right.select(*on).distinct(), on, "left_anti").withColumn("change", F.lit(change))

    both = missing(cur, prev, "added").unionByName(missing(prev, cur, "removed"))
    return both.drop("__item")


def scrape_changed(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether each scrape's ordered item list changed; a missing scrape counts as an empty list."""
    a = item_hash(previous, keys).withColumnRenamed("items_hash", "previous_hash").drop("item_count")
    b = item_hash(current, keys).withColumnRenamed("items_hash", "current_hash").drop("item_count")
    joined = a.join(b, list(keys), "full_outer")
    return joined.withColumn("changed", ~F.col("previous_hash").eqNullSafe(F.col("current_hash")))
