"""Price observations: alerts, summaries, history and ingestion of scraped items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import round_to
from ..functions.numbers import clean_price, finite_number
from .ordering import with_previous

DEFAULT_THRESHOLD = 5.0
ORDER = ("observed_at", "seq")


def change_alert(previous: Column, current: Column, threshold_pct: float) -> dict[str, Column]:
    """Alert columns of one price step; ``alert_type`` is NULL when there is no alert."""
    change = F.try_divide(current - previous, previous) * 100  # NULL after a zero price
    kind = F.when(change < 0, "drop").otherwise("increase")
    return {
        "change_pct": round_to(change, 2),
        "alert_type": F.when(F.abs(change) >= threshold_pct, kind),
    }


def price_alerts(
    observations: DataFrame,
    threshold_pct: float = DEFAULT_THRESHOLD,
    order: Sequence[str] = ORDER,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Steps of at least ``threshold_pct`` percent against the previous price of (product, source)."""
    steps = with_previous(
        observations, ["product", "source"], order, {"previous_price": "price"}, rows_per_task
    ).filter("previous_price is not null and previous_price <> 0")
    return (
        steps.withColumns(change_alert(F.col("previous_price"), F.col("price"), threshold_pct))
        .filter("alert_type is not null")
        .withColumnRenamed("price", "current_price")
    )


def price_summary(observations: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Current, lowest, highest and mean price and the number of observations per product."""
    return observations.groupBy("product").agg(
        F.max_by("price", F.struct(*order)).alias("current"),
        F.min("price").alias("min"),
        F.max("price").alias("max"),
        round_to(F.avg("price"), 2).alias("avg"),
        F.count(F.lit(1)).alias("observations"),
    )


def latest_prices(observations: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest observation of every product, whatever its source."""
    rest = [c for c in observations.columns if c != "product"]
    newest = observations.groupBy("product").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("latest")
    )
    return newest.select("product", "latest.*")


def products(observations: DataFrame) -> DataFrame:
    return observations.select("product").distinct().orderBy("product")


def product_history(observations: DataFrame, product, order: Sequence[str] = ORDER) -> DataFrame:
    """All observations of one product, in order."""
    return observations.filter(F.col("product") == product).orderBy(*order)


def sane_prices(observations: DataFrame, price: str = "price") -> DataFrame:
    """Rows whose price is a number within chart limits, with the price as a double."""
    return observations.withColumn(price, finite_number(price)).filter(F.col(price).isNotNull())


def items_to_observations(
    items: DataFrame, name_field: str | Column = "name", price_field: str | Column = "price"
) -> DataFrame:
    """Scraped items as observations: blank names or prices and unreadable prices are left out.

    Needs ``target``, ``fields`` (map), ``observed_at`` and ``seq``; the source is the target name. The names of
    the two fields may be columns, when they differ by target.
    """
    given = lambda c: F.coalesce(c != "", F.lit(False))
    field = lambda f: F.try_element_at("fields", f if isinstance(f, Column) else F.lit(f))
    name, price = field(name_field), field(price_field)
    return (
        items.filter(given(name) & given(price))
        .select(
            name.alias("product"),
            clean_price(price).alias("price"),
            F.col("target").alias("source"),
            *[c for c in items.columns if c not in ("fields", "target", "product", "price", "source")],
        )
        .filter("price is not null")
    )


def target_items(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Observations of the items of known targets, each read by its target's own field names.

    ``targets`` has ``target``, ``name_field`` and ``price_field``, one row a target; items of other targets are left out.
    Works on a stream of items too: the targets are a table, read again for every micro-batch.
    """
    named = targets.select("target", F.col("name_field").alias("__name"), F.col("price_field").alias("__price"))
    read = items_to_observations(items.join(named, "target"), F.col("__name"), F.col("__price"))
    return read.drop("__name", "__price")


def ingest_targets(
    items: DataFrame, targets: DataFrame, threshold_pct: float = DEFAULT_THRESHOLD, order: Sequence[str] = ORDER
) -> DataFrame:
    """Alerts raised by the items of known targets; an item that comes twice (equal product, source and order) counts once."""
    seen = target_items(items, targets).dropDuplicates(["product", "source", *order])
    return price_alerts(seen, threshold_pct, order)


def ingest_items(
    items: DataFrame,
    name_field: str = "name",
    price_field: str = "price",
    threshold_pct: float = DEFAULT_THRESHOLD,
    history: DataFrame | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Alerts raised by adding scraped items to an optional earlier history.

    History rows must come before the items in ``order``; only alerts of new items are returned.
    """
    fresh = items_to_observations(items, name_field, price_field)
    if history is None:
        return price_alerts(fresh, threshold_pct, order)
    both = history.select(*fresh.columns).withColumn("is_new", F.lit(False)).unionByName(
        fresh.withColumn("is_new", F.lit(True))
    )
    return price_alerts(both, threshold_pct, order).filter("is_new").drop("is_new")
