"""Score rankings and score trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import ratio, round_to
from .ordering import with_position


def rank_pages(pages: DataFrame, market: Sequence[str], seq: str = "seq", rows_per_task: int | None = None) -> DataFrame:
    """Pages of each market by falling score; equal scores keep input order."""
    scored = pages.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return with_position(scored, market, [F.col("score").desc(), F.col(seq)], "rank", rows_per_task)


def market_summary(pages: DataFrame, market: Sequence[str], seq: str = "seq") -> DataFrame:
    """Mean score, best and worst page of each market."""
    scored = pages.withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = F.struct(F.col("score"), -F.col(seq))
    return scored.groupBy(*market).agg(
        round_to(F.avg("score"), 2).alias("avg_score"),
        F.max_by("url", best).alias("top_performer"),
        F.min_by("url", best).alias("bottom_performer"),
        F.count(F.lit(1)).alias("pages"),
    )


def score_trend(history: DataFrame, series: Sequence[str], order: Sequence[str], score: str = "score") -> DataFrame:
    """Direction, mean change per step and next value of each series.

    The mean of the step changes is (last - first) / steps, so no window over the series is needed.
    """
    value = F.coalesce(F.col(score), F.lit(0.0))
    at = F.struct(*order)
    ends = history.groupBy(*series).agg(
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count(F.lit(1)).alias("data_points")
    )
    step = F.coalesce(ratio(F.col("last") - F.col("first"), F.col("data_points") - 1), F.lit(0.0))
    direction = F.when(step > 2.0, "improving").when(step < -2.0, "declining").otherwise("stable")
    single = F.col("data_points") < 2
    return ends.select(
        *series,
        direction.alias("trend_direction"),
        round_to(step, 2).alias("avg_change"),
        F.when(single, F.col("last").cast("double")).otherwise(round_to(F.col("last") + step, 1)).alias("forecast"),
        "data_points",
    )
