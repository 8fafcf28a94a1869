"""Cron texts to intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SPACE, col, let, matches


def interval_seconds(cron: Column | str) -> Column:
    """Seconds between runs for every-N-minutes, hourly and daily expressions, else NULL.

    Month and weekday are not looked at.
    """

    def of_parts(p: Column) -> Column:
        minute, hour, day = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        step = F.substr(minute, F.lit(3))
        number = F.when(step.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(step, F.lit("_"), F.lit("")))
        any_day = day == "*"
        return F.when(
            F.size(p) == 5,
            F.when(
                minute.startswith("*/") & (hour == "*") & any_day,
                F.try_multiply(number.try_cast("bigint"), F.lit(60).cast("bigint")),
            )
            .when((minute == "0") & (hour == "*") & any_day, F.lit(3600).cast("bigint"))
            .when((minute == "0") & (hour == "0") & any_day, F.lit(86400).cast("bigint")),
        )

    return let(matches(F.coalesce(col(cron), F.lit("")), f"[^{SPACE}]+"), of_parts)
