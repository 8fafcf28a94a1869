"""Sinks: numbered tables, price history as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.ordering import with_dense_id
from ..operators.quality import _q


def append_with_id(df: DataFrame, path: str, order: Sequence[str], nan_as_null: bool = True) -> None:
    """Append rows with a gap-free ``id`` that goes on from the rows already stored.

    Types stay native; NaN is stored as NULL. One writer at a time.
    """
    spark = df.sparkSession
    if nan_as_null:
        fractions = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        df = df.withColumns({c: F.when(~F.isnan(F.col(_q(c))), F.col(_q(c))) for c in fractions})
    try:
        start = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    except AnalysisException:  # nothing stored yet
        start = 0
    numbered = with_dense_id(df, order, "id", start)
    numbered.select("id", *df.columns).write.mode("append").parquet(path)


def iso_utc(ts: Column | str) -> Column:
    """ISO text with offset; the fraction is written only when there is one."""
    micros = F.date_format(ts, "SSSSSS")
    part = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def export_prices_csv(observations: DataFrame, path: str, order: Sequence[str] = ("observed_at", "seq")) -> None:
    """Price history as CSV parts with a header, in observation order across the parts."""
    (
        observations.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            F.col("product").alias("product_name"), "price", "source", iso_utc("observed_at").alias("observed_at")
        )
        .write.option("header", True)
        .option("escape", '"')
        .csv(path)
    )
