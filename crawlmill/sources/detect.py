"""Schema detection of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import _q

SAMPLES = 3
# date texts that are recognised (explicit, since Spark does not guess formats)
DATE_FORMATS = (
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
)


def _label(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


def _is_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).isNotNull()


def detect_schema(df: DataFrame, order: str) -> DataFrame:
    """One row per column: label, has-null flag, first non-null values as text, rows of the table.

    A text column is labelled ``date`` if all its values are dates. ``order`` is a unique column that says which
    rows come first. The first values of each column come from a bounded top-n over two columns, so nothing
    is sorted as a whole.
    """
    facts = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(_label(f.dataType)).alias("label"),
            (F.count(_q(f.name)) < F.count(F.lit(1))).alias("nullable"),
            F.count(F.lit(1)).alias("row_count"),
            _all_dates(f).alias("all_dates"),
        )
        for i, f in enumerate(df.schema)
    ]
    table = df.agg(F.array(*facts).alias("r")).select(F.inline("r"))
    # one row per column of the table
    joined = table.join(F.broadcast(reduce(DataFrame.unionByName, [_first_values(df, f, order) for f in df.schema])), "column")
    label = F.when((F.col("label") == "text") & F.col("all_dates"), "date").otherwise(F.col("label"))
    return joined.withColumn("label", label).drop("all_dates").orderBy("position")


def _all_dates(f: T.StructField) -> Column:
    if not isinstance(f.dataType, T.StringType):
        return F.lit(False)
    c = F.col(_q(f.name))
    return (F.count(c) > 0) & (F.count_if(c.isNotNull() & ~_is_date(c)) == 0)


def _first_values(df: DataFrame, f: T.StructField, order: str) -> DataFrame:
    c = F.col(_q(f.name))
    shown = c.cast("string") if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(c)
    head = (
        df.select(F.col(_q(order)).alias("at"), shown.alias("value"))
        .filter("value is not null")
        .orderBy("at")
        .limit(SAMPLES)
    )
    # at most SAMPLES rows arrive here
    values = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return head.agg(values.alias("samples")).select(F.lit(f.name).alias("column"), "samples")
