"""Small helpers shared by the tests."""

from pyspark.sql import functions as F


def one(spark, expression, **columns):
    """Value of an expression over one row of the given columns."""
    schema = ", ".join(f"{k} {t}" for k, (_, t) in columns.items()) or "x int"
    values = tuple(v for v, _ in columns.values()) or (1,)
    return spark.createDataFrame([values], schema).select(expression.alias("r")).first()["r"]


def text_value(spark, fn, text, *args):
    return one(spark, fn("t", *args), t=(text, "string"))


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def observations(spark, points):
    """(product, price, source) tuples in arrival order."""
    data = [(p, float(x), s, i) for i, (p, x, s) in enumerate(points)]
    df = spark.createDataFrame(data, "product string, price double, source string, seq bigint")
    return df.withColumn("observed_at", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
