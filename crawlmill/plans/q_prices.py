"""Price queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import clean_price
from ..operators import prices as P
from ..operators.ordering import with_position
from ..session import scratch_path
from ..sources.readers import read_table
from ..sources.sinks import export_prices_csv
from . import inputs as I
from .registry import query, rnd

_DAY = lambda c: F.date_format(c, "yyyy-MM-dd")

_ALERT_SQL = f"""
SELECT *, {rnd("change", 2)} AS change_pct, CASE WHEN change < 0 THEN 'drop' ELSE 'increase' END AS alert_type
FROM (SELECT *, (current_price - previous_price) / previous_price * 100 AS change FROM steps
      WHERE previous_price IS NOT NULL AND previous_price <> 0)
WHERE abs(change) >= 5.0"""


@query(
    "price_alerts",
    f"""WITH {I.OBSERVATIONS_SQL}, steps AS (
  SELECT product, source, observed_at, l_orderkey, l_linenumber, price AS current_price,
    lag(price) OVER (PARTITION BY product, source ORDER BY observed_at, l_orderkey, l_linenumber) AS previous_price
  FROM obs)
SELECT * EXCLUDE (change) REPLACE (strftime(observed_at, '%Y-%m-%d') AS observed_at) FROM ({_ALERT_SQL})""",
)
def price_alerts(spark, folder):
    alerts = P.price_alerts(I.observations(spark, folder))
    return alerts.select(
        "product", "source", _DAY("observed_at").alias("observed_at"), "seq.*", "current_price", "previous_price",
        "change_pct", "alert_type",
    )


@query(
    "price_history",
    f"""WITH {I.OBSERVATIONS_SQL}
SELECT product, source, price, strftime(observed_at, '%Y-%m-%d') AS observed_at,
  row_number() OVER (PARTITION BY product ORDER BY observed_at, l_orderkey, l_linenumber, source, price) AS position
FROM obs""",
)
def price_history(spark, folder):
    placed = with_position(I.observations(spark, folder), ["product"], I.LATEST_ORDER, "position")
    return placed.select("product", "source", "price", _DAY("observed_at").alias("observed_at"), "position")


@query(
    "price_summary",
    f"""WITH {I.OBSERVATIONS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product
    ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, source DESC, price DESC) AS r FROM obs)
SELECT product, max(CASE WHEN r = 1 THEN price END) AS current, min(price) AS min, max(price) AS max,
  {rnd("avg(price)", 2)} AS avg, count(*) AS observations
FROM ranked GROUP BY product""",
)
def price_summary(spark, folder):
    return P.price_summary(I.observations(spark, folder), I.LATEST_ORDER)


@query(
    "price_latest",
    f"""WITH {I.OBSERVATIONS_SQL}
SELECT product, price, source, strftime(observed_at, '%Y-%m-%d') AS observed_at FROM obs
QUALIFY row_number() OVER (PARTITION BY product
    ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, source DESC, price DESC) = 1""",
)
def price_latest(spark, folder):
    latest = P.latest_prices(I.observations(spark, folder), I.LATEST_ORDER)
    return latest.select("product", "price", "source", _DAY("observed_at").alias("observed_at"))


@query("price_products", "SELECT DISTINCT l_partkey AS product FROM lineitem ORDER BY product")
def price_products(spark, folder):
    return P.products(I.observations(spark, folder))


@query(
    "ingest_items",
    f"""WITH raw AS (
  SELECT 'part ' || l_partkey AS name, 'shop ' || l_suppkey AS source,
    CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 6 THEN 'sold out'
      ELSE '$' || format('{{:,}}', CAST(floor(l_extendedprice) AS BIGINT)) || '.' || l_linenumber || '0' END AS price,
    l_shipdate AS observed_at, l_orderkey, l_linenumber FROM lineitem),
obs AS (
  SELECT name AS product, source, observed_at, l_orderkey, l_linenumber,
    CAST(regexp_extract(replace(price, ',', ''), '[0-9]+\\.?[0-9]*') AS DOUBLE) AS price
  FROM raw WHERE regexp_matches(price, '[0-9]')),
steps AS (
  SELECT product, source, observed_at, l_orderkey, l_linenumber, price AS current_price,
    lag(price) OVER (PARTITION BY product, source ORDER BY observed_at, l_orderkey, l_linenumber) AS previous_price
  FROM obs)
SELECT product, source, l_orderkey, l_linenumber, current_price, previous_price, change_pct, alert_type
FROM ({_ALERT_SQL})""",
)
def ingest_items(spark, folder):
    whole = F.floor("l_extendedprice").cast("bigint")
    line = F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("$"), F.format_number(whole, 0), F.lit("."), line, F.lit("0"))
    price = F.when(F.col("l_linenumber") == 7, "").when(F.col("l_linenumber") == 6, "sold out").otherwise(text)
    items = read_table(spark, folder, "lineitem").select(
        F.concat(F.lit("shop "), F.col("l_suppkey").cast("string")).alias("target"),
        F.create_map(
            F.lit("name"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.lit("price"), price
        ).alias("fields"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
        F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )
    return P.ingest_items(items).select(
        "product", "source", "seq.*", "current_price", "previous_price", "change_pct", "alert_type"
    )


@query(
    "sink_price_csv",
    """SELECT event_type AS product_name, value AS price, user_id AS source,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
    ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS observed_at
FROM events""",
)
def sink_price_csv(spark, folder):
    path = scratch_path(spark, "price-csv")
    export_prices_csv(I.event_prices(spark, folder), path)
    schema = "product_name string, price double, source bigint, observed_at string"
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


_ODD_NUMBER = """CASE p_partkey % 6 WHEN 1 THEN 'n/a' WHEN 2 THEN '1e12' WHEN 3 THEN 'NaN' WHEN 4 THEN '-12.5'
  ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END"""


@query(
    "numeric_sanity",
    f"""SELECT p_partkey, p AS price FROM (SELECT p_partkey, TRY_CAST({_ODD_NUMBER} AS DOUBLE) AS p FROM part)
WHERE p IS NOT NULL AND NOT isnan(p) AND p BETWEEN -1e10 AND 1e10""",
)
def numeric_sanity(spark, folder):
    odd = _ODD_NUMBER.replace("VARCHAR", "STRING")
    return P.sane_prices(read_table(spark, folder, "part").selectExpr("p_partkey", f"{odd} AS price"))


_PRICE_TEXT = """CASE p_partkey % 6 WHEN 1 THEN 'free' WHEN 2 THEN concat('from ', p_size, ',', p_partkey, '.5.7 EUR')
  WHEN 3 THEN concat('-', p_size, '.') ELSE concat('$ 1,', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR(40))) END"""


@query(
    "clean_price",
    f"""SELECT p_partkey, t AS price_text, CAST(nullif(regexp_extract(replace(t, ',', ''), '[0-9]+\\.?[0-9]*'), '') AS DOUBLE)
  AS price FROM (SELECT p_partkey, {_PRICE_TEXT} AS t FROM part)""",
)
def clean_prices(spark, folder):
    texts = read_table(spark, folder, "part").selectExpr(
        "p_partkey", f"{_PRICE_TEXT.replace('VARCHAR(40)', 'STRING')} AS price_text"
    )
    return texts.withColumn("price", clean_price("price_text"))
