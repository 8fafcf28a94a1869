import random

import pytest
from helpers import observations, rows
from pyspark.sql import functions as F

from crawlmill.functions.numbers import clean_price, finite_number
from crawlmill.operators import prices as P
from crawlmill.session import scratch_path
from crawlmill.sources.sinks import export_prices_csv


def alerts(spark, points, threshold=5.0, **kw):
    got = P.price_alerts(observations(spark, points), threshold, **kw)
    return rows(got.orderBy("seq"), "product", "previous_price", "current_price", "change_pct", "alert_type", "source")


def naive(points, threshold=5.0):
    last, out = {}, []
    for product, price, source in points:
        before = last.get((product, source))
        last[product, source] = price
        if before:
            change = (price - before) / before * 100
            if abs(change) >= threshold:
                out.append((product, before, price, "drop" if change < 0 else "increase", source))
    return out


def test_drop_and_increase(spark):
    assert alerts(spark, [("w", 100, "a"), ("w", 90, "a")]) == [("w", 100.0, 90.0, -10.0, "drop", "a")]
    assert alerts(spark, [("w", 100, "a"), ("w", 120, "a")]) == [("w", 100.0, 120.0, 20.0, "increase", "a")]


def test_below_threshold_first_and_other_source(spark):
    assert alerts(spark, [("w", 100, "a"), ("w", 105, "a")], 10.0) == []
    assert alerts(spark, [("w", 100, "a")]) == []
    assert alerts(spark, [("w", 100, "a"), ("w", 50, "b")]) == []


def test_threshold_met_exactly_and_zero_previous(spark):
    assert len(alerts(spark, [("w", 100, "a"), ("w", 105, "a")], 5.0)) == 1
    assert alerts(spark, [("w", 0, "a"), ("w", 5, "a")]) == []


def test_negative_previous_flips_sign_and_zero_threshold(spark):
    assert alerts(spark, [("w", -100, "a"), ("w", -50, "a")])[0][3:5] == (-50.0, "drop")
    assert alerts(spark, [("w", 10, "a"), ("w", 10, "a")], 0.0)[0][3:5] == (0.0, "increase")


@pytest.mark.parametrize("rows_per_task", [None, 50])
def test_alerts_match_a_loop_also_with_heavy_keys(spark, rows_per_task):
    rng = random.Random(7)
    keys = [("hot", "a")] * 6 + [(f"p{i}", f"s{i % 3}") for i in range(12)]
    points = []
    for _ in range(900):
        p, s = rng.choice(keys)
        points.append((p, float(rng.choice([0, 10, 10, 11, 20])), s))
    got = [(a, b, c, e, f) for a, b, c, _, e, f in alerts(spark, points, rows_per_task=rows_per_task)]
    assert got == naive(points)


def test_summary_latest_products_history(spark):
    obs = observations(spark, [("b", 10, "x"), ("a", 5, "x"), ("b", 30, "y"), ("b", 20, "x")])
    assert rows(P.price_summary(obs).orderBy("product")) == [("a", 5, 5, 5, 5, 1), ("b", 20, 10, 30, 20, 3)]
    assert rows(P.latest_prices(obs).orderBy("product"), "product", "price", "source") == [("a", 5, "x"), ("b", 20, "x")]
    assert rows(P.products(obs)) == [("a",), ("b",)]
    assert rows(P.product_history(obs, "b"), "price") == [(10,), (30,), (20,)]


@pytest.mark.parametrize(
    "text, price",
    [("$29.99", 29.99), ("$1,234.56", 1234.56), ("free", None), ("$100", 100.0), ("", None), ("-5", 5.0), ("1.2.3", 1.2), ("7.", 7.0)],
)
def test_clean_price(spark, text, price):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_price("t")).first()[0] == price


def test_finite_number(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("1e11",), (None,), ("Infinity",)], "t string")
    assert [r[0] for r in df.select(finite_number("t")).collect()] == [1.5, None, None, None, None, None]


def items(spark, listed):
    data = [("shop", {"name": n, "price": p}, i) for i, (n, p) in enumerate(listed)]
    df = spark.createDataFrame(data, "target string, fields map<string,string>, seq bigint")
    return df.withColumn("observed_at", F.timestamp_seconds("seq"))


def test_ingest(spark):
    assert P.ingest_items(items(spark, [("", "$10"), ("X", ""), ("Y", "soon")])).count() == 0
    got = P.ingest_items(items(spark, [("Widget", "$100"), ("Widget", "$80.00")]))
    assert rows(got, "product", "source", "change_pct", "alert_type") == [("Widget", "shop", -20.0, "drop")]


def test_ingest_after_history(spark):
    history = P.items_to_observations(items(spark, [("Widget", "$100"), ("Widget", "$50")]))
    new = items(spark, [("Widget", "$60")]).withColumn("observed_at", F.timestamp_seconds(F.lit(100)))
    assert rows(P.ingest_items(new, history=history), "previous_price", "current_price") == [(50.0, 60.0)]


def test_csv_export(spark):
    path = scratch_path(spark, "csv")
    obs = observations(spark, [('a "b", c', 10, "x"), ("a", 5.5, "y")])
    export_prices_csv(obs, path)
    text = spark.read.text(path).collect()
    assert text[0][0] == "product_name,price,source,observed_at"
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert sorted(rows(back)) == [
        ("a", "5.5", "y", "2023-11-14T22:13:21+00:00"),
        ('a "b", c', "10.0", "x", "2023-11-14T22:13:20+00:00"),
    ]
