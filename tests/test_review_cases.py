"""Inputs that the given tables do not hold: caps, repeated rules, odd numbers."""

from helpers import one, rows
from pyspark.sql import functions as F

from crawlmill.functions.core import round_to
from crawlmill.functions.cron import interval_seconds
from crawlmill.operators import robots, runs
from crawlmill.sources.detect import detect_schema
from crawlmill.sources.readers import read_delimited


def test_recent_runs_gives_as_many_as_asked(spark):
    log = spark.range(40).select(F.lit("a").alias("job"), F.col("id").cast("double").alias("ts"), F.col("id").alias("seq"))
    assert runs.recent_runs(log, 25).count() == 25
    assert runs.recent_runs(log).count() == 10


def test_long_cron_steps(spark):
    value = lambda t: one(spark, interval_seconds("t"), t=(t, "string"))
    assert value("*/" + "0" * 1200 + "5 * * * *") == 300
    assert value("*/" + "9" * 18 + " * * * *") is None  # more seconds than fit


def test_one_text_among_dates_makes_a_text_column(spark):
    data = [(i, "2024-01-01" if i < 20 else "never", f"Jan {i % 9 + 1}, 2024") for i in range(25)]
    df = spark.createDataFrame(data, "id int, a string, b string")
    assert dict(rows(detect_schema(df, "id"), "column", "label")) == {"id": "integer", "a": "text", "b": "date"}


def test_rounding_keeps_large_and_exact_values(spark):
    value = lambda x, n: one(spark, round_to("x", n), x=(x, "double"))
    assert value(1e29, 2) == 1e29 and value(-3e15, 1) == -3e15
    assert value(2.675, 2) == 2.68 and value(0.125, 2) == 0.13
    assert value(float("nan"), 2) is None and value(float("inf"), 2) is None


def test_repeated_robots_rows_block_once(spark):
    urls = spark.createDataFrame([("https://a.b/admin/x",), ("https://a.b/ok",)], "url string")
    rules = [("a.b", "User-agent: *\nDisallow: /admin"), ("a.b", "User-agent: *\nDisallow: /tmp")]
    site = one(spark, F.lit(1))  # a session is up
    assert site == 1
    sites = spark.createDataFrame([(d, t) for d, t in rules] * 2, "domain string, robots_text string")
    sites = sites.unionByName(sites.withColumn("domain", F.concat(F.lit("https://"), "domain")))
    got = dict(rows(robots.gate(urls, sites, "bot"), "url", "allowed"))
    assert got == {"https://a.b/admin/x": False, "https://a.b/ok": True}
    assert robots.gate(urls, sites, "bot").count() == 2


def test_line_feeds_inside_quotes(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text('id,text\n1,"two\nlines"\n2,one\n')
    assert rows(read_delimited(spark, str(file), "id int, text string", multi_line=True)) == [(1, "two\nlines"), (2, "one")]
