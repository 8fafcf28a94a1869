import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from crawlmill.operators import robots as B
from crawlmill.operators import runs as R
from crawlmill.operators import series as S


def runs(spark, *log):
    """(job, success) in order of time."""
    data = [(j, ok, i, f"r{i}" if ok else None, None if ok else f"e{i}") for i, (j, ok) in enumerate(log)]
    df = spark.createDataFrame(data, "job string, success boolean, seq bigint, result string, error string")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))


def jobs(spark, *listed):
    return spark.createDataFrame(listed, "name string, interval_seconds bigint, enabled boolean, cron string")


def test_status(spark):
    log = runs(spark, ("a", True), ("a", False), ("a", True), ("a", False), ("b", True))
    table = jobs(spark, ("a", 60, True, ""), ("c", 60, False, ""))
    got = {r["job"]: r for r in R.job_status(log, table).collect()}
    a = got["a"]
    assert (a["run_count"], a["error_count"], a["last_result"], a["last_error"]) == (2, 2, "r2", "e3")
    assert (a["last_run"].second, (a["next_run"] - a["last_attempt"]).seconds) == (42, 60)
    assert (got["c"]["run_count"], got["c"]["next_run"]) == (0, None)
    assert R.job_status(log).filter("job = 'b'").first()["error_count"] == 0


def test_fleet(spark):
    table = jobs(spark, ("a", 1, True, ""), ("b", 1, True, ""), ("c", 1, False, ""))
    log = runs(spark, ("a", True), ("a", True), ("b", True), ("b", False), ("gone", True))
    assert tuple(R.fleet_totals(table, log).first()) == (3, 2, 3, 1)


def test_recent_runs(spark):
    log = runs(spark, *[("a", True)] * 15, ("b", False))
    got = rows(R.recent_runs(log, 20).filter("job = 'a'").orderBy("position"), "seq")
    assert got == [(i,) for i in range(14, -1, -1)]
    assert R.recent_runs(log, 3).count() == 4


def test_intervals(spark):
    got = R.job_intervals(jobs(spark, ("a", 7, True, "*/5 * * * *"), ("b", 7, True, "bad"), ("c", 7, True, None)))
    assert rows(got, "interval_seconds", "cron_applied") == [(300, True), (7, False), (7, False)]


def scores(spark, *values):
    data = [("m", f"u{i}", None if v is None else float(v), i) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "market string, url string, score double, seq bigint")


def test_market(spark):
    pages = scores(spark, 60, 85, 70)
    assert rows(S.rank_pages(pages, ["market"]).orderBy("rank"), "url") == [("u1",), ("u2",), ("u0",)]
    assert tuple(S.market_summary(pages, ["market"]).first()) == ("m", 71.67, "u1", "u0", 3)
    ties = scores(spark, 5, 9, 9, 5, None)
    for limit in (None, 2):
        ranked = S.rank_pages(ties, ["market"], rows_per_task=limit).orderBy("rank")
        assert rows(ranked, "url") == [("u1",), ("u2",), ("u0",), ("u3",), ("u4",)]
    assert tuple(S.market_summary(ties, ["market"]).first())[2:4] == ("u1", "u4")


@pytest.mark.parametrize(
    "values, expected",
    [
        ([50, 55, 60], ("improving", 5.0, 65.0, 3)),
        ([80, 75, 70], ("declining", -5.0, 65.0, 3)),
        ([70, 71, 70.5], ("stable", 0.25, 70.8, 3)),
        ([75], ("stable", 0.0, 75.0, 1)),
        ([10, 12], ("stable", 2.0, 14.0, 2)),
        ([10, None], ("declining", -10.0, -10.0, 2)),
    ],
)
def test_trend(spark, values, expected):
    got = S.score_trend(scores(spark, *values), ["market"], ["seq"])
    assert rows(got, "trend_direction", "avg_change", "forecast", "data_points") == [expected]


def paths(spark, text, agent="MyBot"):
    df = spark.createDataFrame([("http://a.b", text)], "domain string, robots_text string")
    return [r["path"] for r in B.rules(df, agent).collect()]


def test_rules(spark):
    assert paths(spark, "User-agent: MyBot/1\nDisallow: /a\nUser-agent: *\nDisallow: /b") == ["/a", "/b"]
    assert paths(spark, "User-agent: *\nDisallow:\n") == []
    assert paths(spark, "# c\nUser-agent: *\n# Disallow: /x\n\nDisallow: /blocked") == ["/blocked"]
    assert paths(spark, "User-agent: *\nUser-agent: other\nDisallow: /x") == []  # the last line decides
    assert paths(spark, "Disallow: /early\nuser-AGENT:mybot\r\n  DISALLOW:/y  \r\nAllow: /z") == ["/y"]
    assert paths(spark, "") == paths(spark, None) == []


def allowed(spark, url, text, domain="http://a.b"):
    robots = spark.createDataFrame([(domain, text)], "domain string, robots_text string")
    return B.gate(spark.createDataFrame([(url,)], "url string"), robots, "MyBot").first()["allowed"]


def test_gate(spark):
    every = "User-agent: *\nDisallow: "
    assert not allowed(spark, "http://a.b/page", every + "/")
    assert not allowed(spark, "http://a.b", every + "/")
    assert not allowed(spark, "http://a.b/admin/users?x=1", every + "/admin")
    assert allowed(spark, "http://a.b/products", every + "/admin")
    assert allowed(spark, "http://a.b/page?q=/admin", every + "/admin")
    assert allowed(spark, "https://a.b/admin", every + "/admin")  # another scheme, other rules
    assert not allowed(spark, "http://a.b/x", every + "/y\nDisallow: /x")


def test_gate_against_every_rule(spark):
    """Many rules of many lengths, sites with most URLs, repeated URLs, rules that close a site."""
    rng = random.Random(5)
    part = lambda: "".join(rng.choice("ab/é*") for _ in range(rng.randint(1, 5)))
    rules = {f"d{i}.com": [f"/{part()}" for _ in range(rng.randint(0, 60))] for i in range(8)}
    rules["shut.com"] = ["/x", "/"]
    rules["star.com"] = ["*", "no/slash"]
    robots = [(d, "User-agent: *\n" + "\n".join(f"Disallow: {p}" for p in ps)) for d, ps in rules.items()]
    robots += [("d1.com", "User-agent: *\nDisallow: /second/file"), ("empty.com", ""), ("none.com", None)]
    rules["d1.com"] = [*rules["d1.com"], "/second/file"]
    sites = ["d0.com"] * 40 + list(rules) + ["other.com", "empty.com", "none.com"]
    urls = [f"https://{rng.choice(sites)}{rng.choice(['', '/'])}{part() if rng.random() < 0.8 else ''}".replace("com*", "com/*").replace("comé", "com/é") for _ in range(600)]
    urls = [u for u in urls if u.split("//")[1].count("com") == 1 and u.split(".com")[1][:1] in ("", "/")]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int").repartition(4)
    files = spark.createDataFrame([(f"https://{d}", t) for d, t in robots], "domain string, robots_text string")
    got = B.gate(df, files, "bot").collect()
    assert len(got) == len(urls)
    for r in got:
        site, _, path = r["url"].removeprefix("https://").partition("/")
        path = "/" + path
        assert r["allowed"] == (not any(p == "/" or path.startswith(p) for p in rules.get(site, []))), r
    assert {r["allowed"] for r in got} == {True, False}
