import pytest
from helpers import one, rows, text_value
from pyspark.sql import functions as F

from crawlmill.functions import cron as C
from crawlmill.functions import html as H
from crawlmill.functions import records as R
from crawlmill.functions import urls as U
from crawlmill.operators import pages as P

GOOD = """<html><head><title>Fine</title><meta name="description" content="d"></head><body><h1>One</h1>
<a href="/a">a</a><a href='/b'>b</a><img src="x" alt="an x"></body></html>"""


def issue_types(spark, html):
    return [i["issue_type"] for i in text_value(spark, H.issues, html)]


def test_issues(spark):
    assert issue_types(spark, GOOD) == []
    assert issue_types(spark, GOOD + "<H1>Two</H1>") == ["multiple_h1"]
    assert issue_types(spark, "<p>x</p><img src=1>") == [
        "missing_title", "missing_meta_description", "missing_h1", "images_missing_alt", "too_few_links",
    ]
    assert "missing_title" in issue_types(spark, "<title></title>")
    assert "missing_title" not in issue_types(spark, "<title>\n</title>")
    assert text_value(spark, H.issues, "<p>")[-1]["description"] == "Page has only 0 link(s)."


def test_content_score(spark):
    page = spark.createDataFrame([(1, GOOD), (2, "<h2>a</h2><h2>b</h2><h2>c</h2>" + "w " * 1000)], "id int, html string")
    got = {r["id"]: r for r in P.scores(page, "id").collect()}
    assert got[1]["content_score"] == 50 - 10 + 5
    assert got[2]["content_score"] == 50 + 20 + 15 - 10 * 3 - 2
    assert (got[2]["heading_count"], got[2]["issue_count"], got[2]["image_count"]) == (3, 4, 0)


def quality(spark, html):
    return one(spark, H.link_quality(H.link_facts("t")), t=(html, "string"))


def link(*targets):
    return "".join(f'<a href="{t}">x</a>' for t in targets)


def test_link_quality(spark):
    assert quality(spark, "<p>none</p>") == 0.0
    assert quality(spark, link("/a", "#b")) == 10.0
    assert quality(spark, link("http://e.com")) == 20.0
    assert quality(spark, link("mailto:x", "HTTP://x.org")) == 0.0
    assert quality(spark, link("/a", "?b", "http://e.com/1")) == 30 + 30 + 10
    mixed = link(*[f"/p{i}" for i in range(15)], *[f"https://d{i}.org" for i in range(5)])
    assert quality(spark, mixed) == 100.0
    facts = text_value(spark, H.link_facts, link("https://b.org/x", "https://u@A.org:80?q", "https://b.org"))
    assert facts["domains"] == ["b.org", "u@A.org:80"] and facts["external_count"] == 3


def test_words_and_tags(spark):
    page = spark.createDataFrame([(1, "<p>b B a</p><P>a</P><br/>c")], "id int, html string")
    assert rows(P.word_frequency(page, "id", k=2), "word", "n", "rank") == [("b", 2, 1), ("a", 2, 2)]
    assert sorted(rows(P.tag_counts(page, "id"), "tag", "n")) == [("P", 1), ("br", 1), ("p", 1)]
    assert rows(P.links(page.withColumn("html", F.lit(link("/a", "x", "http://y"))), "id"), "pos", "link", "kind") == [
        (0, "/a", "internal"), (2, "http://y", "external"),
    ]


@pytest.mark.parametrize(
    "url, ok",
    [
        ("https://example.com", True),
        ("http://example.com", True),
        ("HTTPS://example.com/p?q=1#f", True),
        ("example.com", False),
        ("", False),
        (None, False),
        ("ftp://example.com", False),
        ("http://localhost", False),
        ("http://exa mple.com", False),
        (" http://example.com", False),
        ("http://", False),
        ("http://[a.b", False),
    ],
)
def test_valid_url(spark, url, ok):
    assert text_value(spark, U.is_valid, url) is ok


def test_url_parts_and_audit(spark):
    assert text_value(spark, U.netloc, "http://u:p@Host.com:80/x") == "u:p@Host.com:80"
    assert text_value(spark, U.path, "http://h.com/a;b/c;d?e#f") == "/a;b/c"
    kinds = lambda u: [f["message"][:14] for f in text_value(spark, U.audit, u)]
    assert kinds("  https://a.b ") == []
    assert kinds(None) == ["URL is require"]
    assert kinds("   ") == ["URL scheme mus", "URL must have "]
    assert kinds("ftp://a b") == ["URL contains i", "URL scheme mus", "URL domain mus"]


@pytest.mark.parametrize(
    "cron, seconds",
    [
        ("*/5 * * * *", 300), ("*/15 * * * *", 900), ("0 * * * *", 3600), ("0 0 * * *", 86400), ("invalid", None),
        ("* * *", None), ("", None), (None, None), (" */10  * * 1 2 ", 600), ("*/x * * * *", None), ("0 0 1 * *", None),
        ("*/+7 * * * *", 420), ("5 * * * *", None),
    ],
)
def test_cron(spark, cron, seconds):
    assert text_value(spark, C.interval_seconds, cron) == seconds


def fetch(spark, url, content, ts, status):
    cols = dict(u=(url, "string"), c=(content, "string"), t=(ts, "double"), s=(status, "int"))
    return one(spark, R.audit_fetch("u", "c", "t", "s"), **cols)


def test_fetch_audit(spark):
    assert fetch(spark, "https://a.b", "", 1.0, 200)["warnings"] == ["Content is empty"]
    assert fetch(spark, "https://a.b", "x", 1.0, 404)["warnings"] == ["HTTP error status: 404"]
    assert fetch(spark, "https://a.b", "x", None, 200)["issues"] == ["Missing required field: timestamp"]
    assert fetch(spark, "x", None, 1.0, None) == (
        False, ["Invalid URL in result", "Missing required field: content"], ["Missing status_code field"],
    )
    big = one(spark, R.audit_fetch(F.lit("https://a.b"), F.repeat(F.lit("x"), 1_000_001), F.lit(1.0), F.lit(200)))
    assert big["warnings"] == ["Content exceeds 1MB; consider truncating"] and big["valid"]


def test_target_audits(spark):
    a = lambda t: text_value(spark, R.audit_target, t)
    b = lambda t: text_value(spark, R.audit_target_map, t)
    assert a('{"url":"https://a.b","interval_seconds":60,"fields":["x"],"enabled":true,"name":"n"}') == (True, [], [])
    assert a("[]")["issues"] == a("not json")["issues"] == ["Config must be a dictionary"]
    assert a('{"url":"https://a.b","interval_seconds":null,"enabled":null,"fields":null}')["valid"]
    low = a('{"url":"https://a.b","interval_seconds":5,"fields":[],"name":""}')
    assert low["valid"] and len(low["warnings"]) == 3
    wrong = a('{"url":"a","interval_seconds":-1,"enabled":"yes","fields":{}}')
    assert len(wrong["issues"]) == 4
    messages = lambda t: [e["message"] for e in b(t)["errors"]]
    assert messages('{"url":"https://a.b","selector":"p","fields":{"a":"b"}}') == []
    assert messages("{}") == ["Config must have 'url' field", "Config must have 'selector' or 'selectors' field"]
    assert messages('{"url":"ftp://a.b","selectors":[],"interval_seconds":null,"enabled":0,"fields":[]}') == [
        "URL scheme must be http or https, got: ftp",
        "interval_seconds must be a positive integer",
        "enabled must be a boolean",
        "fields must be a dictionary",
    ]
    assert b('{"url":"https://a.b","selector":"p","interval_seconds":true}')["warnings"] != []


def test_selector_lint(spark):
    lint = lambda s: [f["message"] for f in text_value(spark, R.audit_selector, s)]
    assert lint("div.card > a[href]") == []
    assert lint(None) == lint("") == ["Selector is required"]
    assert lint("> p") == ["Selector cannot start with combinator"]
    assert lint("a[b") == ["Unbalanced brackets in selector"]
    assert lint("a:not(b") == ["Unbalanced parentheses in selector"]
    assert lint("a,,b") == lint("a,") == ["Selector has empty parts"]
    assert lint("a > > b") == ["Consecutive combinators are invalid"]
    assert len(lint("a > + b + ~ c > > d")) == 2  # one per first combinator


def test_record_quality(spark):
    at = F.lit("2024-01-31").cast("timestamp")
    q = lambda url, status, age: one(
        spark, R.quality_of_record(F.lit(url), F.lit("t"), F.lit(""), at - F.make_dt_interval(days=F.lit(age)), F.lit(status), at)
    )
    assert q("u", 200, 0) == pytest.approx(0.4 * 2 / 3 + 0.6, abs=5e-4)
    assert q(None, 404, 60) == pytest.approx(0.4 / 3 + 0.09, abs=5e-4)
