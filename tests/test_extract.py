import pytest
from helpers import rows

from crawlmill.operators import changes as C
from crawlmill.operators.extract import Target, extract_by_url, extract_items
from crawlmill.sources.readers import parse_targets, read_targets

HTML = """<html><body><!-- c --><div class="product card" id="p1"><h2 class="t">Wid&amp;get <b>A</b></h2>
<span class="price">$29.99</span><a href="/page" data-k="v w">Go</a></div>
<div class="product"><h2 class="t"> Plain </h2><script>var x = "<p>no</p>";</script><a href="">empty</a></div>
<p>one<br>two<p>three</body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "http://a.b", HTML), (2, "http://c.d", "<p>x</p>"), (3, "http://e.f", None)], "id int, url string, html string")


def test_fields(spark):
    fields = {"name": "<h2[^>]*>([^<]*)", "link_href": 'href="([^"]*)"', "price": 'class="price">([^<]*)<'}
    target = Target("t", "", '(?s)<div class="product.*?</div>', fields)
    got = rows(extract_items(pages(spark), [target, Target("p", "", "<p>[^<]*</p>")], ["id"]).orderBy("id", "target", "pos"))
    assert got == [
        (1, "p", 0, {"text": "no"}),
        (1, "t", 0, {"name": "Wid&get", "link_href": "/page", "price": "$29.99"}),
        (1, "t", 1, {"name": "Plain", "link_href": "", "price": ""}),
        (2, "p", 0, {"text": "x"}),
    ]


def test_config_and_target_table(spark, tmp_path):
    config = {"targets": [{"name": "n", "url": "http://c.d", "selector": "p"}]}
    assert parse_targets(config) == [Target("n", "http://c.d", "p")] and parse_targets({}) == []
    with pytest.raises(KeyError):
        parse_targets({"targets": [{"name": "n"}]})
    file = tmp_path / "targets.json"
    file.write_text('{"name":"n","url":"http://c.d","selector":"<p>[^<]*</p>"}\n{"name":"m","url":"http://a.b","selector":"<h2.*?</h2>","fields":{"h":"<h2[^>]*>([^<]*)"}}\n')
    targets = read_targets(spark, str(file))
    assert rows(targets, "headers") == [({},), ({},)]
    got = rows(extract_by_url(pages(spark), targets, ["id"]).orderBy("id", "pos"))
    assert got == [(1, "m", 0, {"h": "Wid&get"}), (1, "m", 1, {"h": "Plain"}), (2, "n", 0, {"text": "x"})]
    file.write_text('{"name":"n","url":"http://c.d"}\n')
    with pytest.raises(Exception, match="target without selector"):
        read_targets(spark, str(file)).collect()


def scrape(spark, *texts):
    data = [(1, i, {"a": t, "b": "x"}) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "k int, pos int, fields map<string,string>")


def changes(spark, before, after):
    got = C.item_changes(scrape(spark, *before), scrape(spark, *after), ["k"])
    return sorted((r["change"], r["fields"]["a"]) for r in got.collect())


def changed(spark, before, after):
    return [r["changed"] for r in C.scrape_changed(scrape(spark, *before), scrape(spark, *after), ["k"]).collect()]


def test_item_changes(spark):
    assert changes(spark, "ab", "ab") == [] and changed(spark, "ab", "ab") == [False]
    assert changes(spark, "a", "ab") == [("added", "b")] and changed(spark, "a", "ab") == [True]
    assert changes(spark, "abc", "a") == [("removed", "b"), ("removed", "c")]
    assert changes(spark, "ab", "ba") == [] and changed(spark, "ab", "ba") == [True]
    assert changes(spark, "a", "abb") == [("added", "b"), ("added", "b")]
    assert changes(spark, "aa", "a") == [] and changed(spark, "aa", "a") == [True]
    assert changed(spark, "", "a") == [True]
