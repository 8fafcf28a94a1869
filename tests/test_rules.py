import pytest
from helpers import rows
from pyspark.sql import functions as F

from crawlmill.operators import rules as V


def failing(spark, schema, values, *checks):
    df = V.validate(spark.createDataFrame([values], schema), checks)
    r = df.first()
    assert r["is_valid"] == (not r["errors"])
    return [(e["rule_type"], e["message"]) for e in r["errors"]]


def variant_failing(spark, text, *checks):
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("v"))
    return [e["message"] for e in V.validate(df, checks).first()["errors"]]


def test_required(spark):
    check = V.required("name")
    assert failing(spark, "name string", ("  ",), check) == [("required", "name is required")]
    assert failing(spark, "name string", (None,), check) == [("required", "name is required")]
    assert failing(spark, "name string", ("x",), check) == []
    assert failing(spark, "other int", (1,), check) == [("required", "name is required")]


@pytest.mark.parametrize(
    "schema, value, expected, ok",
    [
        ("a int", 5, "float", True),
        ("a int", 5, "int", True),
        ("a double", 5.5, "int", False),
        ("a boolean", True, "int", True),
        ("a int", 5, "bool", False),
        ("a string", "5", "int", False),
        ("a string", None, "int", True),
        ("a string", "x", "unheard-of", True),
    ],
)
def test_types(spark, schema, value, expected, ok):
    assert (failing(spark, schema, (value,), V.of_type("a", expected)) == []) == ok


def test_range(spark):
    check = V.in_range("a", 0, 10)
    assert failing(spark, "a double", (10.0,), check) == []
    assert failing(spark, "a double", (10.5,), check) == [("range", "a out of range")]
    assert failing(spark, "a double", (float("nan"),), check) == []
    assert failing(spark, "a string", ("99",), check) == []
    assert failing(spark, "a boolean", (True,), V.in_range("a", 2)) != []


def test_regex_is_anchored_at_the_start_only(spark):
    assert failing(spark, "a string", ("abc1",), V.matching("a", "abc")) == []
    assert failing(spark, "a string", ("xabc",), V.matching("a", "abc|q")) != []
    assert failing(spark, "a int", (7,), V.matching("a", "x")) == []


def test_custom_and_order(spark):
    positive = V.custom("a", lambda c: c > 0, "Must be positive")
    assert failing(spark, "a int, b string", (-1, ""), V.required("b"), positive) == [
        ("required", "b is required"),
        ("custom", "Must be positive"),
    ]
    assert failing(spark, "a int", (None,), positive) == []


def test_config_and_summary(spark):
    rules = V.rules_from_config([{"field": "a", "rule_type": "range", "params": {"min": 1}, "message": "low"}, {"field": "b", "rule_type": "required"}])
    df = spark.createDataFrame([(0, "x"), (5, None)], "a int, b string")
    got = rows(V.validation_summary(df, rules), "field", "message", "failures", "records")
    assert got == [("a", "low", 1, 2), ("b", "", 1, 2)]


def test_variant_values(spark):
    assert variant_failing(spark, "3", V.of_type("v", "int"), V.of_type("v", "float")) == []
    assert variant_failing(spark, "3.5", V.of_type("v", "int")) == ["v must be int"]
    assert variant_failing(spark, "true", V.of_type("v", "int"), V.in_range("v", 2)) == ["v out of range"]
    assert variant_failing(spark, '"x"', V.of_type("v", "float"), V.in_range("v", 2), V.matching("v", "y")) == [
        "v must be float",
        "v does not match pattern",
    ]
    assert variant_failing(spark, "null", V.required("v"), V.of_type("v", "int")) == ["v is required"]
    assert variant_failing(spark, '" "', V.required("v")) == ["v is required"]


def test_item_completeness(spark):
    data = [("t", 0, {"title": "x"}), ("t", 1, {"price": "1", "title": ""})]
    df = spark.createDataFrame(data, "k string, pos int, fields map<string,string>")
    got = V.item_completeness(df, ["k"], ["title", "price"], min_items=3).first()
    assert (got["completeness_score"], got["count_warning"]) == (50.0, "Expected at least 3 items, got 2")
    missing = rows(V.missing_item_fields(df, ["k"], ["title", "price"]), "field", "rule_type", "message")
    assert missing == [
        ("data[0].price", "missing", "Missing or empty field 'price' in item 0"),
        ("data[1].title", "missing", "Missing or empty field 'title' in item 1"),
    ]
    assert V.item_completeness(df, ["k"], []).first()["completeness_score"] == 100.0
    assert V.missing_item_fields(df, ["k"], []).count() == 0


def test_empty_item_lists_are_warned_of(spark):
    items = spark.createDataFrame([("t", 0, {"title": "x"}), (None, 0, {"title": ""})], "k string, pos int, fields map<string,string>")
    lists = spark.createDataFrame([("t",), ("empty",), ("empty",), (None,)], "k string")
    got = {r["k"]: tuple(r)[1:] for r in V.item_completeness(items, ["k"], ["title"], 1, lists).collect()}
    assert got == {"t": (1, 1, 100.0, None), None: (1, 0, 0.0, None), "empty": (0, 0, 100.0, "Expected at least 1 items, got 0")}
