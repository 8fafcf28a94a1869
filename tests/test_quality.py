import math
import random
import statistics

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from crawlmill.operators import quality as Q


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_profile_counts_types_and_ranges(spark):
    data = [("a", 1.0, None, True, "2024-01-02"), ("a", 3.0, None, False, "x"), ("b", None, None, True, "01/02/2024")]
    p = by_column(Q.profile(spark.createDataFrame(data, "s string, n double, e string, b boolean, d string")))
    assert (p["s"]["dtype"], p["s"]["unique_count"], p["s"]["min_text"], p["s"]["max_text"]) == ("string", 2, "a", "b")
    assert p["s"]["cardinality_ratio"] == pytest.approx(2 / 3)
    assert (p["n"]["dtype"], p["n"]["null_count"], p["n"]["min_value"], p["n"]["max_value"]) == ("numeric", 1, 1, 3)
    assert p["n"]["mean"] == 2 and p["n"]["std"] == pytest.approx(statistics.stdev([1, 3]))
    assert (p["e"]["dtype"], p["e"]["null_ratio"], p["e"]["cardinality_ratio"]) == ("unknown", 1.0, 0.0)
    assert p["b"]["dtype"] == "boolean" and p["b"]["min_value"] is None
    assert p["d"]["dtype"] == "date" and p["d"]["min_text"] is None


def test_profile_edges(spark):
    assert Q.profile(spark.createDataFrame([], "a int")).count() == 0
    assert by_column(Q.profile(spark.createDataFrame([(5,)], "a int")))["a"]["std"] == 0.0
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)], "a double")
    assert by_column(Q.profile(zeros))["a"]["unique_count"] == 3
    assert by_column(Q.profile(zeros, nan_as_null=True))["a"]["null_count"] == 1
    assert by_column(Q.profile(zeros, approximate=True))["a"]["unique_count"] == 3


def test_completeness(spark):
    full = lambda df: Q.completeness(df).first()["completeness"]
    assert full(spark.createDataFrame([(1, "a"), (None, None)], "a int, b string")) == 0.5
    assert full(spark.createDataFrame([], "a int")) == 1.0
    assert full(spark.range(3).select()) == 0.0


def test_schema_rules(spark):
    df = spark.createDataFrame([(-5.0, "x", None), (150.0, "y", "z")], "n double, s string, r string")
    found = lambda *rules: rows(Q.check_schema(df, rules), "severity", "message")
    assert found(Q.SchemaRule("r", "string")) == [("error", "Column 'r' has 1 missing values but is required")]
    assert found(Q.SchemaRule("s", "numeric")) == [("error", "Column 's' has 2 values with wrong type (expected numeric)")]
    assert found(Q.SchemaRule("n", "numeric", min_value=0)) == [("warning", "Column 'n' has 1 values below minimum 0")]
    assert found(Q.SchemaRule("n", "numeric", max_value=100)) == [("warning", "Column 'n' has 1 values above maximum 100")]
    assert found(Q.SchemaRule("s", "date"), Q.SchemaRule("q", "numeric", required=False)) == []
    assert len(found(Q.SchemaRule("q", "numeric"))) == 1
    assert found() == []


def test_outliers(spark):
    values = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    assert rows(Q.outlier_rows(values([10, 11, 12, 13, 100]), "v")) == [(100.0,)]
    assert Q.outlier_rows(values([1, 1000]), "v").count() == 0
    f = Q.fences(values([3, 9]))[0]
    assert (f.lower, f.upper, f.active) == (3, 9, False)
    assert Q.outlier_fences(values([10, 11, 12, 13, 100])).first()["outlier_count"] == 1
    assert Q.outlier_fences(spark.createDataFrame([("a",)], "s string")).count() == 0


@pytest.mark.parametrize("n", [4, 5, 8, 9, 100, 101])
def test_quartiles_are_positions(spark, n):
    rng = random.Random(n)
    data = [float(rng.randrange(50)) for _ in range(n)]
    f = Q.fences(spark.createDataFrame([(x,) for x in data], "v double"))[0]
    s = sorted(data)
    assert (f.q1, f.q3) == (s[n // 4], s[3 * n // 4])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from(["spread", "ties", "tails"]))
def test_narrowing_finds_exact_ranks(spark, seed, shape):
    rng = random.Random(seed)
    pick = {
        "spread": lambda: rng.random() * 1e6,
        "ties": lambda: float(rng.choice([1, 1, 1, 2, 3, rng.randrange(100)])),
        "tails": lambda: rng.choice([-1, 1]) * math.exp(rng.random() * 200),
    }[shape]
    data = [pick() for _ in range(1500)] + [0.5]
    df = spark.createDataFrame([(x, -x) for x in data], "a double, b double").repartition(3)
    n = len(data)
    ranks = [0, n // 4, 3 * n // 4, n - 1]
    got = Q.order_statistics(df, {"a": (n, ranks), "b": (n, ranks)}, exact_rows=20)
    assert got["a"] == [sorted(data)[r] for r in ranks]
    assert got["b"] == [sorted(-x for x in data)[r] for r in ranks]


def test_quality_score_and_recommendations(spark):
    df = spark.createDataFrame([(float(i), None if i > 5 else "a") for i in [*range(20), 1000]], "v double, s string")
    score = Q.quality_score(df, [Q.SchemaRule("s", "string")]).first()
    assert score["validity"] == 0.9 and score["outlier_score"] == pytest.approx(1 - 1 / 21)
    expected = 0.4 * round(27 / 42, 4) + 0.4 * 0.9 + 0.2 * (1 - 1 / 21)
    assert score["overall_score"] == pytest.approx(expected, abs=5e-5)
    advice = [r["advice"] for r in Q.recommendations(df, [Q.SchemaRule("s", "string")]).orderBy("step", "position").collect()]
    assert advice == [
        "Data completeness is below 90%; consider imputing or collecting missing values",
        "Column 's' is over 50% null; consider dropping or imputing",
        "Schema validation found 1 error(s); review data pipeline",
        "Column 'v' has 1 outlier(s); review for data errors",
    ]
    clean = Q.quality_score(spark.createDataFrame([("a",)], "s string")).first()
    assert clean["overall_score"] == 1.0


def test_detect_types(spark):
    records = ['{"a": 1, "b": true, "d": "2024-01-01", "m": 1}', '{"a": 2.5, "b": false, "m": "x", "n": null}', '{"d": "2024-01-01T10:00"}']
    df = spark.createDataFrame([(r,) for r in records], "r string")
    got = {r["key"]: (r["dtype"], r["null_count"]) for r in Q.detect_types(df, "r").collect()}
    assert got == {"a": ("numeric", 1), "b": ("boolean", 1), "d": ("date", 1), "m": ("mixed", 1), "n": ("unknown", 3)}


def test_schema_rules_on_variant_values(spark):
    from pyspark.sql import functions as F

    texts = [("1",), ('"x"',), ("true",), ("null",), ("-5.5",), (None,)]
    df = spark.createDataFrame(texts, "t string").select(F.parse_json("t").alias("v"))
    found = rows(Q.check_schema(df, [Q.SchemaRule("v", "numeric", min_value=0)]), "severity", "message")
    assert found == [
        ("error", "Column 'v' has 2 missing values but is required"),
        ("error", "Column 'v' has 2 values with wrong type (expected numeric)"),
        ("warning", "Column 'v' has 1 values below minimum 0"),
    ]
