"""Profile of JSON records of changing keys."""

import json
import math
import statistics

import pytest

from crawlmill.operators import record_profile as P

RECORDS = [
    {"a": 1, "b": "x", "day": "2024-01-01", "flag": True, "mix": 1, "n": None},
    {"a": 2.5, "b": "y", "day": "2024-01-02", "flag": False, "mix": "1"},
    {"a": -7, "b": "", "day": "soon", "mix": [1, {"c": None}], "big": 12345678901234},
    {"a": None, "b": "x", "nest": {"c": [1, 2]}, "é ü": "日本", "a.b": 3},
    {"b": "zz", "nest": {"c": [1, 2]}, "a": 2.5},
    {},
]
BROKEN = ["{", "", "[1]", "7", "null", '"text"', None, "{'a': 1}"]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "r string").repartition(2)


@pytest.fixture(scope="module")
def by_key(spark):
    rows = P.profile_records(frame(spark, [json.dumps(r, ensure_ascii=False) for r in RECORDS] + BROKEN), "r").collect()
    assert len(rows) == len({r["key"] for r in rows})
    return {r["key"]: r for r in rows}


def test_keys_and_counts(by_key):
    assert set(by_key) == {k for r in RECORDS for k in r}
    for key, r in by_key.items():
        filled = [x[key] for x in RECORDS if x.get(key) is not None]
        assert r["row_count"] == len(RECORDS) and r["unreadable"] == len(BROKEN)
        assert r["null_count"] == len(RECORDS) - len(filled)
        assert r["null_ratio"] == r["null_count"] / len(RECORDS)
        assert r["unique_count"] == len({json.dumps(v) if isinstance(v, (dict, list)) else str(v) for v in filled})
        assert r["cardinality_ratio"] == (r["unique_count"] / len(filled) if filled else 0)


def test_labels(by_key):
    labels = {k: r["dtype"] for k, r in by_key.items()}
    assert labels == {
        "a": "numeric", "b": "string", "day": "date", "flag": "boolean", "mix": "mixed", "n": "unknown", "big": "numeric",
        "nest": "mixed", "é ü": "string", "a.b": "numeric",
    }


def test_range_and_moments(by_key):
    numbers = [1, 2.5, -7, 2.5]
    r = by_key["a"]
    assert (r["min_value"], r["max_value"], r["mean"]) == (-7, 2.5, statistics.mean(numbers))
    assert math.isclose(r["std"], statistics.stdev(numbers))
    assert (by_key["big"]["std"], by_key["big"]["mean"]) == (0.0, 12345678901234)
    assert (by_key["b"]["min_text"], by_key["b"]["max_text"]) == ("", "zz")
    for key in ("day", "mix", "flag", "n"):
        r = by_key[key]
        assert all(r[c] is None for c in ("min_value", "max_value", "mean", "std", "min_text", "max_text"))


def test_deviation_keeps_its_digits_far_from_zero(spark):
    values = [1e9 + x for x in (0.25, 0.5, 0.75, 0.5, 0.5)]
    r = P.profile_records(frame(spark, [json.dumps({"v": v}) for v in values]), "r").first()
    assert math.isclose(r["std"], statistics.stdev(values), rel_tol=1e-6)


def test_totals(spark):
    texts = [json.dumps(r) for r in RECORDS] + BROKEN
    filled = sum(v is not None for r in RECORDS for v in r.values())
    keys = len({k for r in RECORDS for k in r})
    r = P.completeness_of_records(frame(spark, texts), "r").first()
    assert tuple(r)[:5] == (14, 6, 8, keys, filled)
    assert r["completeness"] == round(filled / (6 * keys), 4)


@pytest.mark.parametrize("texts", [[], BROKEN, ["{}"]])
def test_nothing_to_profile(spark, texts):
    df = frame(spark, texts)
    assert P.profile_records(df, "r").count() == 0
    assert P.completeness_of_records(df, "r").first()["completeness"] == 1.0
