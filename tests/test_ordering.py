"""The balanced way must give what the plain window gives."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from crawlmill.operators import ordering as O


def frame(spark, n=600, hot_share=0.4, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < hot_share else f"k{rng.randrange(20)}"
        data.append((key if rng.random() > 0.02 else None, rng.randrange(5), i, rng.random()))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, a int, seq int, v double")


def test_hot_keys_are_found_and_bounded(spark):
    df = frame(spark)
    hot = O.hot_keys(df, ["k"], rows_per_task=100)
    expected = df.filter("k = 'hot'").select(O.key_hash(["k"])).first()[0]
    assert hot == {expected: df.filter("k = 'hot'").count()}
    assert O.hot_keys(df, ["k"], rows_per_task=10**6) == {}


@pytest.mark.parametrize("rows_per_task", [5, 100])
def test_position_and_previous_match_the_plain_window(spark, rows_per_task):
    df = frame(spark)
    order = [F.col("a").desc(), F.col("seq")]
    plain = O.with_previous(O.with_position(df, ["k"], order, "n"), ["k"], order, {"pv": "v", "pa": "a"})
    cut = O.with_previous(
        O.with_position(df, ["k"], order, "n", rows_per_task), ["k"], order, {"pv": "v", "pa": "a"}, rows_per_task
    )
    assert plain.columns == cut.columns
    assert sorted(rows(plain), key=repr) == sorted(rows(cut), key=repr)


def test_equal_first_order_values_are_cut_too(spark):
    df = spark.range(500).select(F.lit("one").alias("k"), F.lit(3).alias("a"), F.col("id").alias("seq"))
    got = O.with_position(df, ["k"], ["a", "seq"], "n", rows_per_task=10)
    assert rows(got.orderBy("seq"), "n") == [(i + 1,) for i in range(500)]
    pieces = O.range_pieces(df, ["k", "a", "seq"], 8)
    assert pieces.select("__part").distinct().count() > 1


def test_dense_id_has_no_gaps_and_goes_on(spark):
    df = frame(spark, 300)
    got = rows(O.with_dense_id(df, ["seq"], "id", start=10).orderBy("seq"), "id")
    assert got == [(i + 11,) for i in range(300)]


def test_a_small_file_with_one_heavy_key_is_looked_at(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("1 as k", "id as seq").write.parquet(path)
    df = spark.read.parquet(path)
    assert list(O.hot_keys(df, ["k"], rows_per_task=10_000).values()) == [20_000]
