"""Streams must give what the batch operators give, however the rows fall into micro-batches."""

import random

import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from crawlmill.operators import prices as P
from crawlmill.operators import runs as R
from crawlmill.operators import snapshots as S
from crawlmill.session import scratch_path
from crawlmill.streaming import monitors as M


def drained(spark, make, df, files, tmp_path):
    """Write ``df`` as ordered files, stream them one per micro-batch, return what came out."""
    source = str(tmp_path / "in")
    for i in range(files):
        part = df.filter((F.col("seq") * files / df.count()).cast("int") == i)
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = scratch_path(spark, "stream-out")
    result = make(stream)
    M.drain(result, out, scratch_path(spark, "stream-checkpoint"))
    return spark.read.schema(result.schema).parquet(out)


@pytest.mark.parametrize("files", [1, 3])
def test_alerts(spark, tmp_path, files):
    rng = random.Random(files)
    data = [(rng.choice("pq"), float(rng.choice([0, 10, 11, 20])), rng.choice("st"), i) for i in range(120)]
    df = spark.createDataFrame(data, "product string, price double, source string, seq bigint")
    df = df.withColumn("observed_at", F.timestamp_seconds(F.col("seq")))
    got = drained(spark, M.price_alerts, df, files, tmp_path)
    want = P.price_alerts(df)
    assert sorted(rows(got.select(want.columns))) == sorted(rows(want))


def test_a_heavy_key_is_cut_and_stitched(spark, tmp_path, monkeypatch):
    """One key with most rows, unordered in the files: few of its rows reach the key's task, and none is lost."""
    monkeypatch.setattr(M, "SHORT", 5)
    rng = random.Random(3)
    data = [("p" if i % 10 else rng.choice("pqr"), float(rng.choice([10, 11, 20])), None if i % 97 == 0 else "s", i) for i in range(4000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "product string, price double, source string, seq bigint")
    df = df.withColumn("observed_at", F.timestamp_seconds((F.col("seq") / 7).cast("bigint")))
    got = drained(spark, M.price_alerts, df, 2, tmp_path)
    want = P.price_alerts(df)
    assert sorted(rows(got.select(want.columns)), key=str) == sorted(rows(want), key=str)
    batch = pa.RecordBatch.from_pylist([{"k": k, "at": at, "v": at * at} for k, at in [("a", 2), ("b", 1), *(("a", i) for i in range(3, 500))]])
    marked = pa.Table.from_batches(M._stretches(["k"], ["at"], "v")([batch])).to_pylist()
    assert len(marked) == 499 and [(r["k"], r["at"]) for r in marked if r["stretch_slot"] == 0] == [("a", 2), ("a", 499), ("b", 1)]
    assert [r["previous"] for r in marked if r["k"] == "a"] == [None, *(i * i for i in range(2, 499))] and marked[-1]["previous"] is None


def test_changes_back_and_forth(spark, tmp_path):
    data = [("u", c, i) for i, c in enumerate("AABAAB")]
    df = spark.createDataFrame(data, "url string, content string, seq bigint").withColumn("ts", F.timestamp_seconds("seq"))
    got = drained(spark, M.page_changes, df, 2, tmp_path)
    assert sorted(r["seq"] for r in got.collect()) == [2, 3, 5]
    pairs = S.consecutive_pairs(df).filter("old_hash <> new_hash")
    assert sorted(rows(got, "previous_hash", "content_hash")) == sorted(rows(pairs, "old_hash", "new_hash"))


@pytest.mark.parametrize("files", [1, 2, 5])
def test_run_counts_leave_the_stream(spark, tmp_path, files):
    """Closed windows come out once as such, open ones as well; together they are the counts of the table."""
    data = [(None if i % 10 == 9 else i % 3 > 0, i) for i in range(60)]
    df = spark.createDataFrame(data, "success boolean, seq bigint")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 300))
    out = drained(spark, lambda d: M.run_counts(d, "1 hour", "10 minutes"), df, files, tmp_path)
    # the newest row is at 4:55, so windows ending at 4:00 or before are closed
    assert out.filter("closed").count() == 4
    got = M.latest_counts(out).orderBy("start")
    hour = F.window("ts", "1 hour")["start"].alias("start")
    want = df.groupBy(hour).agg(F.count_if("success"), F.count_if(~F.col("success"))).orderBy("start")
    assert rows(got, "start", "run_count", "error_count") == rows(want)
    assert rows(got, "closed") == [(True,)] * 4 + [(False,)]


def test_late_runs_are_not_counted(spark, tmp_path):
    data = [(True, 0, 100), (True, 1, 20_000), (True, 2, 200), (False, 3, 20_100), (True, 4, None)]
    df = spark.createDataFrame(data, "success boolean, seq bigint, at bigint").withColumn("ts", F.timestamp_seconds("at"))
    out = drained(spark, lambda d: M.run_counts(d.drop("at"), "1 hour", "10 minutes"), df, 5, tmp_path)
    got = M.latest_counts(out).orderBy("start")
    assert rows(got, "run_count", "error_count", "closed") == [(1, 0, True), (1, 1, False)]


@pytest.mark.parametrize("files", [1, 2, 6])
def test_history_is_bounded_and_survives_disorder(spark, tmp_path, files):
    """Runs that come out of order, one very busy job, jobs and times without a value: the lists equal the batch ones."""
    rng = random.Random(files)
    data = []
    for i in range(600):
        job = rng.choice(["busy", "busy", "busy", "a", "b", None])
        at = None if i % 50 == 0 else rng.randint(0, 400)
        data.append((job, at, i, rng.random() < 0.7, rng.choice(["ok", None])))
    df = spark.createDataFrame(data, "job string, at bigint, seq bigint, success boolean, result string")
    df = df.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    out = drained(spark, lambda d: M.run_history(d, 7), df, files, tmp_path)
    assert out.groupBy("job", "version").count().agg(F.max("count")).first()[0] <= 7
    got, want = M.latest_history(out), R.recent_runs(df, 7)
    columns = ["job", "ts", "seq", "success", "result", "position"]
    assert sorted(rows(got, *columns), key=str) == sorted(rows(want, *columns), key=str)


@pytest.mark.parametrize("files", [1, 4])
def test_prices_expire(spark, tmp_path, files, monkeypatch):
    """With ``keep`` only prices that are young enough count, however rows fall into micro-batches; old keys leave the state."""
    monkeypatch.setattr(M, "SHORT", 3)
    rng = random.Random(5)
    data, at = [], 0
    for i in range(400):
        at += rng.choice([1, 1, 5, 40])
        product = "gone" if i < 20 else rng.choice("pppq")
        data.append((product, float(rng.choice([10, 11, 20])), "s", i, at * 60))
    df = spark.createDataFrame(data, "product string, price double, source string, seq bigint, at bigint")
    df = df.withColumn("observed_at", F.timestamp_seconds("at")).drop("at")
    got = drained(spark, lambda d: M.price_alerts(d, keep="30 minutes", late="1 minute"), df, files, tmp_path)
    last, want = {}, []
    for product, price, source, i, at in data:
        before = last.get(product)
        if before and at - before[1] <= 30 * 60 and before[0] != price:
            change = (price - before[0]) / before[0] * 100
            if abs(change) >= 5:
                want.append((product, i, before[0], price))
        last[product] = (price, at)
    assert sorted(rows(got, "product", "seq", "previous_price", "current_price")) == sorted(want)


def test_expired_keys_leave_the_state(spark, tmp_path):
    data = [("old", 10.0, "s", 0, 0), ("new", 10.0, "s", 1, 9_000), ("new", 11.0, "s", 2, 9_060), ("new", 12.0, "s", 3, 9_120)]
    df = spark.createDataFrame(data, "product string, price double, source string, seq bigint, at bigint")
    df = df.withColumn("observed_at", F.timestamp_seconds("at")).drop("at")
    seen = {}

    def make(stream):
        seen["out"] = M.price_alerts(stream, keep="30 minutes", late="1 minute")
        return seen["out"]

    source = str(tmp_path / "in")
    for i in range(4):
        df.filter(F.col("seq") == i).coalesce(1).write.mode("append").parquet(source)
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    checkpoint = scratch_path(spark, "expiry-checkpoint")
    M.drain(stream, scratch_path(spark, "expiry"), checkpoint)
    held = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    assert [r["key"]["product"] for r in held.collect()] == ["new"]


@pytest.mark.parametrize("files", [1, 4])
def test_ingested_items(spark, tmp_path, files):
    """Items of known shops by the shop's field names, repeated deliveries in the same or a later micro-batch counted once."""
    rng = random.Random(11)
    data = []
    for i in range(200):
        shop = rng.choice(["s", "t", "unknown", None])
        price = rng.choice(["$10.00", "$11.00", "20", "1,000.50", "sold out", "", None])
        field = rng.choice(["price", "cost"])
        row = (shop, {"title": rng.choice("pq"), field: price}, i)
        # a second delivery comes up to thirty places later
        data.append((*row, i))
        if i % 4 == 0:
            data.append((*row, i + rng.randint(0, 30)))
    data.sort(key=lambda r: r[3])
    rows_ = [(t, f, k, n) for n, (t, f, k, _) in enumerate(data)]
    # `seq` orders the files here; `item` is the order of the items
    df = spark.createDataFrame(rows_, "target string, fields map<string,string>, item bigint, seq bigint")
    df = df.withColumn("observed_at", F.timestamp_seconds(F.col("item") * 60 + 1_700_000_000))
    targets = spark.createDataFrame([("s", "title", "price"), ("t", "title", "cost"), ("closed", "title", "cost")], "target string, name_field string, price_field string")
    as_items = lambda d: d.drop("seq").withColumnRenamed("item", "seq")
    got = drained(spark, lambda d: M.ingested(as_items(d), targets), df, files, tmp_path)
    want = P.ingest_targets(as_items(df), targets)
    assert want.count() > 20
    assert sorted(rows(got.select(want.columns)), key=str) == sorted(rows(want), key=str)


def test_groups_of_keys_share_a_state_value(spark, tmp_path, monkeypatch):
    """Many keys, some without a value: few state values, and each key's own previous price."""
    monkeypatch.setattr(M, "BUCKETS", 4, raising=False)
    data = [(f"p{i % 50}" if i % 50 else None, float(10 + i % 7), f"s{i % 3}", i) for i in range(600)]
    df = spark.createDataFrame(data, "product string, price double, source string, seq bigint")
    df = df.withColumn("observed_at", F.timestamp_seconds("seq"))
    source, checkpoint, out = str(tmp_path / "in"), scratch_path(spark, "groups-checkpoint"), scratch_path(spark, "groups")
    for i in range(2):
        df.filter((F.col("seq") >= 300) == bool(i)).coalesce(1).write.mode("append").parquet(source)
    result = M.price_alerts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    M.drain(result, out, checkpoint)
    want = P.price_alerts(df)
    assert want.count() > 300
    assert sorted(rows(spark.read.parquet(out).select(want.columns)), key=str) == sorted(rows(want), key=str)
    assert spark.read.format("statestore").option("stateVarName", "last").load(checkpoint).count() <= 4
