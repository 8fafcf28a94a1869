import hashlib
import json
import random
from collections import Counter

import pytest
from helpers import one, rows
from pyspark.sql import functions as F

from crawlmill.operators import snapshots as S
from crawlmill.session import scratch_path


def snaps(spark, *versions):
    """(url, content) in order of time."""
    data = [(u, c, i) for i, (u, c) in enumerate(versions)]
    df = spark.createDataFrame(data, "url string, content string, seq bigint")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000))


def test_hash_and_lines(spark):
    assert one(spark, S.content_hash("t"), t=("héllo", "string")) == hashlib.sha256("héllo".encode()).hexdigest()[:16]
    for text in ("", "a", "a\n", "\n", "a\n\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h", "\n\nx"):
        assert one(spark, S.lines("t"), t=(text, "string")) == text.splitlines(), repr(text)


def test_bags_of_lines(spark):
    rng = random.Random(3)
    pages = [("u", "\n".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for _ in range(12)]
    table = snaps(spark, *pages)
    pairs = S.consecutive_pairs(table)
    got = {(r["old_seq"], r["line"]): (r["added"], r["removed"]) for r in S.bag_diff(pairs, table).collect()}
    alike = dict(rows(S.bag_similarity(pairs, table), "old_seq", "similarity"))
    for i, ((_, a), (_, b)) in enumerate(zip(pages, pages[1:])):
        x, y = Counter(a.splitlines()), Counter(b.splitlines())
        for line in set(x) | set(y):
            change = (max(y[line] - x[line], 0), max(x[line] - y[line], 0))
            assert got.get((i, line), (0, 0)) == change
        total = sum(x.values()) + sum(y.values())
        assert alike[i] == (round(2 * sum((x & y).values()) / total, 4) if total else 1.0)


def test_similarity_of_empty_pages(spark):
    table = snaps(spark, ("u", ""), ("u", ""))
    assert S.bag_similarity(S.consecutive_pairs(table), table).first()["similarity"] == 1.0


def test_pairs_after_a_version_without_content(spark):
    table = snaps(spark, ("u", "a"), ("u", None), ("u", "b"))
    assert rows(S.consecutive_pairs(table).orderBy("new_seq"), "old_seq", "new_seq") == [(0, 1), (1, 2)]


def test_summary(spark):
    table = snaps(spark, ("changed", "v1"), ("changed", "v2"), ("stable", "s"), ("stable", "s"))
    assert tuple(S.change_summary(table).first()) == (2, 4, 1)
    assert tuple(S.change_summary(table.limit(0)).first()) == (0, 0, 0)


@pytest.mark.parametrize("rows_per_task", [None, 2])
def test_history_and_pairs(spark, rows_per_task):
    table = snaps(spark, *[("u", f"v{i}") for i in range(9)], ("w", "x"))
    versions = rows(S.history(table, rows_per_task).filter("url = 'u'").orderBy("version"), "seq", "version")
    assert versions == [(i, i + 1) for i in range(9)]
    pairs = rows(S.consecutive_pairs(table, rows_per_task).orderBy("new_seq"), "old_seq", "new_hash")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    assert pairs == [(i, digest(f"v{i + 1}")) for i in range(8)]


def test_export(spark):
    path = S.export_history(snaps(spark, ("u", "v1"), ("u", "v22")), scratch_path(spark, "history"))
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert [(x["content_length"], x["timestamp"]) for x in lines] == [
        (2, "2023-11-14T22:13:20.000000Z"), (3, "2023-11-14T22:13:21.000000Z"),
    ]
    assert "content" not in lines[0]


def test_version_pairs(spark):
    table = snaps(spark, ("u", "a"), ("u", "b"), ("u", "c"), ("w", "x"))
    picked = lambda a, b: rows(S.version_pair(table, a, b), "url", "old_seq", "new_seq")
    assert picked(-2, -1) == [("u", 1, 2)]
    assert picked(0, -1) == [("u", 0, 2)]
    assert picked(0, 0) == [("u", 0, 0)]
    assert picked(2, 0) == [("u", 2, 0)]
    assert picked(5, 0) == picked(-4, -1) == []
