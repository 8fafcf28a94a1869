"""Registered queries on tables that are laid out or filled otherwise than the given small ones."""

import duckdb
from helpers import rows

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def want(name, **tables):
    con = duckdb.connect()
    for t, files in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con.execute(entry.ORACLES[name])


def same_rows(df, result):
    columns = [d[0] for d in result.description]
    return sorted(rows(df, *columns), key=str) == sorted(result.fetchall(), key=str)


def test_pages_that_share_a_url_keep_their_own_targets(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").selectExpr(
        "page_id", "CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat('http://a.b/', page_id % 3) END AS url", "html"
    )
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = entry.queries()["extract_by_url"](spark, str(tmp_path))
    assert same_rows(got, want("extract_by_url", pages=tmp_path / "pages.parquet/*.parquet"))


def test_a_stream_reads_a_table_of_part_files(spark, tmp_path):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = entry.queries()["stream_page_changes"](spark, str(tmp_path))
    assert got.count() > 0
    assert same_rows(got, want("stream_page_changes", conversations=tmp_path / "conversations.parquet/*.parquet"))
