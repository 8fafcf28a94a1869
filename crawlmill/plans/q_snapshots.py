"""Snapshot and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as S
from ..session import scratch_path
from ..sources.readers import read_table
from ..streaming import monitors as M
from . import inputs as I
from .q_prices import _ALERT_SQL
from .registry import fill, query, rnd

_PAIRS_SQL = f"""hashed AS (SELECT *, {I.HASH_SQL} AS hash FROM snaps),
pairs AS (SELECT url, lag(seq) OVER w AS old_seq, seq AS new_seq, lag(hash) OVER w AS old_hash, hash AS new_hash,
  lag(content) OVER w AS old_content, content AS new_content
  FROM hashed WINDOW w AS (PARTITION BY url ORDER BY ts, seq) QUALIFY old_seq IS NOT NULL)"""


@query("snapshot_hash", f"WITH {I.SNAPSHOTS_SQL} SELECT url, seq, {I.HASH_SQL} AS content_hash FROM snaps")
def snapshot_hash(spark, folder):
    return I.snapshots(spark, folder).select("url", "seq", S.content_hash("content").alias("content_hash"))


@query(
    "snapshot_history",
    f"""WITH {I.SNAPSHOTS_SQL} SELECT url, {I.HASH_SQL} AS content_hash,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, length(content) AS content_length,
  row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS version FROM snaps""",
)
def snapshot_history(spark, folder):
    path = S.export_history(I.snapshots(spark, folder), scratch_path(spark, "history"))
    schema = "url bigint, content_hash string, timestamp string, content_length bigint, version bigint"
    return spark.read.schema(schema).json(path)


@query(
    "snapshot_pairs",
    f"""WITH {I.SNAPSHOTS_SQL}, {_PAIRS_SQL}
SELECT url, old_seq, new_seq, old_hash, new_hash, old_hash <> new_hash AS changed FROM pairs""",
)
def snapshot_pairs(spark, folder):
    pairs = S.consecutive_pairs(I.snapshots(spark, folder))
    changed = (F.col("old_hash") != F.col("new_hash")).alias("changed")
    return pairs.select("url", "old_seq", "new_seq", "old_hash", "new_hash", changed)


@query(
    "snapshot_version_pair",
    f"""WITH {I.SNAPSHOTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS up,
  row_number() OVER (PARTITION BY url ORDER BY ts DESC, seq DESC) AS down, count(*) OVER (PARTITION BY url) AS n FROM snaps)
SELECT a.url, a.seq AS old_seq, b.seq AS new_seq FROM r a JOIN r b ON a.url = b.url
WHERE a.up = 1 AND b.down = 3 AND a.n >= 2""",
)
def snapshot_version_pair(spark, folder):
    return S.version_pair(I.snapshots(spark, folder), 0, -3).select("url", "old_seq", "new_seq")


@query(
    "change_summary",
    f"""WITH {I.SNAPSHOTS_SQL}, u AS (SELECT url, count(*) AS n, count(DISTINCT {I.HASH_SQL}) AS d FROM snaps GROUP BY url)
SELECT count(*) AS urls_tracked, CAST(sum(n) AS BIGINT) AS total_snapshots, count(*) FILTER (d > 1) AS urls_with_changes FROM u""",
)
def change_summary(spark, folder):
    return S.change_summary(I.snapshots(spark, folder))


_LINES = "regexp_split_to_array(regexp_replace({}, '(@BREAK@)$', ''), '@BREAK@')"
_BAGS_SQL = fill(
    f"""sides AS (SELECT url, old_seq, new_seq, unnest({_LINES.format('old_content')}) AS line, 1 AS o, 0 AS n FROM pairs
  UNION ALL SELECT url, old_seq, new_seq, unnest({_LINES.format('new_content')}), 0, 1 FROM pairs),
bags AS (SELECT url, old_seq, new_seq, line, CAST(sum(o) AS BIGINT) AS o, CAST(sum(n) AS BIGINT) AS n FROM sides GROUP BY ALL)"""
)


@query(
    "snapshot_bagdiff",
    f"""WITH {I.SNAPSHOTS_SQL}, {_PAIRS_SQL}, {_BAGS_SQL}
SELECT url, old_seq, new_seq, line, greatest(n - o, 0) AS added, greatest(o - n, 0) AS removed FROM bags WHERE o <> n""",
)
def snapshot_bagdiff(spark, folder):
    snaps = I.snapshots(spark, folder)
    return S.bag_diff(S.consecutive_pairs(snaps), snaps)


@query(
    "snapshot_bag_similarity",
    f"""WITH {I.SNAPSHOTS_SQL}, {_PAIRS_SQL}, {_BAGS_SQL}
SELECT url, old_seq, new_seq, {rnd("2 * sum(least(o, n)) / sum(o + n)", 4)} AS similarity FROM bags GROUP BY ALL""",
)
def snapshot_bag_similarity(spark, folder):
    snaps = I.snapshots(spark, folder)
    return S.bag_similarity(S.consecutive_pairs(snaps), snaps)


# --- streaming ------------------------------------------------------------------------------------


def _stream(spark, folder, name):
    """A table read as a stream; a micro-batch has about 256 MB or one file, cut into ranges for its tasks."""
    schema = read_table(spark, folder, name).schema
    # a glob: the table may be one file or a folder of part files
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", 256 << 20).parquet(f"{folder}/{{{name}.parquet}}")


def _drained(spark, stream, label):
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    M.drain(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_price_alerts",
    f"""WITH steps AS (SELECT event_type AS product, user_id AS source, event_id AS seq, value AS current_price,
  lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS previous_price FROM events)
SELECT product, source, seq, current_price, previous_price, change_pct, alert_type FROM ({_ALERT_SQL})""",
)
def stream_price_alerts(spark, folder):
    stream = M.price_alerts(I.event_prices_of(_stream(spark, folder, "events")))
    return _drained(spark, stream, "alerts").drop("observed_at")


@query(
    "stream_ingest",
    f"""WITH items AS (SELECT event_type AS product, user_id, event_id AS seq, ts,
    CASE WHEN event_id % 11 = 0 THEN 'sold out' WHEN event_id % 13 = 0 THEN '' ELSE '$' || CAST(value AS VARCHAR) END AS price FROM events),
obs AS (SELECT product, user_id AS source, ts, seq, CAST(substr(price, 2) AS DOUBLE) AS price
  FROM items JOIN customer ON c_custkey = user_id WHERE c_acctbal > 0 AND price LIKE '$%'),
steps AS (SELECT product, source, seq, price AS current_price,
  lag(price) OVER (PARTITION BY product, source ORDER BY ts, seq) AS previous_price FROM obs)
SELECT product, 'shop ' || source AS source, seq, current_price, previous_price, change_pct, alert_type FROM ({_ALERT_SQL})""",
)
def stream_ingest(spark, folder):
    """Items of shops in the table of customers, some delivered twice, as a stream into price alerts."""
    targets = read_table(spark, folder, "customer").filter("c_acctbal > 0").selectExpr(
        "concat('shop ', c_custkey) AS target", "'title' AS name_field", "CASE WHEN c_custkey % 2 = 0 THEN 'price' ELSE 'cost' END AS price_field"
    )
    stream = M.ingested(I.scraped_items_of(_stream(spark, folder, "events")), targets)
    return _drained(spark, stream, "ingest").drop("observed_at")


@query(
    "stream_page_changes",
    f"""WITH {I.SNAPSHOTS_SQL}, {_PAIRS_SQL}
SELECT url, new_seq AS seq, old_hash AS previous_hash, new_hash AS content_hash FROM pairs WHERE old_hash <> new_hash""",
)
def stream_page_changes(spark, folder):
    stream = M.page_changes(I.snapshots_of(_stream(spark, folder, "conversations")))
    return _drained(spark, stream, "changes").drop("ts")


@query(
    "stream_run_counts",
    f"""WITH {I.RUNS_SQL}, w AS (SELECT date_trunc('hour', ts) AS s, count(*) FILTER (success) AS run_count,
  count(*) FILTER (NOT success) AS error_count FROM runs GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, run_count, error_count FROM w""",
)
def stream_run_counts(spark, folder):
    counts = _drained(spark, M.run_counts(I.runs_of(_stream(spark, folder, "events"))), "counts")
    return M.latest_counts(counts).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "run_count", "error_count")


@query(
    "stream_run_history",
    f"""WITH {I.RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS position FROM runs)
SELECT job, seq, success, position FROM r WHERE position <= 10""",
)
def stream_run_history(spark, folder):
    """The newest ten runs of each job, held as a stream's state."""
    runs = I.runs_of(_stream(spark, folder, "events")).select("job", "ts", "seq", "success")
    return M.latest_history(_drained(spark, M.run_history(runs), "history")).drop("ts")


@query(
    "stream_price_alerts_expiring",
    f"""WITH steps AS (SELECT event_type AS product, user_id AS source, event_id AS seq, value AS current_price,
  CASE WHEN ts - lag(ts) OVER o <= INTERVAL 1 DAY THEN lag(value) OVER o END AS previous_price
  FROM events WINDOW o AS (PARTITION BY event_type, user_id ORDER BY ts, event_id))
SELECT product, source, seq, current_price, previous_price, change_pct, alert_type FROM ({_ALERT_SQL})""",
)
def stream_price_alerts_expiring(spark, folder):
    """Price alerts against prices of the last day only; other products leave the state."""
    stream = M.price_alerts(I.event_prices_of(_stream(spark, folder, "events")), keep="1 day")
    return _drained(spark, stream, "alerts").drop("observed_at")
