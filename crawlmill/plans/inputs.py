"""Operator inputs drawn from the test tables.

Some tables have none of the odd values an operator is about (missing cells, wrong URLs, images). Those
are put in by expressions over the row's own key; the SQL forms do the same, in ``*_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import Target, extract_items
from ..operators.ordering import spread
from ..sources.readers import read_table


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as price observations."""
    return read_table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_suppkey").alias("source"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
        F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )


# (date, order, line) is unique inside (product, source); across sources the rest decides
LATEST_ORDER = ("observed_at", "seq", "source", "price")

OBSERVATIONS_SQL = """obs AS (
  SELECT l_partkey AS product, l_extendedprice / l_quantity AS price, l_suppkey AS source,
         l_shipdate AS observed_at, l_orderkey, l_linenumber
  FROM lineitem)"""


def event_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a dense series of prices."""
    return event_prices_of(read_table(spark, folder, "events"))


def event_prices_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("product"),
        F.col("value").alias("price"),
        F.col("user_id").alias("source"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("seq"),
    )


def runs_of(events: DataFrame) -> DataFrame:
    """Events as a run log: one job per user, error events are failures."""
    failed = F.col("event_type") == "error"
    return events.select(
        F.col("user_id").alias("job"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (~failed).alias("success"),
        F.when(~failed, F.col("event_type")).alias("result"),
        F.when(failed, F.col("props")).alias("error"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_of(read_table(spark, folder, "events"))


RUNS_SQL = """runs AS (
  SELECT user_id AS job, ts, event_id AS seq, event_type <> 'error' AS success,
         CASE WHEN event_type <> 'error' THEN event_type END AS result,
         CASE WHEN event_type = 'error' THEN props END AS error
  FROM events)"""


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job per user seen in the events, with a cron text of several kinds."""
    users = read_table(spark, folder, "events").select("user_id").distinct()
    kind = F.col("user_id") % 9
    cron = (
        F.when(kind == 0, "*/5 * * * *")
        .when(kind == 1, " */15  * * * 1-5 ")
        .when(kind == 2, "0 * * * *")
        .when(kind == 3, "0 0 * * *")
        .when(kind == 4, "invalid")
        .when(kind == 5, "* * *")
        .when(kind == 6, "*/x * * * *")
        .when(kind == 7, "30 6 * * *")
        .otherwise("")
    )
    return users.select(
        F.col("user_id").alias("name"),
        (F.lit(60) * (1 + F.col("user_id") % 10)).cast("bigint").alias("interval_seconds"),
        (F.col("user_id") % 4 != 0).alias("enabled"),
        cron.alias("cron"),
    )


JOBS_SQL = """jobs AS (
  SELECT DISTINCT user_id AS name, CAST(60 * (1 + user_id % 10) AS BIGINT) AS interval_seconds,
    user_id % 4 <> 0 AS enabled,
    CASE user_id % 9 WHEN 0 THEN '*/5 * * * *' WHEN 1 THEN ' */15  * * * 1-5 ' WHEN 2 THEN '0 * * * *'
      WHEN 3 THEN '0 0 * * *' WHEN 4 THEN 'invalid' WHEN 5 THEN '* * *' WHEN 6 THEN '*/x * * * *'
      WHEN 7 THEN '30 6 * * *' ELSE '' END AS cron
  FROM events)"""

# --- pages ----------------------------------------------------------------------------------------

EXTRA_HTML = (
    "",
    '<img src="a.png"><img src="b.png" alt="b"><h2>More</h2><h2>Even more</h2>'
    '<a href="https://one.example.org/x">1</a><a class="c" href=\'http://two.example.org:80/\'>2</a>',
    '<H1>Second</H1><meta name="description" content="d"><a href="https://three.example.org">3</a>'
    '<a href="mailto:x@example.org">4</a><a href="#top">5</a><a href="?q=1">6</a>',
    '<a href="https://a.example.org/1">a</a><a href="https://b.example.org/2">b</a>'
    '<a href="https://c.example.org/3">c</a><a href="https://d.example.org/4">d</a>'
    '<a href="https://e.example.org/5">e</a><a href="/p">p</a><a href="/q">q</a><a href="/r">r</a>'
    '<a href="/s">s</a><img SRC="c.png" ALT="">',
)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "pages"), "page_id")


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with further images, headings, descriptions and links on three of four pages."""
    kind = F.col("page_id") % 4
    extra = F.lit("")
    for i, text in enumerate(EXTRA_HTML):
        extra = F.when(kind == i, text).otherwise(extra)
    return pages(spark, folder).withColumn("html", F.concat("html", extra))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


RICH_PAGES_SQL = "rich AS (SELECT page_id, url, html || CASE page_id % 4 {} END AS html FROM pages)".format(
    " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(EXTRA_HTML))
)


def odd_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs as they are, but for 7 of 32: other schemes, spaces, missing parts."""
    u, kind = F.col("url"), F.col("page_id") % 32
    odd = (
        F.when(kind == 1, F.concat(F.lit("ftp"), F.substring_index(u, "://", -1)))
        .when(kind == 2, F.substring_index(u, "://", -1))
        .when(kind == 3, F.concat(u, F.lit(" x")))
        .when(kind == 4, F.regexp_replace(u, "^(https?)://[^/]*", "$1://localhost"))
        .when(kind == 5, F.concat(F.lit(" "), F.replace(u, F.lit("http"), F.lit("HTTP"))))
        .when(kind == 6, F.concat(F.lit("ftp://"), F.substring_index(u, "://", -1)))
        .when(kind == 7, F.lit(""))
        .otherwise(u)
    )
    return read_table(spark, folder, "pages").select("page_id", odd.alias("url"), "html")


ODD_URLS_SQL = r"""odd AS (
  SELECT page_id, html, CASE page_id % 32
      WHEN 1 THEN 'ftp' || regexp_extract(url, '://(.*)$', 1)
      WHEN 2 THEN regexp_extract(url, '://(.*)$', 1)
      WHEN 3 THEN url || ' x'
      WHEN 4 THEN regexp_replace(url, '^(https?)://[^/]*', '\1://localhost')
      WHEN 5 THEN ' ' || replace(url, 'http', 'HTTP')
      WHEN 6 THEN 'ftp://' || regexp_extract(url, '://(.*)$', 1)
      WHEN 7 THEN '' ELSE url END AS url
  FROM pages)"""

NAV_PATTERN = '<li><a href="[^"]*">[^<]*</a></li>'
NAV = Target("nav", "", NAV_PATTERN)
NAV_LINKS = Target(
    "nav-links", "", NAV_PATTERN, {"name": ">([^<]*)</a>", "link_href": 'href="([^"]*)"', "price": 'class="price">([^<]*)<'}
)
ADS = Target("ads", "", '<div class="ad">[^<]*</div>')


def nav_items(spark: SparkSession, folder: str) -> DataFrame:
    return extract_items(pages(spark, folder), [NAV], ["page_id"])


# item texts carry no tags; entities are decoded
NAV_SQL = r"""nav AS (
  SELECT page_id, CAST(ord - 1 AS BIGINT) AS pos,
    replace(replace(replace(replace(regexp_extract(m, '>([^<]*)</a>', 1),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text,
    regexp_extract(m, 'href="([^"]*)"', 1) AS href
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS ms FROM pages),
    unnest(ms) WITH ORDINALITY AS t(m, ord))"""

# --- texts ----------------------------------------------------------------------------------------

EXTRA_TEXT = (
    "",
    " A great day, a good team and a Great success: no crisis. New York Times wrote about Anna.",
    " The software company had a bad error, a terrible crash and an awful bug! Is it good? Jane Doe",
    "\n\n# Heading one\n## Heading two\n### Heading three\nresearch study of the lab; best_word word2 naïve",
)


def scraped_items_of(events: DataFrame) -> DataFrame:
    """Events as items that a shop's page gave; some have no price, every fifth is delivered twice."""
    shown = F.concat(F.lit("$"), F.col("value").cast("string"))
    price = F.when(F.col("event_id") % 11 == 0, "sold out").when(F.col("event_id") % 13 == 0, "").otherwise(shown)
    field = F.when(F.col("user_id") % 2 == 0, "price").otherwise("cost")
    times = F.when(F.col("event_id") % 5 == 0, 2).otherwise(1)
    return events.select(
        F.concat(F.lit("shop "), F.col("user_id").cast("string")).alias("target"),
        F.create_map(F.lit("title"), F.col("event_type"), field, price).alias("fields"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("seq"),
        F.explode(F.sequence(F.lit(1), times)).alias("delivery"),
    ).drop("delivery")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a closing passage of plain English on three of four."""
    kind = F.col("doc_id") % 4
    extra = F.lit("")
    for i, text in enumerate(EXTRA_TEXT):
        extra = F.when(kind == i, text).otherwise(extra)
    base = spread(read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return base.withColumn("text", F.concat("text", extra))


DOCS_SQL = "docs AS (SELECT doc_id, lang, source, text || CASE doc_id % 4 {} END AS text FROM documents)".format(
    " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(EXTRA_TEXT))
)

ARTICLE_KEYWORDS = ("the", "in the", "que", "data", "C++")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select(
        "doc_id",
        "text",
        F.substring_index("text", "\n", 1).alias("title"),
        F.substring_index("text", "\n", -1).alias("meta"),
        F.array(*[F.lit(k) for k in ARTICLE_KEYWORDS]).alias("keywords"),
    )


ARTICLES_SQL = (
    DOCS_SQL
    + """, articles AS (
  SELECT doc_id, text, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), -1) AS meta FROM docs)"""
)

# --- snapshots ------------------------------------------------------------------------------------


def snapshots_of(conversations: DataFrame) -> DataFrame:
    """Conversation turns as page versions; beside every third page stands one that never changes."""
    conv = F.col("conv_id").cast("bigint")
    content = F.concat(F.lit("Page "), F.col("conv_id").cast("string"), F.lit("\n"), "text", F.lit("\n"), "role", F.lit("\n"))
    page = F.struct(conv.alias("url"), content.alias("content"))
    still = F.struct((-1 - conv).alias("url"), F.lit("static page\nno change").alias("content"))
    versions = F.when(conv % 3 == 0, F.array(page, still)).otherwise(F.array(page))
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 3600)
    return conversations.select(F.inline(versions), base.alias("ts"), F.col("turn").alias("seq"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots_of(read_table(spark, folder, "conversations"))


SNAPSHOTS_SQL = """turns AS (SELECT *, TIMESTAMP '2023-11-14 22:13:20' + to_hours(turn) AS ts FROM conversations),
snaps AS (
  SELECT conv_id AS url, turn AS seq, ts, 'Page ' || conv_id || chr(10) || text || chr(10) || role || chr(10) AS content FROM turns
  UNION ALL SELECT -1 - conv_id, turn, ts, 'static page' || chr(10) || 'no change' FROM turns WHERE conv_id % 3 = 0)"""

HASH_SQL = "substr(sha256(content), 1, 16)"
