"""Tables drawn from page HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H


def word_frequency(pages: DataFrame, key: str, html: str = "html", k: int = 20) -> DataFrame:
    """The ``k`` most frequent words of each page's visible and script text."""
    return pages.select(key, F.posexplode(H.top_words(html, k)).alias("pos", "t")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("t.term").alias("word"), F.col("t.n").alias("n")
    )


def tag_counts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Opening tags per page and tag name."""
    return pages.select(key, F.explode(H.term_counts_of_tags(html)).alias("t")).select(
        key, F.col("t.term").alias("tag"), F.col("t.n").alias("n")
    )


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per link in page order with its kind; links of neither kind are left out."""
    return (
        pages.select(key, F.posexplode(H.link_targets(html)).alias("pos", "link"))
        .withColumn("kind", H.link_kind(F.col("link")))
        .filter("kind is not null")
    )


def link_report(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Link counts, external domains and link score per page."""
    return (
        pages.select(key, H.link_facts(html).alias("f"))
        .select(key, "f.*", H.link_quality(F.col("f")).alias("quality_score"))
    )


def issues(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per technical issue."""
    return pages.select(key, F.inline(H.issues(html)))


def scores(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Element counts, number of issues and content score per page."""
    facts = pages.select(key, H.element_counts(html).alias("e"), H.issues(html).alias("i"))
    return facts.select(
        key,
        "e.*",
        F.size("i").cast("bigint").alias("issue_count"),
        H.content_score(F.col("e.word_count"), F.col("e.heading_count"), F.col("i")).alias("content_score"),
    )
