"""Expressions over raw HTML text, by pattern only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SPACE, col, let, match_count, matches, ratio
from .text import term_counts, top_terms, word_count
from .urls import netloc

# fixed values: these patterns decide what counts as a tag, link, title, ...
TAG_NAME = r"<(\w+)[^>]*>"
LINK_WITH_HREF = r"(?i)<a\b[^>]*href="
LINK_TARGET = r"""(?i)<a\s+[^>]*href=["']([^"']+)["']"""
IMAGE = r"(?i)<img\b"
IMAGE_TAG = r"(?i)<img\b[^>]*>"
ALT_TEXT = r"""(?i)alt=["'][^"']+["']"""
TITLE = r"(?is)<title\b[^>]*>.+?</title>"
DESCRIPTION = r"""(?i)<meta\s+[^>]*name=["']description["'][^>]*>"""
H1 = r"(?i)<h1\b[^>]*>"
HEADING = r"(?i)<h[1-6]\b"

ISSUE = "struct<issue_type:string,severity:string,description:string,suggestion:string>"


def strip_tags(html: Column | str) -> Column:
    """Tags become spaces; script and style bodies and entities stay."""
    return F.regexp_replace(col(html), "<[^>]+>", " ")


def tag_names(html: Column | str) -> Column:
    return matches(col(html), TAG_NAME, 1)


def term_counts_of_tags(html: Column | str) -> Column:
    return term_counts(tag_names(html))


def page_words(html: Column | str) -> Column:
    return matches(F.lower(strip_tags(html)), f"[^{SPACE}]+")


def top_words(html: Column | str, k: int = 20) -> Column:
    return top_terms(page_words(html), k)


def element_counts(html: Column | str) -> Column:
    """Struct of words, headings, links and images of a page."""
    h = col(html)
    return F.struct(
        word_count(strip_tags(h)).alias("word_count"),
        match_count(h, HEADING).cast("bigint").alias("heading_count"),
        match_count(h, LINK_WITH_HREF).cast("bigint").alias("link_count"),
        match_count(h, IMAGE).cast("bigint").alias("image_count"),
    )


def _issue(cond: Column, issue_type: str, severity: str, description, suggestion: str) -> Column:
    shown = description if isinstance(description, Column) else F.lit(description)
    return F.when(
        cond,
        F.struct(
            F.lit(issue_type).alias("issue_type"),
            F.lit(severity).alias("severity"),
            shown.alias("description"),
            F.lit(suggestion).alias("suggestion"),
        ),
    )


def issues(html: Column | str) -> Column:
    """Technical problems of a page as an array of issue structs."""
    h = col(html)
    facts = F.struct(
        h.rlike(TITLE).alias("title"),
        h.rlike(DESCRIPTION).alias("description"),
        match_count(h, H1).alias("h1"),
        F.size(F.filter(matches(h, IMAGE_TAG), lambda tag: ~tag.rlike(ALT_TEXT))).alias("no_alt"),
        match_count(h, LINK_WITH_HREF).alias("links"),
    )

    def listed(f: Column) -> Column:
        number = lambda c: c.cast("string")
        return F.array_compact(
            F.array(
                _issue(
                    ~f["title"],
                    "missing_title",
                    "high",
                    "Page is missing a <title> tag.",
                    "Add a unique, descriptive <title> tag (50-60 characters).",
                ),
                _issue(
                    ~f["description"],
                    "missing_meta_description",
                    "high",
                    "Page is missing a meta description.",
                    "Add a <meta name='description'> tag (120-160 characters).",
                ),
                _issue(
                    f["h1"] == 0,
                    "missing_h1",
                    "high",
                    "Page has no <h1> heading.",
                    "Add exactly one <h1> tag with the primary keyword.",
                ),
                _issue(
                    f["h1"] > 1,
                    "multiple_h1",
                    "medium",
                    F.concat(F.lit("Page has "), number(f["h1"]), F.lit(" <h1> tags (should be 1).")),
                    "Use only one <h1> tag per page; use <h2>-<h6> for sub-headings.",
                ),
                _issue(
                    f["no_alt"] > 0,
                    "images_missing_alt",
                    "medium",
                    F.concat(number(f["no_alt"]), F.lit(" image(s) missing alt text.")),
                    "Add descriptive alt attributes to all <img> tags.",
                ),
                _issue(
                    f["links"] < 2,
                    "too_few_links",
                    "low",
                    F.concat(F.lit("Page has only "), number(f["links"]), F.lit(" link(s).")),
                    "Add internal and external links to improve SEO.",
                ),
            )
        )

    return let(facts, listed)


def content_score(word_count_: Column, heading_count: Column, issue_list: Column) -> Column:
    """Page score 0 to 100 from its size, headings and issues."""
    size_points = F.when(word_count_ >= 1000, 20).when(word_count_ >= 300, 10).otherwise(-10)
    heading_points = F.when(heading_count >= 3, 15).when(heading_count >= 1, 5).otherwise(0)
    penalty = F.aggregate(
        issue_list,
        F.lit(0),
        lambda acc, i: acc
        + F.when(i["severity"] == "high", 10).when(i["severity"] == "medium", 5).otherwise(2),
    )
    raw = F.lit(50) + size_points + heading_points - penalty
    return F.least(F.greatest(raw, F.lit(0)), F.lit(100)).cast("double")


def link_targets(html: Column | str) -> Column:
    return matches(col(html), LINK_TARGET, 1)


def _internal(link: Column) -> Column:
    return link.startswith("/") | link.startswith("#") | link.startswith("?")


def _external(link: Column) -> Column:
    return link.startswith("http://") | link.startswith("https://")


def link_kind(link: Column) -> Column:
    return F.when(_internal(link), "internal").when(_external(link), "external")


def link_facts(html: Column | str) -> Column:
    """Struct of internal and external link counts and the sorted external domains."""

    def counted(links: Column) -> Column:
        outside = F.filter(links, _external)
        hosts = F.filter(F.transform(outside, netloc), lambda d: d != "")
        return F.struct(
            F.size(F.filter(links, _internal)).cast("bigint").alias("internal_count"),
            F.size(outside).cast("bigint").alias("external_count"),
            F.sort_array(F.array_distinct(hosts)).alias("domains"),
        )

    return let(link_targets(html), counted)


def link_quality(facts: Column) -> Column:
    """Link score 0 to 100 of a ``link_facts`` struct; 0 without links."""
    inside, outside, hosts = facts["internal_count"], facts["external_count"], F.size(facts["domains"])
    total = inside + outside
    balance = ratio(inside, outside)
    raw = (
        F.when((inside > 0) & (outside > 0), 30).otherwise(10)
        + F.when(balance.between(2, 5), 30).when(balance.between(1, 10), 15).otherwise(0)
        + F.when(hosts >= 5, 30).when(hosts >= 3, 20).when(hosts >= 1, 10).otherwise(0)
        + F.when(total >= 20, 10).when(total >= 10, 5).otherwise(0)
    )
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(raw, F.lit(100)).cast("double"))
