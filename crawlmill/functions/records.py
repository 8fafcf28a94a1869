"""Audits of fetched records, crawl targets (JSON texts) and selectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import blank, col, finding, findings, let, messages, round_to, strip
from .urls import audit as audit_url
from .urls import is_valid

MAX_CONTENT = 1_000_000


def audit_fetch(url, content, timestamp, status) -> Column:
    """Struct ``valid, issues, warnings`` of one fetched record; NULL means the field is missing."""
    u, c, ts, st = col(url), col(content), col(timestamp), col(status)
    issues = messages(
        [
            (u.isNull(), "Missing required field: url"),
            (u.isNotNull() & ~is_valid(u), "Invalid URL in result"),
            (c.isNull(), "Missing required field: content"),
            (ts.isNull(), "Missing required field: timestamp"),
        ]
    )
    warnings = messages(
        [
            (c == "", "Content is empty"),
            (st.isNull(), "Missing status_code field"),
            (st >= 400, F.concat(F.lit("HTTP error status: "), st.cast("string"))),
            (F.length(c) > MAX_CONTENT, "Content exceeds 1MB; consider truncating"),
        ]
    )
    return let(
        issues,
        lambda i: F.struct((F.size(i) == 0).alias("valid"), i.alias("issues"), warnings.alias("warnings")),
    )


def _field(config: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(config, f"$.{name}", as_type)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_whole(v: Column) -> Column:
    # True and False count as the numbers 1 and 0 here
    return _kind(v).isin("BIGINT", "BOOLEAN")


def _whole(config: Column, name: str) -> Column:
    v = _field(config, name)
    return F.when(
        _kind(v) == "BOOLEAN", _field(config, name, "boolean").cast("bigint")
    ).otherwise(_field(config, name, "bigint"))


def _is_object(config: Column) -> Column:
    return F.coalesce(_kind(config).startswith("OBJECT"), F.lit(False))


def audit_target(config: Column | str) -> Column:
    """Struct ``valid, issues, warnings`` of a crawl target given as JSON, ``fields`` being a list."""

    def checked(c: Column) -> Column:
        url, interval, name = _field(c, "url"), _field(c, "interval_seconds"), _field(c, "name")
        enabled, fields = _field(c, "enabled"), _field(c, "fields")
        given = lambda v: v.isNotNull() & (_kind(v) != "VOID")
        obj = _is_object(c)
        seconds = _whole(c, "interval_seconds")
        good_interval = _is_whole(interval) & (seconds > 0)
        is_list = _kind(fields).startswith("ARRAY")
        issues = messages(
            [
                (~obj, "Config must be a dictionary"),
                (obj & url.isNull(), "Missing required field: url"),
                (
                    obj & url.isNotNull() & ~((_kind(url) == "STRING") & is_valid(_field(c, "url", "string"))),
                    "Invalid URL in config",
                ),
                (
                    obj & given(interval) & ~F.coalesce(good_interval, F.lit(False)),
                    "interval_seconds must be a positive integer",
                ),
                (obj & given(enabled) & (_kind(enabled) != "BOOLEAN"), "enabled must be a boolean"),
                (obj & given(fields) & ~is_list, "fields must be a list"),
            ]
        )
        warnings = messages(
            [
                (obj & given(interval) & good_interval & (seconds < 60), "Interval under 60s may cause rate limiting"),
                (
                    obj & given(name) & ((_kind(name) != "STRING") | blank(_field(c, "name", "string"))),
                    "Job name is empty or not a string",
                ),
                (obj & is_list & (F.to_json(fields) == "[]"), "fields list is empty"),
            ]
        )
        return let(
            issues,
            lambda i: F.struct(
                (F.size(i) == 0).alias("valid"), i.alias("issues"), warnings.alias("warnings")
            ),
        )

    return let(F.try_parse_json(col(config)), checked)


def audit_target_map(config: Column | str) -> Column:
    """Struct ``is_valid, errors, warnings`` of a crawl target given as JSON, ``fields`` being a map.

    URL problems are listed one by one, a selector is required, and an explicit null counts as wrong.
    """

    def checked(c: Column) -> Column:
        url, interval = _field(c, "url"), _field(c, "interval_seconds")
        enabled, fields = _field(c, "enabled"), _field(c, "fields")
        obj = _is_object(c)
        text_url = F.when(_kind(url) == "STRING", _field(c, "url", "string"))
        seconds = _whole(c, "interval_seconds")
        good_interval = F.coalesce(_is_whole(interval) & (seconds > 0), F.lit(False))
        no_selector = _field(c, "selector").isNull() & _field(c, "selectors").isNull()
        shown = lambda v: F.to_json(v)
        first = [
            finding(~obj, "config", "type", "Config must be a dictionary"),
            finding(obj & url.isNull(), "url", "required", "Config must have 'url' field"),
        ]
        rest = [
            finding(
                obj & no_selector, "selector", "required", "Config must have 'selector' or 'selectors' field"
            ),
            finding(
                obj & interval.isNotNull() & ~good_interval,
                "interval_seconds",
                "type",
                "interval_seconds must be a positive integer",
                shown(interval),
            ),
            finding(
                obj & enabled.isNotNull() & (_kind(enabled) != "BOOLEAN"),
                "enabled",
                "type",
                "enabled must be a boolean",
                shown(enabled),
            ),
            finding(
                obj & fields.isNotNull() & ~_kind(fields).startswith("OBJECT"),
                "fields",
                "type",
                "fields must be a dictionary",
                shown(fields),
            ),
        ]
        of_url = F.when(obj & url.isNotNull(), audit_url(text_url)).otherwise(findings([]))
        errors = F.concat(findings(first), of_url, findings(rest))
        warnings = findings(
            [
                finding(
                    obj & good_interval & (seconds < 60),
                    "interval_seconds",
                    "range",
                    "interval_seconds below 60 may cause rate limiting",
                    shown(interval),
                )
            ]
        )
        return let(
            errors,
            lambda e: F.struct(
                (F.size(e) == 0).alias("is_valid"), e.alias("errors"), warnings.alias("warnings")
            ),
        )

    return let(F.try_parse_json(col(config)), checked)


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def audit_selector(selector: Column | str) -> Column:
    """Findings array of a selector text."""
    raw = col(selector)
    given = raw.isNotNull() & (raw != "")

    def checked(s: Column) -> Column:
        def syntax(cond: Column, message: str) -> Column:
            return finding(given & cond, "selector", "syntax", message, s)

        has = lambda part: F.contains(s, F.lit(part))
        doubled = [
            syntax(
                has(f"{a} >") | has(f"{a} +") | has(f"{a} ~"), "Consecutive combinators are invalid"
            )
            for a in (">", "+", "~")
        ]
        return findings(
            [
                finding(~given, "selector", "required", "Selector is required", raw),
                syntax(s.rlike("^[,>+~]"), "Selector cannot start with combinator"),
                syntax(_occurrences(s, "[") != _occurrences(s, "]"), "Unbalanced brackets in selector"),
                syntax(_occurrences(s, "(") != _occurrences(s, ")"), "Unbalanced parentheses in selector"),
                syntax(has(",,") | s.endswith(","), "Selector has empty parts"),
                *doubled,
            ]
        )

    return let(strip(raw), checked)


def quality_of_record(
    url: Column, title: Column, body: Column, scraped_at: Column, status: Column, as_of: Column
) -> Column:
    """Weighted completeness, freshness and consistency of one fetched record, three decimals."""
    there = [F.coalesce((c != ""), F.lit(False)).cast("int") for c in (url, title, body)]
    completeness = (there[0] + there[1] + there[2]) / F.lit(3.0)
    age_days = (F.unix_micros(as_of) - F.unix_micros(scraped_at)) / F.lit(86400.0 * 1e6)
    freshness = F.greatest(F.lit(0.0), F.lit(1.0) - age_days / 30)
    consistency = F.when(status == 200, 1.0).otherwise(0.3)
    return round_to(0.4 * completeness + 0.3 * freshness + 0.3 * consistency, 3)
