"""Robots rules and the gate they put in front of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import LINE_BREAK, SPACE, col, strip


def disallowed_paths(robots_text: Column | str, agent: str) -> Column:
    """Disallowed path prefixes that hold for ``agent`` or for everyone, in file order.

    The last user-agent line decides; Allow lines, comments and empty paths are ignored. The text is cut
    at its user-agent lines, so the whole file is handled in its row.
    """
    text = F.regexp_replace(F.coalesce(col(robots_text), F.lit("")), LINE_BREAK, "\n")
    blocks = F.split(text, rf"(?imd)^[{SPACE}]*user-agent:")
    named = F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1)))

    def for_us(block: Column) -> Column:
        name = F.lower(strip(F.substring_index(block, "\n", 1)))
        return (name == "*") | F.contains(name, F.lit(agent.lower()))

    def paths(block: Column) -> Column:
        found = F.regexp_extract_all(block, F.lit(rf"(?imd)^[{SPACE}]*disallow:([^\n]*)$"), F.lit(1))
        return F.filter(F.transform(found, strip), lambda p: p != "")

    return F.flatten(F.transform(F.filter(named, for_us), paths))


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """One row per (domain, position, path); ``robots`` has ``domain, robots_text``."""
    return robots.select("domain", F.posexplode(disallowed_paths("robots_text", agent)).alias("pos", "path"))


def gate(urls: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """All URLs with ``allowed``; sites without rules allow everything.

    A rule blocks the paths that begin with it. No list of rules is held per site: a path is cut to prefixes of just the
    lengths that its site's rules have, and those meet the rules by equality of site and prefix. So a URL costs as many rows
    as its site has rule lengths up to its own, however many rules there are. Paths that stand in several URLs are
    judged once; a site, or a rule, with a large share of the URLs is split at run time.
    """
    listed = robots.select(F.col("domain").alias("site"), F.explode(disallowed_paths("robots_text", agent)).alias("prefix")).distinct()
    # at most one length for each code point of the longest rule
    by_site = listed.groupBy("site").agg(F.collect_set(F.char_length("prefix")).alias("lengths"), F.bool_or(F.col("prefix") == "/").alias("closed"))
    at = urls.withColumns({"__site": U.site(url), "__path": F.coalesce(F.nullif(U.path(url), F.lit("")), F.lit("/"))})
    paths = at.select(F.col("__site").alias("site"), F.col("__path").alias("path")).distinct().join(by_site, "site")
    short = F.filter("lengths", lambda n: n <= F.char_length("path"))
    prefixes = paths.filter(~F.col("closed")).select("site", "path", F.explode(short).alias("n"))
    prefixes = prefixes.select("site", "path", F.left("path", F.col("n")).alias("prefix"))
    met = prefixes.join(listed, ["site", "prefix"], "left_semi").select("site", "path")
    blocked = met.unionByName(paths.filter("closed").select("site", "path")).distinct()
    blocked = blocked.select(F.col("site").alias("__b_site"), F.col("path").alias("__b_path"))
    joined = at.join(blocked, (F.col("__site") == F.col("__b_site")) & (F.col("__path") == F.col("__b_path")), "left")
    return joined.withColumn("allowed", F.col("__b_site").isNull()).drop("__site", "__path", "__b_site", "__b_path")
