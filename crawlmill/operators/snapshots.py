"""Page snapshots over time: hashes, pairs, line diffs and summaries.

A snapshot table has ``url, content, ts, seq``; (ts, seq) orders the versions of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import LINE_BREAK, col, ratio, round_to
from .ordering import with_position, with_previous

ORDER = ("ts", "seq")


def content_hash(content: Column | str) -> Column:
    return F.substring(F.sha2(col(content), 256), 1, 16)


def lines(content: Column | str) -> Column:
    """Lines without their breaks; a final break opens no extra line."""
    parts = F.split(col(content), LINE_BREAK)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def history(snapshots: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Every version in order, with its hash and length but without the content."""
    slim = snapshots.select(
        "url", "ts", "seq", content_hash("content").alias("content_hash"), F.length("content").cast("bigint").alias("content_length")
    )
    return with_position(slim, ["url"], ORDER, "version", rows_per_task)


def export_history(snapshots: DataFrame, path: str) -> str:
    """Write the history as JSON lines, ordered by URL and version.

    One line per version instead of one list per URL: a URL with very many versions stays splittable.
    """
    rows = history(snapshots).select(
        "url",
        "content_hash",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "content_length",
        "version",
    )
    rows.repartitionByRange("url", "version").sortWithinPartitions("url", "version").write.json(path)
    return path


def change_summary(snapshots: DataFrame) -> DataFrame:
    """URLs, snapshots, and URLs that ever changed."""
    # the two halves of the hash as numbers: a URL changed if the smallest and largest value of one half
    # differ, so the aggregate keeps four numbers per URL and no set of hashes
    h = content_hash("content")
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    ends = snapshots.select("url", half(1).alias("a"), half(9).alias("b")).groupBy("url")
    per_url = ends.agg(
        F.count(F.lit(1)).alias("n"),
        ((F.min("a") != F.max("a")) | (F.min("b") != F.max("b"))).alias("changed"),
    )
    return per_url.agg(
        F.count(F.lit(1)).alias("urls_tracked"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_snapshots"),
        F.count_if("changed").alias("urls_with_changes"),
    )


def consecutive_pairs(snapshots: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Each version with the one before it: old and new order columns and hashes.

    Contents are hashed where they lie; only order columns and hashes are shuffled and paired. ``with_contents``
    brings the texts back.
    """
    slim = snapshots.select("url", "ts", "seq", content_hash("content").alias("hash"))
    old = {"old_ts": "ts", "old_seq": "seq", "old_hash": "hash"}
    # order columns are never null, so a version before this one shows in its seq
    paired = with_previous(slim, ["url"], ORDER, old, rows_per_task).filter("old_seq is not null")
    return paired.select(
        "url", "old_ts", "old_seq", F.col("ts").alias("new_ts"), F.col("seq").alias("new_seq"), "old_hash", F.col("hash").alias("new_hash")
    )


def with_contents(pairs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The pairs whose hashes differ, with ``old_content`` and ``new_content``; a version is found by URL and order."""
    changed = pairs.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    for side in ("old", "new"):
        version = snapshots.select("url", F.col("ts").alias(f"{side}_ts"), F.col("seq").alias(f"{side}_seq"), F.col("content").alias(f"{side}_content"))
        changed = changed.join(version, ["url", f"{side}_ts", f"{side}_seq"])
    return changed


def _ranked(snapshots: DataFrame, from_start: bool, upto: int) -> DataFrame:
    # the rank filter is applied below the shuffle too, so a task sends at most ``upto`` rows per URL
    by = [F.col(c).asc() if from_start else F.col(c).desc() for c in ORDER]
    ranked = snapshots.withColumn("__r", F.row_number().over(W.partitionBy("url").orderBy(*by)))
    return ranked.filter(F.col("__r") <= upto)


def _versions(snapshots: DataFrame, picks: dict[str, int]) -> DataFrame:
    """One row per URL with the version at each position; the positions have the same sign."""
    place = {name: i + 1 if i >= 0 else -i for name, i in picks.items()}
    ranked = _ranked(snapshots, min(picks.values()) >= 0, max(place.values()))
    version = F.struct("ts", "seq", "content")
    # the rows of a URL are together already, so this needs no further shuffle
    rows = ranked.groupBy("url").agg(
        *[F.max(F.when(F.col("__r") == r, version)).alias(name) for name, r in place.items()]
    )
    return rows.dropna(subset=list(picks))


def version_pair(snapshots: DataFrame, index_a: int = -2, index_b: int = -1) -> DataFrame:
    """Two chosen versions per URL; negative positions count from the newest.

    URLs with fewer than two versions, or without one of the positions, are left out.
    """
    if (index_a >= 0) == (index_b >= 0):
        pair = _versions(snapshots, {"old": index_a, "new": index_b})
    else:
        old, new = _versions(snapshots, {"old": index_a}), _versions(snapshots, {"new": index_b})
        pair = old.join(new, "url")
    if {index_a, index_b} <= {0, -1}:  # anything else needs a second version anyway
        several = snapshots.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
        pair = pair.join(several, "url", "left_semi")
    columns = [
        F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in ("ts", "seq", "content")
    ]
    hashes = {f"{side}_hash": content_hash(f"{side}_content") for side in ("old", "new")}
    return pair.select("url", *columns).withColumns(hashes)


def bag_diff(pairs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Order-blind line diff, without Python: one row per (pair, line) whose number of copies changed."""
    keys = ["url", "old_seq", "new_seq"]
    counted = _line_bags(with_contents(pairs, snapshots), keys)
    return counted.filter("old_n <> new_n").select(
        *keys,
        "line",
        F.greatest(F.col("new_n") - F.col("old_n"), F.lit(0)).cast("bigint").alias("added"),
        F.greatest(F.col("old_n") - F.col("new_n"), F.lit(0)).cast("bigint").alias("removed"),
    )


def _line_bags(pairs: DataFrame, keys: list[str]) -> DataFrame:
    tagged = F.concat(
        F.transform(lines("old_content"), lambda x: F.struct(x.alias("line"), F.lit(1).alias("o"), F.lit(0).alias("n"))),
        F.transform(lines("new_content"), lambda x: F.struct(x.alias("line"), F.lit(0).alias("o"), F.lit(1).alias("n"))),
    )
    return (
        pairs.select(*keys, F.inline(tagged))
        .groupBy(*keys, "line")
        .agg(F.sum("o").alias("old_n"), F.sum("n").alias("new_n"))
    )


def bag_similarity(pairs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """2·M/T per pair, M being the lines both sides share and T all lines; equal pages have 1."""
    keys = ["url", "old_seq", "new_seq"]
    same = pairs.filter("old_hash = new_hash").select(*keys, F.lit(1.0).alias("similarity"))
    bags = _line_bags(with_contents(pairs, snapshots), keys).groupBy(*keys).agg(
        F.sum(F.least("old_n", "new_n")).alias("m"), F.sum(F.col("old_n") + F.col("new_n")).alias("t")
    )
    return same.unionByName(bags.select(*keys, round_to(ratio(F.col("m") * 2, F.col("t")), 4).alias("similarity")))
