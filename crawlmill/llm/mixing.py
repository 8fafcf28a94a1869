"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

REPEATS = 3  # a source gives at most this many times its own size
ROWS_PER_BUCKET = 2_000  # documents of one source ordered together, about


def letter_share(text_col: str) -> Column:
    """A document's quality weight: the share of its characters that are no digit, mark or symbol, 0.05 at least."""
    marks = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    n = F.length(text_col)
    left = F.length(F.translate(F.col(text_col), marks, ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.when(n > 0, left / n), F.lit(0.05)))


def targets(sources: DataFrame) -> DataFrame:
    """Target words per source, as ``target`` next to the columns of ``sources`` (source, source_size, n_docs, mean_weight).

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, ...; the sizes' sum is shared by weight, and what
    a source would take beyond ``REPEATS`` times its size is shared among the others, again by weight. The end of
    that sharing is found at once: with sources ordered by cap per weight, a source is capped as long as the
    level, (all words - caps so far) / (weights left), lies above its own cap per weight. One row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn(
        "cap", F.col("source_size").cast("double") * REPEATS
    )
    # ties in cap per weight may come in any order: they are capped together or not at all
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = weighed.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") > F.col("cap"))
    # the level of the first source that is not capped holds for all of those
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(shared * F.col("w"), F.col("cap")))
    return leveled.select("source", "source_size", target.alias("target"), "n_docs", "mean_weight")


def _placed(docs: DataFrame, weight: Column | None, id_col: str, text_col: str, source_col: str, seed: int, carry: bool) -> DataFrame:
    """id, source, size, source_size, target, ``epochs``, ``part`` (words of the last, fractional epoch), with ``carry`` also ``row``, all columns of ``docs``."""
    row = ["row"] if carry else []
    held = [F.struct(*docs.columns).alias("row")] if carry else []
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    # 53 bits of a hash, never 0 or 1
    bits = F.shiftrightunsigned(F.xxhash64(id_col, text, F.lit(seed)), 11).cast("double")
    share = (bits + 0.5) / F.lit(float(1 << 53))
    kept = [F.col(id_col).alias("id"), F.col(source_col).alias("source")]
    rated = docs.select(*kept, *held, size.alias("size"), share.alias("u"), (weight if weight is not None else letter_share(text_col)).cast("double").alias("w"))
    # a weight that is null, zero or no number counts as very small: the document comes last
    safe = F.when(F.col("w") > 1e-9, F.col("w")).otherwise(F.lit(1e-9))
    rated = rated.select("id", "source", *row, "size", safe.alias("w"), (-F.log("u") / safe).alias("key"))
    rated = stored(rated, "mix")
    per_source = rated.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.avg("w").alias("mean_weight")
    )
    # stored, as both uses below must see the same sums of doubles
    goals = stored(targets(per_source), "targets").withColumnRenamed("source", "__source")
    # the key's distribution for the source's mean weight spreads its documents over the buckets
    spot = F.least(F.lit(1 - 1e-12), 1 - F.exp(-F.col("key") * F.col("mean_weight")))
    joined = (
        rated.join(goals, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("b", F.floor(spot * (1 + F.floor(F.col("n_docs") / ROWS_PER_BUCKET))).cast("bigint"))
    )
    sums = joined.groupBy("source", "b").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("__source"), F.col("b").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    inside = W.partitionBy("source", "b").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        joined.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("__source")) & (F.col("b") == F.col("__b")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    )
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return placed.select("id", "source", *row, "size", "source_size", "target", "epochs", part.cast("bigint").alias("part"))


def mix(
    docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7
) -> DataFrame:
    """How many words of each document the mix takes: id, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` counts the words. A source whose target is e times its size and a rest gives every document e times
    (complete epochs) and then documents in rising order of the key ``-ln(u) / weight`` until the rest is used up;
    the document at the border gives only its first words, so a source's ``taken`` sums to its target, rounded
    down. ``u`` is a hash of id, text and ``seed``: reruns agree. ``weight`` defaults to ``letter_share``.

    Only DataFrame functions run. A source is ordered in buckets of the key's distribution function, as many as
    its number of documents asks for: one sum per bucket is ordered in the source, and rows only in their bucket,
    so a source with a third of all rows is many tasks' work. Equal rows have equal keys and take their places one
    after the other. Null text: size 0, taken 0. A null source is a source, a null id an id. A weight that is
    null, zero or no number is a very small one. An empty table gives an empty result; other columns are
    ignored. Starts jobs when called: sizes and targets are stored.
    """
    placed = _placed(docs, weight, id_col, text_col, source_col, seed, False)
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("bigint")
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(
    docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    Documents of which no word is taken have no row. The document at a source's border comes with its first words,
    joined by spaces.
    """
    placed = _placed(docs, weight, id_col, text_col, source_col, seed, True)
    times = F.col("epochs").cast("int") + (F.col("part") > 0).cast("int")
    some = placed.filter((F.col("size") > 0) & (times > 0))
    each = some.select("row", "size", "epochs", "part", F.explode(F.sequence(F.lit(1), times)).alias("turn"))
    cut = (F.col("turn") > F.col("epochs")) & (F.col("part") < F.col("size"))
    body = F.col(f"row.{text_col}")
    words = F.filter(F.split(body.cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part").cast("int"), F.lit(0))), " ")
    return each.select(*[F.when(cut, first).otherwise(body).alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns])
