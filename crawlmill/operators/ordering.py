"""Ordered work that stays balanced when one key holds a large share of the rows.

A plain window puts a whole key into one task. The helpers here first look for heavy keys with a
bounded sketch; only rows of heavy keys take the other way: they are range-partitioned on the full
order, so a heavy key is cut into pieces, and the pieces are stitched with one small row per piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_HOT_KEYS = 10_000  # the heaviest keys are cut; this many already hold MAX_HOT_KEYS * ROWS_PER_TASK rows
SKETCH_ITEMS = 16384  # a key above rows / (0.75 * this) is never missed
ROWS_PER_TASK = 5_000_000  # a key above this many rows is cut

_KEY, _PART, _AT = "__key", "__part", "__at"


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*_cols(keys))


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> dict[int, int]:
    """Hash and row count of the keys with more than ``rows_per_task`` rows, at most ``MAX_HOT_KEYS``.

    The sketch has a fixed size per task and one row as its result. It only steers the plan: a hash
    collision or a miss changes the speed, never the result.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    top = df.select(key_hash(keys).alias(_KEY)).agg(
        F.expr(f"approx_top_k({_KEY}, {MAX_HOT_KEYS}, {SKETCH_ITEMS})").alias("top")
    )
    found = top.first()["top"] or []
    return {r["item"]: r["count"] for r in found if r["count"] > rows_per_task}


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows_per_task: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``(light, heavy)`` rows; heavy rows come in ordered pieces and are None when no key is heavy."""
    hot = hot_keys(df, keys, rows_per_task)
    if not hot:
        return df, None
    heavy = key_hash(keys).isin(list(hot))
    pieces = -(-sum(hot.values()) // (rows_per_task or ROWS_PER_TASK))
    return df.filter(~heavy), range_pieces(df.filter(heavy), [*keys, *order], pieces)


def range_pieces(df: DataFrame, order: Sequence[str | Column], wanted: int) -> DataFrame:
    """``df`` sorted globally in at least ``wanted`` pieces, with piece number ``__part`` and position in the piece ``__at`` (from 0).

    The result is written to the shared folder, so piece numbers survive a lost executor.
    """
    by = _cols(order)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(default, wanted)
    placed = (
        df.repartitionByRange(pieces, *by)
        .sortWithinPartitions(*by)
        .withColumn(_AT, F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright(_AT, 33).cast("int"))
        .withColumn(_AT, F.col(_AT) - F.shiftleft(F.col(_PART).cast("bigint"), 33))
    )
    return cut_lineage(placed)


def with_dense_id(df: DataFrame, order: Sequence[str | Column], name: str = "id", start: int = 0) -> DataFrame:
    """Number all rows ``start+1 ..`` without gaps, in the given order, with no single-task window.

    Only one row per piece is brought together for the offsets.
    """
    placed = range_pieces(df, order, df.count() // ROWS_PER_TASK + 1)
    sizes = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        placed.join(F.broadcast(offsets), _PART)
        .withColumn(name, (F.col("__off") + F.col(_AT) + 1 + start).cast("bigint"))
        .drop(_PART, _AT, "__off")
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Position 1, 2, … of each row inside its key. The order must be total inside a key."""
    light, placed = split_hot(df, keys, order, rows_per_task)
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    result = light.withColumn(name, F.row_number().over(w).cast("bigint"))
    if placed is None:
        return result
    # a key's rows are consecutive: offset = rows of the key in earlier pieces, minus its first place here
    sizes = placed.groupBy(*keys, _PART).agg(
        F.count(F.lit(1)).alias("__n"), F.min(_AT).alias("__first")
    )
    before = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        _PART,
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__off"),
    )
    ranked = (
        # at most (heavy keys + pieces) rows
        _null_safe_join(placed, F.broadcast(offsets), [*keys, _PART])
        .withColumn(name, (F.col("__off") + F.col(_AT) + 1).cast("bigint"))
        .select(*result.columns)
    )
    return result.unionByName(ranked)


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on])
    return left.join(renamed, cond).drop(*[f"__r_{c}" for c in on])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, str],
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add, for every row, values of the row before it inside its key (NULL on the first row).

    ``values`` maps new column names to existing columns. The order must be total inside a key.
    """
    light, placed = split_hot(df, keys, order, rows_per_task)
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    lagged = {new: F.lag(old).over(w) for new, old in values.items()}
    result = light.withColumns(lagged)
    if placed is None:
        return result
    # inside a piece: plain lag per (piece, key)
    inner = W.partitionBy(_PART, *keys).orderBy(_AT)
    tails = (
        placed.groupBy(*keys, _PART)
        .agg(F.max_by(F.struct(*values.values()), _AT).alias("__tail"))
        .withColumn("__tail", F.lag("__tail").over(W.partitionBy(*keys).orderBy(_PART)))
    )
    inside = placed.withColumns({new: F.lag(old).over(inner) for new, old in values.items()})
    inside = inside.withColumn("__head", F.row_number().over(inner) == 1)
    # at most (heavy keys + pieces) rows: the last row of the key's piece before this one
    joined = _null_safe_join(inside, F.broadcast(tails), [*keys, _PART])
    filled = joined.withColumns(
        {
            new: F.when(F.col("__head"), F.col("__tail")[old]).otherwise(F.col(new))
            for new, old in values.items()
        }
    )
    return result.unionByName(filled.select(*result.columns))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table that is read in fewer pieces than there are cores, such as one file of one row group.

    A table with a piece for every core is left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)
