"""Readers: columnar tables, delimited text, crawl-target configuration, stored queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.extract import Target

TARGET = (
    "name string, url string, selector string, fields map<string,string>, headers map<string,string>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """Header row; tab for ``.tsv``, else comma. Give a schema on big inputs to save the typing pass.

    ``multi_line`` reads records with line feeds inside quotes, a whole file per task; without it files are split at
    line ends.
    """
    reader = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    # quotes inside quoted fields are doubled
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def parse_targets(config: Mapping) -> list[Target]:
    """Targets of a configuration mapping; name, url and selector are required."""
    return [
        Target(e["name"], e["url"], e["selector"], e.get("fields", {}), e.get("headers", {}))
        for e in config.get("targets", [])
    ]


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets from JSON lines as a typed table; absent maps become empty."""
    empty = F.create_map().cast("map<string,string>")
    raw = spark.read.schema(TARGET).option("mode", "FAILFAST").json(path)
    full = raw.withColumns({c: F.coalesce(c, empty) for c in ("fields", "headers")})
    needed = {
        c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"target without {c}")).cast("string")).otherwise(F.col(c))
        for c in ("name", "url", "selector")
    }
    return full.withColumns(needed)


def query(spark: SparkSession, sql: str, params: Sequence | Mapping = (), **tables: DataFrame) -> DataFrame:
    """A parameterised query over the given tables, named in the text as ``{name}``; ``?`` or ``:name`` markers."""
    args = dict(params) if isinstance(params, Mapping) else list(params)
    return spark.sql(sql, args=args or None, **tables)
