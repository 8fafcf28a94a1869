"""Registered queries, each with the SQL text that must give the same rows, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import lexicons as L
from ..functions.core import LINE_BREAK, SPACE, WORDCHAR
from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TEXTS = {
    "@SPACE@": SPACE,
    "@WORD@": WORDCHAR,
    "@BREAK@": LINE_BREAK,
    "@POSITIVE@": _list(L.POSITIVE_WORDS),
    "@NEGATIVE@": _list(L.NEGATIVE_WORDS),
    "@TOPIC_STOP@": _list(L.TOPIC_STOP_WORDS),
    "@KEYWORD_STOP@": _list(L.KEYWORD_STOP_WORDS),
}


def fill(sql: str, **parts: str) -> str:
    for name, text in parts.items():
        sql = sql.replace(f"@{name}@", text)
    for name, text in _TEXTS.items():
        sql = sql.replace(name, text)
    return sql


def rnd(x: str, digits: int) -> str:
    """The rounding rule of ``functions.core.round_to`` in SQL."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def keywords_sql(docs: str) -> str:
    """Keyword suggestions of a CTE ``docs`` with doc_id and text."""
    return fill(
        f"""WITH {docs}, tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM docs),
t AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS w, unnest(list_append(ws[2:], NULL)) AS nxt,
  generate_subscripts(ws, 1) AS pos FROM tok),
k AS (SELECT doc_id, total, pos, w, nxt, length(w) > 2 AND w NOT IN (@KEYWORD_STOP@) AS ok,
  coalesce(length(nxt) > 2 AND nxt NOT IN (@KEYWORD_STOP@), FALSE) AS ok2 FROM t),
c AS (SELECT doc_id, any_value(total) AS total, 0 AS kind, w AS keyword, count(*) AS n, min(pos) AS first
    FROM k WHERE ok GROUP BY doc_id, w
  UNION ALL SELECT doc_id, any_value(total), 1, w || ' ' || nxt, count(*), min(pos) FROM k WHERE ok AND ok2 GROUP BY doc_id, w || ' ' || nxt),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, first) AS cand FROM c
  QUALIFY cand <= CASE WHEN kind = 0 THEN 40 ELSE 20 END),
s AS (SELECT *, {rnd("n * CASE WHEN n < total THEN ln(total / n) ELSE 0.1::DOUBLE END * CASE WHEN kind = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END", 3)} AS score FROM r)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind, cand) AS rank, keyword, n AS frequency,
  score, kind = 1 AS is_ngram FROM s QUALIFY rank <= 20"""
    )


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL form."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add
