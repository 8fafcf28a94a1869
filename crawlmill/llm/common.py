"""Session settings, stored intermediates and word handling shared by the operators of this package."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path

WORD = r"[^\x20\x09-\x0D]+"  # what the operators call a word

_RUNTIME = {
    # shuffle files go when their query ends: the operators run several queries and keep only stored tables
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # long texts: few rows in one Arrow batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings and those of this package, on an existing session."""
    configure(spark)
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: lineage ends here, on files all executors see."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``__id`` and ``__text``: join keys without nulls. Rows equal in both have equal results.

    A null id counts as the largest one.
    """
    last = F.lit((1 << 63) - 1)
    return [
        F.coalesce(F.col(id_col).cast("bigint"), last).alias("__id"),
        F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("__text"),
    ]


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no column made beside it can meet a name of theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def row_columns(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``row``, those in ``changed`` by their expressions."""
    return df.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def worker_memo(name: str, make):
    """An object that lives as long as its Python worker, so that later tasks find it filled."""
    holder = sys.modules.setdefault("crawlmill_worker_memo", types.ModuleType("crawlmill_worker_memo"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def drop_memos(prefix: str) -> None:
    """Free what earlier tasks of this Python worker remember under names that begin with ``prefix``.

    A worker outlives its tasks: without this, the words of one operator's memo would stay in memory beside the next one's work.
    """
    holder = sys.modules.get("crawlmill_worker_memo")
    for name in [n for n in vars(holder) if n.startswith(prefix)] if holder else []:
        delattr(holder, name)


def slices(batch: pa.RecordBatch, text_col: str, most_bytes: int = 4 << 20):
    """Row ranges (start, stop) of a batch with about ``most_bytes`` of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column (null: empty) and where each text starts and the last ends."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


_AT_ONCE = 1 << 18  # bytes hashed in one step


def _powers(n: int, base: int) -> np.ndarray:
    memo = worker_memo("powers", dict)
    if n <= _AT_ONCE + 1 and base in memo:
        return memo[base][:n]
    p = np.full(max(n, _AT_ONCE + 1), np.uint64(base))
    p[0] = 1
    p = np.multiply.accumulate(p)
    if n <= _AT_ONCE + 1:  # those of a longer word are not kept
        memo[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a column: ``(hash, first byte, end byte, words before each text, bytes)``.

    Words are runs of anything but ASCII white space. The hash is 64 bits of the word's bytes and the same
    in every task: a polynomial of the bytes, then mixed with the length.
    """
    data, offsets = text_bytes(column)
    n = len(data)
    solid = np.ones(n + 1, bool)
    solid[:n] = (data != 32) & ((data < 9) | (data > 13))
    solid[n] = False
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] |= solid[at]  # a text's first byte never continues a word of the text before
    last = np.zeros(n + 1, bool)
    last[1:] = solid[:-1] & (~solid[1:] | first[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    h = np.empty(len(starts), np.uint64)
    # some hundred thousand bytes at once, a longer word alone: only bits and words are held for the whole column
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _AT_ONCE)))
        base = starts[i]
        part = data[base : ends[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= _powers(len(part), _BASE)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        h[i:j] = (total[b] - total[a]) * _powers(len(part) + 1, _INVERSE)[a]
        i = j
    h = mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return h, starts, ends, np.searchsorted(starts, offsets), data


def hash_runs(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of words, by their number."""
    total = np.zeros(len(start), np.uint64)
    for i in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > i)
        total[live] = mix(total[live] * np.uint64(0x9FB21C651E98DF25) + h[start[live] + i])
    return total
