"""Stupid-backoff scores of documents under n-gram counts of the whole corpus, by joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, stored, words

ORDER = 2
ALPHA = 0.4  # factor of each step back
GRAMS_PER_PART = 2_000_000  # n-grams of the count table that a task holds at once
_LEAST_PARTS = 48
LEAST_COUNT = 2  # longer n-grams seen less often are not in the tables: the score backs off


def _join(prefix: np.ndarray, suffix: np.ndarray, n: int) -> np.ndarray:
    """Hash of a run of ``n`` words from the hashes of the runs of n - 1 words at both its ends."""
    return mix(prefix * np.uint64(0x9FB21C651E98DF25) ^ (suffix + np.uint64(n - 1)))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    for k in range(2, n + 1):
        h = _join(h[:-1], h[1:], k)
    return h


def gram_rows(docs: DataFrame, n: int) -> DataFrame:
    """The n-grams of every document as ``(p, s, c)`` per Arrow slice, where ``p`` and ``s`` are the hashes of the n-gram
    without its last and first word (of a single word: 0 and its own), which name it, and ``c`` is its count there.

    ``docs`` has ``doc`` and ``text``. Words are hashed to 64 bits.
    """

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch, "text", 8 << 20):
                h, _, _, at, _ = words(batch.slice(lo, hi - lo).column("text"))
                # runs that cross into the next text are left out
                inside = np.ones(max(len(h) - n + 1, 0), bool)
                for k in range(1, n):
                    cut = at[1:-1] - k
                    inside[cut[(cut >= 0) & (cut < len(inside))]] = False
                if not len(inside):
                    continue
                shorter = _grams(h, n - 1) if n > 1 else h
                g, index, c = np.unique(_grams(h, n)[inside], return_index=True, return_counts=True)
                place = np.flatnonzero(inside)[index]
                p = shorter[place] if n > 1 else np.zeros(len(g), np.uint64)
                s = shorter[place + 1] if n > 1 else g
                columns = [p.view(np.int64), s.view(np.int64), c.astype(np.int64)]
                for x in range(0, len(g), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(v[x : x + 100_000]) for v in columns], names=["p", "s", "c"])

    return docs.mapInArrow(run, "p bigint, s bigint, c bigint")


_BLOCK = "part int, kind int, docs binary, runs binary, g binary, v binary"


def _blocks(part: np.ndarray, columns: list[np.ndarray]):
    """Rows of each part, in their order: the part and its stretch of every column."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[lo]), [c[lo:hi] for c in columns]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def gram_blocks(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """The n-grams of every document, by hash in ``parts``: a row per part and Arrow slice, with the documents, how many of their
    n-grams it has, those, and their counts in the document, as bytes: 8 per n-gram beside the small numbers."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch, "text", 8 << 20):
                part = batch.slice(lo, hi - lo)
                h, _, _, at, _ = words(part.column("text"))
                keys = part.column("doc").to_numpy(zero_copy_only=False)
                found = [(k, *np.unique(_grams(h[a:b], n), return_counts=True)) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b - a >= n]
                if not found:
                    continue
                g = np.concatenate([x[1] for x in found]).view(np.int64)
                c = np.concatenate([x[2] for x in found]).astype(np.int32)
                owner = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
                rows = []
                for number, (own, grams, counts) in _blocks(g % parts, [owner, g, c]):
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    runs = np.diff(first, append=len(own)).astype(np.int32)
                    rows.append((number, 1, keys[own[first]].tobytes(), runs.tobytes(), grams.tobytes(), counts.tobytes()))
                yield _batch(rows)

    return docs.mapInArrow(run, _BLOCK)


def _gain_blocks(gains: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            g, gain = (batch.column(c).to_numpy() for c in ("g", "gain"))
            if len(g):
                yield _batch([(k, 0, None, None, x.tobytes(), y.tobytes()) for k, (x, y) in _blocks(g % parts, [g, gain])])

    return gains.select("g", "gain").mapInArrow(run, _BLOCK)


def doc_sums(docs: DataFrame, n: int, gains: DataFrame, parts: int) -> DataFrame:
    """``doc, gain, found``: summed gains and number of the n-grams of every document that are in the table. A document has a row per part.

    The table of a part is held in a task, ``GRAMS_PER_PART`` rows or so; the blocks of n-grams that meet it pass one by one,
    so an n-gram that all documents share takes no more memory than any other.
    """

    def run(batches):
        now, pieces, table = None, [], None
        for batch in batches:
            docs_, gains_, founds_ = [], [], []
            for number, kind, keys, runs, g, v in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if number != now:
                    now, pieces, table = number, [], None
                grams = np.frombuffer(g, np.int64)
                if kind == 0:
                    pieces.append((grams, np.frombuffer(v, np.float64)))
                    continue
                if table is None:
                    names = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in pieces)])
                    order = np.argsort(names)
                    # the last row stands for what is in no table
                    values = np.concatenate([*(y for _, y in pieces), np.zeros(0)])[order]
                    table, pieces = (names[order], np.append(values, 0.0)), []
                place = np.searchsorted(table[0], grams)
                there = np.zeros(len(grams), bool)
                inside = place < len(table[0])
                there[inside] = table[0][place[inside]] == grams[inside]
                c = np.frombuffer(v, np.int32) * there
                length = np.frombuffer(runs, np.int32).astype(np.int64)
                start = np.cumsum(length) - length
                docs_.append(np.frombuffer(keys, np.int64))
                gains_.append(np.add.reduceat(c * table[1][place], start))
                founds_.append(np.add.reduceat(c, start, dtype=np.int64))
            if docs_:
                columns = [np.concatenate(x) for x in (docs_, gains_, founds_)]
                seen = columns[2] > 0
                yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in columns], names=["doc", "gain", "found"])

    blocks = gram_blocks(docs, n, parts).unionByName(_gain_blocks(gains, parts))
    return blocks.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(run, "doc bigint, gain double, found bigint")


def count_table(docs: DataFrame, n: int, least: int) -> DataFrame:
    """Stored corpus counts: ``g, p, s, c`` of every n-gram seen ``least`` times or more, with its prefix and suffix hash."""
    counts = gram_rows(docs, n).groupBy("p", "s").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)

    def named(batches):
        for batch in batches:
            p, s = (batch.column(c).to_numpy().view(np.uint64) for c in ("p", "s"))
            g = s if n == 1 else _join(p, s, n)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), *batch.columns], names=["g", *batch.schema.names])

    return stored(counts.mapInArrow(named, "g bigint, p bigint, s bigint, c bigint"), "counts")


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, least: int = LEAST_COUNT
) -> DataFrame:
    """Stupid-backoff log score (base 10) of every document: id, ``n_words``, ``n_backoff``, ``log_score``, ``mean_score``.

    S(w | context) is count(context w) / count(context) if the n-gram is in the table, else ``alpha`` times the score
    with a context shorter by one word; a single word's score is its count over all words. Counts cover all
    documents; n-grams of two words and more need ``least`` occurrences. A text's first words have shorter contexts.
    ``n_backoff`` counts the steps back.

    A document's sum is taken apart so that each order needs one join: all words' single scores, plus ``log(alpha)``
    for each step down from the longest context there is, plus for every n-gram found its gain over what it
    replaces. The gain is a column of the count table, which is partitioned by n-gram hash, as are the documents' n-grams
    that meet it: they are shuffled as blocks of bytes (``doc_sums``); sums per document are combined before they are
    shuffled. An n-gram that a third of all documents share is combined before counting. Each table is stored, and its
    shuffle files go.

    Null and empty texts have no words: sums 0, mean null. Documents equal in id and text share their key and
    their scores. A null id is kept. An empty table gives an empty result. Starts jobs when called.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("doc"), text.alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    total = None
    tables, sums = {}, None
    for n in range(1, order + 1):
        # a single word seen once adds log10(1): words need no lower bound than 2
        counts = count_table(keyed, n, min(least, 2) if n == 1 else least)
        if n == 1:
            n_all = keyed.agg(F.sum(size)).first()[0] or 0
            total = math.log10(n_all) if n_all else 0.0
            gains = counts.select("g", "c", (F.log10("c") - total).alias("s_n"), (F.log10("c")).alias("gain"))
        else:
            shorter = tables[n - 1]
            prefix = shorter.select(F.col("g").alias("p"), F.col("c").alias("c_p"))
            suffix = shorter.select(F.col("g").alias("s"), F.col("s_n").alias("s_s"))
            ratio = F.log10("c") - F.log10("c_p")
            gains = (
                counts.join(prefix, "p")
                .join(suffix, "s")
                .select("g", "c", ratio.alias("s_n"), (ratio - math.log10(alpha) - F.col("s_s")).alias("gain"))
            )
            # longer n-grams need the scores; without them the gains do
            gains = stored(gains if n < order else gains.select("g", "gain"), "gains")
        tables[n] = gains
        parts = max(_LEAST_PARTS, gains.count() // GRAMS_PER_PART + 1)
        part = doc_sums(keyed, n, gains, parts).groupBy("doc").agg(
            F.sum("gain").alias("gain"), (F.sum("found") if n > 1 else F.lit(0).cast("bigint")).alias("found")
        )
        part = stored(part, "sums")
        sums = part if sums is None else sums.unionByName(part)
    sums = sums.groupBy("doc").agg(F.sum("gain").alias("gain"), F.sum("found").alias("found"))
    sized = keyed.select("id", "doc", size.alias("n_words"))
    copies = sized.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"))
    # contexts there are: one word less for each order beyond the first
    steps = sum((F.greatest(F.lit(0), F.col("n_words") - k) for k in range(1, order)), F.lit(0))
    back = steps - F.coalesce(F.col("found") / F.col("copies"), F.lit(0.0))
    log = F.coalesce(F.col("gain") / F.col("copies"), F.lit(0.0)) - total * F.col("n_words") + math.log10(alpha) * steps
    return (
        sized.join(copies.join(sums, "doc", "left"), "doc")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            back.cast("bigint").alias("n_backoff"),
            F.round(log, 4).alias("log_score"),
            F.when(F.col("n_words") > 0, F.round(log / F.col("n_words"), 6)).alias("mean_score"),
        )
    )


ORACLE = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(list_prepend(NULL, ws[1:len(ws) - 1])) AS prev FROM d WHERE len(ws) > 0),
n AS (SELECT count(*) AS total FROM t),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
b AS (SELECT prev, w, count(*) AS c FROM t WHERE prev IS NOT NULL GROUP BY prev, w HAVING count(*) >= {LEAST_COUNT}),
s AS (SELECT t.doc_id, t.prev IS NOT NULL AND b.c IS NULL AS back,
  CASE WHEN b.c IS NOT NULL THEN log10(b.c / p.c) ELSE log10(u.c / total) + CASE WHEN t.prev IS NULL THEN 0 ELSE log10({ALPHA}) END END AS score
  FROM t CROSS JOIN n JOIN u ON u.w = t.w LEFT JOIN u AS p ON p.w = t.prev LEFT JOIN b ON b.w = t.w AND b.prev = t.prev),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (back) AS n_backoff, sum(score) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(score, 0), 4) AS log_score,
  round(score / n_words, 6) AS mean_score FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""
