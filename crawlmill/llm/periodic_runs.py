"""Stretches of a text that repeat with a period: Kruskal over suffixes in descending order of their common prefixes."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import let
from .common import mix, slices, words

LEAST_WORDS = 6  # of a run
LEAST_PERIODS = 4  # whole periods in a run
BLOCK = 2_000  # positions in one list of an ordered set
SLICE_BYTES = 1 << 20  # text worked on at once; a longer text alone

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Places:
    """An ordered set of positions, in sorted lists of at most ``2 * BLOCK``."""

    def __init__(self, first: int):
        self.size, self.lists, self.tops = 1, [[first]], [first]

    def __iter__(self):
        for x in self.lists:
            yield from x

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours of a position that is not in the set."""
        b = bisect_left(self.tops, x)
        if b == len(self.tops):
            return self.tops[-1], None
        i = bisect_left(self.lists[b], x)
        before = self.lists[b][i - 1] if i else self.tops[b - 1] if b else None
        return before, self.lists[b][i]

    def add(self, x: int) -> None:
        b = min(bisect_left(self.tops, x), len(self.tops) - 1)
        part = self.lists[b]
        insort(part, x)
        self.tops[b] = part[-1]
        self.size += 1
        if len(part) > 2 * BLOCK:
            self.lists[b : b + 1] = part[:BLOCK], part[BLOCK:]
            self.tops[b : b + 1] = part[BLOCK - 1], part[-1]


def _repeated(symbols: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Places whose next ``n`` symbols stand elsewhere in their text too, in order."""
    last = max(len(symbols) - n + 1, 0)
    begin = np.flatnonzero(text[:last] == text[len(text) - last :])
    h = mix(text[begin].astype(np.uint64) + np.uint64(1))
    for i in range(n):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + symbols[begin + i])
    _, group, sizes = np.unique(h, return_inverse=True, return_counts=True)
    return begin[sizes[group] > 1]


def _first_ranks(symbols: np.ndarray, text: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Ranks of ``places``, and of the places ``n`` further on, by text and the next ``n`` symbols; -1 elsewhere."""
    rank = np.full(len(symbols), -1, np.int64)
    if not len(places):
        return rank
    code = np.unique(symbols, return_inverse=True)[1] + 1  # 0: the text is over
    beyond = places[places + n < len(symbols)]
    seen = np.zeros(len(symbols), bool)
    seen[places] = True
    seen[beyond[text[beyond + n] == text[beyond]] + n] = True
    at = np.flatnonzero(seen)
    columns = []
    for i in range(n):
        x = np.minimum(at + i, len(symbols) - 1)
        inside = (at + i < len(symbols)) & (text[x] == text[at])
        columns.append(np.where(inside, code[x], 0))
    columns = [text[at], *columns]
    by = np.lexsort(columns[::-1])
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in columns])
    rank[at[by]] = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return rank


def suffix_edges(symbols: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in a suffix order of each text that share ``least`` symbols or more: ``(a, b, common)``, exact.

    ``symbols`` are the words of several texts one after the other, ``text`` the number of each word's text. Places
    whose next ``least`` words stand once in their text share less with any other and are left out at once. The
    rest are ordered by prefix doubling from ``least`` words on, until every suffix is alone; common prefixes are
    read from the ranks of all doublings and at most ``least - 1`` further words.
    """
    n = len(symbols)
    places = live = _repeated(symbols, text, least)
    levels, size = [_first_ranks(symbols, text, places, least)], least
    while len(live):
        rank, beyond = levels[-1], live + size
        inside = beyond < n
        inside[inside] = text[beyond[inside]] == text[live[inside]]
        ahead = np.zeros(len(live), np.int64)
        ahead[inside] = rank[beyond[inside]] + 1
        key = rank[live] * (n + 1) + ahead
        by = np.argsort(key)
        key, group = key[by], rank[live][by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(by))
        # a group's rank is its parent's and the suffixes before it there
        inner = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        finer = rank.copy()
        finer[live[by]] = group + inner
        levels.append(finer)
        size *= 2
        sizes = np.diff(np.append(np.flatnonzero(new), len(by)))
        live = live[np.sort(by[np.repeat(sizes, sizes) > 1])]
    order = places[np.argsort(levels[-1][places])]
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)

    def further(step: int, rank: np.ndarray) -> None:
        x, y = a + common, b + common
        ok = np.flatnonzero((x < n) & (y < n))
        ok = ok[(text[x[ok]] == text[a[ok]]) & (text[y[ok]] == text[b[ok]])]
        common[ok[rank[x[ok]] == rank[y[ok]]]] += step

    for k in range(len(levels) - 1, -1, -1):
        further(least << k, levels[k])
    for _ in range(least - 1):
        further(1, symbols)
    return a, b, common


def maximal_runs(symbols: np.ndarray, text: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS):
    """All runs of several texts: arrays ``(start, length, period)`` by start and period, starts counted over all texts.

    Suffixes that share prefixes are united from the longest common prefix down. Positions i < j that become
    neighbours in a united set when it shares L words, at distance p <= L, mark a stretch of L + p words with period p.
    Each run appears once so, at its start and with its smallest period: a shorter one would put a third position
    between the two, united before them.
    """
    # L + p reaches both bounds for some period p only from here on
    least = min(max(least_words - p, (least_periods - 1) * p) for p in range(1, least_words + 1))
    a, b, common = suffix_edges(symbols, text, least)
    home: dict[int, Places] = {}
    seeds = []
    by = np.argsort(-common, kind="stable")
    for i, j, shared in zip(a[by].tolist(), b[by].tolist(), common[by].tolist(), strict=True):
        one, two = home.get(i) or Places(i), home.get(j) or Places(j)
        small, big = (one, two) if one.size <= two.size else (two, one)
        furthest = shared // (least_periods - 1)
        xs = list(small)
        for k, x in enumerate(xs):
            before, after = big.around(x)
            if before is not None and x - before <= furthest and (k == 0 or xs[k - 1] < before):
                seeds.append((before, x, shared))
            if after is not None and after - x <= furthest and (k + 1 == len(xs) or after < xs[k + 1]):
                seeds.append((x, after, shared))
        for x in xs:
            big.add(x)
            home[x] = big
        home[i] = home[j] = big
    if not seeds:
        return (np.zeros(0, np.int64),) * 3
    i, j, shared = np.array(sorted(seeds), np.int64).T
    # a stretch that goes on to the left is part of the run that starts there
    first = (i == 0) | (text[i - 1] != text[i])
    whole = (shared + j - i >= least_words) & (first | (symbols[i - 1] != symbols[j - 1]))
    i, j, shared = i[whole], j[whole], shared[whole]
    return i, shared + j - i, j - i


def _worked(docs: DataFrame, text_col: str, least_words: int, least_periods: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words``, ``runs`` and ``collapsed``."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def part_of(part: pa.RecordBatch) -> pa.RecordBatch:
        h, _, _, at, _ = words(part.column("text"))
        text = np.repeat(np.arange(part.num_rows), np.diff(at))
        start, length, period = maximal_runs(h, text, least_words, least_periods)
        edges = np.zeros(len(h) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, start + length, -1)
        keep = np.cumsum(edges[:-1]) == 0
        owner = text[start]
        runs = pa.StructArray.from_arrays([pa.array(start - at[owner]), pa.array(length), pa.array(period)], fields=list(run_type.value_type))
        ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
        collapsed = []
        for k, body in enumerate(part.column("text").to_pylist()):
            ws = body.encode().split() if body else []
            stay = keep[at[k] : at[k + 1]]
            if not stay.all():
                ws = [ws[i] for i in np.flatnonzero(stay).tolist()]
            collapsed.append(b" ".join(ws).decode())
        return pa.RecordBatch.from_arrays(
            [
                part.column("row"),
                pa.array(np.diff(at), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs),
                pa.array(collapsed, pa.string()),
            ],
            names=["row", "n_words", "runs", "collapsed"],
        )

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                yield part_of(batch.slice(lo, hi - lo))

    schema = T.StructType(
        [
            T.StructField("row", source.schema["row"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(_RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return source.mapInArrow(run, schema)


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> DataFrame:
    """Runs of each text: id, ``n_words``, ``runs`` (``start, length, period`` by start, then period) and ``collapsed``.

    A run is a stretch of words with smallest period q, of at least ``least_words`` words and ``least_periods`` periods,
    that no neighbouring word extends. ``collapsed`` has the words left, joined by one space, when each run keeps
    its first period only; a word goes if any run says so. Words are compared by 64-bit hashes.

    One pass without a shuffle: runs lie inside a text. A task works on about a megabyte of text at once; a longer text
    stands alone and needs about 300 bytes of memory a word, more only where it repeats itself. A null or empty text
    has no words, no runs and an empty ``collapsed``. Null and repeated ids keep their rows; rows of equal text have equal
    results. An empty table gives an empty result; other columns are ignored.
    """
    two = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return _worked(two, "text", least_words, least_periods).select(F.col("row.doc").alias(id_col), "n_words", "runs", "collapsed")


def rewritten(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The rows and columns of ``docs``; a text with runs becomes its ``collapsed`` words, others stay."""
    found = _worked(docs, text_col, least_words, least_periods)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col(f"row.`{text_col}`"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text; where crc32 of the id ends in 0, the words from a place on repeat their first ones.

    With h that checksum and n the words: words i >= a become word ``a + (i - a) % p``, a = g % n, p = 1 + (n - a) /
    (3 + g % 8), g = h / 10, all whole. Texts without words or id stay.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    g = F.floor(h / 10)

    def written(ws):
        n = F.size(ws)

        def from_place(a):
            p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
            return let(p, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p))))

        return F.when(n > 0, F.array_join(let((g % n).cast("int"), from_place), " "))

    ws = F.filter(F.split(F.col(f"`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(h % 10 == 0, F.coalesce(let(ws, written), F.col(f"`{text_col}`"))).otherwise(F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``find_runs``: the number of runs, the longest one, and digests of all runs and of the words left."""
    # longest, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
