"""Removal of repeated passages: an FM-index per shard finds word windows that an earlier document has."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_memos, hash_runs, mix, row_columns, row_key, slices, stored, whole_row, words
from .fm_index import FmIndex

WINDOW = 13  # words
ANCHOR = 4  # words of an anchor; the smallest anchor hash in a window decides the window's shard
SHARD_BYTES = 1 << 20  # text whose windows make one shard, about
SHARDS_PER_TASK = 16
SLICE_BYTES = 4 << 20  # text cut into segments at once
SAMPLE_DOCS = 2_000  # documents looked at to find anchors so common that one shard could not hold them
HOT_SHARE = 0.02  # share of those documents that makes an anchor common
MOST_HOT = 1_000

_RANGES = "id bigint, th bigint, start int, n int"


def segments(column: pa.Array, window: int, anchor: int):
    """Runs of neighbouring windows with the same anchor: ``(text, first word, number of windows, anchor hash)``.

    An anchor is the leftmost smallest hash among the ``anchor``-word runs of a window, so equal windows have equal
    anchors in whatever text they stand. Also returns the words of the column, see ``common.words``.
    """
    h, first, end, at, data = words(column)
    count = len(h) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return (none, none, none, none.view(np.uint64)), (h, first, end, at, data)
    g = h[: len(h) - anchor + 1].copy()
    for i in range(1, anchor):
        g = mix(g ^ (h[i : len(h) - anchor + 1 + i] * np.uint64(0x9FB21C651E98DF25)))
    best, where = g[:count].copy(), np.arange(count)
    for i in range(1, window - anchor + 1):
        other = g[i : i + count]
        less = other < best
        best[less] = other[less]
        where[less] = np.flatnonzero(less) + i
    text = np.searchsorted(at, np.arange(count), "right") - 1
    inside = np.arange(count) + window <= at[text + 1]
    new = np.ones(count, bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    # a run ends where the next begins or its text's windows end
    run = np.cumsum(new & inside)[inside]
    sizes = np.bincount(run, minlength=len(starts) + 1)[1:] if len(starts) else np.zeros(0, np.int64)
    return (text[starts], starts, sizes, best[starts]), (h, first, end, at, data)


def _pack(key, ids, th, start, size, parts: list[bytes]) -> bytes:
    import zstandard

    lengths = np.array([len(p) for p in parts], np.int64)
    fixed = np.concatenate([np.array([len(key)], np.int64), key.view(np.int64), ids, th, start, size, lengths])
    return zstandard.ZstdCompressor(level=3).compress(fixed.tobytes() + b"".join(parts))


def _unpack(blob: bytes):
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    fixed = np.frombuffer(data, np.int64, 6 * n, 8).reshape(6, n)
    return fixed, data[8 + 48 * n :]


def route(shards: int, hot: set[int], window: int, anchor: int):
    """A task that sends each segment of its texts to the shard of its anchor, as packed rows ``(shard, blob)``.

    Segments with the same words inside one slice are sent once, for the smallest id; the others are covered by it
    and go out as finished ranges (shard -1). Segments of a common anchor are cut into single windows, which go by
    the hash of the whole window.
    """
    common = np.array(sorted(hot), np.uint64)

    def run(batches):
        drop_memos("tokens_")
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                (text, start, size, key), (h, first, end, at, data) = segments(part.column("text"), window, anchor)
                if not len(start):
                    continue
                heavy = np.isin(key, common)
                if heavy.any():
                    cut = np.flatnonzero(heavy)
                    single = np.concatenate([np.arange(s, s + n) for s, n in zip(start[cut], size[cut], strict=True)])
                    owner = np.repeat(text[cut], size[cut])
                    own = hash_runs(h, single, np.full(len(single), window))
                    text, start = np.append(text[~heavy], owner), np.append(start[~heavy], single)
                    size, key = np.append(size[~heavy], np.ones(len(single), np.int64)), np.append(key[~heavy], own)
                ids, th = part.column("id").to_numpy()[text], part.column("th").to_numpy()[text]
                content = hash_runs(h, start, size + window - 1)
                place = start - at[text]
                by = np.lexsort((ids, content))
                c = content[by]
                begins = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                least = np.repeat(ids[by][begins], np.diff(np.append(begins, len(c))))
                covered = by[ids[by] > least]
                if len(covered):
                    yield _blob_rows([-1 - int(content[0] % np.uint64(shards))], [_pack(key[covered], ids[covered], th[covered], place[covered], size[covered], [b""] * len(covered))])
                keep = by[ids[by] == least]
                shard = (mix(key[keep]) % np.uint64(shards)).astype(np.int64)
                keep = keep[np.argsort(shard, kind="stable")]
                shard = np.sort(shard)
                raw = data.tobytes()
                spans = zip(first[start[keep]].tolist(), end[start[keep] + size[keep] + window - 2].tolist(), strict=True)
                parts = [raw[a:b] for a, b in spans]
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
                blobs = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    s = keep[a:b]
                    blobs.append(_pack(key[s], ids[s], th[s], place[s], size[s], parts[a:b]))
                yield _blob_rows(shard[cuts[:-1]].tolist(), blobs)

    return run


def _blob_rows(shards: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])


def shard_ranges(blobs: list[bytes], window: int):
    """Word ranges of a shard that an earlier document has: arrays ``id, th, start, n``."""
    packed = [_unpack(b) for b in blobs]
    fixed = np.concatenate([f for f, _ in packed], axis=1)
    data = b"".join(d for _, d in packed)
    key, ids, th, start, size, lengths = fixed
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    # anchors of a single document cannot repeat in another one
    by = np.lexsort((ids, key))
    begins = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
    ends = np.append(begins[1:], len(by))
    shared = np.repeat(ids[by][begins] != ids[by][ends - 1], ends - begins)
    live = np.sort(by[shared])
    if not len(live):
        return None
    texts = pa.array([data[a:b] for a, b in zip(offsets[live].tolist(), offsets[live + 1].tolist(), strict=True)], pa.binary()).cast(pa.string())
    h, _, _, at, _ = words(texts)
    ids, th, start, size = ids[live], th[live], start[live], size[live]
    # equal segments are indexed once, with the smallest id
    content = hash_runs(h, at[:-1], np.diff(at))
    _, chosen, same = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(chosen), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    lengths = np.diff(at)[chosen]
    ends = np.cumsum(lengths + 1)
    first = ends - lengths - 1
    inner = np.arange(int(ends[-1])) - np.repeat(first, lengths + 1)
    word = np.repeat(at[:-1][chosen], lengths + 1) + inner
    last = inner == np.repeat(lengths, lengths + 1)
    sigma, codes = np.unique(h, return_inverse=True)
    text = np.where(last, 0, codes[np.minimum(word, len(h) - 1)] + 1)
    index = FmIndex(text, len(sigma) + 1, window)
    found = index.matches(text, first, lengths)
    owner = np.repeat(least, lengths + 1)
    smallest = np.minimum.reduceat(owner[index.suffixes], index.full_starts)
    earliest = smallest[np.searchsorted(index.full_starts, found, "right") - 1]
    # back to every occurrence: its windows stand where its content's windows do
    windows = lengths - window + 1
    base = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(ids)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    covered = earliest[base[same][owner] + inner] < ids[owner]
    # runs of covered windows
    new = covered.copy()
    new[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    run = np.cumsum(new)[covered]
    sizes = np.bincount(run, minlength=len(at) + 1)[1:]
    who = owner[at]
    return ids[who], th[who], start[who] + inner[at], sizes + window - 1


def search(window: int):
    """A task that takes its shards one after the other and gives their ranges."""

    def rows(ids, th, start, n):
        for a in range(0, len(ids), 100_000):
            cut = slice(a, a + 100_000)
            arrays = [pa.array(ids[cut]), pa.array(th[cut]), pa.array(start[cut].astype(np.int32)), pa.array(n[cut].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "th", "start", "n"])

    def run(batches):
        drop_memos("tokens_")
        held, current = [], None
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if shard < 0:
                    _, ids, th, start, size, _ = _unpack(blob)[0]
                    yield from rows(ids, th, start, size + window - 1)
                    continue
                if shard != current and held:
                    found = shard_ranges(held, window)
                    held = []
                    if found is not None:
                        yield from rows(*found)
                current = shard
                held.append(blob)
        if held and (found := shard_ranges(held, window)) is not None:
            yield from rows(*found)

    return run


def common_anchors(source: DataFrame, n_docs: int, window: int, anchor: int) -> set[int]:
    """Hashes of the anchors in many of a sample of documents. They steer only where windows go, not what is found."""
    sample = source.sample(min(1.0, SAMPLE_DOCS / max(n_docs, 1)), seed=11)

    def run(batches):
        for batch in batches:
            (text, _, _, key), _ = segments(batch.column("text"), window, anchor)
            found, n = np.unique(np.unique(np.stack([key.view(np.int64), text]), axis=1)[0], return_counts=True) if len(key) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["key", "n"])

    counts = sample.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(8, HOT_SHARE * min(n_docs, SAMPLE_DOCS))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()
    return {r["key"] % (1 << 64) for r in top}


def repeated_ranges(source: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Ranges ``(id, th, start, n)`` of words that lie in windows which a document with a smaller id has too.

    ``source`` has ``id``, ``th`` and ``text``.
    """
    spark = source.sparkSession
    n_docs, size = source.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // (SHARD_BYTES * SHARDS_PER_TASK))
    hot = common_anchors(source, n_docs, window, anchor)
    routed = source.mapInArrow(route(tasks * SHARDS_PER_TASK, hot, window, anchor), "shard bigint, blob binary")
    by_shard = routed.repartition(tasks, "shard").sortWithinPartitions("shard")
    # stored, so that the shuffled words are gone before texts and ranges are joined
    return stored(by_shard.mapInArrow(search(window), _RANGES), "ranges")


def _kept(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words``, ``n_removed``, ``sha`` and ``kept``, the text without its repeated words."""
    text = F.col(text_col).cast("string")
    keys = [k.alias(n) for k, n in zip(row_key(id_col, text_col), ("id", "th"), strict=True)]
    ranges = repeated_ranges(docs.select(*keys, text.alias("text")), window, anchor)
    per_doc = ranges.groupBy(F.col("id").alias("__rid"), F.col("th").alias("__rth")).agg(
        # a document's ranges, at most its windows
        F.collect_set(F.struct("start", "n")).alias("__ranges")
    )
    wide = docs.select(*row_key(id_col, text_col), whole_row(docs), text.alias("body"))
    joined = wide.join(per_doc, (F.col("__id") == F.col("__rid")) & (F.col("__text") == F.col("__rth")), "left")
    joined = joined.select("row", "body", F.col("__ranges.start").alias("start"), F.col("__ranges.n").alias("n"))
    made = "n_words bigint, n_removed bigint, sha string, kept string"
    schema = T.StructType([joined.schema["row"], *T.StructType.fromDDL(made)])

    def run(batches):
        for batch in batches:
            n_words, removed, sha, texts = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("body", "start", "n"))
            for body, starts, sizes in zip(*columns, strict=True):
                ws = body.encode().split() if body else []
                left = ws
                if starts:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.add(starts, sizes), -1)
                    left = [ws[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                line = b" ".join(left)
                n_words.append(len(ws))
                removed.append(len(ws) - len(left))
                sha.append(hashlib.sha256(line).hexdigest())
                texts.append(line.decode() if len(left) < len(ws) else body)
            made = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "n_words", "n_removed", "sha", "kept"])

    return joined.mapInArrow(run, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Remove every word covered by a ``window``-word window that also starts in a document with a smaller id.

    Returns id, ``n_words``, ``n_removed`` and ``kept_sha256`` (kept words joined by one space). Windows are judged on
    the input.

    Documents are cut into runs of windows with a common anchor; equal windows meet in one shard. Each shard
    builds a compressed FM-index of its distinct runs, streams the runs through it by backward search, and takes
    the smallest id of each window's suffix interval. Ranges come back to the documents by one join. A passage that
    many documents hold is sent once per slice of documents; anchors found common in a sample go by whole windows,
    so they spread over the shards. Words are compared by 64-bit hashes.

    Null and empty texts have no words and nothing to remove. A null id counts as the largest and its windows
    never cover another row's; rows of equal id cover nothing of each other. An empty table gives an empty
    result. Other columns are ignored. Starts jobs when called.
    """
    two = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    found = _kept(two, "doc", "body", window, anchor)
    return found.select(F.col("row.doc").alias(id_col), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows and columns of ``docs``; a text that lost words becomes its kept words joined by spaces, others stay."""
    found = _kept(docs, id_col, text_col, window, anchor)
    return row_columns(found, docs, **{text_col: F.col("kept")})
