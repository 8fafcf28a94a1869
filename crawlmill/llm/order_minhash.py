"""Order MinHash fingerprints, whose likeness follows edit distance, and texts edited with their neighbour's."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

K = 8  # code points of a k-mer
SKETCHES = 32
PICKED = 2  # k-mers of each sketch, kept in text order
BUCKET_BYTES = 16 << 20  # text of one run of neighbours, about

_BASE = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str, k: int = K, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """Order MinHash of a text: one 32-bit value per sketch.

    Every k-mer is told from its equals by its occurrence number. Each sketch ranks the numbered k-mers by a hash of
    its own, takes the ``picked`` smallest, puts them in text order and hashes that tuple. A text shorter than
    ``k`` is its own only k-mer.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = max(len(points) - k + 1, 1)
    if len(points) < k:
        points = np.concatenate([points, np.zeros(k - len(points), np.uint64)])
    h = points[:n].copy()
    for i in range(1, k):
        h = h * _BASE + points[i : i + n]
    # occurrence numbers: equal k-mers stand together in a stable order, each one's place in its run is its number
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    run = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    if len(run) < n:
        number = np.empty(n, np.uint64)
        number[order] = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
        h = h + number * np.uint64(0xD1342543DE82EF95)
    h = mix(h)
    if n <= picked:
        tuples = np.tile(h, (sketches, 1))
    else:
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            odd = (np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
            rank = (low[None, :] * odd[:, None]) ^ high[None, :]
            rank *= np.uint32(0x85EBCA6B)
        # few values lie below a bound that holds all the smallest ones; else look at all
        bound = np.uint32(min(0xFFFFFFFF, (1 << 32) * 12 * picked // n))
        row, column = np.nonzero(rank < bound)
        if n <= 24 * picked or np.bincount(row, minlength=sketches).min() < picked:
            row, column = np.divmod(np.arange(sketches * n), n)
        by = np.lexsort((column, h[column], rank[row, column], row))  # ties by k-mer, then place
        row, column = row[by], column[by]
        first = np.searchsorted(row, np.arange(sketches))
        places = np.sort(column[first[:, None] + np.arange(picked)], axis=1)
        tuples = h[places]
    value = np.arange(sketches, dtype=np.uint64)
    for i in range(tuples.shape[1]):
        value = mix(value * _BASE + tuples[:, i])
    return value.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal sketches."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``, or all of them."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next text's.

    The next document has the next smaller id; after the smallest comes the largest (null ids come last, equal ids in
    the order of their texts' hashes). Neighbours meet by one shuffle: ids are cut into ranges at approximate
    quantiles, and the largest document of each range also goes to the range above, as the one that follows that
    range's last. Per range only two ids pass the driver. A task reads its ranges in order, a row at a time, so no
    range is gathered. Which cuts are made changes nothing in the result; many rows of one id stay in one range.

    Null text: empty. A single document follows itself. An empty table gives an empty result. Returns id, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hexadecimal), ``near_edited``, ``near_next``. Starts jobs when called.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    lowest = F.lit(1 - (1 << 63))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("bigint"), lowest).alias("key"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
    )
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0]
    n = int((size or 0) // BUCKET_BYTES) + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    cuts = np.unique(np.array(cuts or [0], np.int64))
    # bucket of a key: how many cuts lie below it; found by search, as there may be many cuts
    spans = keyed.select("key", "h").mapInArrow(_spans(cuts), "bucket bigint, key bigint, h bigint")
    top = spans.groupBy("bucket").agg(F.max("key").alias("key"), F.min_by("h", F.struct(-F.col("key"), "h")).alias("h")).collect()
    top = sorted((r["bucket"], r["key"], r["h"]) for r in top)
    # the largest document of a bucket follows the smallest of the next bucket above; the very largest follows the smallest
    follows = {}
    for i, (bucket, key, h) in enumerate(top):
        follows.setdefault((key, h), []).append(top[(i + 1) % len(top)][0])

    def route(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            bucket = np.searchsorted(cuts, keys, "left")
            more = [(i, to) for i, kh in enumerate(zip(keys.tolist(), batch.column("h").to_pylist(), strict=True)) if kh in follows for to in follows[kh]]
            rows = np.concatenate([np.arange(len(keys)), np.array([i for i, _ in more], np.int64)])
            to = np.concatenate([bucket, np.array([t for _, t in more], np.int64)])
            extra = rows * 0
            extra[len(keys) :] = 1
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(extra.astype(np.int32)), *taken.columns], names=["bucket", "extra", *taken.schema.names])

    routed = keyed.mapInArrow(route, f"bucket bigint, extra int, id {kind}, key bigint, h bigint, text string")
    ordered = routed.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.desc("key"), "h")

    def run(batches):
        held = None  # the row whose next one is not yet known: id, text, fingerprint, bucket
        out = []

        def emit(row, nxt, nxt_print):
            id_, t, own, _ = row
            e = edited(t, nxt)
            f = fingerprint(e)
            sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((id_, len(t), sha, own.tobytes().hex(), f.tobytes().hex(), likeness(own, f), likeness(own, nxt_print)))

        for batch in batches:
            for bucket, extra, id_, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "id", "text")), strict=True):
                if held is None and extra:
                    continue
                own = held[2] if held is not None and held[1] == t else fingerprint(t)
                if held is not None and held[3] == bucket:
                    emit(held, t, own)
                held = None if extra else (id_, t, own, bucket)
            if out:
                yield _rows(out, batch.schema.field("id").type, id_col)
                out.clear()

    return ordered.mapInArrow(
        run,
        f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _spans(cuts: np.ndarray):
    """Per batch the largest key of each bucket with its smallest hash."""

    def run(batches):
        for batch in batches:
            keys, h = batch.column("key").to_numpy(), batch.column("h").to_numpy()
            order = np.lexsort((h, -keys))
            bucket = np.searchsorted(cuts, keys[order], "left")
            _, first = np.unique(bucket, return_index=True)
            chosen = order[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first].astype(np.int64)), pa.array(keys[chosen]), pa.array(h[chosen])], names=["bucket", "key", "h"]
            )

    return run


def _rows(out: list[tuple], id_type: pa.DataType, id_col: str) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
