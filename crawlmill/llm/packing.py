"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import encoder

ROWS_PER_BUCKET = 200_000  # pieces of one length ranked together, about
LEAST_BUCKETS = 32


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by falling length, on counts: rows ``(length, first_rank, n, per_sequence, first_sequence, offset)``.

    The pieces of a length with ranks ``first_rank .. first_rank + n - 1`` go, ``per_sequence`` at a time, into the
    sequences from ``first_sequence`` on, from ``offset`` on. Sequences that look alike are held as one range, so
    time and rows depend on ``capacity`` (at most that many lengths), not on the number of documents.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # free room -> ranges (first sequence, how many)
    rooms: list[int] = []
    rows, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                n = -(-left // (capacity // length))
                put(capacity, sequences, n)
                sequences += n
                continue
            room = rooms[at]
            first, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            per = room // length
            full = min(n, left // per)
            for each, many in ((per, full), (left - full * per, 1 if full < n and left > full * per else 0)):
                if many:
                    rows.append((length, rank, each * many, each, first, capacity - room))
                    put(room - each * length, first, many)
                    rank, left, first, n = rank + each * many, left - each * many, first + many, n - many
            put(room, first, n)
    return rows


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1
) -> DataFrame:
    """Token pieces of every document: id, ``piece``, ``start``, ``length`` and ``ids_crc32``; longer documents are cut."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer, end_id)
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                rows, columns = [], ([], [], [], [])
                for i, ids in enumerate(encode(part.column("text").to_pylist())):
                    for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                        cut = ids[at : at + 4 * max_tokens]
                        rows.append(i)
                        for column, value in zip(columns, (k, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows, pa.int32())),
                        pa.array(columns[0], pa.int32()),
                        *(pa.array(c, pa.int64()) for c in columns[1:]),
                    ],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return source.mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1
) -> DataFrame:
    """Pack all documents into sequences of at most ``max_tokens`` tokens; one row per piece with its place.

    Adds ``sequence_id`` and ``offset`` to the columns of ``pieces``. The pieces are stored once. Of them only
    the count per length reaches the driver (at most ``max_tokens`` rows); the plan made from it is a table whose
    size depends on ``max_tokens`` alone, so it can be broadcast. A piece's rank within its length comes from
    hash buckets of its id: rows before the bucket plus its place in the bucket, so a length that many documents
    share is still ranked by many tasks.

    A null or empty text is one piece with the end id; a null id is kept; repeated rows are packed each on
    its own; an empty table gives an empty result. Other columns are ignored. Starts jobs when called.
    """
    spark = docs.sparkSession
    kept = stored(pieces(docs, tokenizer, id_col, text_col, max_tokens, end_id), "pieces")
    buckets = max(LEAST_BUCKETS, kept.count() // ROWS_PER_BUCKET)
    kept = kept.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = kept.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("__n")).collect()}
    slots = spark.createDataFrame(
        plan(counts, max_tokens),
        "length bigint, first_rank bigint, n bigint, per bigint, first_sequence bigint, base bigint",
    )
    before = W.partitionBy("length").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # equal rows may swap places, which changes nothing
    inside = W.partitionBy("length", "__b").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = (
        kept.withColumn("__at", F.row_number().over(inside))
        .join(offsets, ["length", "__b"])
        .withColumn("__rank", F.col("__before") + F.col("__at") - 1)
    )
    slots = F.broadcast(slots.withColumnRenamed("length", "__length"))
    turn = F.col("__rank") - F.col("first_rank")
    placed = ranked.join(
        slots,
        (F.col("length") == F.col("__length")) & (turn >= 0) & (turn < F.col("n")),
    )
    return placed.select(
        id_col,
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.expr("(__rank - first_rank) div per")).alias("sequence_id"),
        (F.col("base") + turn % F.col("per") * F.col("length")).alias("offset"),
    )
