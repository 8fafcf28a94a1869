"""Token ids of documents in ORC files: integer run-length encoding, row indexes, Bloom filters on ids."""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import column_encoder

FILE_BYTES = 32 << 20  # text of one file, about
STRIPE_BYTES = 16 << 20  # stripes are what tasks read in parallel
INDEX_ROWS = 1000  # rows between two entries of the row index, which also bound a Bloom filter


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    files: int | None = None,
) -> None:
    """Write every document's ids in rising id order as ORC files below ``path``.

    Columns: ``id_col``, ``at`` (ids before the document in its file) and ``ids array<int>``, ``end_id`` last. Texts
    are range-partitioned and sorted before they are encoded, so that only texts are shuffled and file
    ``part-n`` holds smaller ids than ``part-(n+1)``. ``files`` defaults to as many as hold ``FILE_BYTES`` of text
    each, the session's shuffle partitions at least. Ids are stored as integers, which ORC run-length encodes; row indexes
    and a Bloom filter on the id let a reader skip stripes and row groups.

    Null ids come first; a null or empty text has ``end_id`` alone; rows of one id (or of none) are split and ordered
    by text, equal ones stand side by side; a very long text is encoded alone. Other columns are not read, so
    their names do not matter. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if files is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES)
    order = [F.col("id"), F.xxhash64("text")]

    def run(batches):
        encode = column_encoder(tokenizer, end_id)
        before = 0
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                flat, ends = encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32)))
                at = pa.array(before + ends[:-1], pa.int64())
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays([part.column("id"), at, lists], names=[id_col, "at", "ids"])

    (
        source.repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, f"`{id_col}` {kind}, at bigint, ids array<int>")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list | None = None, id_col: str = "doc_id") -> DataFrame:
    """The stored documents; with ``ids`` only those, found through the files' indexes and Bloom filters."""
    df = spark.read.orc(path)
    return df if ids is None else df.filter(F.col(id_col).isin(list(ids)))


def token_spans(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files alone, per document: ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Counts and checksums are taken from the ids read back and stored once; a start is the document's place in its file
    and the sum of the files before it (one row per file). No files or no rows give an empty result.
    """
    df = read_tokens(spark, path, None, id_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            bounds = (4 * ends.astype(np.int64)).tolist()
            sums = [zlib.crc32(data[a:b]) for a, b in pairwise(bounds)]
            found = [pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "file", "at")), *found],
                names=["id", "file", "at", "n_tokens", "ids_crc32"],
            )

    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    read = df.select(F.col(f"`{id_col}`").alias("id"), file.alias("file"), "at", "ids")
    spans = stored(read.mapInArrow(run, f"id {kind}, file int, at bigint, n_tokens bigint, ids_crc32 bigint"), "spans")
    earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = spans.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    start = (F.col("before") + F.col("at")).alias("start")
    return spans.join(files, "file").select(F.col("id").alias(id_col), start, "n_tokens", "ids_crc32")
