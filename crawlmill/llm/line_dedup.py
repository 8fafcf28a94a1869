"""Lines that an earlier document has: first occurrences are streamed in hash order, documents get bitmaps.

Only DataFrame functions run.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import let
from .common import row_key, stored

LEAST_CHARS = 10  # code points of a key that can repeat
LINES_PER_PIECE = 2_000_000  # of one range of hashes, about
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    # an ASCII text lowers the same way either way, and much faster by lower()
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``id, th, at, h1, h2``: 128 bits of hash for each line whose key has ``least`` code points or more.

    ``id`` and ``th`` are ``common.row_key``; ``at`` counts the lines of a text from 0.
    """
    keys = [k.alias(n) for k, n in zip(row_key(id_col, text_col), ("id", "th"), strict=True)]
    lines = docs.select(*keys, F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("at", "line"))
    keyed = lines.select("id", "th", "at", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least)
    return keyed.select("id", "th", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(least), "key").alias("h2"))


def repeated_lines(hashes: DataFrame) -> DataFrame:
    """``id, th, at`` of the lines of ``line_hashes`` whose key a document of smaller id has.

    Rows are range-partitioned by hash, document and position, so that a key of any number of lines is cut into
    ranges of bounded size. In a range the rows of a key are read in the order of documents and the first
    document is carried along. A key that runs over several ranges is stitched by one row for each range it opens.
    """
    hashes = stored(hashes, "lines")
    default = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(default, hashes.count() // LINES_PER_PIECE)
    order = ["h1", "h2", "id", "at"]
    ranged = stored(
        hashes.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id()), "ranges"
    )
    stream = W.partitionBy("piece", "h1", "h2").orderBy("id", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    streamed = ranged.withColumn("first", F.first("id").over(stream))
    joined = streamed.join(F.broadcast(_carried(streamed)), ["piece", "h1", "h2"], "left")
    return joined.filter(F.coalesce("carried", "first") < F.col("id")).select("id", "th", "at")


def _carried(streamed: DataFrame) -> DataFrame:
    """``piece, h1, h2, carried``: the first document of the key that goes on into a range; at most one row per range."""
    ends = streamed.groupBy("piece").agg(
        F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2", "id", "at", "first")).alias("hi")
    )
    along = W.orderBy("piece")
    key = lambda name: F.struct(f"{name}.h1", f"{name}.h2")
    ends = ends.withColumn("goes_on", F.coalesce(F.col("lo") == F.lag(key("hi")).over(along), F.lit(False)))
    # a range that is wholly inside one key opens none
    opened = F.when(~(F.col("goes_on") & (F.col("lo") == key("hi"))), F.col("hi.first"))
    ends = ends.withColumn("carried", F.last(opened, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)))
    return ends.filter("goes_on").select("piece", "lo.h1", "lo.h2", "carried")


def drop_bitmaps(repeated: DataFrame) -> DataFrame:
    """``id, th, n_dropped, words``: one row per document that loses lines.

    ``words`` is a sparse bitmap in rising order: ``(word, bits)`` marks the dropped ones of lines ``64 * word`` to
    ``64 * word + 63``; where a word is missing all its lines are kept.
    """
    bits = repeated.groupBy("id", "th", F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits")
    )
    return bits.groupBy("id", "th").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def _kept(lines: Column, words: Column) -> Column:
    """``lines`` without the marked ones: the stretches between them are copied, so the work is linear."""
    marked = F.flatten(
        F.transform(words, lambda w: F.filter(
            F.sequence(w["word"] * 64, w["word"] * 64 + 63), lambda i: F.getbit(w["bits"], (i % 64).cast("int")) == 1
        ))
    )

    def cut(dropped: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda i: i + 1))
        ends = F.concat(dropped, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    return let(marked, cut)


def _deduped(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``body`` (null: empty), ``kept``, ``n_dropped``, ``words``."""
    bitmaps = drop_bitmaps(repeated_lines(line_hashes(docs, id_col, text_col, least)))
    keys = [k.alias(n) for k, n in zip(row_key(id_col, text_col), ("id", "th"), strict=True)]
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keys, F.struct(*[F.col(c) for c in docs.columns]).alias("row"), body.alias("body"))
    joined = rows.join(stored(bitmaps, "bitmaps"), ["id", "th"], "left")
    kept = F.when(F.col("words").isNull(), F.col("body")).otherwise(
        let(F.split("body", "\n"), lambda lines: _kept(lines, F.col("words")))
    )
    return joined.select("row", "body", kept.alias("kept"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "words")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """Drop lines whose key, of ``least`` code points or more, a document of smaller id has.

    Returns id, ``n_lines`` (before dropping), ``n_dropped``, ``kept_sha256`` (lines that stay, joined by line feeds) and
    ``dropped``, the sparse bitmap of ``drop_bitmaps`` (empty: all lines stay).

    Lines end at ``\\n`` alone. Keys are compared by 128 bits of hash. Only hashes and positions are ordered;
    texts meet their bitmaps in one join. A null or empty text is one empty line. A null id counts as the largest; rows
    of equal id, or without one, are one document to each other and lose nothing by each other, whatever their
    texts. Lines repeated inside the first document all stay. Very long texts need memory for themselves and
    their lines in one task. An empty table gives an empty result; other columns are ignored. Starts jobs when called.
    """
    two = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = _deduped(two, "doc", "text", least)
    none = F.array().cast("array<struct<word:int,bits:bigint>>")
    return found.select(
        F.col("row.doc").alias(id_col),
        (F.char_length("body") - F.char_length(F.replace("body", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        "n_dropped",
        F.sha2("kept", 256).alias("kept_sha256"),
        F.coalesce("words", none).alias("dropped"),
    )


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """The rows and columns of ``docs``, texts without the lines that ``dedup`` drops; other texts, null ones too, stay."""
    found = _deduped(docs, id_col, text_col, least)
    text = F.when(F.col("words").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.col("kept"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), lines AS (
    SELECT *, translate(trim(line, E' \\t\\n\\x0b\\f\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered
), firsts AS (
    SELECT key, min(doc_id) AS first_doc FROM lines GROUP BY key
), marked AS (
    SELECT doc_id, pos, line, length(key) >= 10 AND first_doc < doc_id AS gone FROM lines JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
