"""Quality rules: base counts, and the distance of a document's histograms from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import let
from .common import stored

COMMON_WORDS = 48  # words of each language that have bins of their own
LEAST_WORDS = 50  # a document below this fails at once
MOST_REPEATED = 50  # percent of the words that may lie in repeated 3-word windows
JUDGED_WORDS = 50  # shorter documents have too few words for a histogram
REFERENCE_WORDS = 5_000  # a language with fewer words has no reference
MOST_CHAR_DISTANCE = 0.28  # Jensen-Shannon distances (base 2) beyond which a document is odd
MOST_WORD_DISTANCE = 0.40  # a text without any common word has 0.409 to 0.415 on sf0.1
MOST_WORD_SHARE = 0.97  # of the distance of such a text in its own language: the bound of languages where that is less

SPACES = r"[\x20\x09-\x0D]+"
# character classes, counted one after the other; what none of them holds is the last class
CLASSES = (r"\p{Ll}+", SPACES, r"\p{Lu}+", r"\p{Nd}+", r"[.,;:?'\"()-]+", r"\p{L}+")
SYMBOLS = r"[#*$%&|<>]+"  # of the last class, counted apart for the base counts


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array, first finds included.

    Windows are sorted by hash with their place, those equal to a neighbour are put back in text order, and each
    adds as many words as lie before the next one, three at most. No step is more than a sort of one text.
    """
    n = F.greatest(F.size(words), F.lit(1))
    last = F.greatest(F.size(words) - 2, F.lit(0))
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, last)

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, n), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(o: Column) -> Column:
            none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
            beside = F.arrays_zip(o.alias("x"), F.slice(o, 2, n).alias("y"), F.concat(none, o).alias("z"))
            kept = F.filter(beside, lambda t: (t["x"]["h"] == t["y"]["h"]) | (t["x"]["h"] == t["z"]["h"]))
            return let(F.sort_array(F.transform(kept, lambda t: t["x"]["i"])), covered)

        return let(ordered, twice)

    # most texts repeat no window: then nothing is sorted
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(places(h)),
    )


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """``n_dup_lines`` and ``n_repeat_words`` of a text and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(words),
    }


def common_words(body: DataFrame, n: int = COMMON_WORDS) -> DataFrame:
    """``(lang, common)``: the ``n`` most frequent lower-cased words of each language of (lang, text), counted exactly; ties by code point."""
    each = body.select("lang", F.explode(F.split(F.lower("text"), SPACES)).alias("w")).filter(F.col("w") != "")
    counts = each.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter(F.col("rank") <= n)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]).alias("common"))


def class_counts(text: Column) -> Column:
    """Characters of each class, by what is left after taking one class after the other away; symbols stand before the rest."""

    def step(rest: Column, patterns: tuple[str, ...]) -> Column:
        size = F.length(rest).cast("double")
        if not patterns:
            return F.array(size)
        return let(F.regexp_replace(rest, patterns[0], ""), lambda left: F.concat(F.array(size - F.length(left)), step(left, patterns[1:])))

    return step(text, (*CLASSES, SYMBOLS))


def bin_counts(words: Column, common: Column) -> Column:
    """How often each word of ``common``, an array of ``COMMON_WORDS`` at most, is among the words, then all other words."""

    # one character of the private use area stands for each common word, so that counting reads short strings
    signs = [chr(0xE000 + i) for i in range(COMMON_WORDS)]

    def counted(found: Column) -> Column:
        sign = F.transform(found, lambda at: F.substring(F.lit("".join(signs)), at.cast("int"), F.lit(1)))
        others = (F.size(words) - F.size(found)).cast("double")

        def each(x: Column) -> Column:
            size = F.length(x)
            return F.array(*[(size - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double") for c in signs], others)

        return let(F.array_join(sign, ""), each)

    return let(F.filter(F.transform(words, lambda w: F.array_position(common, F.lower(w))), lambda at: at > 0), counted)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms given as arrays of counts; null if one is empty."""

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def part(v, m):
        return F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))

    def shares(x, body):
        return let(total(x), lambda n: F.when(n > 0, let(F.transform(x, lambda v: v / n), body)))

    def between(p, q):
        terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), total(terms)))

    return shares(p, lambda a: shares(q, lambda b: between(a, b)))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_char: float = MOST_CHAR_DISTANCE,
    most_word: float = MOST_WORD_DISTANCE,
) -> DataFrame:
    """Base counts and verdict of every document; DataFrame functions only.

    A document's characters by class and its words by common word of its language are compared with the sums over all
    documents of that language by Jensen-Shannon distance. ``kept`` is false for a failed base rule, else unless a
    distance is beyond its bound; the word bound is ``most_word`` or, if less, ``MOST_WORD_SHARE`` of the distance of a
    text without common words, so such a text is never kept. Documents below ``JUDGED_WORDS`` words and languages below ``REFERENCE_WORDS`` are
    not judged by distance. The common words (``COMMON_WORDS`` of each language) are stored and joined by language.
    Counts of each document are stored once; references are sums per language, whatever share of the rows a language holds.

    Null text: no words, so it fails; a null language is one language; a null id is kept; repeated rows are
    judged each on its own; an empty table gives an empty result. Starts jobs when called.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    common = stored(common_words(body).select(F.col("lang").alias("__lang"), "common"), "common")
    body = body.join(common, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    known = F.coalesce("common", F.array().cast("array<string>"))

    def measures(words: Column) -> Column:
        base = [c.alias(k) for k, c in base_counts(F.col("text"), words).items()]
        return F.struct(F.size(words).cast("bigint").alias("n_words"), *base, bin_counts(words, known).alias("bins"))

    counts = body.select("id", "lang", let(words_of(F.col("text")), measures).alias("m"), class_counts(F.col("text")).alias("chars"))
    bins = len(CLASSES) + 1
    sizes = {
        "word_chars": F.aggregate("chars", F.lit(0.0), lambda s, v: s + v) - F.col("chars")[CLASSES.index(SPACES)],
        "n_symbols": F.col("chars")[bins - 1],
    }
    merged = F.concat(F.slice("chars", 1, bins - 1), F.array(F.col("chars")[bins - 1] + F.col("chars")[bins]))
    counts = counts.select("id", "lang", "m.*", *[c.cast("bigint").alias(k) for k, c in sizes.items()], merged.alias("chars"))
    counts = stored(counts, "histograms")
    per_language = counts.groupBy(F.col("lang").alias("__lang")).agg(
        F.sum("n_words").alias("lang_words"),
        F.array(*[F.sum(F.col("chars")[i]) for i in range(bins)]).alias("lang_chars"),
        F.array(*[F.sum(F.col("bins")[i]) for i in range(COMMON_WORDS + 1)]).alias("lang_bins"),
    )
    none = F.array(*[F.lit(0.0)] * COMMON_WORDS, F.lit(1.0))
    per_language = per_language.withColumn("none_distance", distance(none, F.col("lang_bins")))
    joined = counts.join(per_language, F.col("lang").eqNullSafe(F.col("__lang")))
    judged = (F.col("n_words") >= JUDGED_WORDS) & (F.col("lang_words") >= REFERENCE_WORDS)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(judged, distance(F.col("chars"), F.col("lang_chars"))).alias("char_distance"),
        F.when(judged, distance(F.col("bins"), F.col("lang_bins"))).alias("word_distance"),
        F.col("none_distance"),
    )
    bound = F.least(F.lit(most_word), MOST_WORD_SHARE * F.col("none_distance"))
    odd = (F.col("char_distance") > most_char) | (F.col("word_distance") > bound)
    return measured.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).drop("none_distance")
