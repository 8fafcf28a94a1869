"""Topic, keyword and overlap tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.core import let, round_to


def topics(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent topic words per text: one row per (key, rank)."""
    return docs.select(key, F.posexplode(T.topics(text, k)).alias("pos", "t")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("t.term").alias("term"), F.col("t.n").alias("n")
    )


def keywords(docs: DataFrame, key: str, text: str, top_n: int = 20) -> DataFrame:
    """The ``top_n`` keyword suggestions per text: one row per (key, rank)."""
    return docs.select(key, F.posexplode(T.keywords(text, top_n)).alias("pos", "k")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("rank"), "k.*"
    )


def compare_pairs(pairs: DataFrame, text_a: str = "text_a", text_b: str = "text_b") -> DataFrame:
    """Shared and unique keywords and their Jaccard similarity for each row's two texts."""
    sets = F.struct(T.keyword_set(text_a).alias("a"), T.keyword_set(text_b).alias("b"))

    def compared(s):
        a, b = s["a"], s["b"]
        return F.struct(
            F.sort_array(F.array_intersect(a, b)).alias("shared"),
            F.sort_array(F.array_except(a, b)).alias("unique_to_a"),
            F.sort_array(F.array_except(b, a)).alias("unique_to_b"),
        )

    out = pairs.withColumn("__c", let(sets, compared)).drop(text_a, text_b)
    union = F.size("shared") + F.size("unique_to_a") + F.size("unique_to_b")
    similarity = F.coalesce(round_to(F.try_divide(F.size("shared"), union), 4), F.lit(0.0))
    return out.select("*", "__c.*").drop("__c").withColumn("similarity", similarity)


def keyword_table(docs: DataFrame, owner: str, text: str) -> DataFrame:
    """Distinct (owner, keyword) rows; combined per task before the shuffle."""
    return docs.select(owner, F.explode(T.keyword_set(text)).alias("keyword")).distinct()


def keyword_gap(keywords_: DataFrame, rivals: DataFrame, owner: str, rival: str) -> DataFrame:
    """Every keyword of each (owner, rival) pair with status missing, shared or unique.

    ``keywords_`` holds (owner, keyword), ``rivals`` holds the pairs to compare. Each pair gives its two
    sites a role; one join brings the keywords, and they are combined on (pair, keyword), so a site with
    very many keywords is spread over all tasks.
    """
    role = lambda site, mine: F.struct(
        F.col(site).alias("__site"), F.lit(mine).alias("mine"), F.lit(1 - mine).alias("theirs")
    )
    roles = rivals.select(owner, rival, F.inline(F.array(role(owner, 1), role(rival, 0))))
    listed = keywords_.withColumnRenamed(owner, "__site").join(roles, "__site")
    both = listed.groupBy(owner, rival, "keyword").agg(F.max("mine").alias("mine"), F.max("theirs").alias("theirs"))
    status = (
        F.when((F.col("mine") == 1) & (F.col("theirs") == 1), "shared")
        .when(F.col("mine") == 1, "unique")
        .otherwise("missing")
    )
    return both.select(owner, rival, "keyword", status.alias("status"))


def gap_counts(gaps: DataFrame, owner: str, rival: str) -> DataFrame:
    """Numbers of missing (the gap), shared and unique keywords per pair."""
    of = lambda s: F.count_if(F.col("status") == s)
    return gaps.groupBy(owner, rival).agg(
        of("missing").alias("gap_count"), of("shared").alias("shared_count"), of("unique").alias("unique_count")
    )


def keyword_usage(docs: DataFrame, keys: Sequence[str], text: str, title: str, keyword_list: Sequence[str]) -> DataFrame:
    """Usage of each given keyword in each text: one row per (text, keyword)."""
    if len(keyword_list) > 10_000:
        raise ValueError("pass a keyword column instead of more than 10,000 keyword literals")
    listed = F.array(*[F.lit(k) for k in keyword_list])
    return docs.select(*keys, F.explode(T.keyword_usage(text, listed, title)).alias("u")).select(*keys, "u.*")
