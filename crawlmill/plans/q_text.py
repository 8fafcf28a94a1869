"""Text, keyword, article-score and score-trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.core import round_to
from ..operators import terms as K
from ..operators.overlap import corpus_overlap, keyword_sets, set_classes
from ..operators.series import score_trend
from ..sources.readers import read_table
from . import inputs as I
from .registry import fill, keywords_sql, query, rnd

# whole words of plain letters, as in functions.text
_LETTERS_SQL = fill(
    """letters AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[@WORD@]+'),
    lambda w: regexp_matches(w, '^[a-z]+$')) AS ws FROM docs)"""
)

_TOPICS_SQL = fill(
    f"""{_LETTERS_SQL}, counted AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first
  FROM letters, unnest(ws) WITH ORDINALITY AS t(term, pos)
  WHERE length(term) >= 3 AND term NOT IN (@TOPIC_STOP@) GROUP BY ALL),
topics AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank, term, n
  FROM counted QUALIFY rank <= 5)"""
)


@query("doc_topics", f"WITH {I.DOCS_SQL}, {_TOPICS_SQL} SELECT * FROM topics")
def doc_topics(spark, folder):
    return K.topics(I.docs(spark, folder), "doc_id", "text")


@query("doc_keywords", keywords_sql(I.DOCS_SQL))
def doc_keywords(spark, folder):
    return K.keywords(I.docs(spark, folder), "doc_id", "text")


_SENTIMENT_SQL = fill(
    f"""mood AS (SELECT doc_id, {rnd("CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END", 4)} AS sentiment_score FROM (
  SELECT doc_id, len(list_filter(d, lambda w: w IN (@POSITIVE@))) AS p, len(list_filter(d, lambda w: w IN (@NEGATIVE@))) AS n
  FROM (SELECT doc_id, list_distinct(ws) AS d FROM letters)))"""
)


@query("doc_sentiment", f"WITH {I.DOCS_SQL}, {_LETTERS_SQL}, {_SENTIMENT_SQL} SELECT * FROM mood")
def doc_sentiment(spark, folder):
    return I.docs(spark, folder).select("doc_id", T.sentiment("text").alias("sentiment_score"))


@query("doc_entities")
def doc_entities(spark, folder):
    return I.docs(spark, folder).select("doc_id", F.explode(T.entities("text")).alias("entity"))


def _hits_sql(name: str) -> str:
    return " + ".join(f"CAST(contains(l, '{k}') AS INTEGER)" for k in T.CATEGORY_KEYWORDS[name])


_RANKED = [c for c in T.CATEGORIES if c in T.CATEGORY_KEYWORDS]
_CATEGORY_SQL = (
    "cats AS (SELECT doc_id, CASE WHEN greatest("
    + ", ".join(f"s_{c}" for c in _RANKED)
    + ") = 0 THEN 'general' "
    + " ".join(f"WHEN s_{c} = greatest({', '.join(f's_{o}' for o in _RANKED)}) THEN '{c}'" for c in _RANKED)
    + " END AS category FROM (SELECT doc_id, "
    + ", ".join(f"{_hits_sql(c)} AS s_{c}" for c in _RANKED)
    + " FROM (SELECT doc_id, lower(text) AS l FROM docs)))"
)


@query("doc_category", f"WITH {I.DOCS_SQL}, {_CATEGORY_SQL} SELECT * FROM cats")
def doc_category(spark, folder):
    return I.docs(spark, folder).select("doc_id", T.category("text").alias("category"))


_WORDS_SQL = fill(
    """facts AS (SELECT doc_id, text, CAST(len(regexp_extract_all(text, '[^@SPACE@]+')) AS BIGINT) AS words,
  length(regexp_replace(text, '[@SPACE@]+', '', 'g')) AS letters_n,
  len(regexp_extract_all(text, '[^@SPACE@.!?][^.!?]*')) AS sentences,
  len(regexp_extract_all(text, '[^@SPACE@.!?]+')) AS sentence_words,
  len(regexp_extract_all(text, '[@WORD@]+')) AS w_count,
  length(regexp_replace(text, '[^@WORD@]+', '', 'g')) AS w_letters FROM docs)"""
)

_COMPLEXITY = rnd(
    """CASE WHEN words = 0 THEN 0 ELSE (least(greatest((letters_n / words - 4) / 6, 0), 1)
  + least(greatest((words / greatest(sentences, 1) - 5) / 25, 0), 1)) / 2 END""",
    4,
)


@query("doc_complexity", f"WITH {I.DOCS_SQL}, {_WORDS_SQL} SELECT doc_id, {_COMPLEXITY} AS complexity FROM facts")
def doc_complexity(spark, folder):
    return I.docs(spark, folder).select("doc_id", T.complexity("text").alias("complexity"))


# RE2 has no look-behind: a text is put behind a sentence end, and a run of capitalised words that follows one loses its first word
_ENTITIES_SQL = fill(
    """runs AS (SELECT doc_id, regexp_extract_all('. ' || text, '(?:\\.[@SPACE@])?[A-Z][a-z]+(?:[@SPACE@]+[A-Z][a-z]+)+') AS ms FROM docs),
named AS (SELECT doc_id, list_concat(
    list_filter(list_transform(ms, lambda m: regexp_replace(m, '^\\.[@SPACE@][A-Z][a-z]+[@SPACE@]+', '')),
      lambda m: regexp_matches(m, '[@SPACE@]')),
    list_filter(list_transform(flatten(list_transform(string_split_regex(text, '[.!?][@SPACE@]+'),
        lambda s: regexp_extract_all(s, '[^@SPACE@]+')[2:])), lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g')),
      lambda w: regexp_matches(w, '^[A-Z].'))) AS es FROM runs JOIN docs USING (doc_id)),
first_named AS (SELECT doc_id, entity, min(pos) AS first FROM named, unnest(es) WITH ORDINALITY AS t(entity, pos) GROUP BY ALL),
entities AS (SELECT doc_id, string_agg(entity, ',' ORDER BY first) AS entities FROM first_named GROUP BY doc_id)"""
)


@query(
    "doc_analysis",
    f"""WITH {I.DOCS_SQL}, {_TOPICS_SQL}, {_SENTIMENT_SQL}, {_CATEGORY_SQL}, {_ENTITIES_SQL}, {_WORDS_SQL}
SELECT f.doc_id, coalesce((SELECT string_agg(term, ',' ORDER BY rank) FROM topics t WHERE t.doc_id = f.doc_id), '') AS topics,
  sentiment_score, words AS word_count, {rnd("words / 200.0", 2)} AS reading_time_minutes,
  {_COMPLEXITY} AS language_complexity, coalesce(entities, '') AS entities, category
FROM facts f JOIN mood USING (doc_id) JOIN cats USING (doc_id) LEFT JOIN entities USING (doc_id)""",
)
def doc_analysis(spark, folder):
    """All content measures of every text; topics and entities are lists in one text, parted by commas, which neither can hold."""
    done = I.docs(spark, folder).select("doc_id", T.analysis("text").alias("a")).select("doc_id", "a.*")
    return done.withColumns({c: F.concat_ws(",", c) for c in ("topics", "entities")})


_GRADE = rnd(
    """greatest(0.0, 0.39 * coalesce(sentence_words / nullif(sentences, 0), 0)
  + 11.8 * (coalesce(w_letters / nullif(w_count, 0), 0) / 3) - 15.59)""",
    1,
)


@query("doc_readability", f"WITH {I.DOCS_SQL}, {_WORDS_SQL} SELECT doc_id, {_GRADE} AS grade FROM facts")
def doc_readability(spark, folder):
    return I.docs(spark, folder).select("doc_id", T.readability("text").alias("grade"))


# --- keyword usage --------------------------------------------------------------------------------

_KEYWORDS_SQL = "kws AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in I.ARTICLE_KEYWORDS) + "]) AS keyword)"

_USAGE_SQL = fill(
    f"""{_KEYWORDS_SQL}, usage AS (SELECT doc_id, keyword, n AS count,
  {rnd("CASE WHEN words = 0 THEN 0 ELSE n * (1 + length(keyword) - length(replace(keyword, ' ', ''))) / words * 100 END", 2)} AS density,
  title <> '' AND contains(lower(title), lower(keyword)) AS in_title,
  contains(lower(split_part(text, chr(10) || chr(10), 1)), lower(keyword)) AS in_first_paragraph
FROM (SELECT *, CAST((length(lower(text)) - length(replace(lower(text), lower(keyword), ''))) // length(keyword) AS BIGINT) AS n,
  len(regexp_extract_all(text, '[^@SPACE@]+')) AS words FROM articles, kws))"""
)


@query("kw_count", f"WITH {I.ARTICLES_SQL}, {_USAGE_SQL} SELECT doc_id, keyword, count FROM usage")
def kw_count(spark, folder):
    listed = I.articles(spark, folder).select("doc_id", "text", F.explode("keywords").alias("keyword"))
    return listed.select("doc_id", "keyword", T.keyword_count("text", "keyword").alias("count"))


@query("kw_density", f"WITH {I.ARTICLES_SQL}, {_USAGE_SQL} SELECT doc_id, keyword, density FROM usage")
def kw_density(spark, folder):
    listed = I.articles(spark, folder).select("doc_id", "text", F.explode("keywords").alias("keyword"))
    return listed.select("doc_id", "keyword", T.keyword_density("text", "keyword").alias("density"))


@query("kw_analysis", f"WITH {I.ARTICLES_SQL}, {_USAGE_SQL} SELECT * FROM usage")
def kw_analysis(spark, folder):
    return K.keyword_usage(I.articles(spark, folder), ["doc_id"], "text", "title", I.ARTICLE_KEYWORDS)


@query(
    "seo_score",
    fill(
        f"""WITH {I.ARTICLES_SQL}, {_USAGE_SQL}, {_WORDS_SQL},
u AS (SELECT doc_id, sum(CASE WHEN density BETWEEN 0.5 AND 3.0 THEN 8 WHEN count > 0 THEN 4 ELSE 0 END
    + CASE WHEN in_title THEN 4 ELSE 0 END + CASE WHEN in_first_paragraph THEN 3 ELSE 0 END) AS points,
  string_agg(CASE WHEN NOT density BETWEEN 0.5 AND 3.0 AND count = 0 THEN 'Keyword "' || keyword || '" not found in content.' END, ' | '
    ORDER BY list_position([{", ".join(f"'{k}'" for k in I.ARTICLE_KEYWORDS)}], keyword)) AS unused FROM usage GROUP BY doc_id),
a AS (SELECT a.doc_id, words, length(meta) BETWEEN 50 AND 160 AS has_meta, length(title) BETWEEN 30 AND 65 AS good_title,
  CAST(len(regexp_extract_all(a.text, '(?m)^#{{1,6}}[@SPACE@]')) AS BIGINT) AS headings, {_GRADE} AS grade, points, unused
  FROM articles a JOIN facts f USING (doc_id) JOIN u USING (doc_id))
SELECT doc_id, CAST(least(100, least(60, CASE WHEN words >= 1500 THEN 20 WHEN words >= 800 THEN 15 WHEN words >= 300 THEN 10 ELSE 5 END
    + CASE WHEN has_meta THEN 10 ELSE 0 END + CASE WHEN good_title THEN 10 ELSE 0 END + points)
    + CASE WHEN headings >= 3 THEN 15 WHEN headings >= 1 THEN 8 ELSE 0 END
    + CASE WHEN grade BETWEEN 6 AND 12 THEN 15 WHEN grade < 6 THEN 10 ELSE 5 END) AS BIGINT) AS total_score,
  words AS word_count, has_meta AS has_meta_description, headings AS heading_count, grade AS readability_grade,
  concat_ws(' | ', CASE WHEN words < 300 THEN 'Content too short (' || words || ' words). Aim for 1500+.' END,
    CASE WHEN NOT has_meta THEN 'Meta description should be 50-160 characters.' END, unused) AS issues,
  concat_ws(' | ', CASE WHEN NOT good_title THEN 'Title should be 30-65 characters.' END,
    CASE WHEN headings = 0 THEN 'Add headings (H2, H3) to structure content.' END,
    CASE WHEN grade < 6 THEN 'Content may be too simple for the audience.' WHEN grade > 12 THEN 'Content readability is high. Simplify sentences.' END) AS suggestions
FROM a"""
    ),
)
def seo_score(spark, folder):
    scored = I.articles(spark, folder).select("doc_id", T.article_score("text", "title", "meta", "keywords").alias("s"))
    shown = scored.select("doc_id", "s.*").drop("keyword_scores")
    return shown.withColumns({c: F.concat_ws(" | ", c) for c in ("issues", "suggestions")})


# --- overlap --------------------------------------------------------------------------------------

_SET_SQL = fill(
    """sets AS (SELECT doc_id, source, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')),
    lambda w: length(w) > 2 AND w NOT IN (@KEYWORD_STOP@)) AS ks FROM docs)"""
)


@query(
    "content_compare",
    f"""WITH {I.DOCS_SQL}, {_SET_SQL}, p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.ks AS ka, b.ks AS kb,
  list_intersect(a.ks, b.ks) AS shared FROM sets a JOIN sets b ON b.doc_id = a.doc_id + 1)
SELECT doc_a, doc_b, array_to_string(list_sort(shared), ',') AS shared,
  array_to_string(list_sort(list_filter(ka, lambda x: NOT list_contains(shared, x))), ',') AS unique_to_a,
  array_to_string(list_sort(list_filter(kb, lambda x: NOT list_contains(shared, x))), ',') AS unique_to_b,
  {rnd("CASE WHEN len(ka) + len(kb) = 0 THEN 0 ELSE len(shared) / (len(ka) + len(kb) - len(shared)) END", 4)} AS similarity
FROM p""",
)
def content_compare(spark, folder):
    docs = I.docs(spark, folder).select("doc_id", "text")
    after = docs.select(
        (F.col("doc_id") - 1).alias("doc_a"), F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b")
    )
    pairs = docs.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")).join(after, "doc_a")
    compared = K.compare_pairs(pairs)
    return compared.withColumns({c: F.concat_ws(",", c) for c in ("shared", "unique_to_a", "unique_to_b")})


_LEAST_OVERLAP = 0.5

_CLASS_SQL = """same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(ks)) AS same_as, ks FROM sets WHERE len(ks) > 0)"""


@query(
    "content_overlap_pairs",
    f"""WITH {I.DOCS_SQL}, {_SET_SQL}, {_CLASS_SQL}, items AS (
  SELECT doc_id, len(ks) AS n, unnest(ks) AS w FROM same WHERE doc_id = same_as),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared
  FROM items x JOIN items y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)
SELECT a, b, shared, na - shared AS only_a, nb - shared AS only_b, {rnd("shared / (na + nb - shared)", 6)} AS similarity
FROM met WHERE shared / (na + nb - shared) >= {_LEAST_OVERLAP}""",
)
def content_overlap_pairs(spark, folder):
    """All pairs of texts, up to equal keyword sets, of which half the keywords or more are shared."""
    pairs = corpus_overlap(I.docs(spark, folder), "doc_id", "text", _LEAST_OVERLAP)
    return pairs.withColumn("similarity", round_to("similarity", 6))


@query("content_overlap_classes", f"WITH {I.DOCS_SQL}, {_SET_SQL}, {_CLASS_SQL} SELECT doc_id, same_as FROM same")
def content_overlap_classes(spark, folder):
    return set_classes(keyword_sets(I.docs(spark, folder), "doc_id", "text"), "doc_id")


def _gaps(spark, folder):
    table = K.keyword_table(I.docs(spark, folder), "source", "text")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    rival = F.concat(F.lit("src"), (number + 1).cast("string"))
    sources = read_table(spark, folder, "documents").select("source").distinct()
    return K.keyword_gap(table, sources.select("source", rival.alias("rival")), "source", "rival")


_GAP_SQL = f"""{_SET_SQL}, kw AS (SELECT DISTINCT source, unnest(ks) AS keyword FROM sets),
rivals AS (SELECT DISTINCT source, 'src' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) + 1) AS rival FROM docs),
gaps AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.rival, b.rival) AS rival,
    coalesce(a.keyword, b.keyword) AS keyword,
    CASE WHEN a.keyword IS NULL THEN 'missing' WHEN b.keyword IS NULL THEN 'unique' ELSE 'shared' END AS status
  FROM (SELECT r.source, r.rival, k.keyword FROM rivals r JOIN kw k ON k.source = r.source) a
  FULL JOIN (SELECT r.source, r.rival, k.keyword FROM rivals r JOIN kw k ON k.source = r.rival) b
  ON a.source = b.source AND a.rival = b.rival AND a.keyword = b.keyword)"""


@query("keyword_gap", f"WITH {I.DOCS_SQL}, {_GAP_SQL} SELECT * FROM gaps")
def keyword_gap(spark, folder):
    return _gaps(spark, folder)


@query(
    "keyword_gap_counts",
    f"""WITH {I.DOCS_SQL}, {_GAP_SQL} SELECT source, rival, count(*) FILTER (status = 'missing') AS gap_count,
  count(*) FILTER (status = 'shared') AS shared_count, count(*) FILTER (status = 'unique') AS unique_count
FROM gaps GROUP BY source, rival""",
)
def keyword_gap_counts(spark, folder):
    return K.gap_counts(_gaps(spark, folder), "source", "rival")


# --- trends ---------------------------------------------------------------------------------------


@query(
    "score_trend",
    f"""WITH h AS (SELECT o_custkey, o_totalprice / 1e5 AS score, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT o_custkey, max(score) FILTER (r = 1) AS a, max(score) FILTER (r = n) AS z, max(n) AS data_points FROM h GROUP BY o_custkey),
s AS (SELECT *, coalesce((z - a) / nullif(data_points - 1, 0), 0) AS step FROM e)
SELECT o_custkey, CASE WHEN step > 2.0 THEN 'improving' WHEN step < -2.0 THEN 'declining' ELSE 'stable' END AS trend_direction,
  {rnd("step", 2)} AS avg_change, CASE WHEN data_points < 2 THEN z ELSE {rnd("z + step", 1)} END AS forecast, data_points FROM s""",
)
def trend(spark, folder):
    history = read_table(spark, folder, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", (F.col("o_totalprice") / 1e5).alias("score")
    )
    return score_trend(history, ["o_custkey"], ["o_orderdate", "o_orderkey"])
