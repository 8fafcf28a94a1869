import math
import random
import re
from collections import Counter

import pytest
from helpers import one, text_value
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlmill.functions import lexicons as L
from crawlmill.functions import text as T
from crawlmill.operators import terms as K
from crawlmill.plans import inputs

SAMPLE = (
    "The New York Times wrote about Anna. Éange word2 _under naïve data data-set.\tJohn Smith said: "
    "Great success! what is this? A B Ab. X1 foo bar foo\x1cbar baz foo"
)


def random_text(seed):
    rng = random.Random(seed)
    words = "the cat Dog data of Paris naïve x1 go_on London city and market good bad crisis É ab".split()
    gaps = [" ", " ", " ", ". ", "! ", "\n", ", ", " ", ".\n"]
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 80)))


TEXTS = [SAMPLE, "", "   \n", "one", "Hello World. Foo Bar", *map(random_text, range(12))]


def py_topics(text, k=5):
    found = re.findall(r"\b[a-zA-Z]{3,}\b", text.lower())
    return [w for w, _ in Counter(w for w in found if w not in L.TOPIC_STOP_WORDS).most_common(k)]


def py_keywords(text, top_n):
    toks = re.findall("[a-z0-9]+", text.lower())
    ok = lambda t: t not in L.KEYWORD_STOP_WORDS and len(t) > 2
    uni = Counter(filter(ok, toks)).most_common(2 * top_n)
    bi = Counter(f"{a} {b}" for a, b in zip(toks, toks[1:]) if ok(a) and ok(b)).most_common(top_n)
    rows = []
    for pairs, boost in ((uni, 1.0), (bi, 1.5)):
        for term, n in pairs:
            rows.append((term, n, round(n * (math.log(len(toks) / n) if n < len(toks) else 0.1) * boost, 3), boost > 1))
    return sorted(rows, key=lambda r: -r[2])[:top_n]


def py_entities(text):
    out = []
    for m in re.finditer(r"(?<!\. )(?<!\.\s)(?<!^)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", text):
        out.append(m.group(1))
    for sentence in re.split(r"[.!?]\s+", text):
        for word in sentence.split()[1:]:
            plain = re.sub("[^a-zA-Z]", "", word)
            if len(plain) > 1 and plain[0].isupper():
                out.append(plain)
    return list(dict.fromkeys(out))


def py_complexity(text):
    words = text.split()
    if not words:
        return 0.0
    sentences = [s for s in re.split("[.!?]+", text) if s.strip()]
    clamp = lambda x: min(max(x, 0), 1)
    by_word = clamp((sum(map(len, words)) / len(words) - 4) / 6)
    return round((by_word + clamp((len(words) / max(len(sentences), 1) - 5) / 25)) / 2, 4)


def py_readability(text):
    sentences = [s for s in re.split("[.!?]+", text) if s.strip()]
    words = re.findall(r"\w+", text)
    per = sum(len(s.split()) for s in sentences) / len(sentences) if sentences else 0
    size = sum(map(len, words)) / len(words) if words else 0
    return round(max(0, 0.39 * per + 11.8 * (size / 3.0) - 15.59), 1)


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    out = df.select(
        "i",
        F.transform(T.topics("t"), lambda x: x["term"]).alias("topics"),
        T.keywords("t", 4).alias("keywords"),
        T.entities("t").alias("entities"),
        T.complexity("t").alias("complexity"),
        T.readability("t").alias("readability"),
        T.word_count("t").alias("words"),
        T.analysis("t").alias("a"),
    )
    return {r["i"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_against_plain_python(scored, i):
    r, text = scored[i], TEXTS[i]
    assert r["topics"] == py_topics(text)
    assert [tuple(k) for k in r["keywords"]] == py_keywords(text, 4)
    assert r["entities"] == py_entities(text)
    assert r["complexity"] == pytest.approx(py_complexity(text), abs=1.01e-4)
    assert r["readability"] == pytest.approx(py_readability(text), abs=0.101)
    assert r["words"] == len(text.split())
    blank = not text.strip()
    assert r["a"]["category"] == "general" if blank else r["a"]["category"]
    assert r["a"]["topics"] == ([] if blank else py_topics(text))
    assert r["a"]["entities"] == ([] if blank else py_entities(text))


def test_sentiment(spark):
    assert text_value(spark, T.sentiment, "A good great day") == 1.0
    assert text_value(spark, T.sentiment, "a BAD awful day, good") == pytest.approx(-0.3333)
    assert text_value(spark, T.sentiment, "plain words") == 0.0
    assert text_value(spark, T.sentiment, "good good good bad") == 0.0
    assert text_value(spark, T.sentiment, "égood good2 _bad") == 0.0


def test_category(spark):
    assert text_value(spark, T.category, "software and AI code") == "technology"
    assert text_value(spark, T.category, "the company found a market, revenue") == "business"
    assert text_value(spark, T.category, "xyz qqq") == "general"
    assert text_value(spark, T.category, "he said so") == "technology"  # "ai" inside a word
    assert text_value(spark, T.category, "software and bank stock", ["sports", "finance"]) == "finance"


def test_reading_time(spark):
    assert text_value(spark, T.reading_minutes, "word " * 200) == 1.0


def test_lexicon_sizes():
    assert (len(L.POSITIVE_WORDS), len(L.NEGATIVE_WORDS)) == (51, 51)
    assert len(set(L.POSITIVE_WORDS)) == 51 and len(set(L.NEGATIVE_WORDS)) == 51


def usage(spark, text, keyword, title=""):
    listed = F.array("k")
    return one(spark, T.keyword_usage("t", listed, "h"), t=(text, "string"), k=(keyword, "string"), h=(title, "string"))[0]


def test_keyword_usage(spark):
    assert usage(spark, "C++ and c++ or C", "C++")["count"] == 2
    u = usage(spark, "web scraping is fun and Web Scraping works", "web scraping", "On WEB scraping")
    assert (u["count"], u["density"], u["in_title"], u["in_first_paragraph"]) == (2, 50.0, True, True)
    assert usage(spark, "", "x")["density"] == 0.0
    late = usage(spark, "first\n\nsecond key", "key")
    assert (late["in_first_paragraph"], late["in_title"], late["count"]) == (False, False, 1)
    assert one(spark, T.keyword_density("t", "k"), t=("a b a b", "string"), k=("a b", "string")) == 100.0


def article(spark, text, title, meta, keywords):
    cols = dict(t=(text, "string"), h=(title, "string"), m=(meta, "string"), k=(keywords, "array<string>"))
    return one(spark, T.article_score("t", "h", "m", "k"), **cols)


def test_article_score(spark):
    low = article(spark, "Short text.", "t", "m", ["absent"])
    assert low["total_score"] < 40
    assert low["issues"] == [
        "Content too short (2 words). Aim for 1500+.",
        "Meta description should be 50-160 characters.",
        'Keyword "absent" not found in content.',
    ]
    assert "Add headings (H2, H3) to structure content." in low["suggestions"]
    many = [f"key{i}" for i in range(12)]
    body = "# One\n## Two\n### Three\n" + " ".join(many) + " word" * 1600
    capped = article(spark, body, "x" * 40, "y" * 100, many)
    assert capped["heading_count"] == 3
    assert capped["total_score"] == 60 + 15 + (15 if 6 <= capped["readability_grade"] <= 12 else 10 if capped["readability_grade"] < 6 else 5)
    assert article(spark, "", None, None, [])["word_count"] == 0
    assert text_value(spark, T.readability, "") == 0.0


def test_compare_and_gap(spark):
    pairs = spark.createDataFrame([("alpha beta gamma the", "beta gamma delta"), ("", "of")], "text_a string, text_b string")
    got = [tuple(r) for r in K.compare_pairs(pairs).collect()]
    assert got == [(["beta", "gamma"], ["alpha"], ["delta"], 0.5), ([], [], [], 0.0)]
    table = spark.createDataFrame([("me", k) for k in "abcd"] + [("you", k) for k in "cdef"], "s string, keyword string")
    rivals = spark.createDataFrame([("me", "you")], "s string, r string")
    gaps = K.keyword_gap(table, rivals, "s", "r")
    assert tuple(K.gap_counts(gaps, "s", "r").first()) == ("me", "you", 2, 2, 2)
    assert sorted(r["keyword"] for r in gaps.filter("status = 'missing'").collect()) == ["e", "f"]


def test_long_runs_and_prefixes(spark):
    text = "word " * 100_000 + "wor wordy wor " + "ab abc abc ab ab abcd"
    got = text_value(spark, lambda t: T.top_terms(T.tokens(t), 5), text)
    assert [tuple(x) for x in got] == [("word", 100_000), ("ab", 3), ("wor", 2), ("abc", 2), ("wordy", 1)]
    counts = text_value(spark, lambda t: T.term_counts(T.tokens(t)), "b a b c")
    assert sorted(map(tuple, counts)) == [("a", 1), ("b", 2), ("c", 1)]


def test_analysis_finds_the_words_of_a_text_once(spark):
    done = spark.createDataFrame([(1, "A great day, 2nd b_c")], "id int, t string").select(T.analysis("t", names=False).alias("a"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-zA-Z]{1,}") == 1 and "[a-zA-Z]{3,}" not in plan and plan.count(f", {T.WORD}") == 1
    assert done.first()["a"].asDict()["topics"] == ["great", "day"]


def test_doc_analysis_names_entities(spark, tmp_path):
    # those of the closing passage too, which the query puts behind three of four texts
    rows = [(4 * i + k, t, "en", "s") for i, t in enumerate([*TEXTS, "Foo Bar Baz. Foo Bar Baz Qux", None]) for k in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in inputs.docs(spark, str(tmp_path)).collect()}
    got = entry.queries()["doc_analysis"](spark, str(tmp_path))
    assert got.columns[-2:] == ["entities", "category"]
    assert {r["doc_id"]: r["entities"] for r in got.collect()} == {k: ",".join(py_entities(t or "")) for k, t in texts.items()}


def test_keyword_usage_lowers_a_text_once(spark):
    df = spark.createDataFrame([("One two ONE", "One", ["one", "Two", "x"])], "t string, title string, k array<string>")
    used = df.select(T.keyword_usage("t", "k", "title").alias("u"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lower\([^()]*\.text", plan)
    assert [(u["keyword"], u["count"], u["in_title"]) for u in used.first()["u"]] == [("one", 2, True), ("Two", 1, False), ("x", 0, False)]
