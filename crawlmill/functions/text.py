"""Text scoring expressions. Every function is one projection over the text column, with no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SPACE, WORDCHAR, blank, col, let, match_count, matches, messages, ratio, round_to
from .lexicons import (
    CATEGORIES,
    CATEGORY_KEYWORDS,
    KEYWORD_STOP_WORDS,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    TOPIC_STOP_WORDS,
)

WORD = f"[^{SPACE}]+"
ALNUM = "[a-z0-9]+"
# a sentence starts at its first printable character; a word never crosses a terminator here
SENTENCE = f"[^{SPACE}.!?][^.!?]*"
SENTENCE_WORD = f"[^{SPACE}.!?]+"


def _letters(min_length: int) -> str:
    # whole words of plain letters; a neighbouring digit, underscore or accented letter rules a word out
    return f"(?<![{WORDCHAR}])[a-zA-Z]{{{min_length},}}(?![{WORDCHAR}])"


def words(text: Column | str) -> Column:
    return matches(col(text), WORD)


def word_count(text: Column | str) -> Column:
    return match_count(col(text), WORD).cast("bigint")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return matches(F.lower(col(text)), ALNUM)


def is_keyword(token: Column) -> Column:
    return ~token.isin(KEYWORD_STOP_WORDS) & (F.length(token) > 2)


def keyword_set(text: Column | str) -> Column:
    """Distinct keyword tokens in order of first appearance."""
    return F.filter(F.array_distinct(tokens(text)), is_keyword)


# --- term counts inside one row -------------------------------------------------------------------


# a term that occurs at least twice in a row, in a sorted text with a line feed before every term
_REPEATED = r"(\n[^\n]++)\1+(?![^\n])"


def _repeated(terms: Column) -> Column:
    """Terms that occur at least twice with their counts, in term order.

    Sorted and joined, equal terms are neighbouring lines, so one pattern finds each run as a whole and
    only repeated terms are looked at one by one: no explode, no shuffle. Terms hold no line feeds.
    """
    joined = F.concat(F.lit("\n"), F.array_join(F.sort_array(terms), "\n"))

    def counted(run: Column) -> Column:
        term = F.substring_index(F.substring(run, 2, 2**31 - 1), "\n", 1)
        return F.struct(term.alias("term"), F.try_divide(F.length(run), F.length(term) + 1).cast("bigint").alias("n"))

    return F.transform(matches(joined, _REPEATED), counted)


def _once(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(1).cast("bigint").alias("n")))


def _with_runs(terms: Column, body) -> Column:
    return let(terms, lambda t: let(F.struct(t.alias("every"), _repeated(t).alias("runs")), body))


def term_counts(terms: Column) -> Column:
    """``array<struct<term,n>>`` of an array of strings without line feeds."""
    return _with_runs(terms, lambda f: F.concat(f["runs"], _once(F.array_except(f["every"], f["runs"]["term"]))))


def top_terms(terms: Column, k: int) -> Column:
    """The ``k`` most frequent terms as ``array<struct<term,n>>``, best first; ties go to the first seen.

    Terms that occur once follow the repeated ones in order of appearance.
    """

    def best(f: Column) -> Column:
        every, runs = f["every"], f["runs"]
        # both sides are sorted by term, so they pair up one to one
        seen = F.transform(F.array_intersect(every, runs["term"]), lambda t, i: F.struct(t.alias("t"), i.alias("at")))
        paired = F.arrays_zip(runs.alias("run"), F.sort_array(seen).alias("seen"))
        keyed = F.transform(
            paired,
            lambda z: F.struct((-z["run"]["n"]).alias("neg"), z["seen"]["at"].alias("at"), z["run"]["term"].alias("term")),
        )
        often = F.transform(
            F.slice(F.sort_array(keyed), 1, k), lambda x: F.struct(x["term"].alias("term"), (-x["neg"]).alias("n"))
        )
        once = _once(F.slice(F.array_except(every, runs["term"]), 1, k))
        return F.slice(F.concat(often, once), 1, k)

    return _with_runs(terms, best)


# --- topics, sentiment, entities, category --------------------------------------------------------


def _letter_words(text: Column | str) -> Column:
    return matches(F.lower(col(text)), _letters(1))


def _topic_words(letter_words: Column) -> Column:
    return F.filter(letter_words, lambda w: (F.length(w) >= 3) & ~w.isin(TOPIC_STOP_WORDS))


def topic_words(text: Column | str) -> Column:
    return _topic_words(matches(F.lower(col(text)), _letters(3)))


def topics(text: Column | str, k: int = 5) -> Column:
    return top_terms(topic_words(text), k)


def _lexicon_hits(text: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(text, lambda w: w.isin(lexicon)))


def sentiment(text: Column | str) -> Column:
    """(positive - negative) / (positive + negative) over distinct lexicon words; 0 without any."""
    return _sentiment(_letter_words(text))


def _sentiment(letter_words: Column) -> Column:
    seen = F.array_distinct(letter_words)

    def score(w: Column) -> Column:
        pos, neg = _lexicon_hits(w, POSITIVE_WORDS), _lexicon_hits(w, NEGATIVE_WORDS)
        return F.struct(pos.alias("pos"), neg.alias("neg"))

    def balance(s: Column) -> Column:
        return F.coalesce(round_to(ratio(s["pos"] - s["neg"], s["pos"] + s["neg"]), 4), F.lit(0.0))

    return let(let(seen, score), balance)


def entities(text: Column | str) -> Column:
    """Capitalised sequences away from sentence starts, then capitalised non-first words, distinct."""
    t = col(text)
    sequence = rf"(?<!\. )(?<!\.[{SPACE}])(?<!^)([A-Z][a-z]+(?:[{SPACE}]+[A-Z][a-z]+)+)"

    def later_words(sentence: Column) -> Column:
        later = let(words(sentence), lambda w: F.slice(w, 2, F.greatest(F.size(w), F.lit(1))))
        plain = F.transform(later, lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
        return F.filter(plain, lambda w: w.rlike("^[A-Z]."))

    sentences = F.split(t, f"[.!?][{SPACE}]+")
    singles = F.flatten(F.transform(sentences, later_words))
    return F.array_distinct(F.concat(matches(t, sequence, 1), singles))


def category(text: Column | str, categories: list[str] | None = None) -> Column:
    """The category with most keywords found as substrings; ties go to the earlier category."""
    names = categories or CATEGORIES

    def best(lower: Column) -> Column:
        scored = []
        for rank, name in enumerate(names):
            hits = [F.contains(lower, F.lit(k)).cast("int") for k in CATEGORY_KEYWORDS.get(name, [])]
            total = sum(hits, F.lit(0))
            scored.append(F.struct(total.alias("score"), F.lit(-rank).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.array(*scored))

    def named(top: Column) -> Column:
        return F.when(top["score"] > 0, top["name"]).otherwise("general")

    return let(let(F.lower(col(text)), best), named)


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def complexity(text: Column | str) -> Column:
    """Mean of clamped word-length and sentence-length scores, 0 to 1; 0 without words."""
    return _complexity(col(text), word_count(text))


def _complexity(t: Column, word_total: Column) -> Column:
    facts = F.struct(
        word_total.alias("words"),
        F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).alias("letters"),
        match_count(t, SENTENCE).alias("sentences"),
    )

    def score(f: Column) -> Column:
        by_word = _clamped((ratio(f["letters"], f["words"]) - 4) / 6)
        by_sentence = _clamped((ratio(f["words"], F.greatest(f["sentences"], F.lit(1))) - 5) / 25)
        return F.when(f["words"] == 0, F.lit(0.0)).otherwise(round_to((by_word + by_sentence) / 2, 4))

    return let(facts, score)


def reading_minutes(text: Column | str) -> Column:
    return _minutes(word_count(text))


def _minutes(word_total: Column) -> Column:
    return round_to(word_total / F.lit(200.0), 2)


def analysis(text: Column | str, topic_count: int = 5, names: bool = True) -> Column:
    """All content measures of one text; a blank text gets the neutral values. Without ``names`` there are no entities.

    Words are found once for all measures.
    """
    t = col(text)
    none = F.array().cast("array<string>")

    def measured(f: Column) -> Column:
        empty, letter_words, total = f["empty"], f["letter_words"], f["words"]
        measures = [
            F.when(empty, none)
            .otherwise(F.transform(top_terms(_topic_words(letter_words), topic_count), lambda x: x["term"]))
            .alias("topics"),
            F.when(empty, F.lit(0.0)).otherwise(_sentiment(letter_words)).alias("sentiment_score"),
            F.when(empty, F.lit(0).cast("bigint")).otherwise(total).alias("word_count"),
            F.when(empty, F.lit(0.0)).otherwise(_minutes(total)).alias("reading_time_minutes"),
            F.when(empty, F.lit(0.0)).otherwise(_complexity(t, total)).alias("language_complexity"),
        ]
        if names:
            measures.append(F.when(empty, none).otherwise(entities(t)).alias("entities"))
        return F.struct(*measures, F.when(empty, F.lit("general")).otherwise(category(t)).alias("category"))

    facts = F.struct(blank(t).alias("empty"), _letter_words(t).alias("letter_words"), word_count(t).alias("words"))
    return let(facts, measured)


# --- keyword suggestions --------------------------------------------------------------------------


def _scored(term: Column, total: Column, boost: float) -> Column:
    weight = F.when(term["n"] < total, F.ln(total / term["n"])).otherwise(F.lit(0.1))
    return round_to(term["n"] * weight * F.lit(boost), 3)


def keywords(text: Column | str, top_n: int = 20) -> Column:
    """Best unigrams and bigrams: ``array<struct<keyword,frequency,score,is_ngram>>``, best first.

    Equal scores keep unigrams before bigrams and more frequent candidates first.
    """

    def candidates(toks: Column) -> Column:
        total = F.size(toks)
        # NULL where a token is no keyword, so that joining neighbours gives NULL there too
        kept = F.transform(toks, lambda t: F.when(is_keyword(t), t))
        return let(kept, lambda k: best_of(k, total))

    def best_of(kept: Column, total: Column) -> Column:
        following = F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1)))
        pairs = F.transform(
            F.arrays_zip(kept.alias("a"), following.alias("b")), lambda z: F.concat(z["a"], F.lit(" "), z["b"])
        )

        def ranked(terms: Column, size: int, kind: int, boost: float) -> Column:
            return F.transform(
                top_terms(terms, size),
                lambda x, i: F.struct(
                    (-_scored(x, total, boost)).alias("neg"),
                    F.lit(kind).alias("kind"),
                    i.alias("rank"),
                    x["term"].alias("term"),
                    x["n"].alias("n"),
                ),
            )

        return F.concat(
            ranked(F.array_compact(kept), 2 * top_n, 0, 1.0),
            ranked(F.array_compact(pairs), top_n, 1, 1.5),
        )

    best = F.slice(F.sort_array(let(tokens(text), candidates)), 1, top_n)
    return F.transform(
        best,
        lambda x: F.struct(
            x["term"].alias("keyword"),
            x["n"].alias("frequency"),
            (-x["neg"]).alias("score"),
            (x["kind"] == 1).alias("is_ngram"),
        ),
    )


# --- keyword usage and article score --------------------------------------------------------------


def keyword_count(text: Column | str, keyword: Column | str) -> Column:
    """Non-overlapping, case-insensitive, literal occurrences. ``keyword`` is a column."""
    return _occurrences(F.lower(col(text)), F.lower(col(keyword)))


def _occurrences(t: Column, k: Column) -> Column:
    # of texts that are lowered already
    left_out = F.length(t) - F.length(F.replace(t, k, F.lit("")))
    counted = F.try_divide(left_out, F.length(k)).cast("bigint")
    return F.when(F.length(k) == 0, (F.length(t) + 1).cast("bigint")).otherwise(counted)


def keyword_density(text: Column | str, keyword: Column | str) -> Column:
    """Keyword words per 100 words, two decimals; 0 for a text without words."""
    share = ratio(keyword_count(text, keyword) * word_count(keyword), word_count(text))
    return F.coalesce(round_to(share * 100, 2), F.lit(0.0))


def first_paragraph(text: Column | str) -> Column:
    return F.substring_index(col(text), "\n\n", 1)


def _usage_facts(text: Column | str, title: Column | str, words_: Column | None = None) -> Column:
    # what does not depend on the keyword, evaluated once per text
    return F.struct(
        F.lower(col(text)).alias("text"),
        (word_count(text) if words_ is None else words_).alias("words"),
        F.lower(F.coalesce(col(title), F.lit(""))).alias("title"),
        F.lower(first_paragraph(text)).alias("opening"),
    )


def _usage(f: Column, keyword: Column) -> Column:
    k = F.lower(keyword)

    # counted once for both columns that show it
    def shown(n: Column) -> Column:
        share = ratio(n * word_count(keyword), f["words"])
        return F.struct(
            keyword.alias("keyword"),
            n.alias("count"),
            F.coalesce(round_to(share * 100, 2), F.lit(0.0)).alias("density"),
            ((f["title"] != "") & F.contains(f["title"], k)).alias("in_title"),
            F.contains(f["opening"], k).alias("in_first_paragraph"),
        )

    return let(_occurrences(f["text"], k), shown)


def keyword_usage(text: Column | str, keyword_list: Column | str, title: Column | str) -> Column:
    """Count, density, title hit and first-paragraph hit of each keyword of an array column."""
    return let(_usage_facts(text, title), lambda f: F.transform(col(keyword_list), lambda k: _usage(f, k)))


def readability(text: Column | str) -> Column:
    """Approximate school grade from sentence and word length, one decimal, never negative."""
    t = col(text)
    word = f"[{WORDCHAR}]+"
    per_sentence = ratio(match_count(t, SENTENCE_WORD), match_count(t, SENTENCE))
    per_word = ratio(F.length(F.regexp_replace(t, f"[^{WORDCHAR}]+", "")), match_count(t, word))
    grade = (
        F.lit(0.39) * F.coalesce(per_sentence, F.lit(0.0))
        + F.lit(11.8) * (F.coalesce(per_word, F.lit(0.0)) / 3)
        - F.lit(15.59)
    )
    return round_to(F.greatest(grade, F.lit(0.0)), 1)


def heading_lines(text: Column | str) -> Column:
    """Markdown headings; only a line feed ends a line."""
    return match_count(col(text), f"(?md)^#{{1,6}}[{SPACE}]").cast("bigint")


def article_score(
    text: Column | str, title: Column | str, meta: Column | str, keyword_list: Column | str
) -> Column:
    """Article score 0 to 100 with its parts, issues and suggestions."""
    t, ttl, desc = col(text), col(title), col(meta)
    uses = keyword_usage(t, keyword_list, ttl)
    facts = F.struct(
        word_count(t).alias("words"),
        heading_lines(t).alias("headings"),
        readability(t).alias("grade"),
        F.coalesce(F.length(desc).between(50, 160), F.lit(False)).alias("has_meta"),
        F.coalesce(F.length(ttl).between(30, 65), F.lit(False)).alias("has_title"),
        F.coalesce(uses, F.expr("cast(array() as array<struct<keyword:string,count:bigint,"
                                "density:double,in_title:boolean,in_first_paragraph:boolean>>)")).alias("uses"),
    )

    def points(cond: Column, yes: int, no: int = 0) -> Column:
        return F.when(cond, yes).otherwise(no)

    def usage_points(u: Column) -> Column:
        placed = F.when(u["density"].between(0.5, 3.0), 8).when(u["count"] > 0, 4).otherwise(0)
        return placed + points(u["in_title"], 4) + points(u["in_first_paragraph"], 3)

    def unused(u: Column) -> Column:
        return ~u["density"].between(0.5, 3.0) & (u["count"] == 0)

    def graded(f: Column) -> Column:
        w, h, g = f["words"], f["headings"], f["grade"]
        base = (
            F.when(w >= 1500, 20).when(w >= 800, 15).when(w >= 300, 10).otherwise(5)
            + points(f["has_meta"], 10)
            + points(f["has_title"], 10)
        )
        with_keywords = F.aggregate(f["uses"], base, lambda acc, u: acc + usage_points(u))
        capped = F.least(with_keywords, F.lit(60))  # the cap covers everything added so far
        structure = F.when(h >= 3, 15).when(h >= 1, 8).otherwise(0)
        ease = F.when(g.between(6, 12), 15).when(g < 6, 10).otherwise(5)
        missing = F.transform(
            F.filter(f["uses"], unused),
            lambda u: F.concat(F.lit('Keyword "'), u["keyword"], F.lit('" not found in content.')),
        )
        return F.struct(
            F.least(capped + structure + ease, F.lit(100)).cast("bigint").alias("total_score"),
            w.alias("word_count"),
            f["uses"].alias("keyword_scores"),
            f["has_meta"].alias("has_meta_description"),
            h.alias("heading_count"),
            g.alias("readability_grade"),
            F.concat(
                messages(
                    [
                        (
                            w < 300,
                            F.concat(
                                F.lit("Content too short ("), w.cast("string"), F.lit(" words). Aim for 1500+.")
                            ),
                        ),
                        (~f["has_meta"], "Meta description should be 50-160 characters."),
                    ]
                ),
                missing,
            ).alias("issues"),
            messages(
                [
                    (~f["has_title"], "Title should be 30-65 characters."),
                    (h == 0, "Add headings (H2, H3) to structure content."),
                    (g < 6, "Content may be too simple for the audience."),
                    (g > 12, "Content readability is high. Simplify sentences."),
                ]
            ).alias("suggestions"),
        )

    return let(facts, graded)
