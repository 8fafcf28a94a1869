"""Line dedup, token alignment and periodic runs against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlmill.llm import alignment, line_dedup, periodic_runs, queries
from crawlmill.llm.common import prepare

FILES = lambda: (queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model"))
SCHEMA = "doc_id bigint, text string, id int, row string, words string, piece int, first int, h1 int, kept string, links int, body string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use inside."""
    prepare(spark)
    return spark.createDataFrame([(i, t, 1, "r", "w", 2, 3, 4, "k", 5, "b") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["ab", "CD", "é", "ÉÀ", "日本"]) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    lines += ["", "  ", "Shared LINE of ten", " shared line of ten\t\x0b", "ÉCOLE de ligne", "éCOLE DE LIGNE", "nine char", "ten chars!", "TEN CHARS!"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, "Shared LINE of ten\nonly here, without id"), (None, "only here, without id"), (7, "of an id that is here twice")]
    rows += [rows[3], rows[3], (63, "\n".join(f"long text line {i % 3000}" for i in range(6000))), (64, "long text line 17\nother"), (2, "long text line 18")]
    return rows


def brute_lines(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), 1 << 64), rank(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or first[key(x)] == rank(i)]
        out[i, len(lines), len(lines) - len(stay), sha("\n".join(stay))] += 1
    return out


@pytest.mark.parametrize("pieces", [1, 9])
def test_line_dedup(spark, odd_rows, pieces, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_PIECE", 2_000_000 if pieces == 1 else 40)
    docs = frame(spark, odd_rows)
    got = line_dedup.dedup(docs).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_lines(odd_rows)
    for r in got:
        marked = [w["word"] * 64 + b for w in r["dropped"] for b in range(64) if w["bits"] >> b & 1]
        assert len(marked) == r["n_dropped"] and marked == sorted(marked)


def test_a_line_in_most_documents_runs_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_PIECE", 25)
    rows = [(1000 - i, f"the most common line\nline of its own {i}\nThe Most Common Line") for i in range(300)]
    got = line_dedup.dedup(frame(spark, rows)).collect()
    assert Counter(tuple(r)[:4] for r in got) == brute_lines(rows)


def test_line_dedup_rewrites_rows(spark, odd_rows):
    docs = frame(spark, odd_rows)
    kept = line_dedup.rewritten(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter((r["doc_id"], sha(r["text"] or "")) for r in rows) == Counter((k[0], k[3]) for k in brute_lines(odd_rows).elements())
    assert {tuple(r)[2:] for r in rows} == {(1, "r", "w", 2, 3, 4, "k", 5, "b")}
    assert [r["text"] for r in rows if r["doc_id"] == 60] == [None]


def brute_runs(w, least_words=6, least_periods=4):
    out = []
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            smaller = any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q))
            if e - s >= max(least_words, least_periods * q) and not smaller:
                out.append((s, e - s, q))
            i = j
    return sorted(out)


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.fixture(scope="module")
def run_texts():
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a a a a a", "a a a a a a", "x y x y x y x y", "\x1c \x1c\x1c a"]
    for _ in range(150):
        k, n = rng.randint(1, 4), rng.randint(0, 70)
        w = [f"w{rng.randint(1, k)}" for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w = [w[a + (i - a) % p] if i >= a and a + p <= n else w[i] for i in range(n)]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    return texts + ["same " * 30_000, " ".join(str(i % 700) for i in range(20_000)), texts[20], texts[20]]


def test_runs(spark, run_texts):
    rows = [(i, t) for i, t in enumerate(run_texts)] + [(None, "b b b b b b b"), (5, "c c c c c c c")]
    docs = frame(spark, rows)
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic_runs.find_runs(docs).collect())
    expected = Counter()
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        if len(w) == 30_000:
            found = [(0, 30_000, 1)]
        elif len(w) == 20_000:
            found = [(0, 20_000, 700)]
        else:
            found = brute_runs(w)
        expected[i, len(w), tuple(found), collapsed(w, found)] += 1
    assert got == expected
    kept = periodic_runs.rewritten(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert tuple(r)[2:] == (1, "r", "w", 2, 3, 4, "k", 5, "b")
    assert kept.filter("doc_id is null").first()["text"] == "b" and kept.filter("doc_id = 0").first()["text"] is None


def test_symbols_in_thue_morse_order_have_no_run():
    symbols = np.array([i.bit_count() % 2 for i in range(20_000)], np.uint64)
    assert len(periodic_runs.maximal_runs(symbols, np.zeros(len(symbols), np.int64))[0]) == 0


def test_ordered_set_over_many_lists(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    rng = random.Random(2)
    numbers = rng.sample(range(1000), 300)
    places = periodic_runs.Places(numbers[0])
    for k, x in enumerate(numbers[1:], 1):
        seen = sorted(numbers[:k])
        below, above = [y for y in seen if y < x], [y for y in seen if y > x]
        assert places.around(x) == (below[-1] if below else None, above[0] if above else None)
        places.add(x)
    assert list(places) == sorted(numbers) and places.size == 300


def test_run_digests_of_planted_periods(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"v{rng.randint(1, 60)}" for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(150, None), (151, "d d d d d d e e e e e e"), (None, "f g h")]
    got = {r["doc_id"]: r for r in periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(frame(spark, rows)))).collect()}
    changed = 0
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        found = brute_runs(w)
        r = got[i]
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and r["collapsed_sha256"] == sha(collapsed(w, found))
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
    assert changed > 5


def whole_tokens(text, pair):
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    return a, b


@pytest.fixture(scope="module")
def token_texts():
    rng = random.Random(6)
    parts = ["the", "Tokens", "naïve", "日本語", "🙂", "x=1;", "  ", "\n", "\t", "don't", "12345", "<s>", "<|endoftext|>", "<0x41>", "…", " ", "a b", "\x00"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    return texts + [None, "", " ", "   lead", "trail   ", "▁under", "ﬁ ligature", "é", texts[0], texts[0], "word " * 3000, "z" * 500, "\r\n\r\n"]


def test_alignment(spark, token_texts):
    pair = alignment.Pair(*FILES())
    assert pair.cuts
    rows = [(i, t) for i, t in enumerate(token_texts)] + [(None, "no id"), (3, "id again")]
    aligned, counts = [], Counter()
    for i, t in rows:
        a, b = whole_tokens(t, pair) if t else ([], [])
        if t:
            whole = (" " + t).encode()
            if b"".join(pair.a_bytes[x] for x in a) != whole or b"".join(pair.b_bytes[x] for x in b) != whole:
                a, b = [], []
        ends = lambda ids, size: np.cumsum([len(size[x]) for x in ids]).tolist()
        at_a, at_b = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
        links = [(a[at_a.index(e)], b[at_b.index(e)]) for e in at_a if e in set(at_b)]
        groups, x, y = [], 0, 0
        for e in at_a:
            if e in set(at_b):
                u, v = at_a.index(e) + 1, at_b.index(e) + 1
                groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
                x, y = u, v
        over = [(m, n) for m in range(len(a)) for n in range(len(b)) if max(([0] + at_a)[m], ([0] + at_b)[n]) < min(at_a[m], at_b[n])] if len(a) < 200 else None
        aligned.append((i, a, b, links, groups, over))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    expected = Counter(
        (i, len(a), len(b), len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha(";".join(g)) if a else "")
        for i, a, b, ls, g, _ in aligned
    )
    docs = frame(spark, rows)
    assert Counter(map(tuple, alignment.compare(docs, *FILES()).collect())) == expected
    assert sum(1 for _, a, *_ in aligned if a) > 40 and sum(1 for (_, t), x in zip(rows, aligned, strict=True) if t and not x[1]) >= 1
    found = alignment.align(docs, *FILES(), with_overlaps=True).filter("doc_id is not null and doc_id <> 3").collect()
    by = {i: over for i, *_, over in aligned}
    for r in found:
        if by[r["doc_id"]] is not None:
            assert sorted((o["a"], o["b"]) for o in r["overlaps"]) == by[r["doc_id"]]
    assert len(counts) <= alignment.most_pairs(pair.a_bytes, pair.b_bytes) < 1_000_000


def test_ids_by_memo_are_those_of_whole_texts(token_texts, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 20)
    pair = alignment.Pair(*FILES())
    texts = [t for t in token_texts if t]
    for _ in range(2):
        for t, (x, y) in zip(texts, pair.ids(texts), strict=True):
            a, b = whole_tokens(t, pair)
            whole = (" " + t).encode()
            if b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
                a, b = [], []
            assert np.frombuffer(x, "<u4").tolist() == a and np.frombuffer(y, "<u4").tolist() == b


def test_empty_tables(spark, odd_rows):
    none = frame(spark, odd_rows).limit(0)
    assert line_dedup.dedup(none).count() == 0 and line_dedup.rewritten(none).count() == 0
    assert periodic_runs.find_runs(none).count() == 0 and periodic_runs.digests(periodic_runs.find_runs(periodic_runs.planted(none))).count() == 0
    assert alignment.compare(none, *FILES()).count() == 0
    nulls = frame(spark, odd_rows[:3]).withColumn("text", F.lit(None).cast("string"))
    assert {r["n_lines"] for r in line_dedup.dedup(nulls).collect()} == {1}
    assert {r["n_links"] for r in alignment.compare(nulls, *FILES()).collect()} == {0}
