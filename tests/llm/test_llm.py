"""The training-data operators against brute force, with odd rows."""

import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from crawlmill.llm import chat, divergence, language_model, line_crf, mixing, near_dedup, order_minhash, packing, queries, substring, token_files, tokens
from crawlmill.llm.common import prepare
from crawlmill.llm.fm_index import FmIndex

SCHEMA = "doc_id bigint, text string, lang string, source string, __id int, score string, k string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    base = make(150).split()
    out = [make(rng.randint(1, 160)) for _ in range(40)]
    out += [f"{make(30)}\n{passage} {make(20)}" for _ in range(8)]
    for i in range(12):
        ws = list(base)
        ws[10 + i] = "edit"
        out.append(" ".join(ws))
    out += [out[3], out[3], "", "   ", None, make(20_000), "one", "the the the the the the the", "WORD!! " * 60, "\n\nline\nline\n"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    prepare(spark)
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4] if i % 2 else "a", 1, "x", None) for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, 1, None, "k"), rows[2]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def words(text):
    return text.encode().split()


def token_ids(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(queries.tokenizer()).encode(text, add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs):
    got = packing.pack(docs, queries.tokenizer(), max_tokens=512).collect()
    expected = Counter()
    for i, t in pairs(docs):
        ids = token_ids(t, 1)
        expected.update((i, k, at, len(ids[at : at + 512]), crc(ids[at : at + 512])) for k, at in enumerate(range(0, len(ids), 512)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= 1.1 * sum(r["length"] for r in got) / 512 + 1


def test_plan_depends_on_lengths_only():
    rng = random.Random(1)
    counts = {rng.randint(1, 100): rng.randint(1, 10**9) for _ in range(60)}
    rows = packing.plan(counts, 100)
    assert len(rows) < 3000
    placed = Counter()
    for length, _, n, *_ in rows:
        placed[length] += n
    assert placed == Counter(counts)


def test_token_files(spark, docs, tmp_path):
    """Every row's start is where its ids stand, also for rows of one id or of none; odd texts and clashing names."""
    more = [(4, t) for t in ("x y", "a", "x y", "")] + [(None, t) for t in ("null one", "two", None, "null one", "word " * 3000)]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    table = table.withColumns({"at": F.lit("x"), "ids": F.lit(1), "file": F.lit("f")})
    path = str(tmp_path / "tokens")
    token_files.write_tokens(table, path, queries.tokenizer(), files=3)
    spans = token_files.token_spans(spark, path)
    assert spans.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = sorted(spans.collect(), key=lambda r: r["start"])
    flat, order = [], []
    for f in sorted(glob.glob(f"{path}/part-*.orc")):
        for r in orc.read_table(f).to_pylist():
            order.append((r["doc_id"], len(flat), len(r["ids"]), crc(r["ids"])))
            flat += r["ids"]
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == order
    ids = [-1 if i is None else i for i, *_ in order]
    assert ids == sorted(ids)
    expected = [(i, token_ids(t, 2)) for i, t in pairs(table)]
    assert Counter((i, n, c) for i, _, n, c in order) == Counter((i, len(x), crc(x)) for i, x in expected)
    assert token_files.read_tokens(spark, path, [5, 6]).count() == 2


def test_token_files_are_sized_by_bytes(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1000)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs.filter("doc_id < 40"), path, queries.tokenizer())
    assert len(glob.glob(f"{path}/part-*.orc")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert token_files.token_spans(spark, path).count() == docs.filter("doc_id < 40").count()


def test_columns_and_texts_have_the_same_ids(texts):
    """The column form of the encoder, with slices of a column, white space beyond ASCII and added tokens."""
    odd = ["a\u00a0b c", "<|endoftext|> x", " \t lead", "trail \n", "\u3000", "It's 12,5 É", "<unk>", "a\x1cb"]
    column = pa.array(["cut off", *texts, *odd, "cut off"])
    for part in (column.slice(1, len(column) - 2), column.slice(3, 5), column.slice(0, 0)):
        flat, ends = tokens.column_encoder(queries.tokenizer(), 2)(part)
        expected = [token_ids(t or "", 2) for t in part.to_pylist()]
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == expected


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def test_near_duplicates(docs):
    rows = sorted({(i, t) for i, t in pairs(docs)}, key=lambda x: (x[0] is None, x[0]))
    bags = []
    for _, t in rows:
        w = words(t)
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else []))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bags[a] == bags[b] and words(rows[a][1]) == words(rows[b][1]) or bags[a] and jaccard(bags[a], bags[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    expected = {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r["class_id"] for r in got} == expected
    kept = near_dedup.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted(((v,) for v in set(expected.values())), key=str)


def test_null_and_equal_ids_of_different_texts_are_classes_of_their_own(spark):
    prepare(spark)
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    near = " ".join([*b.split()[:-1], "edit"])
    rows = [(None, a), (None, b), (None, near), (5, c), (5, d), (5, c), (None, e), (9, e)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    # b and its near copy have no id: the smaller text hash decides
    kept = [tuple(r) for r in near_dedup.first_of_each(odd).collect()]
    assert len(kept) == 5 and {(None, a), (5, c), (5, d), (9, e)} < set(kept) and {(None, b), (None, near)} & set(kept)
    got = near_dedup.near_duplicates(odd).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["class_key"]].append((r["doc_id"], r["class_id"]))
    none = (None, None)
    assert sorted(map(str, (sorted(v, key=str) for v in groups.values()))) == sorted(
        map(str, ([none], [none, none], [(5, 5), (5, 5)], [(5, 5)], [(9, 9), (None, 9)]))
    )


@pytest.mark.parametrize("rows", [8, 512])
def test_a_cloud_of_copies_keeps_every_link(spark, monkeypatch, rows):
    """Copies of one text with similarities around the bound, compared in one block and in several."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(70):
        ws = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            ws[at] = rng.choice(vocabulary)
        texts.append(" ".join(ws))
    prepare(spark)
    cloud = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(116)) for t in texts]
    root = list(range(70))
    for a in range(70):
        for b in range(a):
            if jaccard(bags[a], bags[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert 1 < len(set(root)) < 70
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(cloud).collect()} == dict(enumerate(root))


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    element = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sign = near_dedup.bag_minhash(text, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((sign[0] == sign[1]).mean() - true) < 0.04


def brute_removed(rows):
    first = {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        covered = [False] * len(w)
        for k in range(len(w) - 12):
            f = first[tuple(w[k : k + 13])]
            if f is not None and (i is None or f < i):
                covered[k : k + 13] = [True] * 13
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring_dedup(docs, monkeypatch):
    expected = brute_removed(pairs(docs))
    for share in (2.0, 0.001):  # no common anchors; every shared anchor is common
        monkeypatch.setattr(substring, "HOT_SHARE", share)
        got = substring.dedup(docs).collect()
        assert len(got) == docs.count()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == expected
    assert substring.rewritten(docs).columns == docs.columns


def test_fm_index_finds_what_is_there():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 500), 0)
    index = FmIndex(text, 4, 5)
    queries_ = rng.integers(1, 4, 300)
    found = index.matches(queries_, np.array([0]), np.array([300]))
    windows = {tuple(text[i : i + 5]) for i in range(496)}
    for i in range(296):
        window = tuple(queries_[i : i + 5])
        assert (found[i] >= 0) == (window in windows)
        if found[i] >= 0:
            assert tuple(text[index.suffixes[found[i]] :][:5]) == window


def test_line_crf(spark):
    prepare(spark)
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "small", "house", "is", "near", "river."]) for _ in range(9)) for _ in range(4))
    bad = lambda: "\n".join("BUY!! NOW!! " * 6 for _ in range(4))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, None), (900, "", "y")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(7, 1), (None, 0), (8, None)], "doc_id bigint, quality int")
    field = line_crf.train(docs, labels)
    got = line_crf.score(docs, field).collect()
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got)
    right = {i: q for i, _, q in rows}
    held = [r for r in got if r["held_out"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert all(r["predicted"] == right[r["doc_id"]] for r in held if r["doc_id"] in right)
    assert line_crf.good_rows(docs, field).columns == docs.columns
    assert line_crf.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in line_crf.score(docs, None).collect()} == {1.0}


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=4), rng.normal(size=(2, 2))
    p, pair = line_crf.marginals(e, t, np.array([0, 4]))
    total, each, both = 0.0, np.zeros(4), np.zeros((2, 2))
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        w = np.exp(sum(e[i] * y[i] for i in range(4)) + sum(t[y[i], y[i + 1]] for i in range(3)))
        total += w
        each += w * np.array(y)
        for i in range(3):
            both[y[i], y[i + 1]] += w
    assert np.allclose(p, each / total) and np.allclose(pair, both / total)


def test_order_minhash(docs):
    rows = sorted(pairs(docs.dropDuplicates(["doc_id", "text"])), key=lambda x: -(1 << 63) if x[0] is None else x[0], reverse=True)
    got = {r["doc_id"]: r for r in order_minhash.compare(docs.dropDuplicates(["doc_id", "text"])).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        edit = order_minhash.edited(t, rows[(n + 1) % len(rows)][1])
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert got[i]["fingerprint"] == order_minhash.fingerprint(t).tobytes().hex()
        assert got[i]["edited_fingerprint"] == order_minhash.fingerprint(edit).tobytes().hex()
    assert order_minhash.compare(docs).count() == docs.count()
    swapped = "abcdefghijklmnopqrstuvwxyz" * 8
    whole, turned = order_minhash.fingerprint(swapped + "0123456789" * 20), order_minhash.fingerprint("0123456789" * 20 + swapped)
    assert order_minhash.likeness(whole, turned) < 0.9


def test_mixing(docs):
    got = mixing.mix(docs).join(docs.select("doc_id", "source").dropDuplicates(["doc_id"]), "doc_id").collect()
    again = mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect()
    assert Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs).select("doc_id", "taken").collect()) == Counter(map(tuple, again))
    sums = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in got:
        s = sums[r["source"]]
        s[0], s[1], s[2], s[3] = s[0] + r["size"], s[1] + r["taken"], r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    sizes = Counter()
    for r in docs.select("text", "source").collect():
        sizes[r["source"]] += len(words(r["text"] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s, (_, taken, goal, size) in sums.items():
        if s is not None:
            assert size == sizes[s] and abs(goal - target[s]) < 1e-6 * target[s] and abs(taken - goal) <= 1
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert abs(sum(len(words(r["text"])) for r in rows.collect()) - sum(target.values())) <= len(order)


def test_language_model(docs):
    rows = pairs(docs)
    one, two = Counter(), Counter()
    for _, t in rows:
        w = words(t)
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    total = sum(one.values())
    expected = {}
    for i, t in rows:
        w, s, back = words(t), 0.0, 0
        for k, x in enumerate(w):
            if k and two[w[k - 1], x] >= 2:
                s += np.log10(two[w[k - 1], x] / one[w[k - 1]])
            else:
                s += np.log10(one[x] / total) + (np.log10(0.4) if k else 0)
                back += k > 0
        expected[i] = (len(w), back, s)
    got = language_model.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, back, s = expected[r["doc_id"]]
        assert (r["n_words"], r["n_backoff"]) == (n, back) and abs(r["log_score"] - s) < 1e-3 + 1e-9 * abs(s)


def test_histogram_rules(docs):
    got = divergence.judge(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    for i, t in pairs(docs):
        w = words(t)
        windows = defaultdict(list)
        for k in range(len(w) - 2):
            windows[tuple(w[k : k + 3])].append(k)
        again = {x for v in windows.values() if len(v) > 1 for k in v for x in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        r = by[i]
        assert r["n_words"] == len(w) and r["n_repeat_words"] == len(again)
        assert r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_word_distance_uses_the_words_of_each_language(spark):
    prepare(spark)
    rng = random.Random(8)
    rows = []
    for lang, n in (("en", 90), ("fr", 12), (None, 12)):
        common = [f"{lang}{chr(97 + i % 26)}{i // 26}" for i in range(60)]
        for i in range(n):
            # a tenth has no common word
            pick = lambda: f"rare{rng.randrange(10**9)}" if i % 10 == 9 or rng.random() < 0.6 else common[min(int(rng.expovariate(0.08)), 59)]  # noqa: B023, E731
            rows.append((len(rows), " ".join(pick() for _ in range(600)), lang))
    got = divergence.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)).collect()
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        counts[lang].update(t.lower().split())
    top = {g: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:48]] for g, c in counts.items()}

    def histogram(c, lang):
        h = np.array([c[w] for w in top[lang]] + [sum(c.values()) - sum(c[w] for w in top[lang])], float)
        return h / h.sum()

    def distance(p, q):
        m = (p + q) / 2
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return np.sqrt(max(0.0, (part(p) + part(q)) / 2))

    by = {r["doc_id"]: r for r in got}
    for i, t, lang in rows:
        want = distance(histogram(Counter(t.lower().split()), lang), histogram(counts[lang], lang))
        none = distance(np.array([0.0] * 48 + [1.0]), histogram(counts[lang], lang))
        assert abs(by[i]["word_distance"] - want) < 1e-9
        assert by[i]["char_distance"] < 0.28
        assert by[i]["kept"] == (want <= min(0.40, 0.97 * none))
    assert {r["kept"] for r in got} == {True, False}


def test_tool_calls(spark):
    prepare(spark)
    call = lambda turn, i, deps=(), name="search", args='{"limit":3,"query":"q"}', conv=1: (conv, turn, i, name, args, list(deps))
    calls = [
        call(1, "a", ["c"]), call(2, "b", ["a"]), call(3, "c"), call(4, "d", ["e"]), call(5, "e", ["d"]), call(6, "f", ["zz"]),
        call(7, "a", []), call(7, "a", []), call(8, None), call(9, "g", args="{bad"), call(9, "h", args='{"limit":3.5,"x":1}'), call(1, "a", conv=None),
    ]
    results = [(1, 2, "a", "first"), (1, 3, "a", "second"), (1, 4, "q", "lost"), (1, 5, None, "none"), (None, 1, "a", None)]
    c = spark.createDataFrame(calls, "conv_id int, turn bigint, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame(results, "conv_id int, turn bigint, call_id string, content string")
    got = chat.link(c, r, chat.TOOLS).collect()
    rows = {(x["conv_id"], x["call_id"], x["status"]): x for x in got}
    assert len(rows) == len(got) == 14
    place = {x["call_id"]: x["position"] for x in got if x["conv_id"] == 1 and x["position"]}
    assert place["c"] < place["a"] < place["b"] and sorted(place.values()) == list(range(1, 9))
    assert rows[1, "a", "answered"]["json"] == '{"arguments":{"limit":3,"query":"q"},"call_id":"a","depends_on":["c"],"name":"search","result":"first","status":"answered"}'
    assert rows[1, "d", "cycle"] and rows[1, "e", "cycle"] and rows[1, "a", "repeated_call"] and rows[1, "a", "repeated_result"]
    assert rows[1, "f", "pending"]["problems"] == ["nothing gives zz"] and rows[None, "a", "answered"]["valid"]
    assert rows[1, "g", "pending"]["problems"] == ["arguments are no object"]
    assert rows[1, "h", "pending"]["problems"] == ["missing query", "limit is no integer", "unknown x"]
    assert rows[1, "q", "orphan_result"] and rows[1, None, "unnamed_result"] and rows[1, None, "unnamed_call"]


def test_call_order_and_status_of_random_graphs(spark):
    """Against reachability in plain Python: cycles, calls behind them, and every call behind all it needs."""
    prepare(spark)
    rng = random.Random(12)
    needs = {}
    for conv in range(24):
        n = rng.randint(1, 9)
        for i in range(n):
            far = [f"{j}x" for j in range(n) if rng.random() < (0.1 if conv % 2 else 0.22)]
            needs[conv if conv else None, f"{i}x"] = [*far, None] if i % 3 else far
    # d and e need each other, x and y stand behind them, z needs itself, w stands behind z, c2 and c3 are a cycle behind x
    needs |= {(99, c): list(d) for c, d in {"d": ["e"], "e": ["d"], "x": ["d"], "y": ["d"], "z": ["z"], "w": ["z"], "v": [], "c2": ["x", "c3"], "c3": ["c2"], "u": ["c3"]}.items()}
    turn = {k: rng.randint(1, 12) for k in needs}
    rows = [(k[0], turn[k], k[1], "search", "{}", d, "other") for k, d in needs.items()]
    calls = spark.createDataFrame(rows, "conv_id int, turn bigint, call_id string, name string, arguments string, depends_on array<string>, root string")
    results = spark.createDataFrame([], "conv_id int, turn bigint, call_id string, content string")
    context = spark.createDataFrame([(1, 0, "be kind"), (None, None, None)], "conv_id int, turn bigint, content string")
    got = chat.link(calls, results, chat.TOOLS, context).collect()
    assert Counter((r["conv_id"], r["turn"], r["json"]) for r in got if r["status"] == "context") == Counter(
        [(1, 0, '{"call_id":null,"content":"be kind","status":"context"}'), (None, None, '{"call_id":null,"content":null,"status":"context"}')]
    )
    ahead = {}
    for k in needs:
        seen, todo = set(), [k]
        while todo:
            for d in needs[todo.pop()]:
                if (k[0], d) in needs and d not in seen:
                    seen.add(d)
                    todo.append((k[0], d))
        ahead[k] = seen
    status, place = {}, {}
    for k in needs:
        on = k[1] in ahead[k]
        behind = any(d in ahead[k[0], d] for d in ahead[k])
        status[k] = "cycle" if on else "blocked" if behind else "pending"
    rows = [r for r in got if r["status"] != "context"]
    assert {(r["conv_id"], r["call_id"]): r["status"] for r in rows} == status and len(rows) == len(needs)
    assert set(status.values()) == {"cycle", "blocked", "pending"}
    for r in rows:
        place[r["conv_id"], r["call_id"]] = r["position"]
    for k, far in ahead.items():
        assert all(place[k] > place[k[0], d] for d in far if k[1] not in ahead[k[0], d]), k
    for conv in {k[0] for k in needs}:
        assert sorted(v for k, v in place.items() if k[0] == conv) == list(range(1, 1 + sum(k[0] == conv for k in needs)))


def test_order_takes_no_round_for_each_step_of_a_chain(spark):
    """A long chain behind a cycle, in one conversation: few jobs, and the same rows by joins."""
    prepare(spark)
    chain = lambda conv, n: [(conv, n - i, f"c{i:03}", "search", "{}", [f"c{i - 1:03}"] if i else ["c001"]) for i in range(n)]
    schema = "conv_id int, turn bigint, call_id string, name string, arguments string, depends_on array<string>"
    calls = spark.createDataFrame([*chain(1, 60), *chain(None, 5), (2, 1, "z", "search", "{}", ["z", None, "no"])], schema)
    results = spark.createDataFrame([], "conv_id int, turn bigint, call_id string, content string")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = chat.link(calls, results, chat.TOOLS).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = {(r["conv_id"], r["call_id"]): (r["position"], r["status"]) for r in got}
    assert len(got) == 66 and jobs < 40, jobs
    for conv, n in ((1, 60), (None, 5)):
        assert {rows[conv, "c000"][0], rows[conv, "c001"][0]} == {1, 2} and rows[conv, "c000"][1] == rows[conv, "c001"][1] == "cycle"
        assert all(rows[conv, f"c{i:03}"] == (i + 1, "blocked") for i in range(2, n))
    assert rows[2, "z"] == (1, "cycle") and next(r for r in got if r["call_id"] == "z")["problems"] == ["missing limit", "missing query", "nothing gives no"]


def test_order_of_large_conversations_is_that_of_small_ones(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(5)
    rows = [(conv, rng.randint(1, 9), f"{i}x", "search", "{}", [f"{j}x" for j in range(12) if rng.random() < 0.12] + ["none"]) for conv in (1, 2, None) for i in range(10)]
    calls = spark.createDataFrame(rows, "conv_id int, turn bigint, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, 3, "2x", "r")], "conv_id int, turn bigint, call_id string, content string")
    small = sorted(map(str, chat.link(calls, results, chat.TOOLS).collect()))
    monkeypatch.setattr(chat, "CALLS_PER_TASK", 5)
    assert sorted(map(str, chat.link(calls, results, chat.TOOLS).collect())) == small and len(small) == 30


def test_odd_arguments_are_named_problems():
    tools = {"t": ({"a": "array"}, {"o": {"type": "object", "required": {"n": {"type": "number", "minimum": 0, "maximum": 2}}, "optional": {"k": {"enum": ["x", 1]}}}, "l": {"type": "array", "items": "integer"}})}
    of = lambda text: chat.problems("t", text, tools)[1]
    deep = lambda n: '{"a":' + "[" * n + "]" * n + "}"
    assert of('{"a":[]}') == of(deep(chat.MOST_DEPTH - 1)) == []
    for n in (chat.MOST_DEPTH, 3_000, 200_000):
        assert of(deep(n)) == ["arguments nest too deeply"]
    assert of('{"a":["\\ud800"]}') == of('{"\\udc00":1}') == ["arguments hold half a surrogate pair"]
    assert of('{"a":["\\ud83d\\ude00"]}') == []
    assert of('{"a":[1e999]}') == of('{"a":[' + "9" * 5000 + "]}") == ["arguments hold a number out of range"]
    assert of('{"a":[NaN]}') == ["arguments hold NaN"] and of('{"a":[],"a":[]}') == ["arguments repeat a"]
    assert of('{"a":[],"\\ud800":1,"\\ud800":2}') == ["arguments repeat \\ud800"]
    assert of("[1]") == of(None) == of("") == ["arguments are no object"]
    assert of('{"a":[],"o":{"n":3,"k":true,"z":0},"l":[1,"2",true]}') == ["l[1] is no integer", "l[2] is no integer", "o.k is none of its values", "o.n is above 2", "unknown o.z"]
    assert of('{"o":{"k":1}}') == ["missing a", "missing o.n"] and of('{"a":[],"o":{"n":-0.5}}') == ["o.n is below 0"]
    assert chat.problems("no", '{"a":[]}', tools) == ({"a": []}, ["unknown tool"])
    assert chat.canonical({"b": 1.0, "a": ["é", 1.5]}) == '{"a":["é",1.5],"b":1}'


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    assert packing.pack(none, queries.tokenizer()).count() == 0
    for fn in (near_dedup.near_duplicates, substring.dedup, order_minhash.compare, mixing.mix, mixing.mixed_rows, language_model.score, divergence.judge):
        assert fn(none).count() == 0, fn
    assert line_crf.score(none, None).count() == 0
    path = str(tmp_path / "none")
    token_files.write_tokens(none, path, queries.tokenizer())
    assert token_files.token_spans(spark, path).count() == 0
    calls, results, context = chat.calls_of(spark.createDataFrame([], "conv_id int, turn bigint, role string, text string"))
    assert chat.link(calls, results, chat.TOOLS, context).count() == 0


def test_line_features_have_one_row_per_line():
    x, weight, first = line_crf.line_features(pa.array(["a\nb", "", None, "\n"]))
    assert first.tolist() == [0, 2, 3, 4, 6] and len(x) == 6 and weight.tolist() == [2, 2, 1, 1, 1, 1]


def test_ngrams_are_shuffled_as_few_bytes(spark):
    """Blocks of n-grams: 8 bytes and a count each, whatever part they are in, and no row of their own."""
    prepare(spark)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(900))) for i in range(40)] + [(90, None), (91, "one"), (92, "a b a b")]
    docs = spark.createDataFrame(rows, "doc bigint, text string").repartition(2)
    got = language_model.gram_blocks(docs, 2, 7).collect()
    want = sum(len(set(zip(t.split(), t.split()[1:], strict=False))) for _, t in rows if t)
    assert sum(len(r["g"]) for r in got) == 8 * want and len(got) <= 2 * 7 * 2 and {r["part"] for r in got} <= set(range(7))
    assert sum(len(r["docs"]) + len(r["runs"]) + len(r["v"]) for r in got) < 5 * want
    counts = language_model.count_table(docs, 2, 2)
    gains = counts.select("g", F.col("c").cast("double").alias("gain"))
    for parts in (1, 7):
        sums = {r["doc"]: (r["gain"], r["found"]) for r in language_model.doc_sums(docs, 2, gains, parts).groupBy("doc").agg(F.sum("gain").alias("gain"), F.sum("found").alias("found")).collect()}
        two = Counter(x for _, t in rows if t for x in zip(t.split(), t.split()[1:], strict=False))
        for i, t in rows:
            ns = [two[x] for x in zip((t or "").split(), (t or "").split()[1:], strict=False) if two[x] >= 2]
            assert sums.get(i, (0, 0)) == (sum(ns), len(ns)), i
