"""The stages one after the other on a small folder, each against brute force over what it was given."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import brute_removed, crc, jaccard, token_ids, words

import corpus_pipeline
from crawlmill.llm import line_crf, near_dedup, substring
from crawlmill.llm.common import prepare, stored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, __id int, __score string, __body string, __kept string, id string, row int"
EXTRA = (5, "s", "b", "k", "i", 8)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    prepare(spark)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(50), make(120).split()
    texts = [f"{make(40)}\n{make(rng.randint(20, 90))}" for _ in range(60)]
    texts += [f"{make(25)}\n{passage}\n{make(25)}" for _ in range(6)]
    texts += [" ".join([*base[:i], "edit", *base[i + 1 :]]) for i in range(20, 26)] + [texts[4], texts[4]]
    bad = ["BUY!! NOW!! $$$ " * rng.randint(8, 20) for _ in range(30)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t), *EXTRA) for i, t in enumerate(texts + bad)]
    rows += [(200, None, None, None, None, *EXTRA), (201, "", "en", "a", 0, *EXTRA), (None, make(60), None, "b", 3, *EXTRA), rows[2]]
    where = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i < len(texts)), 0) for i in range(len(texts + bad))]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").limit(0).write.parquet(f"{where}/none.parquet")
    return str(where), rows


def extras(rows):
    assert all(tuple(r)[5:] == EXTRA for r in rows)


def test_stages(spark, folder):
    where, rows = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "mixture", "packing"]

    good = stored(stages["quality"](spark, docs, where), "good")
    found = good.collect()
    extras(found)
    field = line_crf.train(docs, spark.read.parquet(f"{where}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in line_crf.score(docs, field).collect()}
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows if scores[r[0]] >= line_crf.KEEP)
    ids = {r["doc_id"] for r in found}
    assert set(range(74)) <= ids and not ids & set(range(74, 104))

    first = stored(stages["near_duplicates"](spark, good, where), "first")
    kept = first.collect()
    extras(kept)
    given = sorted({(r["doc_id"], r["text"]) for r in found}, key=lambda x: (x[0] is None, x[0]))
    bags = [Counter(zip(*(words(t or "")[k:] for k in range(5)), strict=False)) for _, t in given]
    seen, group = [], {}
    for k, (i, t) in enumerate(given):
        near = {group[m] for m in seen if (t or "") == (given[m][1] or "") or bags[k] and bags[m] and jaccard(bags[k], bags[m]) >= 0.8}
        group[k] = min(near, default=k)
        group = {m: group[k] if g in near else g for m, g in group.items()}
        seen.append(k)
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(given[g] for g in set(group.values()))

    left = stored(stages["repeated_passages"](spark, first, where), "left")
    rest = left.collect()
    extras(rest)
    removed = brute_removed([(r["doc_id"], r["text"] or "") for r in kept])
    import hashlib

    assert len(rest) == len(kept) and sum(v[1] for v in removed.values()) >= 5 * 50
    before = {r["doc_id"]: r["text"] for r in kept}
    for r in rest:
        _, n, sha = removed[r["doc_id"]]
        assert r["text"] == before[r["doc_id"]] if not n else hashlib.sha256(r["text"].encode()).hexdigest() == sha
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))

    mixed = stored(stages["mixture"](spark, left, where), "mixed")
    taken = mixed.collect()
    extras(taken)
    size, got = defaultdict(int), defaultdict(int)
    for r in rest:
        size[r["source"]] += len(words(r["text"] or ""))
    for r in taken:
        got[r["source"]] += len(words(r["text"]))
    order = sorted(size, key=lambda s: (s is None, s))
    weight, target, open_, todo = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, set(order), sum(size.values())
    while open_:
        level = todo / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        target |= {s: 3 * size[s] if s in full else level * weight[s] for s in full or open_}
        todo -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(got[s] - target[s]) <= 1 for s in order)
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in rest}
    assert all(f"{texts[r['doc_id']]} ".startswith(" ".join(r["text"].split()) + " ") for r in taken)
    assert max(Counter(r["doc_id"] for r in taken).values()) <= 3

    expected = Counter()
    for r in taken:
        ids = token_ids(r["text"], 1)
        expected.update((r["doc_id"], len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for a in range(0, len(ids), 4096))
    pieces = stages["packing"](spark, mixed, where).collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in pieces) == expected
    whole = corpus_pipeline.run(spark, where).collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in whole) == expected


def test_stages_on_no_rows(spark, folder):
    where, _ = folder
    none = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, where)
        assert out.count() == 0
        assert name == "packing" or out.columns == none.columns


def test_columns_with_clashing_names_keep_their_values(spark, folder):
    where, rows = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for kept in (near_dedup.first_of_each(docs), substring.rewritten(docs), line_crf.good_rows(docs, None)):
        assert kept.schema == docs.schema or kept.columns == docs.columns
        extras(kept.collect())


def test_training_lines_are_bounded(spark, monkeypatch):
    prepare(spark)
    rows = [(i, "good small line\nanother good line" if i % 2 else "BAD!! $$$\nBAD!!") for i in range(40)]
    rows.append((999, "\n".join("a line" for _ in range(500))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    sizes = []
    real = line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda x, first, label, **k: sizes.append(len(x)) or real(x, first, label, **k))
    monkeypatch.setattr(line_crf, "TRAIN_LINES", 30)
    assert line_crf.train(docs, labels) is not None
    assert sizes == [30] and np.isfinite(sizes[0])
