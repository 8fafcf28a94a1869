"""Tokens of two tokenizers over the same bytes: which overlap, which end together, and how often pairs do so."""

from __future__ import annotations

import gc
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, worker_memo

SLICE_BYTES = 1 << 20  # text aligned at once; a longer text alone
MEMO_UNITS = 300_000  # stretches between spaces whose ids a worker remembers; a full memo starts anew
LONG_UNIT = 64  # code points; longer stretches are not remembered

_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _byte_level() -> dict[str, int]:
    """Byte of each character in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """A byte-level tokenizer A and a piece tokenizer B: ids of whole texts, and the bytes of each id."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        level = _byte_level()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in level for c in token)
            self.a_bytes[i] = bytes(level[c] for c in token) if known else token.encode()
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.vocab_size()))
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # no token of either has a space after anything but white space, so text can be cut before a lone space
        self.cuts = not any(re.search(r"\S ", x.decode("utf-8", "ignore")) for x in chain(self.a_bytes, self.b_bytes))
        self.memo_a: dict[str, bytes] = {}
        self.memo_b: dict[str, bytes] = {}
        # ids as text, with what follows them: inside a group, at the end of its A side, at the end of the group
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.names = np.array([f"{i}{c}" for c in ",|;" for i in ids], "S")
        self.n_names = len(ids)

    def _joined(self, ids: np.ndarray, names: list[bytes], whole: bytes) -> bytes:
        """``ids`` as bytes if their tokens join to ``whole``, else none."""
        return ids.tobytes() if b"".join([names[i] for i in ids.tolist()]) == whole else b""

    def _one(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a space and the text by A and B; without ids where the tokenizer changes its bytes."""
        whole = b" " + text.encode()
        a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, "<u4")
        b = np.array(self.b.encode(text, num_threads=1), "<u4")
        return self._joined(a, self.a_bytes, whole), self._joined(b, self.b_bytes, whole)

    def _remember(self, units: list[str]) -> None:
        """Encode many units in one text and cut its ids where they end; one by one if ids do not end there."""
        text = " ".join(units)
        whole = b" " + text.encode()
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, "<u4")
        b = np.array(self.b.encode(text, num_threads=1), "<u4")
        want = np.cumsum([len(u.encode()) + 1 for u in units])
        cuts = []
        for ids, names, sizes in ((a, self.a_bytes, self.a_sizes), (b, self.b_bytes, self.b_sizes)):
            if self._joined(ids, names, whole):
                ends = np.cumsum(sizes[ids])
                cut = np.searchsorted(ends, want)
                if (ends[cut] == want).all():
                    cuts.append([0, *(4 * (cut + 1)).tolist()])
        if len(cuts) < 2:
            for u in units:
                self.memo_a[u], self.memo_b[u] = self._one(u)
            return
        for memo, ids, cut in zip((self.memo_a, self.memo_b), (a, b), cuts, strict=True):
            data = ids.tobytes()
            memo.update(zip(units, [data[x:y] for x, y in zip(cut, cut[1:], strict=False)], strict=True))

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of a space and each text, by A and by B, as little-endian 32-bit numbers; none if either changes its bytes."""
        if not self.cuts:
            return [(x, y) if x and y else (b"", b"") for x, y in map(self._one, texts)]
        gc.disable()  # nothing here makes cycles, and collections over many small objects are slow
        try:
            split = [_LONE_SPACE.split(t) for t in texts]
            new = list(set(chain.from_iterable(split)).difference(self.memo_a))
            if len(self.memo_a) + len(new) > MEMO_UNITS:
                self.memo_a.clear(), self.memo_b.clear()
                new = list(set(chain.from_iterable(split)))
            long = [u for u in new if len(u) > LONG_UNIT]
            short = [u for u in new if len(u) <= LONG_UNIT]
            for units, step in ((short, 500), (long, 1)):
                for at in range(0, len(units), step):
                    self._remember(units[at : at + step])
            get_a, get_b = self.memo_a.__getitem__, self.memo_b.__getitem__
            out = []
            for us in split:
                a, b = list(map(get_a, us)), list(map(get_b, us))
                out.append((b"".join(a), b"".join(b)) if all(a) and all(b) else (b"", b""))
            for u in long:
                del self.memo_a[u], self.memo_b[u]
            return out
        finally:
            gc.enable()


def most_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """How many id pairs can end together at all: one token's bytes must end the other's. Depends on the vocabularies only."""
    a, b = set(a_bytes), set(b_bytes)
    tails = lambda xs, ys: sum(x[i:] in ys for x in xs for i in range(len(x)))
    return tails(a, b) + tails(b, a)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens, as places ``i`` in ``a`` and ``j`` in ``b``; in no order, each once.

    Both frames have ``doc`` and ``start`` in order, one row a token. Each token's start lies in one token of the other side:
    the last one that starts there or before. A pair overlaps exactly if one of the two starts inside the other,
    so the union of both directions is complete.
    """
    left, right = a.assign(i=np.arange(len(a))), b.assign(j=np.arange(len(b)))
    one = pd.merge_asof(left, right, on="start", by="doc")
    two = pd.merge_asof(right, left, on="start", by="doc")
    # starts at the same place are found in the first direction already
    two = two[a["start"].to_numpy()[two["i"].to_numpy()] != b["start"].to_numpy()]
    pairs = [np.concatenate([one[c].to_numpy(), two[c].to_numpy()]) for c in "ij"]
    return pairs[0], pairs[1]


def _frame(ids: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, pd.DataFrame, np.ndarray]:
    """All ids of a batch, each token's text and start among the bytes of all texts, and its end."""
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    ends = np.cumsum(sizes[flat])
    return flat, pd.DataFrame({"doc": doc, "start": ends - sizes[flat]}), ends


def _aligned(texts: list[str | None], pair: Pair, with_overlaps: bool):
    """Per text: ``(n_a, n_b, groups, links, pairs)``; groups as text, links as id pairs in one number each."""
    live = [k for k, t in enumerate(texts) if t]
    out = [(0, 0, None, np.zeros(0, np.int64), [])] * len(texts)
    ids_a, ids_b, kept = [], [], []
    for k, (x, y) in zip(live, pair.ids([texts[k] for k in live]), strict=True):
        if x:
            ids_a.append(np.frombuffer(x, "<u4")), ids_b.append(np.frombuffer(y, "<u4")), kept.append(k)
    if not kept:
        return out
    flat_a, a, a_ends = _frame(ids_a, pair.a_sizes)
    flat_b, b, b_ends = _frame(ids_b, pair.b_sizes)
    all_i, all_j = overlaps(a, b)
    together = a_ends[all_i] == b_ends[all_j]
    i, j = np.sort(all_i[together]), np.sort(all_j[together])
    doc = a["doc"].to_numpy()[i]
    links = flat_a[i] * len(pair.b_bytes) + flat_b[j]
    # written order: a group's A tokens, then its B tokens
    last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
    last_a[i], last_b[j] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    b_before = np.concatenate([[0], j + 1])[group_a]  # B tokens of earlier groups
    a_before = (i + 1)[group_b]  # A tokens up to the group's end
    written = np.empty(len(flat_a) + len(flat_b), np.int64)
    written[np.arange(len(flat_a)) + b_before] = flat_a + pair.n_names * last_a
    written[np.arange(len(flat_b)) + a_before] = flat_b + 2 * pair.n_names * last_b
    names = pair.names[written]
    raw = names.view(np.uint8)
    data = raw[raw != 0].tobytes()
    stops = np.cumsum([0, *(len(x) + len(y) for x, y in zip(ids_a, ids_b, strict=True))])
    at = np.concatenate([[0], np.cumsum(np.char.str_len(names))])[stops]
    cut = np.searchsorted(doc, np.arange(len(kept) + 1))
    if with_overlaps:
        first_a, first_b = np.cumsum([0, *map(len, ids_a)]), np.cumsum([0, *map(len, ids_b)])
        order = np.lexsort((all_j, all_i))
        all_i, all_j = all_i[order], all_j[order]
        by_doc = np.searchsorted(a["doc"].to_numpy()[all_i], np.arange(len(kept) + 1))
    for n, k in enumerate(kept):
        pairs = []
        if with_overlaps:
            rows = slice(by_doc[n], by_doc[n + 1])
            pairs = [{"a": x, "b": y} for x, y in zip((all_i[rows] - first_a[n]).tolist(), (all_j[rows] - first_b[n]).tolist(), strict=True)]
        out[k] = len(ids_a[n]), len(ids_b[n]), data[at[n] : at[n + 1] - 1], links[cut[n] : cut[n + 1]], pairs
    return out


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", with_overlaps: bool = False) -> DataFrame:
    """Align the tokens of a space and each text: id, ``n_a``, ``n_b``, ``groups_sha256``, ``links``, ``overlaps``.

    ``links`` holds a number ``a * (size of B's vocabulary) + b`` for each pair of tokens that end together, in
    text order: each closes a group. ``groups_sha256`` is the digest of the groups as text, ``a1,a2|b1;a3|b2,b3``.
    ``overlaps`` has, on request, the places (from 0) of all overlapping tokens. A null or empty text, or one whose
    bytes either tokenizer changes, has no tokens: zeros, an empty digest and no links.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    places = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        pair = worker_memo(f"pair_{a_file}_{b_file}", lambda: Pair(a_file, b_file))
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                n_a, n_b, groups, links, pairs = zip(*_aligned(part.column("text").to_pylist(), pair, with_overlaps), strict=True)
                ends = np.cumsum([0, *map(len, links)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n_a, pa.int64()),
                        pa.array(n_b, pa.int64()),
                        pa.array([hashlib.sha256(g).hexdigest() if g is not None else "" for g in groups], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(links))),
                        pa.array(pairs, places),
                    ],
                    names=["id", "n_a", "n_b", "groups_sha256", "links", "overlaps"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a bigint, n_b bigint, groups_sha256 string, links array<bigint>, overlaps array<struct<a:bigint,b:bigint>>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """``link, n, best`` for each pair of ids in column ``links``: its links in all rows, and if no pair of its B id has more."""
    counts = links.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    b = F.pmod("link", F.lit(b_size))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def compare(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment figures of each text: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``n_best`` counts the links whose id pair is the most frequent one of its B id in all texts, ties included; ``count_sum``
    adds the corpus-wide counts of all links.

    Texts are encoded once, aligned batch by batch and stored as ids of pairs; the counts are one aggregation with
    partial sums. The pair table goes to every task: a pair can only end together if one token's bytes end the
    other's, so it has at most ``most_pairs`` rows whatever the corpus (about half a million for the public
    vocabularies), which is checked. Ids are cut and encoded between lone spaces with a memo of bounded size. A very
    long text stands alone in its batch and needs about 200 bytes of memory a token.

    Null ids and repeated rows keep their rows; equal texts have equal results and count each time. An empty table
    gives an empty result; other columns are ignored. Starts jobs when called: the alignment is stored.
    """
    pair = Pair(a_file, b_file)
    aligned = stored(align(docs, a_file, b_file, id_col, text_col).drop("overlaps"), "aligned")
    table = pair_counts(aligned.select("links"), len(pair.b_bytes)).toArrow()
    bound = most_pairs(pair.a_bytes, pair.b_bytes)
    if table.num_rows > bound:
        raise RuntimeError(f"{table.num_rows} pairs end together, the vocabularies allow {bound}")
    link, n, best = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("link", "n", "best"))
    by = np.argsort(link)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((link[by], n[by], best[by]))

    def run(batches):
        link, n, best = shared.value
        for batch in batches:
            lists = batch.column("links")
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[ends[0] : ends[-1]]
            at = np.searchsorted(link, flat)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends - ends[0]])  # noqa: B023, E731
            made = [np.diff(ends), total(best[at].astype(np.int64)), total(n[at])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "n_a", "n_b", "groups_sha256")), *(pa.array(x, pa.int64()) for x in made)],
                names=["id", "n_a", "n_b", "groups_sha256", "n_links", "n_best", "count_sum"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = aligned.withColumnRenamed(id_col, "id").mapInArrow(
        run, f"id {kind}, n_a bigint, n_b bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint"
    )
    # each place where both end closes one group and is one link
    return found.select(
        F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"
    )
