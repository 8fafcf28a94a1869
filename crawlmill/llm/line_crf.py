"""Document quality from a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_memos, row_columns, slices, whole_row, words

TRAIN_DOCS = 6_000  # labelled documents the field is fitted on, chosen by a hash of their id
TRAIN_LINES = 200_000  # lines of all of them together; a document that no longer fits is passed over
STEPS = 300
RIDGE = 1e-3
SLICE_BYTES = 1 << 20  # text worked on at once
KEEP = 0.7  # score from which a document counts as good

_KINDS = 10  # of bytes, see _byte_kinds


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 5, np.int8)  # other marks
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[32, *range(9, 14)]] = 3
    kind[[ord(c) for c in ".,;:'\"()?-"]] = 4
    kind[[ord(c) for c in "#*$%&<>@^~=_\\"]] = 6
    kind[ord("!")] = 7
    kind[[ord(c) for c in "|{}[]/+"]] = 8
    kind[128:] = 9
    return kind


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of a column of texts: ``(lines x features, weight per line, first line per text)``.

    A text has one line more than line feeds, so an empty one has one. Own features: byte kinds, word lengths,
    repetition inside the line, whether the line comes twice in its text. Then the same features of the line
    before and after (zero where there is none). A line weighs its bytes plus one.
    """
    h, first, end, before, data = words(column)
    offsets = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))])
    feeds = np.flatnonzero(data == 10)
    # a line begins where a text begins or after a line feed
    starts = np.concatenate([offsets[:-1], feeds + 1])
    text = np.concatenate([np.arange(len(column)), np.searchsorted(offsets, feeds, "right") - 1])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    n = len(starts)
    first_line = np.searchsorted(text, np.arange(len(column) + 1))
    stops = np.empty(n, np.int64)
    stops[:-1] = starts[1:] - 1
    stops[first_line[1:] - 1] = offsets[1:]
    size = np.maximum(stops - starts, 0)
    counts = np.empty((n, _KINDS))
    kind = _byte_kinds()[data] if len(data) else np.zeros(0, np.int8)
    for k in range(_KINDS):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts[:, k] = total[starts + size] - total[starts]
    # words per line: lines never cut a word
    lo, hi = np.searchsorted(first, starts), np.searchsorted(first, starts + size)
    n_words = hi - lo
    line_of = np.repeat(np.arange(n), n_words)
    take = np.arange(len(h)) if len(line_of) == len(h) else np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
    hw, lengths = h[take], (end - first)[take]
    again = np.zeros(n)
    same = np.zeros(n)
    if len(hw):
        same = np.bincount(line_of[1:][(hw[1:] == hw[:-1]) & (line_of[1:] == line_of[:-1])], minlength=n).astype(float)
        by = np.lexsort((hw, line_of))
        twice = (hw[by][1:] == hw[by][:-1]) & (line_of[by][1:] == line_of[by][:-1])
        again = np.bincount(line_of[by][1:][twice], minlength=n).astype(float)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.searchsorted(line_of, np.arange(n + 1))
    chars = total[at[1:]] - total[at[:-1]]
    print_ = np.concatenate([[np.uint64(0)], np.cumsum(hw * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)])
    mark = print_[at[1:]] - print_[at[:-1]]
    by = np.lexsort((mark, text))
    equal = (mark[by][1:] == mark[by][:-1]) & (text[by][1:] == text[by][:-1]) & (n_words[by][1:] > 0)
    copies = np.zeros(n)
    copies[by[1:][equal]] = 1
    copies[by[:-1][equal]] = 1
    bytes_, per = np.maximum(size, 1)[:, None], np.maximum(n_words, 1)
    own = np.column_stack(
        [
            counts / bytes_,
            np.sqrt(counts / bytes_),
            np.log1p(size),
            np.log1p(n_words),
            chars / per,
            same / per,
            again / per,
            np.minimum(again / per, 0.5) ** 2,
            copies,
            (n_words == 0),
            (n_words < 4),
        ]
    ).astype(np.float64)
    inner = np.ones(n, bool)
    inner[first_line[:-1]] = False
    earlier = np.zeros_like(own)
    earlier[1:][inner[1:]] = own[:-1][inner[1:]]
    later = np.zeros_like(own)
    later[:-1][inner[1:]] = own[1:][inner[1:]]
    edge = np.column_stack([~inner, np.append(~inner[1:], True)]).astype(float)
    return np.hstack([own, earlier, later, edge, np.ones((n, 1))]), size + 1.0, first_line


def _lattice(first: np.ndarray):
    """For each position in a text, the rows of the lines that stand there, texts with more lines first."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    sizes = np.searchsorted(-count[order], -np.arange(count.max(initial=0)), "left")
    return order, sizes, [first[order[:m]] + t for t, m in enumerate(sizes)]


def marginals(emission: np.ndarray, transition: np.ndarray, first: np.ndarray):
    """Forward-backward over all texts at once: ``(P(good) per line, P(state, next state) summed over all)``.

    ``emission`` is the score of state 1 over state 0 per line; ``transition`` the 2 x 2 scores.
    """
    node = np.stack([np.zeros_like(emission), emission], axis=1)
    alpha, beta = np.empty_like(node), np.zeros_like(node)
    _, sizes, rows = _lattice(first)
    for t, at in enumerate(rows):
        if t == 0:
            alpha[at] = node[at]
        else:
            a = alpha[at - 1]
            s = a[:, :, None] + transition[None]
            alpha[at] = np.logaddexp(s[:, 0], s[:, 1]) + node[at]
    pairs = np.zeros((2, 2))
    for t in range(len(rows) - 1, 0, -1):
        at = rows[t]
        s = transition[None] + (node[at] + beta[at])[:, None, :]
        beta[at - 1] = np.logaddexp(s[:, :, 0], s[:, :, 1])
        joint = alpha[at - 1][:, :, None] + s
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs


class Field:
    """Weights of a fitted field: feature means and scales, emission weights, transition scores."""

    def __init__(self, mean, scale, weights, transition):
        self.mean, self.scale, self.weights, self.transition = mean, scale, weights, transition

    def scores(self, column: pa.Array) -> np.ndarray:
        """Per text the mean of its lines' marginals of the good label, weighted by line length."""
        if not len(column):
            return np.zeros(0)
        x, weight, first = line_features(column)
        p, _ = marginals(((x - self.mean) / self.scale) @ self.weights, self.transition, first)
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood with a ridge term, by Adam on the full gradient; all lines of a text carry its label."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0.0, 1.0
    z = (x - mean) / scale
    y = np.repeat(label.astype(float), np.diff(first))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    a, b = y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (a, b), 1)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, pairs = marginals(z @ theta[:-4], theta[-4:].reshape(2, 2), first)
        slope = np.concatenate([z.T @ (y - p), (seen - pairs).ravel()]) / len(label) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def held_out(id_col: str):
    """The rows no label may be learned from: crc32 of the id as text, modulo 4, is 2. A null id is none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field | None:
    """Fit on at most ``TRAIN_DOCS`` labelled documents that are not held out; None if either label is missing.

    The documents are those with the smallest hashes of their ids, so the choice is the same at every run; those that
    would bring their lines above ``TRAIN_LINES`` are passed over. Line features are made on the executors; the
    driver receives those of the sample only, at most 90 numbers for each of these lines.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    # a few more ids than needed, as some labels may have no document here
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    there = docs.select(F.col(id_col).alias("id"), lines.alias("lines")).groupBy("id").agg(F.max("lines").cast("bigint").alias("lines"))
    first = known.join(there, "id").orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS).collect()
    chosen, left = [], TRAIN_LINES
    for r in first:
        if r["lines"] <= left:
            chosen.append((r["id"], r["label"]))
            left -= r["lines"]
    if len({label for _, label in chosen}) < 2:
        return None
    picked = spark.createDataFrame(chosen, known.schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(picked), "id").dropDuplicates(["id"])

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                x, _, first = line_features(part.column("text"))
                lines = [x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), part.column("label"), pa.array(lines, pa.binary())], names=["id", "label", "x"])

    rows = texts.mapInArrow(run, "id bigint, label int, x binary").collect()
    rows.sort(key=lambda r: r["id"])
    wide = line_features(pa.array([""]))[0].shape[1]
    blocks = [np.frombuffer(r["x"], "<f4").reshape(-1, wide).astype(float) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    return fit(np.vstack(blocks), first, np.array([r["label"] for r in rows]))


def _scored(docs: DataFrame, field: Field | None, text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``."""
    source = docs.select(whole_row(docs), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        drop_memos("tokens_")
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                s = np.ones(hi - lo) if field is None else field.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(s)], names=["row", "score"])

    schema = T.StructType([source.schema["row"], T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``KEEP`` on) of every document.

    Whole texts are scored in Arrow batches; nothing is shuffled. Null and empty texts are one empty line;
    a null id is kept; repeated rows are scored each on its own; an empty table gives an empty result; other
    columns are ignored. Without a field (no usable labels) every score is 1.0.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        drop_memos("tokens_")
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                s = np.ones(hi - lo) if field is None else field.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s)], names=["id", "score"])

    found = source.mapInArrow(run, f"id {kind}, score double")
    return found.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )


def good_rows(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``KEEP``, with their columns."""
    return row_columns(_scored(docs, field, text_col).filter(F.col("score") >= KEEP), docs)
