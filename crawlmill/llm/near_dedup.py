"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, bands, and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_memos, hash_runs, mix, row_columns, row_key, slices, stored, whole_row, words
from .graph import components

SHINGLE = 5  # words
SLICE_BYTES = 1 << 20  # text worked on at once
LEAST = 0.8  # weighted Jaccard similarity of a link
BANDS, ROWS = 24, 4  # a pair at 0.8 shares no band with probability 3e-6
MEMBERS_PER_TASK = 256  # texts compared with one leader by one task, about
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20  # members of a bucket, and bytes of their texts, that a task holds at a time, about
PAIRS_AT_ONCE = 200_000  # pairs of signatures compared in one step
# of the 96 signature components, as 4-bit values, a pair at 0.8 has fewer equal ones with probability 1e-5
LEAST_EQUAL = 62
SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 16)]  # those values, 16 in a long


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of shingles: ``(text, shingle hash, count)`` sorted by both, and a hash of each text's words in order.

    A text of fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    h, _, _, at, _ = words(column)
    n = np.diff(at)
    position = np.arange(len(h)) - np.repeat(at[:-1], n)
    text = np.repeat(np.arange(len(n)), n)
    marked = mix(h ^ mix(position.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(marked, dtype=np.uint64)])
    key = mix((total[at[1:]] - total[at[:-1]]) ^ n.astype(np.uint64))
    whole = np.flatnonzero(position + SHINGLE <= np.repeat(n, n))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    starts = np.concatenate([whole, at[:-1][short]])
    lengths = np.concatenate([np.full(len(whole), SHINGLE), n[short]])
    owner, shingle = text[starts], hash_runs(h, starts, lengths)
    by = np.lexsort((shingle, owner))
    owner, shingle = owner[by], shingle[by]
    new = np.ones(len(by), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return owner[first], shingle[first], np.diff(np.append(first, len(by))), key


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (n x m) of n multisets; equal components at the rate of the weighted Jaccard similarity.

    The weight axis is cut at 1, 2, 4, 8, ...; each element has a Poisson process per interval, of one point per
    unit of time, unit of weight and component. Points come in rising time; each falls to a component and, by
    halving the interval again and again, to one unit of weight, and counts if that lies below the element's
    weight. A component keeps its earliest point. As points rise, an element is left as soon as its next one is
    later than the time by which all components should be filled; if some are not, that time is doubled.
    """
    out = np.zeros((n, m), np.uint64)
    if not len(text):
        return out
    total = np.bincount(text, weights=weight, minlength=n)
    has = total > 0
    limit = np.where(has, (np.log(m) + 4) / np.maximum(total, 1), 0.0)
    # one process per element and interval that begins below the weight
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    who = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(who)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    units = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    seed = mix(element[who] ^ mix(level.astype(np.uint64) + np.uint64(77)))
    todo = np.flatnonzero(has[text[who]])
    while len(todo):
        owner = text[who[todo]]
        best = np.full(n * m, np.inf)
        ident = np.zeros(n * m, np.uint64)
        live, time, step = todo, np.zeros(len(todo)), 0
        points = []
        while len(live):
            draw = mix(seed[live] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(_unit(draw)) / (m * units[live])
            near = time <= limit[text[who[live]]]
            live, time, draw = live[near], time[near], mix(draw[near])
            cell = low[live] + ((draw >> np.uint64(32)) * units[live].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            component = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            hit = cell < weight[who[live]]
            points.append((text[who[live[hit]]] * m + component[hit], time[hit], draw[hit]))
            step += 1
        place, when, mark = (np.concatenate(x) for x in zip(*points, strict=True))
        np.minimum.at(best, place, when)
        first = when == best[place]
        ident[place[first]] = mark[first]
        filled = np.isfinite(best).reshape(n, m).all(axis=1)
        done = np.unique(owner)[filled[np.unique(owner)]]
        out[done] = ident.reshape(n, m)[done]
        limit = limit * 2
        todo = todo[~filled[owner]]
    return out


def signatures(source: DataFrame) -> DataFrame:
    """``(id, th, k, size, bands, s0 ..)`` of each row of (id, th, text): ``k`` names the text's words, ``size`` is its bytes, ``bands`` its buckets, and the longs hold 4 bits of each signature component."""

    def run(batches):
        drop_memos("tokens_")
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                text, shingle, count, key = bags(part.column("text"))
                sign = bag_minhash(text, shingle, count, len(part), BANDS * ROWS).reshape(len(part), BANDS, ROWS)
                band = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
                for r in range(ROWS):
                    band = mix(band ^ sign[:, :, r])
                nibbles = (sign.reshape(len(part), len(SKETCH), 16) & np.uint64(15)) << np.arange(0, 64, 4, dtype=np.uint64)
                sketch = np.bitwise_or.reduce(nibbles, axis=2).view(np.int64)
                some = np.bincount(text, minlength=len(part)) > 0
                ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(band[some].ravel().view(np.int64)))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                columns = [part.column("id"), part.column("th"), pa.array(key.view(np.int64)), size, lists, *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "k", "size", "bands", *SKETCH])

    longs = "".join(f", {c} bigint" for c in SKETCH)
    return source.mapInArrow(run, f"id bigint, th bigint, k bigint, size bigint, bands array<bigint>{longs}")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int]:
    """Of two multisets, given as sorted hashes and counts: common weight and both weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum()), int(a[1].sum()), int(b[1].sum())


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) with ``both`` (weight in common), ``n_u`` and ``n_v`` (weights).

    ``texts`` has ``k`` and ``text``, one row per k. Each v's text leads groups of its u's, so it is sent once per group
    and read before them; a task holds the multiset of one leader and one Arrow batch. A leader of many pairs
    has many groups. Multisets are compared exactly.
    """
    groups = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(F.col("v").alias("__v"), (1 + F.floor(F.col("n") / MEMBERS_PER_TASK)).cast("bigint").alias("groups"))
    sized = pairs.join(groups, F.col("v") == F.col("__v")).select("u", "v", F.expr("pmod(xxhash64(u), groups)").alias("g"))
    members = sized.join(texts, F.col("u") == F.col("k")).select("v", "g", F.lit(1).alias("kind"), F.col("u").alias("node"), "text")
    leads = groups.join(texts, F.col("__v") == F.col("k")).select(
        F.col("__v").alias("v"), F.explode(F.expr("sequence(0, groups - 1)")).alias("g"), F.lit(0).alias("kind"), F.col("__v").alias("node"), "text"
    )
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leads.unionByName(members).repartition(tasks, "v", "g").sortWithinPartitions("v", "g", "kind")

    def run(batches):
        lead = None
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                text, shingle, count, _ = bags(part.column("text"))
                ends = np.searchsorted(text, np.arange(len(part) + 1))
                found = []
                for i, (kind, node, v) in enumerate(zip(*(part.column(c).to_pylist() for c in ("kind", "node", "v")), strict=True)):
                    bag = shingle[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]
                    if kind == 0:
                        lead = bag
                    else:
                        found.append((node, v, *overlap(bag, lead)))
                columns = zip(*found, strict=True) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "both", "n_u", "n_v"])

    return rows.mapInArrow(run, "u bigint, v bigint, both bigint, n_u bigint, n_v bigint")


def _equal_components() -> Column:
    """How many signature components a member and its leader (columns v_s0 ..) have in common, by their 4 bits."""
    total = F.lit(BANDS * ROWS)
    for c in SKETCH:
        x = F.col(c).bitwiseXOR(F.col(f"v_{c}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _mixed(members: DataFrame) -> DataFrame:
    """The rows (b, k, root) of buckets whose members are of more than one component."""
    open_ = members.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select(F.col("b").alias("__b"))
    return members.join(open_, F.col("b") == F.col("__b"), "left_semi")


def _blocks(members: DataFrame, across: bool) -> DataFrame:
    """The members with the blocks (p, q) they are compared in, and ``kind``, 0 for p's and 1 for q's.

    A bucket is cut into blocks by its rows and bytes. Inside a block (p = q) all are of kind 0. ``across`` gives
    the pairs of different blocks: a member goes to as many as its bucket has other blocks.
    """
    blocks = 1 + F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + F.floor(F.sum("size") / BLOCK_BYTES)
    sizes = members.groupBy(F.col("b").alias("__b")).agg(blocks.cast("int").alias("blocks"))
    sizes = sizes.filter("blocks > 1") if across else sizes
    own = members.join(sizes, F.col("b") == F.col("__b")).withColumn("own", F.expr("cast(pmod(xxhash64(k), blocks) as int)"))
    if across:
        own = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).filter("other != own")
    else:
        own = own.withColumn("other", F.col("own"))
    places = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("kind")]
    return own.select("b", *places, "k", "root", *SKETCH)


def _whole_groups(batches):
    """The rows of a sorted partition as tables of whole groups (b, p, q); the last group of a batch waits for its rest."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        keys = np.stack([table.column(c).to_numpy() for c in ("b", "p", "q")])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest


def likely_pairs(rows: pa.Table):
    """Row numbers (i, j), in portions, of pairs of one group that have ``LEAST_EQUAL`` equal components and are not yet in one component."""
    keys = np.stack([rows.column(c).to_numpy() for c in ("b", "p", "q")])
    kind, root = rows.column("kind").to_numpy(), rows.column("root").to_numpy()
    sketch = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in SKETCH], axis=1)
    n = len(rows)
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    size = np.diff(np.append(first, n))
    end = np.repeat(first + size, size)
    # partners: in a block the rows that follow; between two blocks the rows of the second
    seconds = np.repeat(np.add.reduceat(kind, first), size)
    low = np.where(keys[1] == keys[2], np.arange(n) + 1, end - seconds)
    partners = np.where(kind == 0, end - low, 0)
    before = np.concatenate([[0], np.cumsum(partners)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS_AT_ONCE, "right")) - 1)
        count = partners[lo:hi]
        i = np.repeat(np.arange(lo, hi), count)
        j = np.repeat(low[lo:hi] - (before[lo:hi] - before[lo]), count) + np.arange(len(i))
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        x = sketch[i] ^ sketch[j]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
        likely = differ <= BANDS * ROWS - LEAST_EQUAL
        yield i[likely], j[likely]
        lo = hi


def _with_partners(blocks: DataFrame) -> DataFrame:
    """The rows of blocks that are in a likely pair of their blocks."""

    def run(batches):
        for rows in _whole_groups(batches):
            some = np.zeros(len(rows), bool)
            for i, j in likely_pairs(rows):
                some[i] = some[j] = True
            yield from rows.filter(pa.array(some)).to_batches()

    return _dealt(blocks).mapInArrow(run, blocks.schema)


def _dealt(blocks: DataFrame) -> DataFrame:
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "b", "p", "q").sortWithinPartitions("b", "p", "q", "kind")


def block_links(blocks: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that tie the members of each group (b, p, q) as all links of its pairs do.

    A pair is judged in the first bucket that both texts are in, by its exact overlap, unless links already found
    in the same rows tie it. A task holds one group, whose rows and bytes are bounded, and one batch.
    """

    def run(batches):
        for rows in _whole_groups(batches):
            bucket, k, root = (rows.column(c).to_numpy() for c in ("b", "k", "root"))
            bands = rows.column("bands").combine_chunks()
            bands = bands.flatten().to_numpy().reshape(len(rows), BANDS)
            text = rows.column("text").combine_chunks()
            parent: dict[int, int] = {}

            def top(x, parent=parent):
                while x in parent:
                    x = parent[x]
                return x

            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            found = []
            for i, j in likely_pairs(rows):
                shared = bands[i] == bands[j]
                here = bands[i, shared.argmax(axis=1)] == bucket[i]
                i, j = i[here], j[here]
                new = [r for r in np.unique(np.concatenate([i, j])).tolist() if r not in known]
                if not len(i):
                    continue
                owner, shingle, count, _ = bags(text.take(pa.array(new, pa.int64())))
                ends = np.searchsorted(owner, np.arange(len(new) + 1))
                known.update((r, (shingle[a:b], count[a:b])) for r, a, b in zip(new, ends[:-1], ends[1:], strict=True))
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = top(root[a]), top(root[b])
                    if x != y:
                        both, n_a, n_b = overlap(known[a], known[b])
                        if both >= least * (n_a + n_b - both) - 1e-6:
                            parent[max(x, y)] = min(x, y)
                            found.append((k[a], k[b]))
            columns = zip(*found, strict=True) if found else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])

    near = stored(_with_partners(blocks), "near")
    full = near.join(texts.withColumnRenamed("k", "__k"), F.col("k") == F.col("__k")).drop("__k")
    return _dealt(full).mapInArrow(run, "u bigint, v bigint")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``(id, th, root, class_id)`` of every row, keys as in ``common.row_key``: the row's class and the smallest id in it.

    ``root`` names the class. ``class_id`` does not: classes whose smallest ids are equal or null share it.

    Texts with the same words in the same order are one node. Nodes are linked if the weighted Jaccard similarity of
    their 5-word shingle multisets is ``least`` or more; classes are the connected components. Candidates are the
    nodes that share a band of their signatures and have ``LEAST_EQUAL`` equal components. First all members of a
    bucket are compared with its leader, the member that meets the most others; the leader has then met
    all and leaves. That settles groups of copies of one text: buckets whose remaining members already belong to one
    component are done, as no further link could change a class. The members of the others are compared block by
    block inside tasks (see ``block_links``), first inside each block, then, in buckets still open, across blocks;
    only links leave a task. So no candidate that could join two classes is passed over, yet pairs never
    become rows.

    Bands, candidate texts, links and labels are stored tables; none of them is collected. Texts without words
    (null, empty, blank) are one class. Starts jobs when called.
    """
    spark = docs.sparkSession
    keys = [k.alias(n) for k, n in zip(row_key(id_col, text_col), ("id", "th"), strict=True)]
    source = docs.select(*keys, F.col(text_col).cast("string").alias("text"))
    signed = stored(signatures(source), "signatures")
    nodes = signed.groupBy("k").agg(F.min(F.struct("id", "th")).alias("rep"), F.max("size").alias("size"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in SKETCH])
    nodes = stored(nodes.select("k", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), "size", "bands", *SKETCH), "nodes")
    members = nodes.select(F.explode("bands").alias("b"), "k", F.col("k").alias("root"))
    members = stored(_mixed(members), "buckets")  # buckets of two nodes and more
    # the member that meets the most others is the likeliest to be what the others were copied from: it leads
    sizes = members.groupBy(F.col("b").alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    ranks = members.join(sizes, F.col("b") == F.col("__b")).groupBy(F.col("k").alias("__k")).agg(F.sum("n").alias("rank"))
    sketches = nodes.select(F.col("k").alias("__k"), "size", *SKETCH).join(ranks, "__k")
    members = stored(members.join(sketches, F.col("k") == F.col("__k")).drop("__k"), "members")
    wanted = members.select("k").distinct().join(nodes.select("k", "id", "th", "bands"), "k")
    wanted = wanted.select("k", "bands", F.col("id").alias("__id"), F.col("th").alias("__th"))
    texts = source.join(wanted, (F.col("id") == F.col("__id")) & (F.col("th") == F.col("__th"))).select("k", "bands", "text")
    # equal rows hold the same text
    texts = stored(texts, "texts")
    single = texts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0
    texts = texts if single else stored(texts.dropDuplicates(["k"]), "texts")
    links = roots = None
    if not members.isEmpty():
        leaders = members.groupBy("b").agg(F.max(F.struct("rank", "k", *SKETCH)).alias("lead"))
        leaders = leaders.select(F.col("b").alias("__b"), F.col("lead.k").alias("v"), *[F.col(f"lead.{c}").alias(f"v_{c}") for c in SKETCH])
        leaders = stored(leaders, "leaders")
        likely = (F.col("k") != F.col("v")) & (_equal_components() >= LEAST_EQUAL)
        pairs = members.join(leaders, (F.col("b") == F.col("__b")) & likely).select(F.col("k").alias("u"), "v").distinct()
        facts = compared(stored(pairs, "pairs"), texts.select("k", "text"))
        linked = facts.filter(F.col("both") >= F.lit(least) * (F.col("n_u") + F.col("n_v") - F.col("both")) - 1e-6)
        links = stored(linked.select("u", "v"), "linked")
        members = members.join(leaders.select(F.col("__b").alias("b"), F.col("v").alias("k")), ["b", "k"], "left_anti")
    for across in (False, True):
        roots = None if links is None else components(links).select(F.col("node").alias("__k"), F.col("root").alias("new_root"))
        if roots is None or members.isEmpty():
            continue
        members = members.drop("root").join(roots, F.col("k") == F.col("__k"), "left").withColumn("root", F.coalesce("new_root", "k")).drop("__k", "new_root")
        members = stored(_mixed(members), "members")
        more = stored(block_links(_blocks(members, across), texts, least), "linked")
        links = links.unionByName(more)
    if links is not None:
        roots = components(links).select(F.col("node").alias("__k"), F.col("root").alias("new_root"))
    # null first ids stand last, so the smallest id of a class is its first row's
    labelled = nodes.select("k", "id")
    if roots is None:
        labelled = labelled.withColumn("root", F.col("k"))
    else:
        labelled = labelled.join(roots, F.col("k") == F.col("__k"), "left").select("k", "id", F.coalesce("new_root", "k").alias("root"))
    labelled = stored(labelled, "labels")
    firsts = labelled.groupBy("root").agg(F.min("id").alias("class_id"))
    named = labelled.join(firsts, "root").select("k", "root", "class_id")
    return signed.select("id", "th", "k").join(named, "k").select("id", "th", "root", "class_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: id, ``class_id``, the smallest id among its exact and near copies, and ``class_key`` (see ``classes``).

    A null id counts as the largest: ``class_id`` is null only if no row of the class has an id. Where ids are null or
    repeat, different classes can have one ``class_id``; ``class_key`` tells them apart. Repeated rows are in one class. An empty table gives an empty result; other columns are ignored.
    """
    none = F.lit((1 << 63) - 1)
    found = classes(docs, id_col, text_col, least)
    return found.select(F.nullif("id", none).alias(id_col), F.nullif("class_id", none).alias("class_id"), F.col("root").alias("class_key"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` with one row for each class: that of the smallest id, of the smallest text hash if it repeats.

    Rows with null or repeated ids that are no copies of each other are all kept.
    """
    chosen = classes(docs, id_col, text_col, least).groupBy("root").agg(F.min(F.struct("id", "th")).alias("first"))
    chosen = chosen.select(F.col("first.id").alias("__cid"), F.col("first.th").alias("__cth"))
    keyed = docs.select(*row_key(id_col, text_col), whole_row(docs))
    kept = keyed.join(chosen, (F.col("__id") == F.col("__cid")) & (F.col("__text") == F.col("__cth")), "left_semi")
    return row_columns(kept.dropDuplicates(["__id", "__text"]), docs)
