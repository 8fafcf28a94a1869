"""Tool calls of conversations: linked to their results, ordered by what they need, validated, as canonical JSON."""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import hot_keys, key_hash, with_position
from .common import stored

CALLS_PER_TASK = 200_000  # calls of one conversation that a task orders; larger conversations are ordered by joins
MOST_DEPTH = 100  # lists and objects inside each other; deeper arguments are a problem of their own

# argument schemas: name -> (required fields, optional fields), each field with its JSON type, or with a dictionary of
# type, enum, minimum, maximum, items (of an array), required and optional (of an object)
TOOLS = {
    "search": ({"query": "string", "limit": {"type": "integer", "minimum": 0, "maximum": 100}}, {"language": "string"}),
    "summarize": ({"text": "string", "max_words": {"type": "integer", "minimum": 0}}, {}),
    "translate": ({"text": "string", "target": {"type": "string", "enum": ["de", "en", "es", "fr"]}}, {"formal": "boolean"}),
}


def calls_of(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tool traffic of plain conversations: a user's turn is a call, the assistant's turn after it its result, any other context.

    Tool, arguments and needs follow from the turn's text: most calls need the call four turns before, some the one two
    turns later, which the transcript has in the wrong order; some arguments have a wrong type.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    call_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    needs = F.when(n % 5 == 0, F.col("turn") + 2).when(F.col("turn") >= 4, F.col("turn") - 4)
    limit = F.when(n % 7 == 0, F.lit('"many"')).otherwise((n % 50).cast("string"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    arguments = (
        F.when(n % 3 == 0, F.concat(F.lit('{"query":'), quoted, F.lit(',"limit":'), limit, F.lit("}")))
        .when(n % 3 == 1, F.concat(F.lit('{"max_words": '), limit, F.lit(', "text": '), quoted, F.lit("}")))
        .otherwise(F.concat(F.lit('{"text":'), quoted, F.lit(',"target":"en"}')))
    )
    calls = messages.filter(F.col("role") == "user").select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        call_id.alias("call_id"),
        F.element_at(F.array(F.lit("search"), F.lit("summarize"), F.lit("translate")), (n % 3 + 1).cast("int")).alias("name"),
        arguments.alias("arguments"),
        F.when(needs.isNotNull(), F.array(F.concat_ws("-", F.col("conv_id").cast("string"), needs.cast("string")))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    before = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    results = messages.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), before.alias("call_id"), F.col("text").alias("content")
    )
    context = messages.filter(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("text").alias("content")
    )
    return calls, results, context


def _firsts(rows: DataFrame) -> DataFrame:
    """``rows`` without repeated rows, and ``first``: whether a row is its identifier's earliest (ties by hash)."""
    once = rows.distinct()
    rank = F.struct("turn", F.xxhash64(*[c for c in rows.columns if c != "turn"]))
    least = once.groupBy("conv_id", "call_id").agg(F.min(rank).alias("__least")).withColumnsRenamed({"conv_id": "__conv", "call_id": "__call"})
    joined = once.join(least, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("call_id").eqNullSafe(F.col("__call")))
    return joined.withColumn("first", (rank == F.col("__least")) & F.col("call_id").isNotNull()).drop("__conv", "__call", "__least")


_STUCK = 1 << 30  # level of the first call that no order frees

_pair = ["conv_id", "call_id"]


def _same(conv: str, call: str):
    return F.col("conv_id").eqNullSafe(F.col(conv)) & (F.col("call_id") == F.col(call))


def _components(edges: DataFrame) -> DataFrame:
    """``root`` of every call in ``edges`` (conv_id, call_id, need): calls have the same root if each needs the other.

    Every call takes the largest identifier among those it can reach; the calls that the bearer of that identifier
    can reach in turn, within those of the same mark, are one component. What is left is marked anew. Rounds are
    as many as the longest way in the calls that no order frees, which are few.
    """
    nodes = edges.select(*_pair).unionByName(edges.select("conv_id", F.col("need").alias("call_id"))).distinct()
    nodes, found = stored(nodes, "nodes"), None
    while not nodes.isEmpty():
        here = nodes.select(F.col("conv_id").alias("n_conv"), F.col("call_id").alias("n_id"))
        inside = edges.join(here, F.col("conv_id").eqNullSafe(F.col("n_conv")) & (F.col("need") == F.col("n_id")), "left_semi")
        inside = stored(inside.join(here, _same("n_conv", "n_id"), "left_semi"), "inside")
        marks = stored(nodes.withColumn("root", F.col("call_id")), "marks")
        while True:
            ahead = marks.select(F.col("conv_id").alias("m_conv"), F.col("call_id").alias("m_id"), F.col("root").alias("m_root"))
            best = inside.join(ahead, F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("need") == F.col("m_id")))
            best = best.groupBy(F.col("conv_id").alias("b_conv"), F.col("call_id").alias("b_id")).agg(F.max("m_root").alias("best"))
            joined = marks.join(best, _same("b_conv", "b_id"), "left")
            joined = joined.select(*_pair, F.greatest("root", "best").alias("root"), F.coalesce(F.col("best") > F.col("root"), F.lit(False)).alias("moved"))
            joined = stored(joined, "marks")
            marks = joined.drop("moved")
            if joined.filter("moved").isEmpty():
                break
        reached = frontier = stored(marks.filter("call_id = root"), "reached")
        while not frontier.isEmpty():
            start = frontier.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_id"), F.col("root").alias("f_root"))
            to = inside.join(start, _same("f_conv", "f_id")).select("conv_id", F.col("need").alias("call_id"), F.col("f_root").alias("root")).distinct()
            held = marks.select(F.col("conv_id").alias("m_conv"), F.col("call_id").alias("m_id"), F.col("root").alias("m_root"))
            to = to.join(held, _same("m_conv", "m_id") & (F.col("root") == F.col("m_root")), "left_semi")
            known = reached.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"))
            frontier = stored(to.join(known, _same("k_conv", "k_id"), "left_anti"), "frontier")
            reached = reached.unionByName(frontier)
        reached = stored(reached, "reached")
        found = reached if found is None else found.unionByName(reached)
        done = reached.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"))
        nodes = stored(nodes.join(done, _same("k_conv", "k_id"), "left_anti"), "nodes")
    return nodes.withColumn("root", F.col("call_id")) if found is None else stored(found, "components")


def _behind(cycles: DataFrame, needs: DataFrame) -> DataFrame:
    """The calls (conv_id, call_id) that need one of ``cycles``, straight or through others, and are none of them."""
    known = frontier = cycles
    while True:
        reached = frontier.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_id"))
        new = needs.join(reached, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("need") == F.col("f_id")), "left_semi").select(*_pair).distinct()
        held = known.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"))
        frontier = stored(new.join(held, _same("k_conv", "k_id"), "left_anti"), "behind")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    held = cycles.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"))
    return known.join(held, _same("k_conv", "k_id"), "left_anti")


def _levels(edges: DataFrame, first_level: int) -> tuple[DataFrame | None, DataFrame]:
    """Levels of the calls in ``edges`` (conv_id, call_id, need) from ``first_level``, one above the last call needed, and the edges of calls never freed."""
    levels, level = None, first_level
    while not edges.isEmpty():
        waiting = edges.select(F.col("conv_id").alias("w_conv"), F.col("call_id").alias("w_id")).distinct()
        bound = edges.join(waiting, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("need") == F.col("w_id")), "left_semi")
        bound = bound.select(F.col("conv_id").alias("b_conv"), F.col("call_id").alias("b_id")).distinct()
        # a call is free when none of its needs waits
        free = edges.select(*_pair).distinct().join(bound, _same("b_conv", "b_id"), "left_anti")
        free = stored(free.withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            break
        level += 1
        levels = free if levels is None else levels.unionByName(free)
        gone = free.select(F.col("conv_id").alias("f_conv"), F.col("call_id").alias("f_id"))
        edges = stored(edges.join(gone, _same("f_conv", "f_id"), "left_anti"), "waits")
    return levels, edges


def _components_of(needs: list[list[int]]) -> list[list[int]]:
    """Calls that need each other, straight or through others; each such set after all that it needs (Tarjan's way, without recursion)."""
    seen, low, open_, stack, found, clock = [0] * len(needs), [0] * len(needs), [False] * len(needs), [], [], 0
    for root in range(len(needs)):
        if seen[root]:
            continue
        way = [(root, iter(needs[root]))]
        clock += 1
        seen[root] = low[root] = clock
        stack.append(root)
        open_[root] = True
        while way:
            v, ahead = way[-1]
            for w in ahead:
                if not seen[w]:
                    clock += 1
                    seen[w] = low[w] = clock
                    stack.append(w)
                    open_[w] = True
                    way.append((w, iter(needs[w])))
                    break
                if open_[w]:
                    low[v] = min(low[v], seen[w])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[v])
                if low[v] == seen[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    found.append(stack[at:])
                    del stack[at:]
                    for w in found[-1]:
                        open_[w] = False
    return found


def ordered_calls(ids: list[str], depends_on: list[list[str] | None]) -> tuple[list[int], list[int], list[str | None]]:
    """``late``, ``level`` and ``mark`` of the calls of one conversation, which come by turn and id: as ``_ordered`` has them,
    with ``late`` as the row of the call whose place it is."""
    row = {x: i for i, x in enumerate(ids)}
    needs = [list({row[d] for d in far or () if d in row}) for far in depends_on]
    late, level, mark = list(range(len(ids))), [0] * len(ids), [None] * len(ids)
    for members in _components_of(needs):
        inside = set(members)
        far = {d for i in members for d in needs[i]} - inside
        last = max([*members, *(late[d] for d in far)])
        rank = max((level[d] + 1 for d in far if late[d] == last), default=0)
        kind = "cycle" if len(members) > 1 or members[0] in needs[members[0]] else "blocked" if any(mark[d] for d in far) else None
        for i in members:
            late[i], level[i], mark[i] = last, rank, kind
    return late, level, mark


def _ordered(calls: DataFrame) -> DataFrame:
    """The first call of every identifier (conv_id, call_id) with ``late``, ``level``, ``mark`` and ``absent``, the needs that no call of the conversation fulfils.

    A conversation of up to ``CALLS_PER_TASK`` calls is ordered in one task, whatever the length of its chains; larger ones
    by joins (``_ordered_by_joins``). A sketch of bounded size tells them apart and only steers the plan.
    """
    firsts = calls.filter("first").select("conv_id", "turn", "call_id", "depends_on")
    hot = hot_keys(firsts, ["conv_id"], CALLS_PER_TASK)
    heavy = key_hash(["conv_id"]).isin(list(hot)) if hot else F.lit(False)
    kind = firsts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "call_id", "late_turn", "late_id", "level", "mark", "absent"]

    def run(parts):
        for part in parts:
            turns, ids, far = (part.column(c).to_pylist() for c in ("turn", "call_id", "depends_on"))
            rows = sorted(range(len(ids)), key=lambda i: (turns[i] is not None, turns[i] or 0, ids[i].encode()))
            turns, ids, far = ([x[i] for i in rows] for x in (turns, ids, far))
            late, level, mark = ordered_calls(ids, far)
            there = set(ids)
            absent = [sorted({d for d in x or () if d is not None} - there, key=str.encode) or None for x in far]
            conv = part.column("conv_id").take(pa.array(rows, pa.int64()))
            made = [conv, pa.array(ids, pa.string()), pa.array([turns[i] for i in late], pa.int64()), pa.array([ids[i] for i in late], pa.string())]
            made += [pa.array(level, pa.int32()), pa.array(mark, pa.string()), pa.array(absent, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in made], names=names)

    def conversations(batches):
        # rows come by conversation; the calls of one are held until the next begins
        held = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if held and held[-1].column("group")[-1].as_py() != group[lo]:
                    yield from run(_same_conversation(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from run(_same_conversation(held))

    light = firsts.filter(~heavy).withColumn("group", key_hash(["conv_id"])).repartition("group").sortWithinPartitions("group")
    order = light.mapInArrow(conversations, f"conv_id {kind}, call_id string, late_turn bigint, late_id string, level int, mark string, absent array<string>")
    if not hot:
        return order
    large = stored(firsts.filter(heavy).withColumn("first", F.lit(True)), "large")
    joined = _ordered_by_joins(large).select(*_pair, F.col("late.turn").alias("late_turn"), F.col("late.call_id").alias("late_id"), "level", "mark")
    needed = large.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("need")).filter("need is not null")
    there = large.select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_id"))
    absent = needed.join(there, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("need") == F.col("t_id")), "left_anti")
    absent = absent.groupBy(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id")).agg(F.array_sort(F.collect_list("need")).alias("absent"))
    joined = joined.join(absent, _same("a_conv", "a_id"), "left")
    return order.unionByName(joined.select(names))


def _same_conversation(held: list[pa.RecordBatch]):
    """The rows of each conversation whose keys share a hash: nearly always one."""
    table = pa.Table.from_batches(held)
    keys = table.column("conv_id").to_pylist()
    if all(k == keys[0] for k in keys):
        yield table
        return
    for key in dict.fromkeys(map(repr, keys)):
        yield table.filter(pa.array([repr(k) == key for k in keys]))


def _ordered_by_joins(calls: DataFrame) -> DataFrame:
    """Adds ``late`` (the turn and id a call must wait for), ``level`` behind that, ``cycle`` and ``blocked``.

    A call takes the latest place among its own and those of all it needs; the few calls that wait for a later one
    are then levelled among those of the same place, in rounds. Rounds are as many as the longest chain that the
    transcript has in the wrong order. Calls that no round frees lie on cycles or behind them: each cycle is found
    and levelled as one, so that a call stands behind all it needs unless that needs the call itself.
    """
    place = F.struct("turn", "call_id")
    state = stored(calls.filter("first").select("conv_id", "call_id", place.alias("own"), place.alias("late")), "places")
    needs = calls.filter("first").select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("need"))
    needs = stored(needs.filter("need is not null and need != call_id"), "needs")
    selves = calls.filter(F.col("first") & F.array_contains(F.coalesce("depends_on", F.array().cast("array<string>")), F.col("call_id")))
    while True:
        parent = state.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"), F.col("late").alias("p_late"))
        latest = needs.join(parent, (F.col("conv_id").eqNullSafe(F.col("p_conv"))) & (F.col("need") == F.col("p_id")))
        latest = latest.groupBy(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id")).agg(F.max("p_late").alias("waits"))
        joined = state.join(latest, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("call_id") == F.col("c_id")), "left")
        moved = F.coalesce(F.col("waits") > F.col("late"), F.lit(False))
        after = stored(joined.select("conv_id", "call_id", "own", F.when(moved, F.col("waits")).otherwise(F.col("late")).alias("late"), moved.alias("moved")), "places")
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    # needs between calls of the same place
    parent = state.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"), F.col("late").alias("p_late"))
    child = state.select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), "late")
    edges = needs.join(child, _same("c_conv", "c_id")).join(parent, (F.col("conv_id").eqNullSafe(F.col("p_conv"))) & (F.col("need") == F.col("p_id")))
    edges = stored(edges.filter(F.col("late") == F.col("p_late")).select("conv_id", "call_id", "need"), "waits")
    levels, stuck = _levels(edges, 1)
    cycles = selves.select(*_pair)
    if not stuck.isEmpty():
        # needs that are free already keep their levels
        bound = stuck.select(F.col("conv_id").alias("w_conv"), F.col("call_id").alias("w_id")).distinct()
        stuck = stored(stuck.join(bound, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("need") == F.col("w_id")), "left_semi"), "stuck")
        roots = _components(stuck)
        size = roots.groupBy(F.col("conv_id").alias("s_conv"), F.col("root").alias("s_root")).agg(F.count(F.lit(1)).alias("size"))
        roots = stored(roots.join(size, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("root") == F.col("s_root"))).drop("s_conv", "s_root"), "roots")
        cycles = cycles.unionByName(roots.filter("size > 1").select(*_pair))
        child = roots.select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), F.col("root").alias("c_root"))
        parent = roots.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_id"), F.col("root").alias("p_root"))
        between = stuck.join(child, _same("c_conv", "c_id")).join(parent, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("need") == F.col("p_id")))
        between = between.filter("c_root <> p_root").select("conv_id", F.col("c_root").alias("call_id"), F.col("p_root").alias("need")).distinct()
        ranks, _ = _levels(stored(between, "between"), _STUCK + 1)
        late = roots.withColumn("level", F.lit(_STUCK)).select(*_pair, "root", "level")
        if ranks is not None:
            ranks = ranks.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_root"), F.col("level").alias("rank"))
            late = late.join(ranks, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("root") == F.col("r_root")), "left")
            late = late.select(*_pair, F.coalesce("rank", "level").alias("level"))
        late = late.select(*_pair, "level")
        levels = late if levels is None else levels.unionByName(late)
    cycles = stored(cycles.distinct(), "cycles")
    marks = cycles.withColumn("mark", F.lit("cycle")).unionByName(_behind(cycles, needs).withColumn("mark", F.lit("blocked")))
    marks = marks.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"), "mark")
    joined = state.join(marks, _same("k_conv", "k_id"), "left")
    if levels is None:
        return joined.select(*_pair, "late", F.lit(0).alias("level"), "mark")
    levels = levels.select(F.col("conv_id").alias("m_conv"), F.col("call_id").alias("m_id"), "level")
    return joined.join(levels, _same("m_conv", "m_id"), "left").select(*_pair, "late", F.coalesce("level", F.lit(0)).alias("level"), "mark")


class _Bad(ValueError):
    """What is wrong with a JSON text."""


def parsed(text: str | None):
    """The JSON object of a text; raises ``_Bad`` with what is wrong with it."""

    def finite(digits):
        value = float(digits)
        if not math.isfinite(value):
            raise _Bad("arguments hold a number out of range")
        return value

    def whole(digits):
        if len(digits) > 4000:
            raise _Bad("arguments hold a number out of range")
        return int(digits)

    def constant(name):
        raise _Bad(f"arguments hold {name}")

    def once(members):
        found = dict(members)
        if len(found) < len(members):
            seen = Counter(k for k, _ in members)
            raise _Bad(f"arguments repeat {_shown(min(k for k, n in seen.items() if n > 1))}")
        return found

    try:
        value = json.loads(text, parse_float=finite, parse_int=whole, parse_constant=constant, object_pairs_hook=once) if text is not None else None
    except _Bad:
        raise
    except ValueError:
        value = None
    except RecursionError:
        raise _Bad("arguments nest too deeply") from None
    if not isinstance(value, dict):
        raise _Bad("arguments are no object")
    layer, depth = [value], 0
    while layer:
        depth += 1
        if depth > MOST_DEPTH:
            raise _Bad("arguments nest too deeply")
        inner = []
        for x in layer:
            for y in [*x, *x.values()] if isinstance(x, dict) else x:
                if isinstance(y, str):
                    if not _shown(y) == y:
                        raise _Bad("arguments hold half a surrogate pair")
                elif isinstance(y, (dict, list)):
                    inner.append(y)
        layer = inner
    return value


def _shown(text: str) -> str:
    """A text that UTF-8 can hold: halves of surrogate pairs as escapes."""
    return text.encode("utf-8", "backslashreplace").decode()


def problems(name: str | None, arguments: str | None, tools: dict) -> tuple[object, list[str]]:
    """The parsed arguments (None if they are no sound JSON object) and what is wrong with them, in order."""
    try:
        value = parsed(arguments)
    except _Bad as e:
        return None, [str(e)]
    if name not in tools:
        return value, ["unknown tool"]
    required, optional = tools[name]
    return value, _members(value, required, optional, "")


def _members(value: dict, required: dict, optional: dict, path: str) -> list[str]:
    found = [f"missing {path}{f}" for f in sorted(required) if f not in value]
    for f in sorted(value):
        if f in required or f in optional:
            found += _wrong(value[f], required[f] if f in required else optional[f], f"{path}{f}")
        else:
            found.append(f"unknown {path}{f}")
    return found


def _wrong(value, schema, path: str) -> list[str]:
    """What keeps a value from its schema: a type's name or a dictionary, as in ``TOOLS``."""
    if isinstance(schema, str):
        schema = {"type": schema}
    kind = schema.get("type")
    if kind is not None and not _is(value, kind):
        return [f"{path} is no {kind}"]
    found = []
    # true is no 1
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        found.append(f"{path} is none of its values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{path} is below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{path} is above {schema['maximum']}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += _wrong(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict) and ("required" in schema or "optional" in schema):
        found += _members(value, schema.get("required", {}), schema.get("optional", {}), f"{path}.")
    return found


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    kinds = {"string": str, "integer": int, "number": (int, float), "array": list, "object": dict}
    return kind in kinds and isinstance(value, kinds[kind])


def canonical(value) -> str:
    """JSON with sorted keys, no white space, whole numbers without a point."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float) and math.isfinite(x) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def link(calls: DataFrame, results: DataFrame, tools: dict, context: DataFrame | None = None) -> DataFrame:
    """One row per call, per result that has none and per turn of ``context``: linked, ordered, validated, as canonical JSON.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids); ``results``: conv_id,
    turn, call_id, content; ``context``: conv_id, turn, content, turns that are neither and stay as they are. Output: conv_id,
    call_id, turn, ``position`` (1, 2, ... in the conversation; null for rows out of order), ``status``, ``valid``,
    ``problems``, ``json``. Other columns are not read.

    A call and its result are joined by conversation and identifier. The first row of an identifier counts
    (by turn, then by hash); later ones are ``repeated_call`` and ``repeated_result``, exact repeats are dropped. A
    call is ``answered`` or ``pending``; ``cycle`` if it needs itself, straight or through others; ``blocked`` if it
    needs a call on a cycle but is on none. A result without call is ``orphan_result``, a turn of context ``context``. Arguments
    that are no object, nest deeper than ``MOST_DEPTH``, repeat a member, or hold numbers out of range or half a
    surrogate pair are a problem and stay text in the JSON. A very long text is one row's. A null identifier links nothing (``unnamed_call``, ``unnamed_result``). Calls stand behind all
    they need; needs that no call of the conversation fulfils are a problem. Only the identifiers and needs of up to
    ``CALLS_PER_TASK`` calls of a conversation meet in a task; order in larger ones comes from joins, in rounds as many as
    their longest way. Null texts are null in the
    JSON; empty tables give an empty result. Starts jobs when called.
    """
    calls = _firsts(calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on"))
    calls = stored(calls, "calls")
    results = _firsts(results.select("conv_id", "turn", "call_id", "content"))
    answers = results.filter("first").select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("turn").alias("r_turn"), F.col("content"))
    order = _ordered(calls).withColumnsRenamed({"conv_id": "o_conv", "call_id": "o_id"})
    main = calls.filter("first").join(order, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("call_id") == F.col("o_id")))
    main = main.join(answers, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "left")
    main = main.select(
        "conv_id", "call_id", "turn", "name", "arguments", "depends_on", "absent", "content", "late_turn", "late_id", "level",
        F.when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("r_turn").isNotNull() | F.col("r_id").isNotNull(), "answered").otherwise("pending").alias("status"),
    )
    main = with_position(stored(main, "linked"), ["conv_id"], ["late_turn", "late_id", "level", "turn", "call_id"], "position")
    main = main.drop("late_turn", "late_id", "level")
    none = {c: F.lit(None).cast(t) for c, t in (("name", "string"), ("arguments", "string"), ("depends_on", "array<string>"), ("absent", "array<string>"), ("content", "string"), ("position", "bigint"))}
    others = calls.filter("not first").withColumns({c: none[c] for c in ("absent", "content", "position")})
    others = others.withColumn("status", F.when(F.col("call_id").isNull(), "unnamed_call").otherwise("repeated_call"))
    named = calls.filter("first").select(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"))
    lost = results.join(named, F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("call_id") == F.col("c_id")) & F.col("first"), "left_anti")
    lost = lost.withColumns({c: none[c] for c in ("name", "arguments", "depends_on", "absent", "position")})
    lost = lost.withColumn("status", F.when(F.col("call_id").isNull(), "unnamed_result").when(F.col("first"), "orphan_result").otherwise("repeated_result"))
    columns = ["conv_id", "call_id", "turn", "position", "status", "name", "arguments", "depends_on", "absent", "content"]
    rows = main.select(columns).unionByName(others.select(columns)).unionByName(lost.select(columns))
    if context is not None:
        plain = context.select("conv_id", "turn", "content").withColumns({c: none[c] for c in none if c != "content"} | {"call_id": F.lit(None).cast("string"), "status": F.lit("context")})
        rows = rows.unionByName(plain.select(columns))
    kind = calls.schema["conv_id"].dataType.simpleString()

    def run(batches):
        kept = ["conv_id", "call_id", "turn", "position", "status"]
        for batch in batches:
            valid, wrong, texts = [], [], []
            for r in batch.select(["call_id", "status", "name", "arguments", "depends_on", "absent", "content"]).to_pylist():
                body = {"call_id": r["call_id"], "status": r["status"]}
                if r["status"].endswith("result") or r["status"] == "context":
                    valid.append(None)
                    wrong.append([])
                    texts.append(canonical(body | {"content": r["content"]}))
                    continue
                value, found = problems(r["name"], r["arguments"], tools)
                found += [f"nothing gives {x}" for x in r["absent"] or []]
                valid.append(not found)
                wrong.append(found)
                body |= {"name": r["name"], "arguments": r["arguments"] if value is None else value, "depends_on": r["depends_on"] or []}
                texts.append(canonical(body | {"result": r["content"]}))
            made = [pa.array(valid, pa.bool_()), pa.array(wrong, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "valid", "problems", "json"])

    schema = f"conv_id {kind}, call_id string, turn bigint, position bigint, status string, valid boolean, problems array<string>, json string"
    return rows.mapInArrow(run, schema)
