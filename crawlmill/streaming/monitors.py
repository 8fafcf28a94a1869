"""Continuous price alerts, page-change events and run counts.

The keyed monitors keep one small value per key, those of a group of keys together. Rows of one key must arrive in order across
micro-batches; inside a batch they are sorted. A micro-batch is cut into ranges of key and order, as many as there are
shuffle partitions, so a heavy key is spread over tasks; only the first and last row of a key's stretch in a range meet in
the group's task. A task so holds about its share of the micro-batch, whatever the keys; bound the micro-batch
with ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` at the source.

Counts and histories come out anew whenever they change, with what tells the newest row from older ones; ``latest_counts``
and ``latest_history`` read them. Rows are gathered per Arrow batch before they meet their key, so a busy window or job
sends few.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


from ..operators.prices import DEFAULT_THRESHOLD, change_alert, target_items
from ..operators.runs import KEPT_RUNS
from ..operators.snapshots import content_hash


SHORT = 10_000  # complete rows that pass the keys' tasks as one
BUCKETS = 512  # groups of keys that share a task's call and a state value
# rows reach the processor as named tuples: no leading underscore
_FIRST, _SLOT, _PACKED, _BUCKET = "stretch_first", "stretch_slot", "stretch_rows", "stretch_bucket"


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's key is not that of the row before; nulls are equal."""
    n = table.num_rows
    starts = np.zeros(n, bool)
    starts[:1] = True
    for k in keys:
        column = table.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        left, right = column.slice(0, n - 1), column.slice(1)
        unlike = pc.fill_null(pc.not_equal(left, right), pc.xor(pc.is_null(left), pc.is_null(right))) if n > 1 else pa.array([], pa.bool_())
        starts[1:] |= unlike.to_numpy(zero_copy_only=False)
    return starts


def _ordered(table: pa.Table, columns: list[str]) -> pa.Table:
    # nulls stand first, as in Spark
    by = [(c, "ascending") for c in columns]
    return table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_start")).combine_chunks()


def _micros(column) -> pa.Array:
    return column.cast(pa.timestamp("us", "UTC")).cast(pa.int64()).combine_chunks()


def _stretches(keys: list[str], order: list[str], value: str, keep_s: float | None = None):
    """Rows of one range with the value before each, which is not known for the first row of a key's stretch.

    With ``keep_s`` a value more than so many seconds (by the first order column) before a row is not given.

    Slot 0 has the rows that the key's task needs: first and last ones. The other rows are complete; up to ``SHORT`` of
    them share a slot, whatever their keys.
    """
    many = SHORT

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = _ordered(pa.Table.from_batches(found), [*keys, *order])
        n = table.num_rows
        starts = _starts(table, keys)
        inner = ~starts & ~np.append(starts[1:], True)
        context = TaskContext.get()
        at_range = (context.partitionId() if context else 0) << 40
        slot = np.where(inner, 1 + at_range + np.cumsum(inner) // many, 0)
        before = table.column(value).take(pa.array(np.arange(-1, n - 1), mask=np.arange(n) == 0))
        unknown = starts
        if keep_s is not None:
            at = _micros(table.column(order[0]))
            gap = pc.subtract(at, at.take(pa.array(np.maximum(np.arange(-1, n - 1), 0))))
            unknown = starts | pc.fill_null(pc.greater(gap, int(keep_s * 1e6)), False).to_numpy(zero_copy_only=False)
        before = pc.if_else(pa.array(unknown), pa.scalar(None, before.type), before)
        out = table.append_column("previous", before).append_column(_FIRST, pa.array(starts)).append_column(_SLOT, pa.array(slot))
        out = out.select([*keys, _SLOT, *order, value, "previous", _FIRST])
        yield from out.to_batches(max_chunksize=10_000)

    return run


def _packed(stretches, by: list[str], rest: list[str]):
    """Rows as Arrow bytes: those of slot 0 in a row for each group ``by``, those of each other slot in a row without one."""

    def run(batches):
        for batch in stretches(batches):
            slots = batch.column(_SLOT)
            keyed = batch.filter(pc.equal(slots, 0))
            # a range is sorted by its groups
            cuts = np.append(np.flatnonzero(_starts(keyed, by)), keyed.num_rows)
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                group = keyed.slice(at, end - at)
                yield _row({c: group.column(c).slice(0, 1) for c in by}, 0, group.select([*rest, _FIRST]))
            for slot in pc.unique(slots).to_pylist():
                if slot:
                    none = {c: pa.nulls(1, batch.schema.field(c).type) for c in by}
                    yield _row(none, slot, batch.filter(pc.equal(slots, slot)).select(rest))

    return run


def _row(group: dict, slot: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(group | {_SLOT: pa.array([slot], pa.int64()), _PACKED: pa.array([_to_bytes(rows)], pa.binary())})


def _to_bytes(rows) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(batches):
    for batch in batches:
        for rows in batch.column(_PACKED):
            yield from pa.ipc.open_stream(rows.as_buffer())


class _Stitched(StatefulProcessor):
    """Give the first row of each stretch of a key the value of the last row of the stretch before it, NULL for the first of all.

    Only slot 0 has state and is gathered, two rows for each range that has a key; rows of other slots pass. A group of keys
    has one call and one state value, the last value of each key, so a key costs no message of its own. With ``keep_s`` a last value counts
    for so many seconds of event time; older ones then leave the state, and a timer takes out a group with none left. The gap is judged by
    the rows, so watermark and timer decide about memory only.
    """

    def __init__(self, keys: list[str], order: list[str], value: str, keep_s: float | None = None):
        self.keys, self.order, self.value = keys, order, value
        self.keep = None if keep_s is None else int(keep_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "held binary, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out = Row(_PACKED)
        if key[-1] != 0:
            yield from (out(r[_PACKED]) for r in rows)
            return
        fresh = pa.concat_tables([pa.ipc.open_stream(r[_PACKED]).read_all() for r in rows])
        times = pa.nulls(fresh.num_rows, pa.int64()) if self.keep is None else _micros(fresh.column(self.order[0]))
        fresh = fresh.append_column("at", times).append_column("new", pa.array(np.ones(fresh.num_rows, bool)))
        held, timer = self.last.get() or (None, None)
        if held is not None:
            fresh = pa.concat_tables([fresh, pa.ipc.open_stream(held).read_all()], promote_options="default")
        table = _ordered(fresh, [*self.keys, "new", *self.order])
        n = table.num_rows
        starts = _starts(table, self.keys)
        at, unknown = table.column("at"), starts
        one_up = pa.array(np.maximum(np.arange(-1, n - 1), 0))
        if self.keep is not None:
            gap = pc.subtract(at, at.take(one_up))
            unknown = starts | pc.fill_null(pc.greater(gap, self.keep), False).to_numpy()
        values = table.column(self.value)
        before = pc.if_else(pa.array(unknown), pa.scalar(None, values.type), values.take(one_up))
        place = table.schema.get_field_index("previous")
        table = table.set_column(place, "previous", pc.if_else(table.column(_FIRST), before, table.column("previous")))
        yield out(_to_bytes(table.filter(table.column("new")).select([*self.keys, *self.order, self.value, "previous"])))
        last = table.filter(pa.array(np.append(starts[1:], True))).select([*self.keys, self.value, "at"])
        self._keep(last.append_column("new", pa.array(np.zeros(last.num_rows, bool))), timer, timerValues)

    def _keep(self, last: pa.Table, timer: int | None, timerValues) -> None:
        expires = None
        if self.keep is not None:
            # a row without a time cannot grow old: it stays
            old = pc.less(pc.add(last.column("at"), self.keep), timerValues.getCurrentWatermarkInMs() * 1000)
            last = last.filter(pc.invert(pc.fill_null(old, False)))
            if timer is not None:
                self.handle.deleteTimer(timer)
            if last.num_rows and not last.column("at").null_count:
                expires = -(-(pc.max(last.column("at")).as_py() + self.keep) // 1000) + 1
                self.handle.registerTimer(expires)
        if last.num_rows:
            self.last.update((_to_bytes(last), expires))
        else:
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def _with_previous(stream: DataFrame, keys: list[str], order: list[str], value: str, keep: str | None = None, late: str = "1 hour") -> DataFrame:
    keep_s = None
    if keep is not None:
        # a length of time, by Spark's own reading of it
        keep_s = stream.sparkSession.range(1).select(_seconds(keep)).first()[0]
        stream = stream.withWatermark(order[0], late)
    # with ``keep`` a group has one value of all key columns but the last, so that it can leave the state
    shared = keys[:-1] if keep is not None else []
    by, others = [*shared, _BUCKET], [k for k in keys if k not in shared]
    bucket = F.pmod(F.xxhash64(*others), F.lit(BUCKETS)).cast("int").alias(_BUCKET)
    slim = stream.select(*shared, bucket, *others, *order, value)
    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    types |= {"previous": types[value], _SLOT: "bigint", _PACKED: "binary"}
    typed = lambda names: ", ".join(f"{n} {types[n]}" for n in names)
    pieces = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = slim.repartitionByRange(pieces, *by, *others, *order)
    given = [*keys, *order, value, "previous"]
    packed = _packed(_stretches([*by, *others], order, value, keep_s), by, given)
    marked = ranges.mapInArrow(packed, typed([*by, _SLOT, _PACKED]))
    time_mode = "None" if keep is None else "EventTime"
    stitched = marked.groupBy(*by, _SLOT).transformWithState(_Stitched(keys, order, value, keep_s), typed([_PACKED]), "append", time_mode)
    return stitched.mapInArrow(_unpacked, typed(given))


def _seconds(length: str) -> Column:
    """Seconds of a length of time such as ``7 days``."""
    zero = F.timestamp_seconds(F.lit(0))
    return F.unix_micros(zero + F.expr(f"interval {length}")) / 1e6


def price_alerts(
    observations: DataFrame, threshold_pct: float = DEFAULT_THRESHOLD, keep: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """The streaming form of the batch price alerts: same columns, same results for ordered input.

    With ``keep`` a price counts as the previous one for that long; products not seen for longer leave the state once the
    watermark (``late`` behind the newest row) has passed. Without, a product's last price is kept for good.
    """
    steps = _with_previous(observations, ["product", "source"], ["observed_at", "seq"], "price", keep, late)
    return (
        steps.filter("previous is not null and previous <> 0")
        .withColumns(change_alert(F.col("previous"), F.col("price"), threshold_pct))
        .filter("alert_type is not null")
        .withColumnsRenamed({"price": "current_price", "previous": "previous_price"})
    )


def ingested(items: DataFrame, targets: DataFrame, late: str = "1 hour", threshold_pct: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The streaming form of ``prices.ingest_targets``: alerts of a stream of scraped items that may be delivered again.

    Items meet the table of targets, which is read anew for every micro-batch; repeated deliveries within ``late`` of each
    other are dropped, and what is left feeds the price alerts. State: an item for ``late``, one price per product and
    source. An item more than ``late`` older than the newest one of the micro-batches before is dropped.
    """
    seen = target_items(items, targets).withWatermark("observed_at", late)
    return price_alerts(seen.dropDuplicatesWithinWatermark(["product", "source", "observed_at", "seq"]), threshold_pct)


def page_changes(snapshots: DataFrame, keep: str | None = None, late: str = "1 hour") -> DataFrame:
    """One event whenever a URL's content hash differs from the one seen before, ``keep`` ago at most if that is given.

    With ``keep`` URLs not seen for longer leave the state, as in ``price_alerts``.
    """
    hashed = snapshots.select("url", "ts", "seq", content_hash("content").alias("content_hash"))
    steps = _with_previous(hashed, ["url"], ["ts", "seq"], "content_hash", keep, late)
    return steps.filter("previous is not null and previous <> content_hash").withColumnRenamed(
        "previous", "previous_hash"
    )


def _partial_counts(batches):
    """Successes and errors of each window in one Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            sums = pa.Table.from_batches([batch]).group_by(["start", "end"]).aggregate([("won", "sum"), ("lost", "sum")])
            yield from sums.rename_columns(["start", "end", "won", "lost"]).to_batches()


class _WindowCounts(StatefulProcessor):
    """Counts of one window: a row whenever they change, the last one from a timer at the window's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "won bigint, lost bigint")

    def _row(self, key, won: int, lost: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"start": [key[0]], "end": [key[1]], "run_count": [won], "error_count": [lost], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = pd.Timestamp(key[1])
        ends = (ends.tz_localize("UTC") if ends.tzinfo is None else ends).value // 1_000_000
        sums = [(int(part["won"].sum()), int(part["lost"].sum())) for part in rows]
        if ends <= timerValues.getCurrentWatermarkInMs():
            return  # the window is closed
        before = self.counts.get() if self.counts.exists() else None
        if before is None:
            self.handle.registerTimer(ends)
        won, lost = (sum(x) for x in zip(*sums, before or (0, 0), strict=True))
        self.counts.update((won, lost))
        yield self._row(key, won, lost, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counts.exists():
            yield self._row(key, *self.counts.get(), True)
            self.counts.clear()

    def close(self) -> None:
        pass


def run_counts(runs: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Successes and errors per job-independent time window: ``start, end, run_count, error_count, closed``.

    Every micro-batch gives the counts so far of the windows it adds to, so that open windows leave the stream as well;
    once ``late`` has passed after its end, a window comes out a last time, ``closed``, and leaves the state. Rows of closed
    windows are not counted. ``latest_counts`` takes the newest row of each window. Rows without a time are in no window;
    a run whose success is unknown counts as neither.
    """
    seen = runs.withWatermark("ts", late).select(F.window("ts", interval), "success")
    flags = {"won": F.coalesce("success", F.lit(False)), "lost": ~F.coalesce("success", F.lit(True))}
    slim = seen.select("window.start", "window.end", *[c.cast("bigint").alias(n) for n, c in flags.items()])
    partial = slim.mapInArrow(_partial_counts, "start timestamp, end timestamp, won bigint, lost bigint")
    schema = "start timestamp, end timestamp, run_count bigint, error_count bigint, closed boolean"
    return partial.groupBy("start", "end").transformWithStateInPandas(_WindowCounts(), schema, "append", "EventTime")


def latest_counts(counts: DataFrame) -> DataFrame:
    """The newest row of each window from what ``run_counts`` has written."""
    newest = F.struct("closed", F.col("run_count") + F.col("error_count"))
    columns = ["run_count", "error_count", "closed"]
    return counts.groupBy("start", "end").agg(F.max_by(F.struct(*columns), newest).alias("last")).select("start", "end", "last.*")


def _newest(job: str, order: list[str], limit: int):
    """The newest ``limit`` rows of each job in one Arrow batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                by = [(job, "ascending"), *((c, "descending") for c in order)]
                table = pa.Table.from_batches([batch])
                table = table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_end"))
                jobs = table.column(job).dictionary_encode(null_encoding="encode").combine_chunks()
                codes = jobs.indices.to_numpy()
                starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
                yield from table.filter(pa.array(rank < limit)).to_batches()

    return run


class _History(StatefulProcessor):
    """The newest runs of one job as a bounded list, given out whole whenever it changes."""

    def __init__(self, columns: dict[str, str], limit: int):
        self.columns, self.limit = columns, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", ", ".join(f"`{n}` {t}" for n, t in self.columns.items()))
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = list(self.columns)
        held = [tuple(r) for r in self.runs.get()] if self.version.exists() else []
        kept = held
        for part in rows:
            # Python's own values: missing ones as None, times as datetime
            fresh = pa.Table.from_pandas(part[names], preserve_index=False).to_pylist()
            kept = kept + [tuple(r[n] for n in names) for r in fresh]
            # ts and seq stand first; those without come last
            kept = sorted(kept, key=lambda r: [(v is not None, _plain(v) if v is not None else 0) for v in r[:2]], reverse=True)[: self.limit]
        if kept == held:
            return
        version = self.version.get()[0] + 1 if self.version.exists() else 1
        self.runs.put(kept)
        self.version.update((version,))
        out = pd.DataFrame(kept, columns=names)
        out.insert(0, "job", key[0])
        yield out.assign(position=range(1, len(kept) + 1), version=version)

    def close(self) -> None:
        pass


def _plain(value):
    """A time as a number; other values as they are."""
    if isinstance(value, datetime):
        stamp = pd.Timestamp(value)
        return (stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp).value
    return value


def run_history(runs: DataFrame, limit: int = KEPT_RUNS) -> DataFrame:
    """The newest ``limit`` runs of each job as a stream: the columns of ``runs``, ``position`` (1: newest) and ``version``.

    ``runs`` has ``job, ts, seq`` and more. The state holds ``limit`` runs per job, whatever the order they come in:
    a run older than those held changes nothing, one between them takes its place. A job whose list changes comes out
    whole with the next version; ``latest_history`` takes the newest one. A task holds ``limit`` rows per job
    and Arrow batch of the micro-batch.
    """
    order = ["ts", "seq"]
    fields = {f.name: f.dataType.simpleString() for f in runs.schema}
    stored = {n: fields[n] for n in [*order, *(c for c in fields if c not in ("job", *order))]}
    slim = runs.select("job", *stored)
    typed = ", ".join(f"`{n}` {t}" for n, t in {"job": fields["job"], **stored}.items())
    few = slim.mapInArrow(_newest("job", order, limit), typed)
    schema = f"{typed}, position bigint, version bigint"
    return few.groupBy("job").transformWithStateInPandas(_History(stored, limit), schema, "append", "None")


def latest_history(history: DataFrame) -> DataFrame:
    """The newest list of each job from what ``run_history`` has written: like ``recent_runs`` of all runs streamed."""
    newest = history.groupBy(F.col("job").alias("of_job")).agg(F.max("version").alias("of_version"))
    same = F.col("job").eqNullSafe(F.col("of_job")) & (F.col("version") == F.col("of_version"))
    return history.join(newest, same, "left_semi").drop("version")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over everything available into parquet files and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
