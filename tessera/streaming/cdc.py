"""Change deltas: coalescing, applying, logging.

A delta is (id, type, operation, payload, ts, seq).  Deltas of a key are folded
in the order of (ts, seq):

    insert, update -> insert with both      update, update -> update with both
    insert, delete -> nothing               delete, insert -> update
    delete, update -> the update is ignored

The fold is associative on (first operation, last operation, merged payload),
so in batch it is one aggregation with map-side work, and on a stream it is
keyed state.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA = "id string, type string, operation string, payload string, ts timestamp, seq long"
OUTPUT = "id string, type string, operation string, payload string, version long, applied long"


def fold(state: tuple[str | None, dict] | None, operation: str, payload: dict, delete_wins: bool = False) -> tuple[str | None, dict]:
    """One more delta on the state (operation or None, payload).  ``delete_wins``: insert, delete gives a delete."""
    was, data = state or (None, {})
    if operation == "INSERT":
        return ("UPDATE", payload) if was == "DELETE" else ("INSERT", {**data, **payload} if was == "INSERT" else payload)
    if operation == "UPDATE":
        if was == "DELETE":
            return was, data
        return ("INSERT" if was == "INSERT" else "UPDATE", {**data, **payload})
    if was == "INSERT" and not delete_wins:
        return None, {}
    return "DELETE", {}


def _fold_rows(rows: list[tuple[str, str | None]], state=None, delete_wins: bool = False):
    for operation, payload in rows:
        state = fold(state, operation, json.loads(payload) if payload else {}, delete_wins)
    return state


#: What a slice of deltas does to a key, for each operation it may find.
STATES = (None, "INSERT", "UPDATE", "DELETE")
SLICE = "id string, slice long, type string, n long, effects array<struct<operation: string, keeps: boolean, payload: string>>"
#: Marks fields from before a slice: the fold carries the mark on or drops it with them.
BEFORE = "\x00before"


def _runs(batches: Iterator[pd.DataFrame], key: list[str], start: Callable, step: Callable, end: Callable) -> Iterator[pd.DataFrame]:
    """A fold over each run of rows with an equal key, in sorted batches: ``start`` of the first row, ``step`` of each; rows that ``end`` gives, a frame a batch."""
    at, state = None, None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            here = tuple(getattr(row, c) for c in key)
            if state is None or here != at:
                out += [] if state is None else end(at, state)
                at, state = here, start(row)
            state = step(state, row)
        if out:
            yield pd.DataFrame(out)
    if state is not None and (out := end(at, state)):
        yield pd.DataFrame(out)


def coalesce(deltas: DataFrame, delete_wins: bool = False, seconds: int = 86400) -> DataFrame:
    """(id, type, operation, payload, version, applied): what is left of each key's deltas; keys that cancel are left out.

    version counts the key's deltas; deltas without a time come first.  The fold
    is associative: the deltas of a key are folded within slices of ``seconds``,
    and then the slices in order, so a key with very many deltas is dealt over
    as many tasks as it has slices.  Rows are sorted and run through one by one;
    no task holds more of a key than its state.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def step(state, row):
            data = json.loads(row.payload) if row.payload else {}
            return state[0], state[1] + 1, [fold(was, row.operation, data, delete_wins) for was in state[2]]

        def end(at, state):
            effects = [{"operation": operation, "keeps": BEFORE in data, "payload": json.dumps({k: v for k, v in data.items() if k != BEFORE})} for operation, data in state[2]]
            return [{"id": at[0], "slice": at[1], "type": state[0], "n": state[1], "effects": effects}]

        return _runs(batches, ["id", "slice"], lambda row: (row.type, 0, [(was, {BEFORE: 1}) for was in STATES]), step, end)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def step(state, row):
            kind, n, operation, data = state
            found = row.effects[STATES.index(operation)]
            return kind, n + row.n, found["operation"], {**(data if found["keeps"] else {}), **json.loads(found["payload"])}

        def end(at, state):
            kind, n, operation, data = state
            row = {"id": at[0], "type": kind, "operation": operation, "payload": json.dumps(data, sort_keys=True), "version": n, "applied": n}
            return [] if operation is None else [row]

        return _runs(batches, ["id"], lambda row: (row.type, 0, None, {}), step, end)

    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62)))
    rows = deltas.select("id", "type", "operation", "payload", "seq", at.alias("_at"), F.floor(at / F.lit(seconds * 1_000_000)).alias("slice"))
    sliced = rows.repartition("id", "slice").sortWithinPartitions("id", "slice", "_at", "seq").mapInPandas(partial, SLICE)
    return sliced.repartition("id").sortWithinPartitions("id", "slice").mapInPandas(whole, OUTPUT)


def coalesce_operations(deltas: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(key, operation, n): the folded operation alone, without Python: what counts is the last insert or delete and whether
    the key existed before its first delta (its first delta is no insert)."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, "operation")))
    rows = deltas.groupBy(key).agg(ordered.alias("d"))
    step = lambda s, d: (
        F.when(d["operation"] == "INSERT", F.when(s == "DELETE", "UPDATE").otherwise("INSERT"))
        .when(d["operation"] == "UPDATE", F.when(s == "DELETE", "DELETE").when(s == "INSERT", "INSERT").otherwise("UPDATE"))
        .otherwise(F.when(s == "INSERT", "NONE").otherwise("DELETE"))
    )
    return rows.select(key, F.aggregate("d", F.lit("NONE"), step).alias("operation"), F.size("d").cast("long").alias("n")).where("operation <> 'NONE'")


def versions(deltas: DataFrame, key: str = "id") -> DataFrame:
    """A growing version per key."""
    return deltas.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy("ts", "seq")))


def coalesce_stream(deltas: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """The fold as keyed state of a stream, update mode: each micro-batch gives every touched key's delta so far."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was, data, version = state.get if state.exists else (None, "{}", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        operation, merged = _fold_rows(list(zip(rows["operation"], rows["payload"], strict=True)), (was, json.loads(data)) if version else None)
        version += len(rows)
        state.update((operation, json.dumps(merged, sort_keys=True), version))
        yield pd.DataFrame([{"id": key[0], "type": rows["type"].iloc[0], "operation": operation or "NONE", "payload": json.dumps(merged, sort_keys=True), "version": version, "applied": len(rows)}])

    return deltas.groupBy("id").applyInPandasWithState(run, OUTPUT, "operation string, payload string, version long", "update", timeout)


def apply_deltas(table: DataFrame, deltas: DataFrame, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    """The table after coalesced deltas: inserts added, updates merged field by field, deletes dropped; updates of absent rows are ignored."""
    fields = columns or [c for c in table.columns if c != key]
    get = lambda c: F.get_json_object("payload", f"$.{c}").cast(table.schema[c].dataType)
    joined = table.withColumn("_was", F.lit(True)).join(deltas.select(key, "operation", "payload"), key, "full_outer")
    kept = joined.where(F.col("operation").isNull() | (F.col("operation") == "INSERT") | ((F.col("operation") == "UPDATE") & F.col("_was")))
    return kept.select(key, *[F.coalesce(get(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns if c != key])


def apply_stream(deltas: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None, mirrors: tuple[Callable[[DataFrame, int], None], ...] = (), attempts: int = 3, wait: float = 0.1, telemetry: list[dict] | None = None):
    """Start a stream that hands each micro-batch, coalesced, to ``apply`` and then to ``mirrors``.

    At least once: a batch is given again after a failure, so ``apply`` must be
    idempotent by (id, version).  A failing sink is tried ``attempts`` times,
    each wait twice as long as the one before; then the stream fails, and goes
    on with the same batch when it is started again.  ``telemetry`` gets a row
    a batch: its number, rows by operation, tries and seconds.
    """

    def attempt(sink, done: DataFrame, number: int) -> int:
        for n in range(1, attempts + 1):
            try:
                sink(done, number)
                return n
            except Exception:
                if n == attempts:
                    raise
                time.sleep(wait * 2 ** (n - 1))
        return attempts

    def each(batch: DataFrame, number: int) -> None:
        done = coalesce(batch).persist()
        began = time.monotonic()
        try:
            tries = sum(attempt(sink, done, number) for sink in (apply, *mirrors))
            if telemetry is not None:
                counts = {r["operation"]: r["n"] for r in done.groupBy("operation").agg(F.count("*").alias("n")).collect()}
                telemetry.append({"batch": number, "operations": counts, "tries": tries, "seconds": time.monotonic() - began})
        finally:
            done.unpersist()

    writer = deltas.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def has_changed(rows: DataFrame, key: str, content: str, at: str) -> DataFrame:
    """Each version with whether its content differs from the one before; the first has changed."""
    h = F.xxhash64(F.coalesce(content, F.lit("")))
    before = F.lag("hash").over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("hash", h).withColumn("changed", F.coalesce(F.col("hash") != before, F.lit(True)))


def skip_rate(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("checks"), F.avg((~F.col("changed")).cast("double")).alias("skip_rate"))


def mutation_log(mutations: DataFrame, versions_now: DataFrame) -> DataFrame:
    """Mutations (id, base_version, ...) with their status: CONFLICTED if the record (id, version) has moved on, else APPLIED;
    of several on one record and base the first in (ts, seq) is applied."""
    first = F.row_number().over(Window.partitionBy("id", "base_version").orderBy("ts", "seq"))
    joined = mutations.join(versions_now.select("id", F.col("version").alias("now")), "id", "left")
    stale = F.col("now").isNotNull() & (F.col("now") > F.col("base_version"))
    return joined.withColumn("_n", first).withColumn("status", F.when(stale | (F.col("_n") > 1), "CONFLICTED").otherwise("APPLIED")).drop("_n", "now")


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, watermark: str = "1 hour", at: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling or sliding counts and sums; the watermark bounds the state when the input is a stream."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", at: str = "ts", by: str = "user_id", watermark: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def running_scores(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Term parts (key, term, part) summed: on a stream in update mode, so scores follow new postings."""
    return parts.groupBy(key).agg(F.sum("part").alias("score"))


def mention_batches(events: DataFrame, size: int = 100, order: tuple[str, ...] = ("ts", "event_id"), entity: str = "entity_id") -> DataFrame:
    """(batch, entity, n): queued mention events in order, ``size`` to a batch, counted by entity."""
    from tessera.operators.ordering import with_place

    placed = with_place(events, *order)
    return placed.groupBy(F.floor((F.col("place") - 1) / size).alias("batch"), entity).agg(F.count("*").alias("n"))


#: Order in which jobs are taken.
PRIORITIES = ("high", "normal", "low")


def job_queue(jobs: DataFrame, processing: DataFrame | None = None, node: str = "node_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``jobs`` with their ``place`` in the queue: of a node's jobs the last enqueued counts, nodes in ``processing`` (node) are not enqueued,
    high priority goes before normal and low, the first enqueued before the next.  Jobs of other priorities are left out."""
    from tessera.operators.ordering import with_place

    level = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    waiting = jobs if processing is None else jobs.join(processing.select(node).distinct(), node, "left_anti")
    last = waiting.groupBy(node).agg(F.max_by(F.struct(*[c for c in jobs.columns if c != node]), F.struct(*order)).alias("_j")).select(node, "_j.*").select(*jobs.columns)
    queued = last.withColumn("_level", level).where("_level > 0")
    return with_place(queued, "_level", *order, node).drop("_level")


def flush_ready(pending: Column, oldest_ms: Column, since_last_ms: Column, debounce_ms: int = 50, max_wait_ms: int = 200, most: int = 100) -> Column:
    """Whether a buffer should be flushed: quiet for the debounce, waited the longest, or full."""
    return (pending > 0) & ((since_last_ms >= debounce_ms) | (oldest_ms >= max_wait_ms) | (pending >= most))
