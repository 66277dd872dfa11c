"""As-of reads, snapshots, diffs, histories and timelines over rows with validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_at(rows: DataFrame, at, start: str = "valid_at", end: str = "invalid_at") -> DataFrame:
    """Rows valid at a moment: start <= at < end, an open end being valid on."""
    moment = F.lit(at).cast("timestamp") if isinstance(at, str) else F.lit(at)
    return rows.where((F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment)))


def in_range(rows: DataFrame, low, high, column: str = "valid_at") -> DataFrame:
    return rows.where(F.col(column).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))


def snapshot(entities: DataFrame, edges: DataFrame, at, least_weight: float = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, one row of counts) at a moment."""
    e = active_at(entities, at)
    links = active_at(edges, at).where(F.col("weight") >= least_weight)
    counts = e.agg(F.count("*").alias("entity_count")).crossJoin(links.agg(F.count("*").alias("edge_count")))
    return e, links, counts


def diff(before: DataFrame, after: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """key..., change (added, removed, modified), and the compared columns of both sides; equal rows are left out."""
    a = before.select(*key, F.struct(*compare).alias("was"))
    b = after.select(*key, F.struct(*compare).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change is not null").select(*key, "change", "was", "now")


def edge_history(events: DataFrame, key: list[str], at: str = "at", weight: str = "weight", invalid: str = "invalid_at") -> DataFrame:
    """Each moment of an edge: created, strengthened, weakened, unchanged, or invalidated where it ends."""
    order = Window.partitionBy(*key).orderBy(at)
    before = F.lag(weight).over(order)
    kind = F.when(F.col(invalid).isNotNull(), "invalidated").when(before.isNull(), "created").when(F.col(weight) > before, "strengthened").when(F.col(weight) < before, "weakened").otherwise("unchanged")
    return events.select(*key, at, weight, before.alias("previous"), kind.alias("change"))


def entity_history(mentions: DataFrame, entity: str = "entity_id", at: str = "valid_at") -> DataFrame:
    """(entity, at, mentions, total, gap): state at each mention moment and how it differs from the last."""
    per = mentions.groupBy(entity, at).agg(F.count("*").alias("mentions"))
    order = Window.partitionBy(entity).orderBy(at)
    return per.select(entity, at, "mentions", F.sum("mentions").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), (F.col("mentions") - F.coalesce(F.lag("mentions").over(order), F.lit(0))).alias("delta"))


def provenance(mentions: DataFrame, episodes: DataFrame, notes: DataFrame, entity, limit: int = 50) -> DataFrame:
    """The first ``limit`` mentions of an entity with their episode and note, by time."""
    return mentions.where(F.col("entity_id") == F.lit(entity)).join(episodes, "episode_id").join(notes, "note_id").orderBy("valid_at", "episode_id").limit(limit)


def narrative_timeline(entities: DataFrame, notes: DataFrame, points: DataFrame, participants: DataFrame, kinds: list[str]) -> DataFrame:
    """Entities of given kinds with their note, their last temporal point, and participants' names.

    points (entity_id, seq, ...): the row with the largest seq wins;
    participants (event_id, entity_id) are resolved through entities (id, name).
    """
    rest = [c for c in points.columns if c not in ("entity_id", "seq")]
    last = points.groupBy("entity_id").agg(F.max_by(F.struct(*rest), "seq").alias("point"))
    named = participants.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("event_id").agg(F.sort_array(F.collect_set("name")).alias("participants"))
    return (
        entities.where(F.col("kind").isin(kinds)).join(notes, "note_id")
        .join(last, F.col("id") == F.col("entity_id"), "left").drop("entity_id")
        .join(named, F.col("id") == F.col("event_id"), "left").drop("event_id")
    )


def comparable_time() -> Column:
    """Sort key of a point: its timestamp in ms; else chapter * 1e6 + act * 1e3 + sequence; else ``reference_ms``
    (0 if unknown) plus day and hour offsets; abstract points last."""
    offset = F.coalesce(F.col("offset_days"), F.lit(0)) * 86_400_000 + F.coalesce(F.col("offset_hours"), F.lit(0)) * 3_600_000
    order = F.coalesce("chapter", F.lit(0)) * 1_000_000 + F.coalesce("act", F.lit(0)) * 1_000 + F.coalesce("sequence", F.lit(0))
    return (
        F.when(F.col("timestamp_ms").isNotNull(), F.col("timestamp_ms").cast("double"))
        .when(F.col("kind") == "sequential", order.cast("double"))
        .when(F.col("kind") == "relative", (F.coalesce("reference_ms", F.lit(0)) + offset).cast("double"))
        .otherwise(F.lit(float("inf")))
    )


def story_timeline(points: DataFrame) -> DataFrame:
    """Points (id, reference_id, ...) with their sort key and place; a relative one looks its reference up."""
    refs = points.select(F.col("id").alias("reference_id"), F.col("timestamp_ms").alias("reference_ms"))
    keyed = points.join(refs, "reference_id", "left")
    keyed = keyed.withColumn("sort_key", comparable_time())
    return keyed.withColumn("place", F.row_number().over(Window.orderBy("sort_key", "id")))


def timeline_order(events: DataFrame) -> DataFrame:
    """Scenes and events by chapter * 10000 + scene * 100 + sequence."""
    key = F.col("chapter") * 10_000 + F.col("scene") * 100 + F.coalesce("sequence", F.lit(0))
    return events.where(F.col("kind").isin("SCENE", "EVENT")).withColumn("timeline_key", key).orderBy("timeline_key", "id")


def relative_events(events: DataFrame, reference) -> DataFrame:
    return events.where(F.col("reference_id") == F.lit(reference)).orderBy("id")


def query_timeline(events: DataFrame, kinds: list[str] | None = None, low=None, high=None, sort: str = "temporal", group: str | None = None) -> DataFrame:
    """Filter by kind and time; sort temporal, narrative, importance or creation; with a group key column."""
    rows = events
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    if low is not None:
        rows = rows.where(F.col("at") >= F.lit(low).cast("timestamp"))
    if high is not None:
        rows = rows.where(F.col("at") <= F.lit(high).cast("timestamp"))
    keys = {"temporal": [F.asc_nulls_last("at")], "narrative": [F.asc_nulls_last("sequence")], "importance": [F.desc_nulls_last("importance")], "creation": [F.asc_nulls_last("created_at")]}[sort]
    if group:
        rows = rows.withColumn("group_key", F.date_format("at", {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[group]) if group in ("day", "month", "year") else F.col(group).cast("string"))
    return rows.orderBy(*keys, "id")


def era_timeline(mentions: DataFrame) -> DataFrame:
    """Era mentions by era and year."""
    return mentions.where("kind = 'ERA'").orderBy("era_name", "era_year", "id")


def entity_timeline(participants: DataFrame, events: DataFrame, entity, low: int | None = None, high: int | None = None) -> DataFrame:
    rows = participants.where(F.col("entity_id") == F.lit(entity)).join(events, "event_id")
    if low is not None:
        rows = rows.where(F.col("year") >= low)
    if high is not None:
        rows = rows.where(F.col("year") <= high)
    return rows.orderBy("year", "month", "day", "event_id")


def entities_in_range(participants: DataFrame, events: DataFrame, low, high, limit: int = 100, at: str = "at") -> DataFrame:
    """(entity_id, n): entities with most events in a range."""
    return in_range(events, low, high, at).join(participants, "event_id").groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(limit)


def genesis(spark, units: list[tuple[str, int]], group: str) -> tuple[DataFrame, DataFrame]:
    """(time units, next-edges): the edges run in a circle, the last unit leading to the first."""
    rows = spark.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("days")) for n, d in units])).alias("idx", "u"))
    table = rows.select(F.concat(F.lit(f"{group}:"), F.col("idx").cast("string")).alias("id"), "u.name", F.lower("u.name").alias("normalized_name"), F.substring("u.name", 1, 3).alias("short_name"), "idx", F.col("u.days").alias("days_in_unit"))
    n = len(units)
    edges = table.select(F.col("id").alias("source"), F.concat(F.lit(f"{group}:"), ((F.col("idx") + 1) % n).cast("string")).alias("target"), F.lit("NEXT").alias("type"))
    return table, edges


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], forward: bool = False) -> DataFrame:
    """Each left row with the values of the nearest right row at or before it (``forward``: at or after), by key.

    One sort of both sides together and a window that carries the last value:
    no row is joined with more than one other.  Of right rows at one moment the
    least values win.
    """
    side = right.groupBy(*by, F.col(right_at).alias("_at")).agg(F.min(F.struct(*values)).alias("_v")).select(*by, "_at", "_v", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), F.lit(0).alias("_side"))
    rows = left.select(*by, F.col(left_at).alias("_at"), F.lit(None).cast(side.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"))
    moment = F.desc("_at") if forward else F.asc("_at")
    order = Window.partitionBy(*by).orderBy(moment, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return side.unionByName(rows).withColumn("_hit", F.last("_v", ignorenulls=True).over(order)).where("_side = 1").select("_row.*", *[F.col("_hit")[v].alias(v) for v in values])
