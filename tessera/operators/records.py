"""Record-level operators: statistics, merges, integrity, membership, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import with_place
from tessera.operators.traversal import closure, has_cycle

#: Weight of a source of relationships; others weigh .5.
SOURCE_WEIGHTS = {"FOLDER_STRUCTURE": 1.0, "MANUAL": 1.0, "LLM_EXTRACTION": 0.7, "NER_EXTRACTION": 0.6, "CO_OCCURRENCE": 0.4, "IMPORT": 0.8, "TIMELINE": 0.9, "NETWORK": 1.0}


def source_weight(source: Column) -> Column:
    w = F.lit(0.5)
    for name, value in SOURCE_WEIGHTS.items():
        w = F.when(source == name, F.lit(value)).otherwise(w)
    return w


def recalculate_confidence(provenance: DataFrame, key: str = "rel_id") -> DataFrame:
    """(key, confidence): mean of confidences weighted by source, 1 at most; relationships without provenance drop out."""
    w = source_weight(F.col("source"))
    return provenance.groupBy(key).agg(F.least(F.sum(F.col("confidence") * w) / F.sum(w), F.lit(1.0)).alias("confidence"))


def query_relationships(rels: DataFrame, *, source=None, target=None, either=None, types: list[str] | None = None, namespace: str | None = None, least: float | None = None, sources: list[str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filters that are given, by confidence descending, then a page."""
    tests = []
    if source is not None:
        tests.append(F.col("source_id") == F.lit(source))
    if target is not None:
        tests.append(F.col("target_id") == F.lit(target))
    if either is not None:
        tests.append((F.col("source_id") == F.lit(either)) | (F.col("target_id") == F.lit(either)))
    if types:
        tests.append(F.col("type").isin(types))
    if namespace is not None:
        tests.append(F.col("namespace") == namespace)
    if least is not None:
        tests.append(F.col("confidence") >= least)
    if sources:
        tests.append(F.arrays_overlap("provenance", F.array(*map(F.lit, sources))))
    for t in tests:
        rels = rels.where(t)
    out = rels.orderBy(F.desc("confidence"), "rel_id").offset(offset)
    return out.limit(limit) if limit is not None else out


def add_relationships(rels: DataFrame, new: DataFrame) -> DataFrame:
    """rels and new (source_id, target_id, type, namespace, provenance array<struct<source,confidence>>): equal keys are
    merged, provenance united, confidence worked out again."""
    key = ["source_id", "target_id", "type", "namespace"]
    every = rels.select(*key, "provenance").unionByName(new.select(*key, "provenance"))
    merged = every.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("provenance"))).alias("provenance"))
    weight = lambda p: source_weight(p["source"])
    total = F.aggregate("provenance", F.lit(0.0), lambda a, p: a + weight(p))
    conf = F.aggregate("provenance", F.lit(0.0), lambda a, p: a + p["confidence"] * weight(p))
    return merged.withColumn("confidence", F.when(total > 0, F.least(conf / total, F.lit(1.0)))).where("confidence is not null")


def merge_records(rows: DataFrame, key: list[str], counts: list[str], sets: list[str], firsts: list[str] = ()) -> DataFrame:
    """Rows of one key as one: counts added, arrays united, the first of other columns by value."""
    return rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counts], *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets], *[F.min(c).alias(c) for c in firsts])


def find_or_create(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities (name, kind, subtype, group_id, frequency, aliases) with those found merged in by key."""
    key = ["name", "kind", "subtype", "group_id"]
    return merge_records(entities.select(*key, "frequency", "aliases").unionByName(found.select(*key, "frequency", "aliases")), key, ["frequency"], ["aliases"])


def merge_entities(entities: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name, mention_count, aliases) merged by mapping (id, to): edges re-pointed, self edges dropped,
    parallel edges added, names of those merged kept as aliases."""
    m = mapping.select("id", F.col("to").alias("_to"))
    joined = entities.join(m, "id", "left")
    mapped = joined.withColumn("aliases", F.when(F.col("_to").isNotNull(), F.array_union("aliases", F.array("name"))).otherwise(F.col("aliases"))).withColumn("id", F.coalesce("_to", "id"))
    name = F.min(F.when(F.col("_to").isNull(), F.col("name")))
    out = mapped.groupBy("id").agg(F.coalesce(name, F.min("name")).alias("name"), F.sum("mention_count").alias("mention_count"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    s, t = m.toDF("source", "_s"), m.toDF("target", "_t")
    moved = edges.join(s, "source", "left").join(t, "target", "left").select(F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target"), "type", "weight")
    return out, moved.where(F.col("source") != F.col("target")).groupBy("source", "target", "type").agg(F.sum("weight").alias("weight"))


def map_scope(entities: DataFrame, known: DataFrame) -> DataFrame:
    """(id, to, created): entities (id, name, kind) mapped to those known by (name, kind); new ids where there is none."""
    k = known.groupBy(F.lower("name").alias("_n"), F.col("kind").alias("_k")).agg(F.min("id").alias("_id"))
    fresh = F.concat_ws(":", F.lower("kind"), F.regexp_replace(F.lower(F.trim("name")), " ", "_"))
    return entities.join(k, (F.lower("name") == F.col("_n")) & (F.col("kind") == F.col("_k")), "left").select("id", F.coalesce(F.col("_id").cast("string"), fresh).alias("to"), F.col("_id").isNull().alias("created"))


def integrity(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(issue, id): entities without mentions, edges with a missing end, mentions of missing entities."""
    ids = entities.select("id")
    lonely = ids.join(mentions.select(F.col("entity_id").alias("id")), "id", "left_anti").select(F.lit("orphan_entity").alias("issue"), F.col("id").cast("string").alias("id"))
    end = lambda c: edges.join(ids.withColumnRenamed("id", c), c, "left_anti").select(F.lit("dangling_edge").alias("issue"), F.col("edge_id").cast("string").alias("id"))
    lost = mentions.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti").select(F.lit("dangling_mention").alias("issue"), F.col("mention_id").cast("string").alias("id"))
    return lonely.unionByName(end("source")).unionByName(end("target")).unionByName(lost).distinct()


def repair(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what ``integrity`` finds."""
    ids = entities.select("id")
    kept = mentions.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")
    good = entities.join(kept.select(F.col("entity_id").alias("id")), "id", "left_semi")
    links = edges.join(good.select(F.col("id").alias("source")), "source", "left_semi").join(good.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)
    return good, links, kept


def metadata_layer(spans: DataFrame) -> DataFrame:
    """(entity_id, frequency, first_pos, docs, importance): importance is frequency over the largest."""
    per = spans.groupBy("entity_id").agg(F.count("*").alias("frequency"), F.min(F.struct("doc_id", "start")).alias("f"), F.countDistinct("doc_id").alias("docs"))
    return per.select("entity_id", "frequency", F.col("f.doc_id").alias("first_doc"), F.col("f.start").alias("first_pos"), "docs", (F.col("frequency") / F.max("frequency").over(Window.partitionBy())).alias("importance"))


def record_spans(log: DataFrame, docs: DataFrame, spans: DataFrame, around: int = 50) -> DataFrame:
    """The span log with the spans of re-scanned documents in place of their old ones, each with its context."""
    low = F.greatest(F.col("start") - around, F.lit(0))
    fresh = spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("context", F.substring("text", low + 1, F.col("end") + around - low)).drop("text")
    return log.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def entity_at(spans: DataFrame, doc, offset: int) -> DataFrame:
    return spans.where((F.col("doc_id") == F.lit(doc)) & (F.col("start") <= offset) & (F.col("end") > offset))


def enforce_uniqueness(refs: DataFrame) -> DataFrame:
    """refs (kind, target, entity_kind, scope_path, predicate, source_note_id, positions, last_seen_at) one a key: positions
    joined, the last sight kept."""
    t, scope = F.lower("target"), F.coalesce("scope_path", F.lit(""))
    key = (
        F.when(F.col("kind") == "entity", F.concat_ws(":", F.lit("entity"), F.coalesce("entity_kind", F.lit("UNKNOWN")), t, scope))
        .when(F.col("kind").isin("wikilink", "backlink"), F.concat_ws(":", "kind", t, scope))
        .when(F.col("kind").isin("tag", "mention"), F.concat_ws(":", "kind", t))
        .when(F.col("kind") == "triple", F.concat_ws(":", F.lit("triple"), "target", F.coalesce("predicate", F.lit(""))))
        .when(F.col("kind") == "temporal", F.concat_ws(":", F.lit("temporal"), "target", "source_note_id", F.coalesce(F.get("positions", F.lit(0)), F.lit(0)).cast("string")))
        .otherwise(F.concat_ws(":", "kind", "target", "source_note_id"))
    )
    return refs.withColumn("key", key).groupBy("key").agg(F.min("kind").alias("kind"), F.min("target").alias("target"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("last_seen_at").alias("last_seen_at"))


#: Predicates allowed by kind of entity; kinds not named allow all.
PREDICATE_RULES = {
    "CHARACTER": ["KNOWS", "LOVES", "HATES", "ALLIED_WITH", "ENEMY_OF", "PARENT_OF", "CHILD_OF", "MEMBER_OF", "LOCATED_IN", "OWNS"],
    "LOCATION": ["CONTAINS", "PART_OF", "NEAR", "CONNECTED_TO"], "FACTION": ["ALLIED_WITH", "ENEMY_OF", "CONTAINS", "LOCATED_IN"],
    "ITEM": ["OWNED_BY", "LOCATED_IN", "PART_OF"], "EVENT": ["PRECEDES", "CAUSES", "LOCATED_IN", "INVOLVES"],
}


def predicate_allowed(kind: Column, predicate: Column) -> Column:
    test = F.lit(True)
    for k, allowed in PREDICATE_RULES.items():
        test = F.when(kind == k, predicate.isin(allowed)).otherwise(test)
    return test


def timeline(temporal: DataFrame, entities: DataFrame, radius: int = 200) -> DataFrame:
    """Temporal references (note_id, text, position, ts) with the entities (note_id, entity_id, position) within ``radius``
    characters: dated ones first, then by place.  The position is bucketed by the radius, so the range join is an equi join."""
    left = temporal.withColumn("_b", F.explode(F.array(*[F.floor(F.col("position") / radius) + d for d in (-1, 0, 1)])))
    right = entities.select("note_id", "entity_id", F.col("position").alias("e_pos"), F.floor(F.col("position") / radius).alias("_b"))
    near = left.join(right, ["note_id", "_b"]).where(F.abs(F.col("position") - F.col("e_pos")) <= radius).groupBy("note_id", "position", "text").agg(F.sort_array(F.collect_set("entity_id")).alias("entities"))
    return temporal.join(near, ["note_id", "position", "text"], "left").orderBy(F.asc_nulls_last("ts"), "note_id", "position")


def relationship_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples (subject, predicate, object)."""
    return triples.select(F.col("subject").alias("node")).union(triples.select("object")).distinct(), triples.select("subject", "predicate", "object").distinct()


def character_sheet(entity, relations: DataFrame, mentions: DataFrame, traits: DataFrame, temporal: DataFrame) -> dict[str, DataFrame]:
    """Parts of a sheet: relations both ways ('<-' before those that come in), appearances by note, traits, timeline, one row of counts."""
    e = F.lit(entity)
    out = relations.where(F.col("subject") == e).select(F.col("predicate").alias("relation"), F.col("object").alias("other"))
    into = relations.where(F.col("object") == e).select(F.concat(F.lit("← "), F.col("predicate")).alias("relation"), F.col("subject").alias("other"))
    both = out.unionByName(into).distinct()
    seen = mentions.where(F.col("entity_id") == e).groupBy("note_id").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    marks = traits.where((F.col("subject") == e) & (F.col("predicate") == "HAS_TRAIT")).select(F.col("object").alias("trait")).distinct()
    when = temporal.join(seen.select("note_id"), "note_id", "left_semi").orderBy("note_id", "position")
    counts = both.agg(F.count("*").alias("relations")).crossJoin(seen.agg(F.count("*").alias("notes"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions")))
    return {"relations": both, "appearances": seen, "traits": marks, "timeline": when, "stats": counts}


#: Parts into which the intervals that begin on a day are dealt, so that a full day is shared by tasks.
DAY_PARTS = 8


def _with_confidence(events: DataFrame) -> DataFrame:
    base = F.lit(0.5)
    for g, c in {"second": 0.95, "minute": 0.90, "hour": 0.85, "day": 0.80, "month": 0.70}.items():
        base = F.when(F.col("granularity") == g, c).otherwise(base)
    return events.withColumn("c", base)


def _seconds(c: str) -> Column:
    return F.col(c).cast("timestamp").cast("long")


def during_relations(events: DataFrame) -> DataFrame:
    """(source, target, type, confidence) of events (id, at, until, granularity): source lies inside target, x .85.

    The result may grow with the square of a day's events, so tasks are dealt
    by day and part of the outer intervals, in a number that does not follow
    the (small) size of what is moved.
    """
    rows = _with_confidence(events)
    day = lambda c: F.floor(_seconds(c) / 86_400)
    spark = events.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    outer = rows.where("until is not null").select("id", "at", "until", "c", F.explode(F.sequence(day("at"), day("until"))).alias("_d"), F.pmod(F.xxhash64("id"), F.lit(DAY_PARTS)).cast("int").alias("_p"))
    inner = rows.select(F.col("id").alias("i"), F.col("at").alias("i_at"), F.coalesce("until", "at").alias("i_until"), F.col("c").alias("i_c"), day("at").alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(DAY_PARTS - 1))).alias("_p"))
    both = outer.repartition(tasks, "_d", "_p").join(inner.repartition(tasks, "_d", "_p").hint("merge"), ["_d", "_p"])
    inside = both.where((F.col("i") != F.col("id")) & (F.col("i_at") >= F.col("at")) & (F.col("i_until") <= F.col("until")))
    return inside.select(F.col("i").alias("source"), F.col("id").alias("target"), F.lit("DURING").alias("type"), (F.least("c", "i_c") * 0.85).alias("confidence"))


def temporal_relations(events: DataFrame) -> DataFrame:
    """(source, target, type, confidence) of events (id, at, until, granularity): neighbours in time PRECEDE, or are
    CONCURRENT within a day (x .9); an interval inside another is DURING it (x .85)."""
    rows = _with_confidence(events)
    placed = with_place(rows.select("id", "at", "c"), "at", "id")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("id").alias("n"), F.col("at").alias("n_at"), F.col("c").alias("n_c"))
    follow = placed.join(after, "place")
    same = _seconds("n_at") - _seconds("at") <= 86_400
    pairs = follow.select(F.col("id").alias("source"), F.col("n").alias("target"), F.when(same, "CONCURRENT").otherwise("PRECEDES").alias("type"), (F.least("c", "n_c") * F.when(same, 0.9).otherwise(1.0)).alias("confidence"))
    return pairs.unionByName(during_relations(events))


def tree_relations(nodes: DataFrame) -> DataFrame:
    """(source, target, type): CONTAINS between parent and child of a folder tree (id, parent_id)."""
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"))


def attributes_as_record(attributes: DataFrame) -> DataFrame:
    """(entity_id, fields map): the long table as one map a row."""
    pairs = F.array_sort(F.collect_list(F.struct("field_name", "value")))
    return attributes.groupBy("entity_id").agg(F.map_from_entries(pairs).alias("fields"))


def set_fields(attributes: DataFrame, new: DataFrame) -> DataFrame:
    return attributes.join(new.select("entity_id", "field_name"), ["entity_id", "field_name"], "left_anti").unionByName(new)


def copy_attributes(attributes: DataFrame, source, target) -> DataFrame:
    """The table with the fields of one entity given to another, which keeps those it has."""
    have = attributes.where(F.col("entity_id") == F.lit(target)).select("field_name")
    copied = attributes.where(F.col("entity_id") == F.lit(source)).join(have, "field_name", "left_anti").withColumn("entity_id", F.lit(target).cast(attributes.schema["entity_id"].dataType))
    return attributes.unionByName(copied.select(*attributes.columns))


def find_by_field(attributes: DataFrame, name: str, value: str) -> DataFrame:
    return attributes.where((F.col("field_name") == name) & (F.col("value") == value)).select("entity_id").distinct()


def candidate_targets(entities: DataFrame, types: DataFrame, source_kind: str) -> DataFrame:
    """Entities whose kind some relationship type (source_kind, target_kind) allows as a target."""
    kinds = types.where((F.col("source_kind") == source_kind) | (F.col("source_kind") == "*")).select(F.col("target_kind").alias("kind"))
    return entities.join(kinds, "kind", "left_semi")


def mention_counters(counters: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, note_id, n): counters with new mentions added."""
    new = mentions.groupBy("entity_id", "note_id").agg(F.count("*").alias("n"))
    return counters.select("entity_id", "note_id", "n").unionByName(new).groupBy("entity_id", "note_id").agg(F.sum("n").alias("n"))


def induced_graph(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges among them); the first ``limit`` nodes by id."""
    kept = nodes.orderBy("id").limit(limit) if limit else nodes
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def validate_network(edges: DataFrame, members: DataFrame, most: dict[str, int] | None = None, acyclic: tuple[str, ...] = ()) -> DataFrame:
    """(issue, detail): self loops, repeated edges, nodes past a type's cardinality, cycles, ends that are no members."""
    loops = edges.where(F.col("source") == F.col("target")).select(F.lit("self_loop").alias("issue"), F.col("source").cast("string").alias("detail"))
    twice = edges.groupBy("source", "target", "type").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("issue"), F.concat_ws("->", "source", "target").alias("detail"))
    out = loops.unionByName(twice)
    for kind, n in (most or {}).items():
        full = edges.where(F.col("type") == kind).groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > n)
        out = out.unionByName(full.select(F.lit("cardinality").alias("issue"), F.col("source").cast("string").alias("detail")))
    for kind in acyclic:
        cyc = has_cycle(edges.where((F.col("type") == kind) & (F.col("source") != F.col("target"))))
        out = out.unionByName(cyc.select(F.lit("cycle").alias("issue"), F.col("node").cast("string").alias("detail")))
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    lost = ends.join(members.select(F.col("entity_id").alias("node")), "node", "left_anti")
    return out.unionByName(lost.select(F.lit("not_member").alias("issue"), F.col("node").cast("string").alias("detail")))


def folders_due_network(children: DataFrame, least: int = 3, child_kind: str | None = None) -> DataFrame:
    """(parent_id, n): folders with ``least`` children or more of a kind."""
    rows = children if child_kind is None else children.where(F.col("kind") == child_kind)
    return rows.groupBy("parent_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def network_stats(members: DataFrame, edges: DataFrame, network: str = "network_id") -> DataFrame:
    """(network, members, relationships, max_depth): the depth is that of the longest chain found by closure."""
    m = members.groupBy(network).agg(F.countDistinct("entity_id").alias("members"))
    r = edges.groupBy(network).agg(F.count("*").alias("relationships"))
    deep = closure(edges.select("source", "target")).groupBy("ancestor").agg(F.max("depth").alias("d"))
    d = members.join(deep, members.entity_id == deep.ancestor).groupBy(network).agg(F.max("d").alias("max_depth"))
    return m.join(r, network, "left").join(d, network, "left").fillna(0)


def ranking_quality(results: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, ndcg, average_precision) of results (query_id, doc_id, rank) against judged (query_id, doc_id, rel)."""
    hits = results.where(F.col("rank") <= k).join(judged, ["query_id", "doc_id"], "left").fillna(0, ["rel"])
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("good", (F.col("rel") > 0).cast("int")).withColumn("seen", F.sum("good").over(order))
    got = hits.groupBy("query_id").agg((F.sum("good") / k).alias("precision"), F.sum(gain).alias("dcg"), F.sum(F.when(F.col("good") == 1, F.col("seen") / F.col("rank"))).alias("ap"))
    best = judged.where("rel > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain)).alias("idcg"), F.count("*").alias("relevant"))
    out = got.join(ideal, "query_id", "left")
    return out.select("query_id", "precision", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), F.when(F.col("relevant") > 0, F.coalesce("ap", F.lit(0.0)) / F.least("relevant", F.lit(k))).otherwise(0.0).alias("average_precision"))


def find_matching_event(names: DataFrame, events: DataFrame) -> DataFrame:
    """(text, event_id): the least event whose name lies in the text or around it.  Events are a dimension: they are broadcast under Spark's own size check."""
    hit = F.contains(F.lower("text"), F.lower("name")) | F.contains(F.lower("name"), F.lower("text"))
    return names.join(events, hit, "left").groupBy("text").agg(F.min("event_id").alias("event_id"))
