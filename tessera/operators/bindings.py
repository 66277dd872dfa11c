"""Field bindings: values that mirror, inherit or aggregate those of other entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import transforms as X

KINDS = ("mirror", "inherit", "aggregate")


def resolve(attributes: DataFrame, bindings: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(entity_id, field_name, value, origin): override, else mirrored or inherited, else aggregated, else direct.

    attributes (entity_id, field_name, value); bindings (source_entity_id,
    source_field_name, target_entity_id, target_field_name, binding_type,
    transform, aggregation_fn, allow_override): the source field takes its
    value from the target.  links (entity_id, linked_id) name the entities an
    aggregate reads, ``target_field_name`` of each.
    """
    own = attributes.select("entity_id", "field_name", "value")
    b = bindings.select(
        F.col("source_entity_id").alias("entity_id"), F.col("source_field_name").alias("field_name"),
        F.col("target_entity_id").alias("t_entity"), F.col("target_field_name").alias("t_field"), "binding_type", "transform", "aggregation_fn", "allow_override")
    target = own.select(F.col("entity_id").alias("t_entity"), F.col("field_name").alias("t_field"), F.col("value").alias("t_value"))
    specs = [r[0] for r in bindings.where("transform is not null").select("transform").distinct().collect()]
    changed = F.col("t_value")
    for spec in specs:
        changed = F.when(F.col("transform") == spec, X.apply_chain(F.col("t_value"), spec)).otherwise(changed)
    bound = b.where(F.col("binding_type").isin("mirror", "inherit")).join(target, ["t_entity", "t_field"], "left").select("entity_id", "field_name", "allow_override", changed.alias("bound"), F.lit("bound").alias("origin"))
    if links is not None:
        gathered = aggregate_values(own, b.where("binding_type = 'aggregate'"), links)
        bound = bound.unionByName(gathered)
    out = own.join(bound, ["entity_id", "field_name"], "full_outer")
    overridden = F.col("value").isNotNull() & F.coalesce("allow_override", F.lit(False))
    return out.select(
        "entity_id", "field_name", F.when(overridden | F.col("origin").isNull(), F.col("value")).otherwise(F.col("bound")).alias("value"),
        F.when(F.col("origin").isNull(), "direct").when(overridden, "override").otherwise(F.col("origin")).alias("origin"))


def aggregate_values(attributes: DataFrame, bindings: DataFrame, links: DataFrame) -> DataFrame:
    """Aggregate bindings over linked entities, optionally of one relationship (links.type = bindings.relationship)."""
    linked = bindings.join(links, "entity_id")
    if "relationship" in bindings.columns and "type" in links.columns:
        linked = linked.where(F.col("relationship").isNull() | (F.col("relationship") == F.col("type")))
    values = attributes.select(F.col("entity_id").alias("linked_id"), F.col("field_name").alias("t_field"), "value")
    rows = linked.join(values, ["linked_id", "t_field"], "left")
    v = F.col("value")
    every = rows.groupBy("entity_id", "field_name", "allow_override", "aggregation_fn").agg(*[fn(v).cast("string").alias(n) for n, fn in X.AGGREGATIONS.items()], X.agg_concat(v, F.col("linked_id")).alias("concat"))
    pick = F.lit(None).cast("string")
    for n in (*X.AGGREGATIONS, "concat"):
        pick = F.when(F.col("aggregation_fn") == n, F.col(n)).otherwise(pick)
    return every.select("entity_id", "field_name", "allow_override", pick.alias("bound"), F.lit("aggregate").alias("origin"))


def validate_binding(bindings: DataFrame, source: tuple, target: tuple, depth: int | None = None) -> str | None:
    """Why a binding (entity, field) -> (entity, field) can't be made, or None: it binds itself, the field is bound, or it closes a cycle."""
    if source == target:
        return "a field cannot be bound to itself"
    taken = bindings.where((F.col("source_entity_id") == F.lit(source[0])) & (F.col("source_field_name") == F.lit(source[1])))
    if not taken.isEmpty():
        return "the field is bound already"
    from tessera.operators.traversal import would_cycle

    name = lambda e, f: F.concat_ws("\x00", F.col(e).cast("string"), F.col(f))
    edges = bindings.select(name("source_entity_id", "source_field_name").alias("source"), name("target_entity_id", "target_field_name").alias("target"))
    return "the binding closes a cycle" if would_cycle(edges, "\x00".join(map(str, source)), "\x00".join(map(str, target)), depth) else None


def notify_change(changes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(entity_id, field_name, value): direct dependents of changed fields (entity_id, field_name, value), one hop on."""
    c = changes.select(F.col("entity_id").alias("target_entity_id"), F.col("field_name").alias("target_field_name"), "value")
    return c.join(bindings, ["target_entity_id", "target_field_name"]).select(F.col("source_entity_id").alias("entity_id"), F.col("source_field_name").alias("field_name"), "value")


#: Confidence of a schema rule's match: equal code, equal label, code within, keyword.
MATCH_CONFIDENCE = {"code": 1.0, "label": 0.95, "substring": 0.8, "keyword": 0.75}


def match_schemas(relationships: DataFrame, rules: DataFrame, least: float = 0.5) -> DataFrame:
    """(rel_id, schema_id, confidence): the best rule of each schema for each relationship type.

    relationships (rel_id, type); rules (schema_id, code, label, keywords array).
    """
    t, code, label = F.lower("type"), F.lower("code"), F.lower("label")
    keyword = F.exists("keywords", lambda k: F.contains(t, F.lower(k)))
    m = MATCH_CONFIDENCE
    score = F.when(t == code, m["code"]).when(t == label, m["label"]).when(F.contains(t, code) | F.contains(code, t), m["substring"]).when(keyword, m["keyword"]).otherwise(0.0)
    from tessera.operators.traversal import small

    kinds = relationships.select("type").distinct().crossJoin(F.broadcast(rules)).groupBy("type", "schema_id").agg(F.max(score).alias("confidence")).where(F.col("confidence") > least)
    return relationships.join(small(kinds), "type").select("rel_id", "schema_id", "confidence")


def enrol(relationships: DataFrame, rules: DataFrame, networks: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(memberships, counts) of relationships enrolled in bulk.

    relationships (rel_id, type); rules as in match_schemas; networks
    (network_id, schema_id).  A membership (rel_id, network_id, schema_id,
    confidence) joins a relationship with every network of a schema it matches;
    counts is one row (enrolled, skipped) of relationships with a membership and without.
    """
    from tessera.operators.traversal import small

    types = relationships.select(F.col("type").alias("rel_id"), "type").distinct()
    places = small(match_schemas(types, rules, least).join(networks.select("network_id", "schema_id"), "schema_id").withColumnRenamed("rel_id", "type"))
    members = relationships.select("rel_id", "type").join(places, "type").select("rel_id", "network_id", "schema_id", "confidence")
    counted = relationships.groupBy("type").agg(F.count("*").alias("n")).join(places.select("type").distinct().withColumn("_in", F.lit(1)), "type", "left")
    marked = counted.agg(F.coalesce(F.sum(F.when(F.col("_in") == 1, F.col("n"))), F.lit(0)).alias("enrolled"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return members, marked.select("enrolled", (F.col("total") - F.col("enrolled")).alias("skipped"))
