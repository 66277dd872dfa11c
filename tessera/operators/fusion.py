"""Fusion and re-ranking of result lists (modality, id, score, title)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a modality in a weighted fusion; others weigh OTHER.
WEIGHTS = {"vector": 0.4, "fts": 0.3, "graph": 0.2, "entity": 0.3, "history": 0.2, "path": 0.3, "community": 0.1}
OTHER = 0.1


def _weight(weights: dict[str, float], column: str = "modality") -> Column:
    w = F.lit(OTHER)
    for name, value in weights.items():
        w = F.when(F.col(column) == name, F.lit(float(value))).otherwise(w)
    return w


def weighted_fusion(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores over their modality's largest, weighted and summed."""
    most = F.max("score").over(Window.partitionBy("modality"))
    scaled = results.withColumn("s", F.when(most > 0, F.col("score") / most).otherwise(1.0) * _weight(weights or WEIGHTS))
    return scaled.groupBy("id").agg(F.sum("s").alias("score"), F.count("*").alias("sources"))


def ranked(results: DataFrame) -> DataFrame:
    order = Window.partitionBy("modality").orderBy(F.desc("score"), "id")
    return results.withColumn("rank", F.row_number().over(order))


def ranked_fusion(results: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion, ranks from 1."""
    return ranked(results).groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def intersect_fusion(results: DataFrame, least: int = 2) -> DataFrame:
    """Ids of ``least`` modalities or more; most modalities first, then the sum of scores."""
    return results.groupBy("id").agg(F.countDistinct("modality").alias("sources"), F.sum("score").alias("score")).where(F.col("sources") >= least)


def union_fusion(results: DataFrame, order: list[str]) -> DataFrame:
    """Modalities folded in the given order: the first score, then 1.2 times the larger of the score so far and the next."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("modality"))
    scores = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "score"))), lambda x: x["score"])
    fold = F.aggregate(F.slice(scores, 2, 1 << 20), scores[0], lambda a, s: F.greatest(a, s) * 1.2)
    return results.groupBy("id").agg(fold.alias("score"))


def context_boost(score: Column, context: Column, recency: Column, popularity: Column) -> Column:
    return score * (1 + 0.3 * F.coalesce(context, F.lit(0.0))) * (1 + 0.2 * F.coalesce(recency, F.lit(0.0))) * (1 + 0.5 * F.coalesce(popularity, F.lit(0.0)))


def diversify(results: DataFrame, title: str = "title", most: int = 2) -> DataFrame:
    """At most ``most`` results a title, compared trimmed and lower-cased."""
    order = Window.partitionBy(F.lower(F.trim(F.col(title)))).orderBy(F.desc("score"), "id")
    return results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def rerank_vector_graph(results: DataFrame, k: int = 60, vector_weight: float = 0.7, graph_weight: float = 0.3) -> DataFrame:
    """id, similarity, distance: ranks by similarity and by graph distance (999 if none), fused."""
    far = F.coalesce("distance", F.lit(999.0))
    by_vector = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))
    by_graph = F.row_number().over(Window.orderBy(far, "id"))
    return results.withColumn("score", vector_weight / (k + by_vector) + graph_weight / (k + by_graph))


def min_max(score: str, partition: list[str] = ()) -> Column:
    """0..1 between the least and most; 1 if all are equal."""
    w = Window.partitionBy(*partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def floor_min_max(score: str) -> Column:
    """0..1 with the range floored at .001, so equal scores give 0."""
    w = Window.partitionBy()
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (F.col(score) - low) / F.greatest(high - low, F.lit(0.001))


def hybrid_max_fusion(vector: DataFrame, lexical: DataFrame, k: int, vector_weight: float = 0.5, key: str = "id") -> DataFrame:
    """Both sides over their own largest score, mixed; missing is 0."""
    side = lambda df, name: df.select(key, F.when(F.max("score").over(Window.partitionBy()) > 0, F.col("score") / F.max("score").over(Window.partitionBy())).otherwise(0.0).alias(name))
    both = side(vector, "v").join(side(lexical, "l"), key, "full_outer")
    mixed = F.coalesce("v", F.lit(0.0)) * vector_weight + F.coalesce("l", F.lit(0.0)) * (1 - vector_weight)
    return both.withColumn("score", mixed).orderBy(F.desc(F.round("score", 9)), key).limit(k)


def graph_signals(candidates: DataFrame, edges: DataFrame, centrality: DataFrame) -> DataFrame:
    """id, degree, centrality, avg_weight, reach, avg_path_weight, candidate_links, temporal, causal for every candidate.

    edges (source, target, weight, kind) are read in both directions; reach is
    the distinct nodes within two hops.
    """
    both = edges.select("source", "target", "weight", "kind").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight", "kind"))
    ids = candidates.select("id").distinct()
    near = both.join(ids, F.col("source") == F.col("id"), "left_semi")
    linked = near.join(ids.select(F.col("id").alias("target"), F.lit(1).alias("in_set")), "target", "left")
    own = linked.groupBy(F.col("source").alias("id")).agg(
        F.countDistinct("target").alias("degree"), F.avg("weight").alias("avg_weight"),
        F.countDistinct(F.when(F.col("in_set") == 1, F.col("target"))).alias("candidate_links"),
        F.count(F.when(F.col("kind") == "temporal", 1)).alias("temporal"), F.count(F.when(F.col("kind") == "causal", 1)).alias("causal"))
    hop1 = near.select(F.col("source").alias("id"), F.col("target").alias("n"), F.col("weight").alias("w"))
    hop2 = hop1.join(both.select(F.col("source").alias("n"), F.col("target").alias("m"), F.col("weight").alias("w2")), "n").where(F.col("m") != F.col("id")).select("id", F.col("m").alias("n"), (F.col("w") * F.col("w2")).alias("w"))
    reach = hop1.unionByName(hop2).groupBy("id").agg(F.countDistinct("n").alias("reach"), F.avg("w").alias("avg_path_weight"))
    out = ids.join(own, "id", "left").join(reach, "id", "left").join(centrality.select("id", "centrality"), "id", "left")
    return out.fillna(0)


def graph_relevance() -> Column:
    """Weighted mean of the signals; degree and links are capped at 20 and 10."""
    cap = lambda c, n: F.least(F.col(c) / n, F.lit(1.0))
    return (
        0.15 * cap("degree", 20) + 0.25 * F.col("centrality") + 0.2 * F.col("avg_weight") + 0.15 * F.col("avg_path_weight")
        + 0.15 * cap("candidate_links", 10) + 0.05 * F.least(F.col("temporal"), F.lit(1)) + 0.05 * F.least(F.col("causal"), F.lit(1))
    )


#: Weights of lexical, vector and graph scores by intent.
PRESETS = {"semantic": (0.1, 0.7, 0.2), "relational": (0.2, 0.2, 0.6), "balanced": (0.2, 0.4, 0.4), "contextual": (0.2, 0.5, 0.3)}


def fuse_signals(lexical: DataFrame, vector: DataFrame, graph: DataFrame, preset: str = "balanced") -> DataFrame:
    """Three (id, score) lists, each min-max scaled with a floored range, weighted and summed."""
    wl, wv, wg = PRESETS[preset]
    scaled = [df.select("id", floor_min_max("score").alias(n)) for df, n in ((lexical, "l"), (vector, "v"), (graph, "g"))]
    both = scaled[0].join(scaled[1], "id", "full_outer").join(scaled[2], "id", "left").fillna(0.0, ["l", "v", "g"])
    return both.withColumn("score", wl * F.col("l") + wv * F.col("v") + wg * F.col("g"))


def propagate(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of the best max(3, 20 %) results gain .15 times the edge weight (.1 without one), up to 1.

    Results are ranked before the anchors are taken.
    """
    n = F.count("*").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.round("score", 9)), "id")
    marked = results.withColumn("anchor", F.row_number().over(order) <= F.greatest(F.lit(3), F.ceil(n * 0.2)))
    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    gain = both.join(marked.where("anchor").select(F.col("id").alias("source")), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.coalesce(F.col("weight") * 0.15, F.lit(0.1))).alias("gain"))
    return marked.join(gain, "id", "left").withColumn("score", F.least(F.col("score") + F.coalesce("gain", F.lit(0.0)), F.lit(1.0))).drop("gain", "anchor")


#: Patterns of each intent, tried in this order; the first that matches names the intent.
INTENTS = [
    ("entity_lookup", [
        r"^(who|what) (?:is|are) (?:the )?(.+?)[\?\.]*$",
        r"^define (.+?)[\?\.]*$",
        r"^(get|show|find) (?:me )?(?:the )?(?:entity|character|person|thing) (.+?)[\?\.]*$",
    ]),
    ("relationship", [
        r"(?:how|what) (?:is|are) (.+?) (?:related|connected|linked) (?:to|with) (.+?)[\?\.]*$",
        r"(?:relationship|connection|link) between (.+?) and (.+?)[\?\.]*$",
        r"(.+?) (?:and|vs|versus) (.+?) relationship[\?\.]*$",
    ]),
    ("path_finding", [
        r"path (?:from|between) (.+?) (?:to|and) (.+?)[\?\.]*$",
        r"(?:how|what) connects (.+?) (?:to|and|with) (.+?)[\?\.]*$",
        r"shortest (?:path|route|connection) (?:from|between) (.+?) (?:to|and) (.+?)[\?\.]*$",
    ]),
    ("neighborhood", [
        r"(?:what's|what is) (?:around|near|connected to) (.+?)[\?\.]*$",
        r"(?:show|find|get) (?:everything|all|things) (?:connected|related|linked) to (.+?)[\?\.]*$",
        r"(.+?)(?:'s| is) (?:connections|neighbors|network)[\?\.]*$",
    ]),
    ("evolution", [
        r"(?:how|what) (?:has|have) (.+?) (?:changed|evolved|developed|progressed)[\?\.]*$",
        r"(?:evolution|change|development|progression) of (.+?)[\?\.]*$",
        r"(.+?) over time[\?\.]*$",
    ]),
    ("timeline", [
        r"(?:history|timeline|chronology) of (.+?)[\?\.]*$",
        r"(?:show|give|get) (?:me )?(?:the )?(?:complete )?(?:history|timeline) (?:of|for) (.+?)[\?\.]*$",
    ]),
    ("snapshot", [
        r"(.+?) (?:at|in|during) (.+?)[\?\.]*$",
        r"(?:how|what) (?:was|were) (.+?) (?:at|in|during) (.+?)[\?\.]*$",
    ]),
    ("semantic", [
        r"(?:similar|like|related) (?:to|as) (.+?)[\?\.]*$",
        r"(?:themes|topics|concepts) (?:in|about|related to) (.+?)[\?\.]*$",
        r"(?:find|show) (?:notes|entities|things) (?:similar|like|related) to (.+?)[\?\.]*$",
    ]),
    ("conceptual", [
        r"(?:explain|describe|what is|what are) (?:the concept of )?(.+?)[\?\.]*$",
        r"(?:meaning|definition) of (.+?)[\?\.]*$",
    ]),
    ("community", [
        r"(?:groups|clusters|communities|categories) (?:of|in|within) (.+?)[\?\.]*$",
        r"(?:find|detect|identify) (?:groups|clusters|communities) (?:in|of|within) (.+?)[\?\.]*$",
        r"(?:what|which) (?:groups|clusters|categories) (?:contain|include|have) (.+?)[\?\.]*$",
    ]),
    ("comparison", [
        r"(?:compare|contrast|difference between) (.+?) (?:and|vs|versus|with) (.+?)[\?\.]*$",
        r"(.+?) (?:vs|versus) (.+?)[\?\.]*$",
        r"(?:similarities|differences) between (.+?) and (.+?)[\?\.]*$",
    ]),
    ("aggregation", [
        r"(?:all|every|everything) (?:about|related to|concerning) (.+?)[\?\.]*$",
        r"(?:list|show|find) (?:all|every) (.+?)[\?\.]*$",
    ]),
    ("exploratory", [
        r"(?:tell me|explain) (?:about|everything about) (.+?)[\?\.]*$",
        r"(?:what|tell me) (?:can you|should I|do I need to) (?:know|understand) about (.+?)[\?\.]*$",
    ]),
    ("discovery", [
        r"(?:what's|what is) (?:interesting|notable|important|significant) (?:about|in) (.+?)[\?\.]*$",
        r"(?:discover|explore|investigate) (.+?)[\?\.]*$",
    ]),
]

#: The fusion of each intent and its modalities in order of priority, with the results or hops each may take.
PLANS = {
    "entity_lookup": ("ranked", [("fts", {"results": 5}), ("entity", {}), ("graph", {"hops": 1})]),
    "relationship": ("weighted", [("path", {}), ("graph", {"hops": 2}), ("vector", {"expand": True})]),
    "path_finding": ("ranked", [("path", {}), ("graph", {"hops": 3})]),
    "neighborhood": ("ranked", [("fts", {"results": 1}), ("graph", {"hops": 2})]),
    "evolution": ("weighted", [("history", {}), ("vector", {"results": 10}), ("graph", {"hops": 1})]),
    "timeline": ("ranked", [("history", {}), ("fts", {"results": 20})]),
    "snapshot": ("ranked", [("history", {}), ("entity", {})]),
    "semantic": ("weighted", [("vector", {"results": 15, "expand": True}), ("graph", {"hops": 2})]),
    "conceptual": ("union", [("vector", {"results": 10}), ("fts", {"results": 5}), ("entity", {})]),
    "community": ("ranked", [("community", {}), ("graph", {"hops": 3})]),
    "comparison": ("weighted", [("entity", {}), ("path", {}), ("vector", {"results": 10}), ("graph", {"hops": 2})]),
    "aggregation": ("union", [("vector", {"results": 30}), ("fts", {"results": 20}), ("graph", {"hops": 2})]),
    "exploratory": ("weighted", [("vector", {"results": 15, "expand": True}), ("entity", {}), ("graph", {"hops": 2}), ("fts", {"results": 10})]),
    "discovery": ("weighted", [("vector", {"results": 20}), ("community", {}), ("graph", {"hops": 3})]),
}
#: What makes a query one of time or of comparison, and capitalised words that name nothing.
OF_TIME = r"(?:changed|evolved|history|timeline|over time|at|during|in \d{4})"
OF_COMPARISON = r"(?:compare|contrast|vs|versus|difference|similar|like)"
NO_NAMES = {"The", "A", "An", "This", "That", "These", "Those", "I", "You", "What", "How", "Why"}
#: Modalities that start from the names in the query, and how many they need.
NEEDS_NAMES = {"graph": 1, "history": 1, "entity": 1, "path": 2}


def query_names(text: str) -> list[str]:
    """Quoted phrases, then runs of capitalised words, each once."""
    quoted = re.findall(r'"([^"]+)"', text)
    capitals = [w for w in re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text, re.ASCII) if w not in NO_NAMES]
    return list(dict.fromkeys([*quoted, *capitals]))


def classify_query(text: str) -> dict:
    """intent, strategy, modalities (type, priority, params), confidence, names and the other intents matched.

    Without a match a query explores, with confidence 0.85; one match gives
    0.95, several 0.75.  A query of time looks at the history first; a complex
    one (two of: several names, time, comparison with time; over two names; over
    15 words) takes vector and graph search as well.
    """
    text = text.strip()
    names = query_names(text)
    timed, compared = re.search(OF_TIME, text, re.I) is not None, re.search(OF_COMPARISON, text, re.I) is not None
    is_complex = timed and (len(names) > 1 or compared) or len(names) > 2 or len(text.split(" ")) > 15
    matched = [intent for intent, patterns in INTENTS for p in patterns if re.search(p, text, re.I)]
    intent = matched[0] if matched else "exploratory"
    strategy, modalities = PLANS[intent]
    plan = [{"type": kind, "priority": n, "params": params} for n, (kind, params) in enumerate(modalities, 1)]
    has = lambda kind: any(m["type"] == kind for m in plan)
    if is_complex and not has("vector"):
        plan.append({"type": "vector", "priority": 99, "params": {"results": 10}})
    if is_complex and not has("graph"):
        plan.append({"type": "graph", "priority": 99, "params": {"hops": 2}})
    if timed and not has("history"):
        plan.insert(0, {"type": "history", "priority": 0, "params": {}})
    confidence = 0.85 if not matched else 0.95 if len(matched) == 1 else 0.75
    return {"intent": intent, "strategy": strategy, "modalities": plan, "confidence": confidence, "names": names, "also": matched[1:]}


def multi_modal_search(text: str, searches: dict[str, Callable[[dict, list[str]], DataFrame]], per_title: int = 2) -> tuple[DataFrame | None, dict]:
    """(results (id, title, score), plan): the searches that the query's plan asks for, fused as it says, few of one title.

    ``searches`` gives for a modality a function of its parameters and the
    query's names to (id, title, score).  A modality is left out if there is no
    such function or the query has too few names for it; without any the result is None.
    """
    plan = classify_query(text)
    used = [m for m in plan["modalities"] if m["type"] in searches and len(plan["names"]) >= NEEDS_NAMES.get(m["type"], 0)]
    found = None
    for m in used:
        part = searches[m["type"]](m["params"], plan["names"]).select("id", "title", F.col("score").cast("double").alias("score"), F.lit(m["type"]).alias("modality"))
        found = part if found is None else found.unionByName(part)
    plan |= {"used": [m["type"] for m in used]}
    if found is None:
        return None, plan
    titles = found.groupBy("id").agg(F.min("title").alias("title"))
    fused = fuse(found, plan["strategy"], plan["used"]).select("id", "score").join(titles, "id")
    return diversify(fused, most=per_title), plan


def fuse(results: DataFrame, strategy: str, order: list[str] | None = None) -> DataFrame:
    if strategy == "ranked":
        return ranked_fusion(results)
    if strategy == "intersect":
        return intersect_fusion(results)
    if strategy == "union":
        return union_fusion(results, order or ["lexical", "vector", "graph"])
    return weighted_fusion(results)


def select_model(query: str, corpus_size: int) -> str:
    """Long queries and small corpora take the larger embedding model."""
    return "medium" if len(query.split()) > 8 or corpus_size < 1000 else "small"


def model_for(query: Column, corpus_size: int) -> Column:
    """``select_model`` of each query; a null one counts as empty."""
    words = F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when((F.size(words) > 8) | F.lit(corpus_size < 1000), "medium").otherwise("small")
