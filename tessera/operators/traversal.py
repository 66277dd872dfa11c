"""Recursion over edges: closures, breadth-first search, paths and cycles.

Each level is one join of the frontier with the edges and one anti join with
what was reached.  Levels are written to the checkpoint folder, so a lost
executor repeats a level and not the whole walk, and plans stay short.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levels(first: int, depth: int | None):
    """Levels up to ``depth``, or without end: every walk stops at an empty frontier, since no pair is reached twice."""
    return count(first) if depth is None else range(first, depth + 1)


def shared_dir(spark) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; where unset, a temporary one if all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "/tmp/checkpoints"
    return path.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A side of a join, worked out once, and to be broadcast if it has at most BROADCAST_ROWS rows."""
    held = _cut(df)
    return F.broadcast(held) if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else held


def undirected(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select("source", "target", *keep).unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *keep))


def bfs(edges: DataFrame, starts: DataFrame, hops: int | None, start_column: str = "id") -> DataFrame:
    """(start, node, distance): nodes within ``hops`` of each start (None: all that are reached), the start itself at 0."""
    seen = starts.select(F.col(start_column).alias("start"), F.col(start_column).alias("node"), F.lit(0).alias("distance"))
    frontier, links = seen, edges.select(F.col("source").alias("node"), F.col("target").alias("_next"))
    for level in _levels(1, hops):
        step = frontier.join(links, "node").select("start", F.col("_next").alias("node")).distinct()
        frontier = _cut(step.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = _cut(seen.unionByName(frontier))
    return seen


def within_hops(edges: DataFrame, start, hops: int | None) -> DataFrame:
    """(node, distance) over directed edges, the start left out."""
    starts = edges.sparkSession.range(1).select(F.lit(start).alias("id"))
    return bfs(edges, starts, hops).where(F.col("distance") > 0).select("node", "distance")


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth) over (source = parent, target = child), the least depth of each pair."""
    frontier = _cut(edges.select(F.col("source").alias("ancestor"), F.col("target").alias("descendant"), F.lit(1).alias("depth")).distinct())
    seen, links = frontier, edges.select(F.col("source").alias("descendant"), F.col("target").alias("_next")).distinct()
    for level in _levels(2, depth):
        step = frontier.join(links, "descendant").select("ancestor", F.col("_next").alias("descendant")).distinct()
        frontier = _cut(step.join(seen, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = _cut(seen.unionByName(frontier))
    return seen


def ancestors(edges: DataFrame, node, depth: int | None = None) -> DataFrame:
    """(node, depth) above ``node``: the walk goes up from it, not over the whole graph."""
    up = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return within_hops(up, node, depth).withColumnRenamed("distance", "depth")


def descendants(edges: DataFrame, node, depth: int | None = None) -> DataFrame:
    return within_hops(edges, node, depth).withColumnRenamed("distance", "depth")


def siblings(edges: DataFrame, node) -> DataFrame:
    """Other children of the node's parents."""
    parents = edges.where(F.col("target") == F.lit(node)).select("source")
    return edges.join(parents, "source", "left_semi").where(F.col("target") != F.lit(node)).select(F.col("target").alias("node")).distinct()


def common_ancestors(edges: DataFrame, a, b, depth: int | None = None) -> DataFrame:
    return ancestors(edges, a, depth).select("node").intersect(ancestors(edges, b, depth).select("node"))


def shortest_path(edges: DataFrame, source, target, max_depth: int = 10, labels: bool = False) -> DataFrame:
    """(path array, hops) of a shortest undirected path, the least path where several are; with ``labels`` also the
    edge types, INVERSE_ before those that can only be walked backwards.

    The walk out keeps nodes only, by level; the walk back finds which of them
    lie on shortest paths, and the least of these is read off from the source on.
    """
    spark, kind = edges.sparkSession, edges.schema["source"].dataType
    one = lambda v: spark.range(1).select(F.lit(v).cast(kind).alias("node"))
    links = undirected(edges).select(F.col("source").alias("node"), F.col("target").alias("_next"))
    near = lambda nodes: links.join(small(nodes), "node").select(F.col("_next").alias("node")).distinct()
    levels = [one(source)]
    seen, end = levels[0], F.col("node") == F.lit(target)
    while levels[-1].where(end).isEmpty():
        if len(levels) > max_depth:
            levels = []
            break
        levels.append(_cut(near(levels[-1]).join(seen.select(F.col("node").alias("_seen")), F.col("node") == F.col("_seen"), "left_anti")))
        if levels[-1].isEmpty():
            levels = []
            break
        seen = _cut(seen.union(levels[-1]))
    hops = len(levels) - 1
    path, types = [levels[0].first()[0]] if levels else [], []
    on = [one(target)]
    for level in range(hops - 1, 0, -1):
        on.append(_cut(near(on[-1]).join(levels[level].select(F.col("node").alias("_on")), F.col("node") == F.col("_on"), "left_semi")))
    for level in range(hops):
        way = F.struct(F.lit(1).alias("way"), (F.col("type") if labels else F.lit("")).alias("type"))
        back = F.struct(F.lit(2).alias("way"), (F.concat(F.lit("INVERSE_"), F.col("type")) if labels else F.lit("")).alias("type"))
        here = F.lit(path[-1])
        steps = edges.where(F.col("source") == here).select(F.col("target").alias("node"), way.alias("by")).unionByName(edges.where(F.col("target") == here).select(F.col("source").alias("node"), back.alias("by")))
        best = steps.join(on[hops - 1 - level].select(F.col("node").alias("_on")), F.col("node") == F.col("_on"), "left_semi").agg(F.min(F.struct("node", "by")).alias("s")).select("s.node", "s.by.type").first()
        path.append(best[0])
        types.append(best[1])
    array = lambda values, of: F.array(*[F.lit(v).cast(of) for v in values]).cast(f"array<{of}>")
    found = spark.range(1).select(array(path, kind.simpleString()).alias("path"), *([array(types, "string").alias("types")] if labels else []), F.lit(max(hops, 0)).alias("hops"))
    return found if levels else found.where(F.lit(False))


def k_shortest_paths(edges: DataFrame, source, target, k: int = 3, max_depth: int = 6) -> DataFrame:
    """The k shortest simple undirected paths, by hops then path."""
    links = undirected(edges).distinct().select(F.col("source").alias("node"), F.col("target").alias("_next"))
    frontier = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path"))
    done = None
    for _ in range(max_depth):
        step = frontier.join(links, "node").where(~F.array_contains("path", F.col("_next")))
        frontier = _cut(step.select(F.col("_next").alias("node"), F.concat("path", F.array("_next")).alias("path")))
        hit = frontier.where(F.col("node") == F.lit(target)).select("path")
        done = hit if done is None else done.unionByName(hit)
        if done.limit(k).count() >= k:
            break
        frontier = frontier.where(F.col("node") != F.lit(target))
    return done.withColumn("hops", F.size("path") - 1).orderBy("hops", "path").limit(k)


def weighted_traverse(edges: DataFrame, start, hops: int = 2, least: float = 0.2) -> DataFrame:
    """(node, distance, path_weight): out edges, and in edges of bidirectional ones; parallel edges keep the last;
    the weight is the product along the first path found; edges under ``least`` are not walked."""
    last = edges.groupBy("source", "target").agg(F.max_by(F.struct("weight", "bidirectional"), "seq").alias("e")).select("source", "target", "e.weight", "e.bidirectional")
    links = last.select("source", "target", "weight").unionByName(last.where("bidirectional").select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    links = links.where(F.col("weight") >= least).groupBy("source", "target").agg(F.max("weight").alias("weight")).select(F.col("source").alias("node"), F.col("target").alias("_next"), F.col("weight").alias("w"))
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("distance"), F.lit(1.0).alias("path_weight"))
    frontier = seen
    for level in range(1, hops + 1):
        step = frontier.join(links, "node").select(F.col("_next").alias("node"), F.struct(F.col("node").alias("via"), (F.col("path_weight") * F.col("w")).alias("p")).alias("s"))
        step = step.groupBy("node").agg(F.min("s").alias("s")).select("node", F.lit(level).alias("distance"), F.col("s.p").alias("path_weight"))
        frontier = _cut(step.join(seen, "node", "left_anti"))
        seen = _cut(seen.unionByName(frontier))
    return seen.where(F.col("distance") > 0)


def expand_results(results: DataFrame, mentions: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """Notes found, then notes whose entities are near theirs: new ones score .5 at distance 1.

    mentions (note_id, entity_id); seeds count as the first hop.
    """
    seeds = mentions.join(results.select("note_id"), "note_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    near = bfs(undirected(edges), seeds, max(0, max_hops - 1)).select(F.col("node").alias("entity_id")).distinct()
    new = mentions.join(near, "entity_id", "left_semi").select("note_id").distinct().join(results.select("note_id"), "note_id", "left_anti")
    return results.select("note_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("distance")).unionByName(new.select("note_id", F.lit(0.5).alias("score"), F.lit(1).alias("distance")))


def has_cycle(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that can reach themselves."""
    return closure(edges, depth).where(F.col("ancestor") == F.col("descendant")).select(F.col("ancestor").alias("node")).distinct()


def would_cycle(edges: DataFrame, source, target, depth: int | None = None) -> bool:
    """True if an edge from source to target closes a cycle: source is reached from target, or is it."""
    return source == target or not within_hops(edges, target, depth).where(F.col("node") == F.lit(source)).isEmpty()


def subgraph(edges: DataFrame, center, depth: int) -> DataFrame:
    """Edges among the nodes within ``depth`` undirected hops."""
    nodes = bfs(undirected(edges), edges.sparkSession.range(1).select(F.lit(center).alias("id")), depth).select("node")
    return edges.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def adjacency(edges: DataFrame, node, direction: str = "both") -> DataFrame:
    """(neighbour, direction) of a node."""
    out = edges.where(F.col("source") == F.lit(node)).select(F.col("target").alias("neighbour"), F.lit("out").alias("direction"))
    into = edges.where(F.col("target") == F.lit(node)).select(F.col("source").alias("neighbour"), F.lit("in").alias("direction"))
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)


def generation_depth(edges: DataFrame, root, node, depth: int | None = None) -> DataFrame:
    """One row: the generation of ``node`` below ``root``, 0 for the root, -1 if it is not below."""
    found = descendants(edges, root, depth).where(F.col("node") == F.lit(node)).agg(F.min("depth").alias("d"))
    return found.select(F.when(F.lit(root == node), 0).otherwise(F.coalesce("d", F.lit(-1))).alias("generation"))


def entities_at_generation(edges: DataFrame, root, generation: int) -> DataFrame:
    return descendants(edges, root, max(generation, 1)).where(F.col("depth") == generation).select("node")


def generation_count(edges: DataFrame, root, depth: int | None = None) -> DataFrame:
    """Generations below a root with it, 0 without a root."""
    if root is None:
        return edges.sparkSession.range(1).select(F.lit(0).alias("generations"))
    return descendants(edges, root, depth).agg((F.coalesce(F.max("depth"), F.lit(0)) + 1).alias("generations"))


def are_related(edges: DataFrame, a, b, max_depth: int = 10) -> bool:
    return not shortest_path(edges, a, b, max_depth).isEmpty()


def family_unit(edges: DataFrame, node, spouse_types: tuple[str, ...] = ("SPOUSE_OF",), parent_types: tuple[str, ...] = ("PARENT_OF",)) -> DataFrame:
    """(node, relation): parents, children, siblings and spouses over typed edges."""
    parent_edges = edges.where(F.col("type").isin(*parent_types))
    spouse_edges = undirected(edges.where(F.col("type").isin(*spouse_types)))
    tag = lambda df, name: df.select(F.col("node"), F.lit(name).alias("relation"))
    parents = parent_edges.where(F.col("target") == F.lit(node)).select(F.col("source").alias("node"))
    children = parent_edges.where(F.col("source") == F.lit(node)).select(F.col("target").alias("node"))
    spouses = spouse_edges.where(F.col("source") == F.lit(node)).select(F.col("target").alias("node"))
    return tag(parents, "parent").unionByName(tag(children, "child")).unionByName(tag(siblings(parent_edges, node), "sibling")).unionByName(tag(spouses, "spouse")).distinct()


def members_by_relationship(edges: DataFrame, kind: str) -> DataFrame:
    typed = edges.where(F.col("type") == kind)
    return typed.select(F.col("source").alias("node")).union(typed.select("target")).distinct()


def folder_notes_and_links(folders: DataFrame, notes: DataFrame, links: DataFrame, root, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes below a folder, links among them): folders (source, target), notes (note_id, folder_id), links (source, target)."""
    tree = descendants(folders, root, depth).select("node").union(folders.sparkSession.range(1).select(F.lit(root)))
    inside = notes.join(tree.withColumnRenamed("node", "folder_id"), "folder_id", "left_semi")
    ids = inside.select("note_id")
    linked = links.join(ids.withColumnRenamed("note_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("note_id", "target"), "target", "left_semi")
    return inside, linked


def path_weight(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(1.0), lambda a, w: a * w)


def relatives(edges: DataFrame, node, entities: DataFrame, up: bool = False) -> DataFrame:
    """Descendants, or with ``up`` ancestors, of ``node`` with the columns of their entity (id, ...); those without an entity are left out."""
    found = ancestors(edges, node) if up else descendants(edges, node)
    return found.join(entities.withColumnRenamed("id", "node"), "node")
