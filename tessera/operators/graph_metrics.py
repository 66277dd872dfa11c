"""Graph measures.

Everything that can be is relational: degrees, ranks, components, triangles.
Algorithms that walk a whole graph in order (articulation points, betweenness,
modularity) run on one group of edges in one task, so give them a group key
whose graphs are bounded; label propagation is the community method without
that bound.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import with_place
from tessera.operators.traversal import _cut, undirected


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, least_weight: float = 2) -> DataFrame:
    """(node, score, rank): undirected power iteration over edges of weight ``least_weight`` and more, unweighted."""
    links = undirected(edges.where(F.col("weight") >= least_weight)).distinct()
    degree = links.groupBy("source").agg(F.count("*").alias("deg"))
    out = _cut(links.join(degree, "source"))
    nodes = out.select(F.col("source").alias("node")).distinct()
    n = nodes.count()
    rank = nodes.withColumn("score", F.lit(1.0 / max(n, 1)))
    for i in range(iterations):
        got = out.join(rank, out.source == rank.node).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("score") / F.col("deg")).alias("got"))
        rank = nodes.join(got, "node", "left").select("node", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 5 == 4:
            rank = _cut(rank)
    return with_place(rank, F.desc(F.round("score", 9)), "node", name="rank")


def flow_centrality(edges: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, score): every node starts at 1/n; each round gives (1 - d)/n plus d * score / out degree * weight over its
    in edges; dangling mass is lost; the rounds are fixed."""
    degree = edges.groupBy("source").agg(F.count("*").alias("deg"))
    out = _cut(edges.select("source", "target", "weight").join(degree, "source"))
    nodes = _cut(nodes_of(edges))
    n = max(nodes.count(), 1)
    score = nodes.withColumn("score", F.lit(1.0 / n))
    for i in range(iterations):
        got = out.join(score, out.source == score.node).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("score") / F.col("deg") * F.col("weight")).alias("got"))
        score = nodes.join(got, "node", "left").select("node", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 5 == 4:
            score = _cut(score)
    return score


def degree(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, total)."""
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("target", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(in + out) / (2 (n - 1)), 0 for a single node."""
    found = degree(edges)
    n = F.col("_n")
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("_n")))).withColumn("centrality", F.when(n > 1, F.col("total") / (2 * (n - 1))).otherwise(0.0)).drop("_n")


def compare_importance(ranks: DataFrame, degrees: DataFrame) -> DataFrame:
    """Rank score over degree, 0 without a degree."""
    return ranks.join(degrees.select("node", "total"), "node").withColumn("ratio", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0))


def triangles(edges: DataFrame) -> DataFrame:
    """One row: directed cycles a -> b -> c -> a of distinct nodes, each counted once."""
    e = edges.select("source", "target").where(F.col("source") != F.col("target")).distinct()
    ab, bc, ca = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("c", "a")
    least_first = (F.col("a") < F.col("b")) & (F.col("a") < F.col("c")) & (F.col("b") != F.col("c"))
    return ab.where(F.col("a") < F.col("b")).join(bc, "b").where(least_first).join(ca, ["c", "a"], "left_semi").agg(F.count("*").alias("triangles"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached undirected, by least-label spreading with pointer jumps."""
    links = _cut(undirected(edges).distinct())
    label = _cut(nodes_of(edges).withColumn("component", F.col("node")))
    while True:  # labels only fall, and jumps halve what is left of a chain
        near = links.join(label, links.target == label.node).groupBy(F.col("source").alias("node")).agg(F.min("component").alias("near"))
        spread = label.join(near, "node", "left").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("up"))
        spread = _cut(spread.join(jump, "component", "left").select("node", F.least("component", "up").alias("component"), "old"))
        changed = not spread.where(F.col("component") != F.col("old")).isEmpty()
        label = spread.drop("old")
        if not changed:
            return label


def strong_components_of(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of its strongly connected component, over a directed graph of any size.

    Nodes without a way in or out stand alone and go first, again and again.
    Then every node takes the least node that reaches it as its colour; a node
    of its own colour is the least of its component, and the component is what
    reaches it within the colour.  That is cut off, and the rest is coloured
    anew.  The rounds grow with the longest way through the graph.
    """
    links = _cut(edges.select("source", "target").where(F.col("source") != F.col("target")).distinct())
    live, done = _cut(nodes_of(edges)), None
    within = lambda nodes: _cut(links.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target"))
    while not live.isEmpty():
        through = links.select(F.col("source").alias("node")).intersect(links.select("target"))
        lone = _cut(live.join(through, "node", "left_anti"))
        if not lone.isEmpty():
            found = lone.select("node", F.col("node").alias("component"))
        else:
            colour, changed = _cut(live.withColumn("colour", F.col("node"))), True
            while changed:
                into = links.join(colour, links.source == colour.node).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("near"))
                spread = _cut(colour.join(into, "node", "left").select("node", F.least("colour", "near").alias("colour"), F.col("colour").alias("old")))
                changed = not spread.where(F.col("colour") != F.col("old")).isEmpty()
                colour = spread.drop("old")
            back = links.join(colour.toDF("source", "c"), "source").join(colour.toDF("target", "d"), "target").where("c = d")
            back = _cut(back.select(F.col("target").alias("node"), F.col("source").alias("before"), F.col("c").alias("component")))
            found = frontier = _cut(colour.where("node = colour").select("node", F.col("colour").alias("component")))
            while not frontier.isEmpty():
                step = frontier.join(back, ["node", "component"]).select(F.col("before").alias("node"), "component").distinct()
                frontier = _cut(step.join(found, "node", "left_anti"))
                found = _cut(found.unionByName(frontier))
        done = found if done is None else _cut(done.unionByName(found))
        live = _cut(live.join(found.select("node"), "node", "left_anti"))
        links = within(live)
    return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0) if done is None else done


def isolated_subplots(components: DataFrame, most: int = 3) -> DataFrame:
    """(component, size): components (node, component) of ``most`` nodes at most."""
    return components.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") <= most)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.join(nodes_of(edges), "node", "left_anti")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): each node takes the label of most edge weight around it, ties to the least, for fixed rounds."""
    links = _cut(undirected(edges, "weight"))
    label = _cut(nodes_of(edges).withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = links.join(label, links.target == label.node).groupBy(F.col("source").alias("node"), "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b")).select("node", "b.community")
        label = _cut(label.select("node").join(best, "node"))
    return label


def bridges_between(edges: DataFrame, community: DataFrame) -> DataFrame:
    """(node, external): nodes with neighbours in other communities, by how many."""
    own = community.select(F.col("node").alias("source"), F.col("community").alias("c1"))
    other = community.select(F.col("node").alias("target"), F.col("community").alias("c2"))
    return undirected(edges).join(own, "source").join(other, "target").where(F.col("c1") != F.col("c2")).groupBy(F.col("source").alias("node")).agg(F.countDistinct("c2").alias("external"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node and edge counts, average degree 2E/V, density 2E/(V(V-1))."""
    v, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    n, m = F.col("nodes"), F.col("edges")
    return v.crossJoin(e).select("nodes", "edges", F.when(n > 0, 2.0 * m / n).otherwise(0.0).alias("avg_degree"), F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0).alias("density"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


# -- algorithms over one bounded graph -------------------------------------------------


def _adjacent(pairs) -> dict:
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
        else:
            near[a]
    return near


def articulation_nodes(pairs) -> list:
    """Nodes whose loss parts their component, by an iterative depth-first search."""
    near, order, low, cut, clock = _adjacent(pairs), {}, {}, set(), 0
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = clock
        clock += 1
        stack, children = [(root, None, iter(sorted(near[root])))], 0
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other == parent:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = clock
                    clock += 1
                    stack.append((other, node, iter(sorted(near[other]))))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent == root:
                        children += 1
                    elif low[node] >= order[parent]:
                        cut.add(parent)
        if children > 1:
            cut.add(root)
    return sorted(cut)


def strong_components(pairs) -> dict:
    """node -> least node of its strongly connected component, by two searches."""
    out, into = defaultdict(set), defaultdict(set)
    nodes = set()
    for a, b in pairs:
        out[a].add(b)
        into[b].add(a)
        nodes |= {a, b}
    finished, seen = [], set()
    for root in sorted(nodes):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(sorted(out[root])))]
        while stack:
            node, rest = stack[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    stack.append((other, iter(sorted(out[other]))))
                    break
            else:
                finished.append(node)
                stack.pop()
    owner = {}
    for root in reversed(finished):
        if root in owner:
            continue
        members, todo = [], [root]
        owner[root] = root
        while todo:
            node = todo.pop()
            members.append(node)
            for other in into[node]:
                if other not in owner:
                    owner[other] = root
                    todo.append(other)
        least = min(members)
        for m in members:
            owner[m] = least
    return owner


def shortest_path_centrality(pairs) -> dict:
    """node -> (betweenness, closeness), undirected: pair dependencies summed over breadth-first trees, both normalised."""
    near = _adjacent(pairs)
    n, between, close = len(near), dict.fromkeys(near, 0.0), {}
    for s in sorted(near):
        paths, dist, order, before = defaultdict(float, {s: 1.0}), {s: 0}, [], defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
        total = sum(dist.values())
        close[s] = (len(dist) - 1) / total if total else 0.0
    norm = (n - 1) * (n - 2)
    return {v: (between[v] / norm if norm > 0 else 0.0, close[v]) for v in near}


def modularity_communities(weighted) -> dict:
    """node -> community number: greedy modularity moves, then the same on the graph of communities, until none helps."""
    member = None
    graph = defaultdict(lambda: defaultdict(float))
    for a, b, w in weighted:
        graph[a][b] += w
        graph[b][a] += w
    while True:
        total = sum(sum(x.values()) for x in graph.values()) or 1.0
        strength = {v: sum(x.values()) for v, x in graph.items()}
        label, load, moved_once = {v: v for v in graph}, dict(strength), False
        moved = True
        while moved:
            moved = False
            for v in sorted(graph):
                links = defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        links[label[u]] += w
                home = label[v]
                load[home] -= strength[v]
                gain = lambda c: links[c] - load.get(c, 0.0) * strength[v] / total  # noqa: B023, E731
                best = max(sorted({home, *links}), key=lambda c: (round(gain(c), 12), c == home))
                load[best] = load.get(best, 0.0) + strength[v]
                label[v] = best
                if best != home:
                    moved = moved_once = True
        member = {v: label[v] for v in graph} if member is None else {v: label[c] for v, c in member.items()}
        if not moved_once:
            break
        merged = defaultdict(lambda: defaultdict(float))
        for v, x in graph.items():
            for u, w in x.items():
                merged[label[v]][label[u]] += w
        graph = merged
    number = {c: i for i, c in enumerate(sorted(set(member.values())))}
    return {v: number[c] for v, c in member.items()}


def health_score(nodes: int, orphan_count: int, component_count: int, critical_count: int) -> float:
    """100 less 5 an orphan (50 at most), less 20 a component past one (40 at most), plus 5 a critical node (20 at most), in 0..100."""
    if not nodes:
        return 100.0
    return float(max(0, min(100, 100 - min(5 * orphan_count, 50) - min(20 * max(component_count - 1, 0), 40) + min(5 * critical_count, 20))))


def _per_group(edges: DataFrame, group: str, fn, schema: str) -> DataFrame:
    kind = edges.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        out.insert(0, group, pdf[group].iloc[0])
        return out

    return edges.groupBy(group).applyInPandas(run, f"{group} {kind}, {schema}")


def critical_nodes(edges: DataFrame, group: str) -> DataFrame:
    """(group, node): articulation points of each group's graph."""
    kind = edges.schema["source"].dataType.simpleString()
    return _per_group(edges, group, lambda p: pd.DataFrame({"node": articulation_nodes(zip(p["source"], p["target"], strict=True))}), f"node {kind}")


def strongly_connected(edges: DataFrame, group: str) -> DataFrame:
    """(group, node, component)."""
    kind = edges.schema["source"].dataType.simpleString()

    def run(p):
        owner = sorted(strong_components(zip(p["source"], p["target"], strict=True)).items())
        return pd.DataFrame(owner, columns=["node", "component"])

    return _per_group(edges, group, run, f"node {kind}, component {kind}")


def centralities(edges: DataFrame, group: str) -> DataFrame:
    """(group, node, betweenness, closeness)."""
    kind = edges.schema["source"].dataType.simpleString()

    def run(p):
        found = sorted(shortest_path_centrality(zip(p["source"], p["target"], strict=True)).items())
        return pd.DataFrame([(v, b, c) for v, (b, c) in found], columns=["node", "betweenness", "closeness"])

    return _per_group(edges, group, run, f"node {kind}, betweenness double, closeness double")


def communities(edges: DataFrame, group: str, least_weight: float = 2) -> DataFrame:
    """(group, node, community) over edges of weight ``least_weight`` and more."""
    kind = edges.schema["source"].dataType.simpleString()

    def run(p):
        found = sorted(modularity_communities(zip(p["source"], p["target"], p["weight"], strict=True)).items())
        return pd.DataFrame(found, columns=["node", "community"])

    return _per_group(edges.where(F.col("weight") >= least_weight), group, run, f"node {kind}, community long")


def health(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, score): nodes (group, node) and edges (group, source, target) of bounded graphs."""
    kind = nodes.schema[group].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(right["source"], right["target"], strict=True)) if len(right) else []
        near = _adjacent(pairs)
        lonely = len(set(left["node"]) - set(near))
        seen, count = set(), 0
        for v in near:
            if v not in seen:
                count += 1
                todo = [v]
                seen.add(v)
                while todo:
                    for u in near[todo.pop()]:
                        if u not in seen:
                            seen.add(u)
                            todo.append(u)
        key = (left if len(left) else right)[group].iloc[0]
        return pd.DataFrame({group: [key], "score": [health_score(len(left), lonely, count + lonely, len(articulation_nodes(pairs)))]})

    return nodes.groupBy(group).cogroup(edges.groupBy(group)).applyInPandas(run, f"{group} {kind}, score double")


def analytics(edges: DataFrame, group: str) -> DataFrame:
    """(group, node, in_degree, out_degree, total, betweenness, closeness, community) in one table."""
    deg = edges.select(group, F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(group, "target", F.lit(1), F.lit(0)))
    deg = deg.groupBy(group, "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total"))
    return deg.join(centralities(edges, group), [group, "node"], "left").join(communities(edges, group, 0), [group, "node"], "left")


def plot_holes(nodes: DataFrame, edges: DataFrame, community: DataFrame, most_external: int = 5) -> DataFrame:
    """(node, issue): isolated components, rare nodes without an edge, bridges over many communities."""
    comp = components(edges)
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    largest = size.agg(F.max("size").alias("most"))
    small = comp.join(size.crossJoin(F.broadcast(largest)).where(F.col("size") < F.col("most")), "component").select("node", F.lit("isolated component").alias("issue"))
    lonely = nodes.where(F.col("frequency") < 3).select("node").join(nodes_of(edges), "node", "left_anti").select("node", F.lit("orphan").alias("issue"))
    wide = bridges_between(edges, community).where(F.col("external") > most_external).select("node", F.lit("overloaded bridge").alias("issue"))
    return small.unionByName(lonely).unionByName(wide)
