"""One search over texts, vectors and a graph: lexical, semantic or hybrid, filtered.

Each mode is a lazy DataFrame of at most a few thousand candidates; filters come
before the cut to k, so a filtered search gives k results if there are k.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from time import monotonic

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import fusion as U
from tessera.operators import ranking as R
from tessera.operators import vector_search as V

#: Candidates of each side of a hybrid search, as a multiple of k.
CANDIDATES = 5


class ResultCache:
    """Least recently used results by key, at most ``size``, each for ``seconds``."""

    def __init__(self, size: int = 100, seconds: float = 300, clock: Callable[[], float] = monotonic):
        self.size, self.seconds, self.clock, self.held = size, seconds, clock, OrderedDict()

    def get(self, key):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.seconds:
            self.held.pop(key, None)
            return None
        self.held.move_to_end(key)
        return value

    def set(self, key, value) -> None:
        self.held[key] = (self.clock(), value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)


@dataclass
class SearchService:
    """index: a stored text index or None; points: vectors (id, embedding); nodes (id, ...): what filters and results see;
    edges (source, target, weight, kind) and centrality (id, centrality) for hybrid search."""

    nodes: DataFrame
    index: object | None = None
    points: DataFrame | None = None
    edges: DataFrame | None = None
    centrality: DataFrame | None = None
    cache: ResultCache = field(default_factory=ResultCache)

    def search(self, mode: str, k: int = 10, *, terms: Sequence[str] = (), vector: Sequence[float] | None = None, where: Column | None = None, least: float | None = None, preset: str = "contextual", cached: bool = False) -> DataFrame:
        """(id, score, mode, and the columns of nodes): the k best of a mode, ties by id.

        where filters nodes; least is a floor of the score.  With ``cached`` the
        rows of an equal question come from memory: at most k of them are held.
        """
        key = (mode, k, tuple(terms), tuple(vector or ()), str(where), least, preset)
        if cached and (rows := self.cache.get(key)) is not None:
            return rows
        modes = {"lexical": self._lexical, "semantic": self._semantic, "hybrid": self._hybrid}
        if mode not in modes:
            raise ValueError(f"unknown search mode: {mode}")
        found = modes[mode](k, list(terms), vector, where, preset)
        if least is not None:
            found = found.where(F.col("score") >= least)
        nodes = self.nodes if where is None else self.nodes.where(where)
        best = found.join(nodes, "id").orderBy(F.desc(F.round("score", 9)), "id").limit(k)
        if cached:
            spark = self.nodes.sparkSession
            best = spark.createDataFrame(best.collect(), best.schema)
            self.cache.set(key, best)
        return best

    def _allowed(self, df: DataFrame, where: Column | None) -> DataFrame:
        return df if where is None else df.join(self.nodes.where(where).select("id"), "id", "left_semi")

    def _lexical(self, k, terms, vector, where, preset) -> DataFrame:
        index = self.index
        hits = R.score(index.postings, terms, index.key, corpus=index.corpus).where(F.col("score") > 0)
        hits = self._allowed(hits.select(F.col(index.key).alias("id"), "score"), where)
        return hits.orderBy(F.desc(F.round("score", 9)), "id").limit(k).withColumn("mode", F.lit("lexical"))

    def _semantic(self, k, terms, vector, where, preset) -> DataFrame:
        points = self._allowed(self.points, where)
        return V.search_knn(points, vector, k, key="id").select("id", "score", F.lit("semantic").alias("mode"))

    def _hybrid(self, k, terms, vector, where, preset) -> DataFrame:
        """Both sides' candidates, the graph's signals over them, one weighted fusion, then the spread to neighbours."""
        wide = CANDIDATES * k
        lexical = self._lexical(wide, terms, None, where, preset).select("id", "score")
        near = self._semantic(wide, [], vector, where, preset).select("id", "score")
        ids = lexical.select("id").union(near.select("id")).distinct()
        signals = U.graph_signals(ids, self.edges, self.centrality).select("id", U.graph_relevance().alias("score"))
        fused = U.fuse_signals(lexical, near, signals, preset).select("id", "score")
        return U.propagate(fused, self.edges).select("id", "score", F.lit("hybrid").alias("mode"))


def expanded_search(points: DataFrame, vector: Sequence[float], k: int, mentions: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id, similarity, distance, score): the nearest notes, those that share entities within ``hops``, ranks of both fused."""
    from tessera.operators.traversal import expand_results

    near = V.search_knn(points, vector, CANDIDATES * k, key="id").select("id", F.col("score").alias("similarity"))
    wider = expand_results(near.select(F.col("id").alias("note_id"), F.col("similarity").alias("score")), mentions, edges, hops)
    both = near.join(wider.select(F.col("note_id").alias("id"), "distance"), "id", "full_outer")
    ranked = U.rerank_vector_graph(both.select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("distance").cast("double").alias("distance")))
    return ranked.orderBy(F.desc(F.round("score", 12)), "id").limit(k)
