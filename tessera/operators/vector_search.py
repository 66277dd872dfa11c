"""Vector search: exact top-k, filtered, quantised, two-stage, diverse and partitioned.

Exact search is one scan with an Arrow-batched score and a bounded top-k (each
task keeps k rows); there is no shuffle of vectors.  The partitioned index
lets a search read only the clusters near the query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def validate_points(points: DataFrame, existing: DataFrame | None, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows that cannot be added, with the reason: empty, dimension or duplicate."""
    size = F.size(vector)
    marked = points.withColumn("reason", F.when(F.col(vector).isNull() | (size == 0), "empty vector").when(size != dims, "dimension mismatch"))
    repeats = points.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    bad = marked.where("reason is not null").select(key, "reason")
    bad = bad.unionByName(repeats.withColumn("reason", F.lit("duplicate id")))
    if existing is not None:
        bad = bad.unionByName(points.join(existing.select(key), key, "left_semi").select(key, F.lit("duplicate id").alias("reason")))
    return bad.distinct()


def soft_delete(points: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """``deleted`` is true for the ids given, and as before for others."""
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    was = F.col("deleted") if "deleted" in points.columns else F.lit(False)
    return points.join(gone, key, "left").withColumn("deleted", F.coalesce("_gone", was)).drop("_gone")


def search_knn(points: DataFrame, query: Sequence[float], k: int, *, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", where: Column | None = None, least: float | None = None) -> DataFrame:
    """The k rows most similar to the query, ties by key.

    The filter comes before the top-k, so k rows are found if there are k.
    Deleted points are skipped; ``least`` is a similarity floor.
    """
    rows = points.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in points.columns else points
    if where is not None:
        rows = rows.where(where)
    scored = rows.withColumn("score", V.scan_similarity(query, metric)(vector))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def find_similar(points: DataFrame, vec_id, query: Sequence[float], k: int, least: float = 0.0, key: str = "vec_id") -> DataFrame:
    """Neighbours of a stored vector, itself left out."""
    return search_knn(points, query, k, key=key, where=F.col(key) != F.lit(vec_id), least=least)


def quantized(points: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    return points.withColumn("scalar", V.scalar_quantize(F.col(vector))).withColumn("bits", V.binary_quantize(F.col(vector), dims))


def search_quantized(points: DataFrame, query: Sequence[float], k: int, key: str = "vec_id") -> DataFrame:
    """Top-k by cosine with the vectors restored from their scalar codes."""
    scored = points.withColumn("score", V.cosine(V.scalar_restore(F.col("scalar")), V.literal(query)))
    return scored.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def two_stage_search(points: DataFrame, query: Sequence[float], k: int, multiplier: float = 3.0, *, key: str = "vec_id", vector: str = "embedding", rerank: Callable[[Column], Column] | None = None) -> DataFrame:
    """The best max(k, ceil(k * multiplier)) by Hamming distance of sign bits, then the best k by exact similarity."""
    first = max(k, int(np.ceil(k * multiplier)))
    bits = V.binary_quantize(V.literal(query), len(query))
    near = points.withColumn("distance", V.hamming(F.col("bits"), bits)).orderBy("distance", key).limit(first)
    similarity = rerank(F.col(vector)) if rerank else V.scan_similarity(query)(vector)
    return near.withColumn("score", similarity).orderBy(F.desc(F.round("score", 9)), key).limit(k)


def mmr_order(query: np.ndarray, vectors: np.ndarray, k: int, trade: float) -> list[int]:
    """Places picked greedily by trade * relevance - (1 - trade) * nearness to those picked; the first best wins."""
    def unit(m):
        n = np.linalg.norm(m, axis=-1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m, dtype=float), where=n > 0)

    m, q = unit(vectors.astype(float)), unit(query.astype(float))
    relevance, nearest, picked = m @ q, np.full(len(m), -np.inf), []
    for _ in range(min(k, len(m))):
        penalty = np.where(np.isneginf(nearest), 0.0, nearest)
        value = trade * relevance - (1 - trade) * penalty
        value[picked] = -np.inf
        best = int(np.round(value, 12).argmax())
        picked.append(best)
        nearest = np.maximum(nearest, m @ m[best])
    return picked


def mmr_rerank(candidates: DataFrame, query: Sequence[float], k: int, trade: float = 0.5, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rerank a bounded candidate list (of some k rows) for diversity; scores stay as they were."""
    q = np.asarray(query, float)
    columns = [key, "score", "rank"]
    kind = candidates.schema[key].dataType.simpleString()

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        order = mmr_order(q, np.vstack(pdf[vector]), k, trade)
        out = pdf.iloc[order].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out[columns]

    one = candidates.select(key, vector, "score", F.lit(0).alias("_one"))
    return one.groupBy("_one").applyInPandas(lambda pdf: rerank(pdf), f"{key} {kind}, score double, rank long")


def search_with_diversity(points: DataFrame, query: Sequence[float], k: int, trade: float = 0.5, key: str = "vec_id") -> DataFrame:
    """MMR over the 2k nearest."""
    return mmr_rerank(search_knn(points, query, 2 * k, key=key), query, k, trade, key=key)


class PartitionedIndex:
    """Clusters of unit vectors with bounding radii; only the nearest clusters are searched.

    Seeds are chosen by k-means++ from a bounded sample in hash order and moved
    a few rounds over it; every vector is assigned, and centroids are
    re-averaged once from all of them.
    """

    #: Rows the seeds are drawn from, and clusters: both bound what the driver holds.
    SAMPLE, MAX_CLUSTERS = 10_000, 4_096

    def __init__(self, centroids: np.ndarray, assigned: DataFrame, key: str, vector: str):
        self.centroids, self.assigned, self.key, self.vector = centroids, assigned, key, vector

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m, dtype=float), where=n > 0)

    @classmethod
    def _nearest(cls, centroids: np.ndarray):
        @F.pandas_udf("int")
        def nearest(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="int32")
            return pd.Series((cls._unit(np.vstack(vectors).astype(float)) @ cls._unit(centroids).T).argmax(1).astype("int32"))

        return nearest

    @staticmethod
    def _seeds(sample: np.ndarray, clusters: int, rounds: int = 5) -> np.ndarray:
        """k-means++: each next seed is drawn in proportion to its squared distance from those chosen; then ``rounds`` of means."""
        if not len(sample):
            return sample
        rng = np.random.default_rng(17)
        chosen = [int(rng.integers(len(sample)))]
        near = ((sample - sample[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(clusters, len(sample)) and near.sum() > 1e-12:
            chosen.append(int(rng.choice(len(sample), p=near / near.sum())))
            near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        seeds = sample[chosen]
        for _ in range(rounds):
            own = (sample @ seeds.T).argmax(1)
            seeds = np.array([sample[own == c].mean(0) if (own == c).any() else seeds[c] for c in range(len(seeds))])
        return seeds

    @classmethod
    def build(cls, points: DataFrame, clusters: int, key: str = "vec_id", vector: str = "embedding") -> PartitionedIndex:
        clusters = min(clusters, cls.MAX_CLUSTERS)
        sample = [r[0] for r in points.select(vector, key).orderBy(F.xxhash64(key), key).limit(cls.SAMPLE).collect()]
        seeds = cls._seeds(cls._unit(np.array(sample, float).reshape(len(sample), -1)), clusters)
        first = points.withColumn("cluster", cls._nearest(seeds)(vector))
        place = F.posexplode(V.normalize(F.col(vector)))
        means = first.select("cluster", place.alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
        centroids = seeds.copy()
        for r in means.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).toLocalIterator():
            centroids[r["cluster"]] = [p["x"] for p in r["v"]]
        return cls(centroids, points.withColumn("cluster", cls._nearest(centroids)(vector)), key, vector)

    def radii(self) -> DataFrame:
        """cluster, members, radius: the largest distance of a member's unit vector from the centroid."""
        table = self.assigned.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)], "cluster int, centroid array<double>")
        far = F.sqrt(V.l2_squared(V.normalize(F.col(self.vector)), F.col("centroid")))
        return self.assigned.join(F.broadcast(table), "cluster").groupBy("cluster").agg(F.count("*").alias("members"), F.max(far).alias("radius"))

    def probes(self, query: Sequence[float], share: float = 0.85, least: int = 3) -> list[int]:
        """Clusters whose similarity is ``share`` of the best or more, ``least`` at any rate."""
        scores = self._unit(self.centroids) @ self._unit(np.asarray([query], float))[0]
        order = np.argsort(-scores, kind="stable")
        return [int(c) for n, c in enumerate(order) if n < least or scores[c] >= share * scores[order[0]]]

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return search_knn(self.assigned, query, k, key=self.key, vector=self.vector, where=F.col("cluster").isin(self.probes(query)))

    def upsert(self, points: DataFrame) -> PartitionedIndex:
        """A new index in which ``points`` are added or replace those of their key; the clusters stay."""
        fresh = points.withColumn("cluster", self._nearest(self.centroids)(self.vector))
        kept = self.assigned.join(points.select(self.key).distinct(), self.key, "left_anti")
        return PartitionedIndex(self.centroids, kept.select(*fresh.columns).unionByName(fresh), self.key, self.vector)

    def split_large(self, most: int = 1000) -> PartitionedIndex:
        """A new index in which clusters over ``most`` members are two; only their members move."""
        centroids, moved = list(self.centroids), None
        for c in [r["cluster"] for r in self.assigned.groupBy("cluster").count().where(F.col("count") > most).orderBy("cluster").collect()]:
            own = self.assigned.where(F.col("cluster") == c)
            sample = [r[0] for r in own.orderBy(F.xxhash64(self.key), self.key).limit(self.SAMPLE).select(self.vector).collect()]
            pair = self._seeds(self._unit(np.array(sample, float)), 2)
            if len(pair) < 2:
                continue  # all alike
            side = self._nearest(pair)(self.vector)
            halves = own.drop("cluster").withColumn("cluster", F.when(side == 0, F.lit(c)).otherwise(F.lit(len(centroids))).cast("int"))
            centroids[c] = pair[0]
            centroids.append(pair[1])
            moved = (halves, [c]) if moved is None else (moved[0].unionByName(halves), [*moved[1], c])
        if moved is None:
            return self
        rest = self.assigned.where(~F.col("cluster").isin(moved[1])).select(*moved[0].columns)
        return PartitionedIndex(np.array(centroids), rest.unionByName(moved[0]), self.key, self.vector)


def global_range(points: DataFrame, vector: str = "embedding") -> DataFrame:
    """The least and most value over all vectors, for a shared quantiser."""
    return points.agg(F.min(F.array_min(vector)).alias("least"), F.max(F.array_max(vector)).alias("most"))
