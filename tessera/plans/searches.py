"""Vector search and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import fusion as U
from tessera.operators import vector_search as S
from tessera.plans.registry import SQL, query

Q = [float((i * 7) % 11 - 5) / 5 for i in range(64)]
_Q = "[" + ", ".join(map(str, Q)) + "]::DOUBLE[]"
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q})"
_TOP = "SELECT vec_id, round({c}, 6) AS score FROM embeddings {w} ORDER BY round({c}, 9) DESC, vec_id LIMIT {k}"


def _top(df):
    return df.select("vec_id", F.round("score", 6).alias("score"))


@query("v_search_exact", _TOP.format(c=_COS, w="", k=20))
def v_exact(t):
    return _top(S.search_knn(t.embeddings, Q, 20))


@query("v_search_filtered_full_k", _TOP.format(c=_COS, w="WHERE vec_id % 2 = 0 AND label <> 3", k=20))
def v_filtered(t):
    return _top(S.search_knn(t.embeddings, Q, 20, where=(F.col("vec_id") % 2 == 0) & (F.col("label") != 3)))


@query("v_search_skips_deleted", _TOP.format(c=_COS, w="WHERE vec_id % 5 <> 0", k=10))
def v_deleted(t):
    return _top(S.search_knn(S.soft_delete(t.embeddings, t.embeddings.where("vec_id % 5 = 0")), Q, 10))


@query("v_search_l2", f"SELECT vec_id, round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q})), 6) AS score FROM embeddings ORDER BY round(1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), {_Q})), 9) DESC, vec_id LIMIT 20")
def v_l2(t):
    return _top(S.search_knn(t.embeddings, Q, 20, metric="l2"))


@query("v_search_threshold", _TOP.format(c=_COS, w=f"WHERE {_COS} >= 0.1", k=50))
def v_threshold(t):
    return _top(S.search_knn(t.embeddings, Q, 50, least=0.1))


@query("v_find_similar_excludes_self", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, q WHERE vec_id <> 0) SELECT vec_id, round(s, 6) AS score FROM c WHERE s >= 0 ORDER BY round(s, 9) DESC, vec_id LIMIT 10")
def v_similar(t):
    me = [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]
    return _top(S.find_similar(t.embeddings, 0, me, 10))


@query("v_magnitudes", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS m FROM embeddings")
def v_mag(t):
    return t.embeddings.select("vec_id", F.round(V.magnitude(F.col("embedding")), 5).alias("m"))


@query("v_scalar_quantise", "WITH q AS (SELECT vec_id, embedding AS e, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings), c AS (SELECT vec_id, list_transform(e, lambda x: floor((CAST(x AS DOUBLE) - lo) / ((hi - lo) / 255) + 0.5)) AS codes FROM q) SELECT vec_id, CAST(list_sum(codes) AS BIGINT) AS code_sum, CAST(list_max(codes) AS BIGINT) AS code_max FROM c")
def v_quant(t):
    q = t.embeddings.select("vec_id", V.scalar_quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.array_max("q.codes").cast("long").alias("code_max"))


@query("v_search_scalar_codes")
def v_codes(t):
    return _top(S.search_quantized(S.quantized(t.embeddings, 64), Q, 10))


_BITS = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] >= 0) <> (({q})[i] >= 0) THEN 1 ELSE 0 END))".replace("{q}", _Q)


@query("v_binary_hamming", f"SELECT vec_id, CAST({_BITS} AS BIGINT) AS d, round(1 - {_BITS} / 64.0, 6) AS similarity FROM embeddings")
def v_hamming(t):
    b, q = V.binary_quantize(F.col("embedding"), 64), V.binary_quantize(V.literal(Q), 64)
    return t.embeddings.select("vec_id", V.hamming(b, q).cast("long").alias("d"), F.round(V.hamming_similarity(b, q, 64), 6).alias("similarity"))


@query("v_two_stage", f"WITH a AS (SELECT vec_id, embedding FROM embeddings ORDER BY {_BITS}, vec_id LIMIT 30) SELECT vec_id, round({_COS}, 6) AS score FROM a ORDER BY round({_COS}, 9) DESC, vec_id LIMIT 10")
def v_two(t):
    return _top(S.two_stage_search(S.quantized(t.embeddings, 64), Q, 10, 3.0))


@query("v_memory_usage", "SELECT count(*) * 256 AS floats, count(*) * 72 AS scalar, count(*) * 8 AS binary FROM embeddings")
def v_memory(t):
    n = F.count("*")
    return t.embeddings.agg((n * V.size_bytes(64)).alias("floats"), (n * V.size_bytes(64, "scalar")).alias("scalar"), (n * V.size_bytes(64, "binary")).alias("binary"))


@query("v_global_range", "SELECT round(CAST(min(list_min(embedding)) AS DOUBLE), 5) AS least, round(CAST(max(list_max(embedding)) AS DOUBLE), 5) AS most FROM embeddings")
def v_range(t):
    return S.global_range(t.embeddings).select(F.round(F.col("least").cast("double"), 5).alias("least"), F.round(F.col("most").cast("double"), 5).alias("most"))


@query("v_truncate_prefix", "SELECT vec_id, CAST(len(embedding[1:16]) AS BIGINT) AS dims, round(list_inner_product(CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[1:16] AS DOUBLE[])), 5) AS energy FROM embeddings")
def v_truncate(t):
    e = V.truncate(F.col("embedding"), 16)
    return t.embeddings.select("vec_id", F.size(e).cast("long").alias("dims"), F.round(V.dot(e, e), 5).alias("energy"))


@query("v_mmr_diversity")
def v_mmr(t):
    return S.search_with_diversity(t.embeddings, Q, 10, 0.5).select("vec_id", "rank", F.round("score", 6).alias("score"))


@query("v_partitioned_index")
def v_ivf(t):
    return _top(S.PartitionedIndex.build(t.embeddings, 16).search(Q, 10))


@query("v_partition_radii")
def v_radii(t):
    return S.PartitionedIndex.build(t.embeddings, 16).split_large(100).radii().select("cluster", "members", F.round("radius", 5).alias("radius"))


@query("v_validate_points", "SELECT vec_id, 'duplicate id' AS reason FROM embeddings WHERE vec_id < 5 UNION ALL SELECT vec_id, 'dimension mismatch' FROM embeddings WHERE vec_id BETWEEN 10 AND 12")
def v_validate(t):
    e = t.embeddings
    new = e.where("vec_id < 5").unionByName(e.where("vec_id between 10 and 12").withColumn("embedding", F.slice("embedding", 1, 8)))
    return S.validate_points(new, e.where("vec_id < 5"), 64)


# -- fusion ----------------------------------------------------------------------------

_LISTS = """r AS (SELECT 'vector' AS modality, p_partkey AS id, p_retailprice AS score, p_brand AS title FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'fts', p_partkey, p_size * 10.0, p_brand FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'graph', p_partkey, p_partkey % 97 + 0.5, p_brand FROM part WHERE p_partkey % 5 = 0)"""


def lists(t):
    p = t.part
    one = lambda name, test, score: p.where(test).select(F.lit(name).alias("modality"), F.col("p_partkey").alias("id"), score.cast("double").alias("score"), F.col("p_brand").alias("title"))
    return one("vector", "p_partkey % 3 = 0", F.col("p_retailprice")).unionByName(one("fts", "p_partkey % 4 = 0", F.col("p_size") * 10.0)).unionByName(one("graph", "p_partkey % 5 = 0", F.col("p_partkey") % 97 + 0.5))


@query("u_weighted_fusion", f"WITH {_LISTS}, m AS (SELECT *, score / max(score) OVER (PARTITION BY modality) * CASE modality WHEN 'vector' THEN 0.4 WHEN 'fts' THEN 0.3 ELSE 0.2 END AS s FROM r) SELECT id, round(sum(s), 6) AS score, count(*) AS sources FROM m GROUP BY 1")
def u_weighted(t):
    return U.weighted_fusion(lists(t)).select("id", F.round("score", 6).alias("score"), "sources")


@query("u_reciprocal_rank_fusion", f"WITH {_LISTS}, k AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY score DESC, id) AS rank FROM r) SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score FROM k GROUP BY 1")
def u_rrf(t):
    return U.ranked_fusion(lists(t)).select("id", F.round("score", 8).alias("score"))


@query("u_intersect_fusion", f"WITH {_LISTS} SELECT id, count(DISTINCT modality) AS sources, round(sum(score), 4) AS score FROM r GROUP BY 1 HAVING count(DISTINCT modality) >= 2")
def u_intersect(t):
    return U.intersect_fusion(lists(t)).select("id", "sources", F.round("score", 4).alias("score"))


@query("u_union_fusion_ordered", f"""WITH {_LISTS}, p AS (SELECT id, max(CASE modality WHEN 'fts' THEN score END) AS a, max(CASE modality WHEN 'vector' THEN score END) AS b, max(CASE modality WHEN 'graph' THEN score END) AS c FROM r GROUP BY 1),
s AS (SELECT id, c, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) * 1.2 ELSE coalesce(a, b) END AS ab FROM p) SELECT id, round(CASE WHEN ab IS NOT NULL AND c IS NOT NULL THEN greatest(ab, c) * 1.2 ELSE coalesce(ab, c) END, 4) AS score FROM s""")
def u_union(t):
    return U.union_fusion(lists(t), ["fts", "vector", "graph"]).select("id", F.round("score", 4).alias("score"))


@query("u_context_boosts", "SELECT p_partkey, round(p_retailprice * (1 + 0.3 * (p_size / 50.0)) * (1 + 0.2 * coalesce(CASE WHEN p_size > 25 THEN 1.0 END, 0)) * 1.05, 2) AS score FROM part")
def u_boost(t):
    return t.part.select("p_partkey", F.round(U.context_boost(F.col("p_retailprice"), F.col("p_size") / 50.0, F.when(F.col("p_size") > 25, 1.0), F.lit(0.1)), 2).alias("score"))


@query("u_diversify_titles", f"WITH {_LISTS} SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY score DESC, id) AS n FROM r WHERE modality = 'vector') WHERE n <= 2")
def u_diversify(t):
    return U.diversify(lists(t).where("modality = 'vector'")).select("id", "title")


@query("u_rerank_vector_graph", "WITH r AS (SELECT p_partkey AS id, p_retailprice AS similarity, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS distance FROM part), k AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS v, row_number() OVER (ORDER BY coalesce(distance, 999), id) AS g FROM r) SELECT id, round(0.7 / (60 + v) + 0.3 / (60 + g), 8) AS score FROM k")
def u_rerank(t):
    r = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("similarity"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("distance"))
    return U.rerank_vector_graph(r).select("id", F.round("score", 8).alias("score"))


@query("u_min_max", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER (PARTITION BY p_brand)) / (max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand)), 6) AS s FROM part")
def u_minmax(t):
    return t.part.select("p_partkey", F.round(U.min_max("p_retailprice", ["p_brand"]), 6).alias("s"))


@query("u_hybrid_full_outer", f"WITH {_LISTS}, v AS (SELECT id, score / max(score) OVER () AS v FROM r WHERE modality = 'vector'), l AS (SELECT id, score / max(score) OVER () AS l FROM r WHERE modality = 'fts') SELECT id, round(coalesce(v, 0) * 0.6 + coalesce(l, 0) * 0.4, 6) AS score FROM v FULL JOIN l USING (id) ORDER BY round(coalesce(v, 0) * 0.6 + coalesce(l, 0) * 0.4, 9) DESC, id LIMIT 25")
def u_hybrid(t):
    r = lists(t)
    return U.hybrid_max_fusion(r.where("modality = 'vector'"), r.where("modality = 'fts'"), 25, 0.6).select("id", F.round("score", 6).alias("score"))


@query("u_three_signal_fusion", f"""WITH {_LISTS}, n AS (SELECT modality, id, (score - min(score) OVER (PARTITION BY modality)) / greatest(max(score) OVER (PARTITION BY modality) - min(score) OVER (PARTITION BY modality), 0.001) AS s FROM r),
p AS (SELECT id, max(CASE modality WHEN 'fts' THEN s END) AS l, max(CASE modality WHEN 'vector' THEN s END) AS v, max(CASE modality WHEN 'graph' THEN s END) AS g FROM n GROUP BY 1) SELECT id, round(0.2 * coalesce(l, 0) + 0.4 * coalesce(v, 0) + 0.4 * coalesce(g, 0), 6) AS score FROM p WHERE l IS NOT NULL OR v IS NOT NULL""")
def u_signals(t):
    r = lists(t)
    return U.fuse_signals(*(r.where(f"modality = '{m}'") for m in ("fts", "vector", "graph"))).select("id", F.round("score", 6).alias("score"))


def web(t):
    """Customers and suppliers as nodes, orders as edges."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").cast("long").alias("source"), (F.col("l_suppkey") + 1_000_000).cast("long").alias("target")).agg((F.count("*") / 100).alias("weight"), F.min(F.when(F.col("l_returnflag") == "R", "causal").otherwise("temporal")).alias("kind"))


_WEB = "e AS (SELECT o_custkey AS source, l_suppkey + 1000000 AS target, count(*) / 100 AS weight, min(CASE WHEN l_returnflag = 'R' THEN 'causal' ELSE 'temporal' END) AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query("u_graph_signals", f"""WITH {_WEB}, b AS (SELECT source, target, weight, kind FROM e UNION ALL SELECT target, source, weight, kind FROM e), c AS (SELECT i AS id FROM range(30, 50) r(i)),
o AS (SELECT source AS id, count(DISTINCT target) AS degree, avg(weight) AS avg_weight, count(DISTINCT CASE WHEN target IN (SELECT id FROM c) THEN target END) AS candidate_links, count(*) FILTER (kind = 'temporal') AS temporal, count(*) FILTER (kind = 'causal') AS causal FROM b WHERE source IN (SELECT id FROM c) GROUP BY 1),
h AS (SELECT source AS id, target AS n, weight AS w FROM b WHERE source IN (SELECT id FROM c)), h2 AS (SELECT h.id, b.target AS n, h.w * b.weight AS w FROM h JOIN b ON h.n = b.source WHERE b.target <> h.id),
r AS (SELECT id, count(DISTINCT n) AS reach, avg(w) AS apw FROM (SELECT * FROM h UNION ALL SELECT * FROM h2) GROUP BY 1)
SELECT c.id, coalesce(degree, 0) AS degree, coalesce(candidate_links, 0) AS candidate_links, coalesce(reach, 0) AS reach, round(coalesce(avg_weight, 0), 6) AS avg_weight, round(coalesce(apw, 0), 6) AS avg_path_weight,
 round(0.15 * least(coalesce(degree, 0) / 20.0, 1) + 0.25 * 0.5 + 0.2 * coalesce(avg_weight, 0) + 0.15 * coalesce(apw, 0) + 0.15 * least(coalesce(candidate_links, 0) / 10.0, 1) + 0.05 * least(coalesce(temporal, 0), 1) + 0.05 * least(coalesce(causal, 0), 1), 5) AS relevance
FROM c LEFT JOIN o USING (id) LEFT JOIN r USING (id)""")
def u_graph(t):
    c = t.spark.range(30, 50)
    s = U.graph_signals(c, web(t), c.select("id", F.lit(0.5).alias("centrality")))
    return s.select("id", "degree", "candidate_links", "reach", F.round("avg_weight", 6).alias("avg_weight"), F.round("avg_path_weight", 6).alias("avg_path_weight"), F.round(U.graph_relevance(), 5).alias("relevance"))


@query("u_context_propagation", f"""WITH {_WEB}, r AS (SELECT i AS id, (i * 37 % 101) / 101.0 AS score FROM range(30, 80) r(i)), b AS (SELECT source, target, weight FROM e UNION ALL SELECT target, source, weight FROM e),
a AS (SELECT id FROM r ORDER BY round(score, 9) DESC, id LIMIT 10), g AS (SELECT target AS id, sum(coalesce(weight * 0.15, 0.1)) AS gain FROM b WHERE source IN (SELECT id FROM a) GROUP BY 1)
SELECT id, round(least(score + coalesce(gain, 0), 1.0), 6) AS score FROM r LEFT JOIN g USING (id)""")
def u_propagate(t):
    r = t.spark.range(30, 80).select("id", (F.col("id") * 37 % 101 / 101.0).alias("score"))
    return U.propagate(r, web(t)).select("id", F.round("score", 6).alias("score"))


@query("u_multi_modal_plan", f"SELECT id, score, 'relationship' AS intent FROM ({SQL['u_weighted_fusion']}) ORDER BY score DESC, id LIMIT 50")
def u_plan(t):
    plan = U.classify_query("how is part 3 related to part 6")
    fused = U.fuse(lists(t), plan["strategy"])
    return fused.select("id", F.round("score", 6).alias("score"), F.lit(plan["intent"]).alias("intent")).orderBy(F.desc("score"), "id").limit(50)


@query("u_multi_modal_search", f"""WITH {_LISTS}, m AS (SELECT *, score / max(score) OVER (PARTITION BY modality) * CASE modality WHEN 'vector' THEN 0.4 ELSE 0.2 END AS s FROM r WHERE modality <> 'fts'),
f AS (SELECT id, min(title) AS title, sum(s) AS score FROM m GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY score DESC, id) AS n FROM f) SELECT id, title, round(score, 6) AS score FROM n WHERE n <= 2""")
def u_multi(t):
    """A question of relationship: paths (none are given here), the graph and vectors, weighted, two of a title; lexical search has no part in it."""
    found = lambda name: lambda params, names: lists(t).where(F.col("modality") == name)
    out, _ = U.multi_modal_search('how is "Part 3" related to "Part 6"', {n: found(n) for n in ("vector", "fts", "graph")})
    return out.select("id", "title", F.round("score", 6).alias("score"))
