"""Aggregates, joins, windows, set operations and co-occurrence on the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import transforms as X
from tessera.operators import cooccurrence as C
from tessera.operators import graph_metrics as G
from tessera.operators import records as R
from tessera.operators.temporal import as_of_join
from tessera.plans.registry import query


@query("a_binding_aggregates", """SELECT c_custkey, coalesce(sum(o_totalprice), 0) AS total, coalesce(avg(o_totalprice), 0) AS mean, count(o_orderkey) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most
FROM (SELECT c_custkey, o_orderkey, round(o_totalprice) AS o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey) GROUP BY 1""".replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)").replace("avg(o_totalprice)", "round(avg(o_totalprice), 2)"))
def a_bind(t):
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("v", F.round("o_totalprice"))
    v = F.col("v")
    return rows.groupBy("c_custkey").agg(F.round(X.agg_sum(v), 2).alias("total"), F.round(X.agg_avg(v), 2).alias("mean"), X.agg_count(F.col("o_orderkey")).alias("n"), X.agg_min(v).alias("least"), X.agg_max(v).alias("most"))


@query("a_concat_in_order", "SELECT o_custkey, string_agg(o_orderstatus, ', ' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1")
def a_concat(t):
    return t.orders.groupBy("o_custkey").agg(X.agg_concat(F.col("o_orderstatus"), F.col("o_orderkey")).alias("s"))


@query("a_aggregation_types", "SELECT * FROM (VALUES ('text', 'concat,count'), ('number', 'avg,concat,count,max,min,sum')) v(field_type, available)")
def a_types(t):
    return t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("field_type"), F.lit(",".join(X.available_aggregations(k))).alias("available")) for k in ("text", "number")])))


@query("a_grouped_count_desc", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 50")
def a_count(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(50)


@query("a_count_by_kind", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a_kind(t):
    return G.counts_by(t.events, "event_type")


@query("a_three_counts_joined", """SELECT r_regionkey, n.c AS nations, cu.c AS customers, su.c AS suppliers FROM region
JOIN (SELECT n_regionkey, count(*) c FROM nation GROUP BY 1) n ON n_regionkey = r_regionkey
JOIN (SELECT n_regionkey, count(*) c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) cu ON cu.n_regionkey = r_regionkey
JOIN (SELECT n_regionkey, count(*) c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) su ON su.n_regionkey = r_regionkey""")
def a_three(t):
    n = t.nation
    a = n.groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    b = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("customers"))
    c = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("suppliers"))
    return t.region.select("r_regionkey", F.col("r_regionkey").alias("n_regionkey")).join(a, "n_regionkey").join(b, "n_regionkey").join(c, "n_regionkey").drop("n_regionkey")


@query("a_union_of_counts", "SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def a_union(t):
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "n")
    return one(t.customer, "customer").unionByName(one(t.supplier, "supplier")).unionByName(one(t.part, "part"))


@query("a_collect_distinct", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS suppliers FROM lineitem GROUP BY 1")
def a_collect(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


@query("a_confidence_recalculated", """WITH p AS (SELECT o_custkey AS rel_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'MANUAL' WHEN '2-HIGH' THEN 'LLM_EXTRACTION' WHEN '3-MEDIUM' THEN 'CO_OCCURRENCE' ELSE 'OTHER' END AS source, (o_orderkey % 10) / 10.0 AS confidence FROM orders),
w AS (SELECT *, CASE source WHEN 'MANUAL' THEN 1.0 WHEN 'LLM_EXTRACTION' THEN 0.7 WHEN 'CO_OCCURRENCE' THEN 0.4 ELSE 0.5 END AS w FROM p)
SELECT rel_id, round(least(sum(confidence * w) / sum(w), 1.0), 6) AS confidence FROM w GROUP BY 1""")
def a_conf(t):
    s = F.col("o_orderpriority")
    p = t.orders.select(F.col("o_custkey").alias("rel_id"), F.when(s == "1-URGENT", "MANUAL").when(s == "2-HIGH", "LLM_EXTRACTION").when(s == "3-MEDIUM", "CO_OCCURRENCE").otherwise("OTHER").alias("source"), ((F.col("o_orderkey") % 10) / 10).alias("confidence"))
    return R.recalculate_confidence(p).withColumn("confidence", F.round("confidence", 6))


@query("a_metadata_layer", """WITH s AS (SELECT l_partkey AS entity_id, l_orderkey AS doc_id, l_linenumber AS start FROM lineitem),
f AS (SELECT entity_id, count(*) AS frequency, min(struct_pack(a := doc_id, b := start)) AS f, count(DISTINCT doc_id) AS docs FROM s GROUP BY 1)
SELECT entity_id, frequency, f.a AS first_doc, f.b AS first_pos, docs, round(frequency / max(frequency) OVER (), 6) AS importance FROM f""")
def a_meta(t):
    s = t.lineitem.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"))
    return R.metadata_layer(s).withColumn("importance", F.round("importance", 6))


@query("a_backlinks_for_note", "SELECT l_partkey, l_suppkey, count(*) AS n, round(avg(l_quantity), 4) AS relevance, min(l_linenumber) AS first_position, max(l_linenumber) AS last_position FROM lineitem GROUP BY 1, 2")
def a_back(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("relevance"), F.min("l_linenumber").alias("first_position"), F.max("l_linenumber").alias("last_position"))


@query("a_distinct_counts", "SELECT l_suppkey, count(*) AS mentions, count(DISTINCT l_orderkey) AS notes FROM lineitem GROUP BY 1")
def a_distinct(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("mentions"), F.countDistinct("l_orderkey").alias("notes"))


@query("a_enforce_uniqueness", """SELECT 'tag:' || lower(l_returnflag || l_linestatus) || '' AS key, CAST(count(*) AS BIGINT) AS positions, max(l_shipdate) AS last_seen_at FROM lineitem GROUP BY 1""")
def a_unique(t):
    refs = t.lineitem.select(F.lit("tag").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("target"), F.lit(None).cast("string").alias("entity_kind"), F.lit(None).cast("string").alias("scope_path"), F.lit(None).cast("string").alias("predicate"), F.col("l_orderkey").cast("string").alias("source_note_id"), F.array("l_linenumber").alias("positions"), F.col("l_shipdate").alias("last_seen_at"))
    return R.enforce_uniqueness(refs).select("key", F.size("positions").cast("long").alias("positions"), "last_seen_at")


@query("a_embedding_sync_stats", "SELECT label, count(*) AS total, count(*) FILTER (vec_id % 3 = 0) AS synced FROM embeddings GROUP BY 1")
def a_sync(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("total"), F.count(F.when(F.col("vec_id") % 3 == 0, 1)).alias("synced"))


@query("a_global_stats", "SELECT count(*) AS nodes, count(DISTINCT p_brand) AS kinds, CAST(sum(p_size) AS BIGINT) AS mentions FROM part")
def a_global(t):
    return t.part.agg(F.count("*").alias("nodes"), F.countDistinct("p_brand").alias("kinds"), F.sum("p_size").alias("mentions"))


# -- joins -----------------------------------------------------------------------------


@query("j_natural_join_distinct", "SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def j_natural(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()


@query("j_four_way_contexts", "SELECT l_orderkey, l_linenumber, p_name, o_orderdate, c_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE p_partkey = 7")
def j_four(t):
    return t.lineitem.where("l_partkey = 7").join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "p_name", "o_orderdate", "c_name")


_EDGES = """e AS (SELECT l_suppkey AS source, l_partkey AS target, count(*) AS weight FROM lineitem GROUP BY 1, 2)"""


def supply(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count("*").alias("weight"))


@query("j_top_edges_both_ends", f"WITH {_EDGES} SELECT s_name, p_name, weight FROM e JOIN supplier ON source = s_suppkey JOIN part ON target = p_partkey ORDER BY weight DESC, source, target LIMIT 25")
def j_top(t):
    return supply(t).join(t.supplier, F.col("source") == F.col("s_suppkey")).join(t.part, F.col("target") == F.col("p_partkey")).orderBy(F.desc("weight"), "source", "target").limit(25).select("s_name", "p_name", "weight")


@query("j_self_join_sentence", "SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 AND a.l_partkey < b.l_partkey")
def j_sentence(t):
    m = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("a"))
    return m.join(m.select("l_orderkey", (F.col("n") - 1).alias("n"), F.col("a").alias("b")), ["l_orderkey", "n"]).where("a < b").select("a", "b").distinct()


def mentions(t):
    return t.lineitem.select(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("sentence_index"))


@query("c_pairs_in_episode", "SELECT a.l_orderkey AS episode_id, a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey < b.l_partkey")
def c_episode(t):
    return C.pairs_in(mentions(t), ["episode_id"])


_WINDOW = "p AS (SELECT a.l_orderkey AS episode_id, a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 2 AND a.l_partkey < b.l_partkey)"


@query("c_pairs_in_window_band_join", f"WITH {_WINDOW} SELECT * FROM p")
def c_window(t):
    return C.pairs_in_window(mentions(t), 3)


@query("c_aggregate_pairs", f"WITH {_WINDOW} SELECT a, b, count(*) AS weight, array_to_string(list_sort(list(episode_id)), ',') AS episodes FROM p GROUP BY 1, 2")
def c_aggregate(t):
    return C.aggregate_pairs(C.pairs_in_window(mentions(t), 3)).select("a", "b", "weight", F.array_join(F.transform("episode_ids", lambda e: e.cast("string")), ",").alias("episodes"))


_PMI = f"""WITH {_WINDOW}, g AS (SELECT a, b, count(*) AS w FROM p GROUP BY 1, 2), s AS (SELECT * FROM g WHERE w >= 1), f AS (SELECT l_partkey AS k, count(*) AS f FROM lineitem GROUP BY 1), t AS (SELECT sum(w) AS t FROM s)
SELECT a, b, w AS weight, round(ln((w / t) / ((fa.f / t) * (fb.f / t))), 6) AS pmi_score FROM s JOIN f fa ON a = fa.k JOIN f fb ON b = fb.k, t"""


@query("c_cooccurrence_graph_pmi", _PMI)
def c_pmi(t):
    m = mentions(t)
    f = m.groupBy("entity_id").agg(F.count("*").alias("frequency"))
    return C.build_graph(m, f, window=3, least_weight=1).select("a", "b", "weight", F.round("pmi_score", 6).alias("pmi_score"))


@query("c_edges_by_weight_and_pmi", f"SELECT * FROM ({_PMI}) WHERE weight >= 1 AND pmi_score >= 3 ORDER BY weight DESC, pmi_score DESC, a, b LIMIT 100")
def c_top(t):
    return c_pmi(t).where("weight >= 1 AND pmi_score >= 3").orderBy(F.desc("weight"), F.desc("pmi_score"), "a", "b").limit(100)


_TOK = r"""w AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS ts FROM documents))"""


def terms(t):
    w = t.documents.select("doc_id", F.posexplode(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)).alias("pos", "term"))
    return w


def known_terms(t):
    """Places of the entities: the 200 most frequent terms of six letters and more."""
    w = terms(t)
    top = w.where(F.length("term") >= 6).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(200)
    return w.join(F.broadcast(top.select("term")), "term", "left_semi")


@query("c_word_window", f"WITH {_TOK}, k AS (SELECT term FROM w WHERE length(term) >= 6 GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 200), e AS (SELECT * FROM w WHERE term IN (SELECT term FROM k)) SELECT l.doc_id, l.term AS a, r.term AS b, greatest(1, 5 - (r.pos - l.pos) + 1) AS weight FROM e l JOIN e r ON l.doc_id = r.doc_id AND r.pos > l.pos AND r.pos - l.pos <= 5 AND l.term <> r.term")
def c_words(t):
    return C.word_window(known_terms(t), 5)


@query("c_aggregate_word_edges", f"WITH {_TOK}, k AS (SELECT term FROM w WHERE length(term) >= 6 GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 200), e AS (SELECT * FROM w WHERE term IN (SELECT term FROM k)), p AS (SELECT l.doc_id, l.term AS a, r.term AS b, greatest(1, 5 - (r.pos - l.pos) + 1) AS weight FROM e l JOIN e r ON l.doc_id = r.doc_id AND r.pos > l.pos AND r.pos - l.pos <= 5 AND l.term <> r.term) SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT doc_id) AS episodes FROM p GROUP BY 1, 2")
def c_word_edges(t):
    return C.aggregate_edges(c_words(t)).select("a", "b", "weight", F.size("episode_ids").cast("long").alias("episodes"))


@query("c_mask_overlap", "WITH m AS (SELECT l_orderkey AS s, l_partkey AS e, CAST(1 + l_linenumber % 3 AS BIGINT) AS mask, CAST(l_quantity AS DOUBLE) AS idf FROM lineitem) SELECT a.s AS sentence_id, a.e AS a, b.e AS b, CAST(bit_count(a.mask & b.mask) AS BIGINT) AS overlap, round((a.idf + b.idf) / 2 * bit_count(a.mask & b.mask), 4) AS salience FROM m a JOIN m b ON a.s = b.s AND a.e < b.e AND (a.mask & b.mask) <> 0")
def c_mask(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("sentence_id"), F.col("l_partkey").alias("entity_id"), (1 + F.col("l_linenumber") % 3).cast("long").alias("mask"), F.col("l_quantity").cast("double").alias("idf"))
    return C.mask_cooccurrence(m).select("sentence_id", "a", "b", F.col("overlap").cast("long").alias("overlap"), F.round("salience", 4).alias("salience"))


@query("c_merge_across_scopes", "WITH e AS (SELECT l_suppkey % 10 AS a, l_partkey % 10 AS b, l_quantity AS weight, l_discount AS pmi_score, l_orderkey AS note FROM lineitem) SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(floor(avg(weight) + 0.5) AS BIGINT) AS weight, round(avg(pmi_score), 6) AS pmi_score, count(DISTINCT note) AS notes FROM e WHERE a <> b GROUP BY 1, 2")
def c_merge(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b"), F.col("l_quantity").alias("weight"), F.col("l_discount").alias("pmi_score"), F.array("l_orderkey").alias("note_ids"))
    ids = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    mapping = ids.select("id", (F.when(F.col("id") >= 1_000_000, F.col("id") - 1_000_000).otherwise(F.col("id")) % 10).alias("to"))
    return C.merge_across_scopes(e, mapping, "average").select("a", "b", "weight", F.round("pmi_score", 6).alias("pmi_score"), F.size("note_ids").cast("long").alias("notes"))


@query("c_increment_weight", "WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS w, list(l_orderkey) AS es FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), s AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS w, list(l_orderkey) AS es FROM lineitem WHERE l_linenumber = 3 GROUP BY 1, 2) SELECT coalesce(e.a, s.a) AS a, coalesce(e.b, s.b) AS b, coalesce(e.w, 0) + coalesce(s.w, 0) AS weight, CAST(len(list_distinct(list_concat(coalesce(e.es, []), coalesce(s.es, [])))) AS BIGINT) AS episodes FROM e FULL JOIN s ON e.a = s.a AND e.b = s.b")
def c_increment(t):
    li = t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_orderkey").alias("episode_id"), "l_linenumber")
    e = li.where("l_linenumber <= 2").groupBy("a", "b").agg(F.count("*").alias("weight"), F.collect_list("episode_id").alias("episode_ids"))
    return C.increment_weight(e, li.where("l_linenumber = 3")).select("a", "b", "weight", F.size("episode_ids").cast("long").alias("episodes"))


@query("c_edge_key", "SELECT DISTINCT least(CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) || '--' || greatest(CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS k FROM lineitem")
def c_key(t):
    return t.lineitem.select(C.edge_key(F.col("l_suppkey"), F.col("l_partkey")).alias("k")).distinct()


@query("c_term_graph_edges", f"WITH {_TOK}, k AS (SELECT term FROM w WHERE length(term) >= 6 GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 200), d AS (SELECT DISTINCT doc_id, term FROM w WHERE term IN (SELECT term FROM k)) SELECT l.term AS a, r.term AS b, count(*) AS weight FROM d l JOIN d r ON l.doc_id = r.doc_id AND l.term < r.term GROUP BY 1, 2")
def c_terms(t):
    return C.term_graph(known_terms(t))[1]


@query("c_causal_links")
def c_causal(t):
    w = F.split("text", r"\W+")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
    docs = t.documents.select("doc_id", F.concat(F.lit("The "), at(0), F.lit(" of old caused much "), at(1), F.lit(".\n"), F.col("text")).alias("text"), at(0).alias("a"), at(1).alias("b"))
    events = docs.select("doc_id", F.inline(F.array(F.struct(F.lit(1).alias("event_id"), F.col("a").alias("name")), F.struct(F.lit(2).alias("event_id"), F.col("b").alias("name")))))
    return C.causal_links(docs, events)


@query("j_anti_join_orphans", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def j_anti(t):
    return t.part.join(t.lineitem.where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


_INTEGRITY = """WITH e AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0), ed AS (SELECT s_suppkey AS edge_id, s_suppkey AS source, s_suppkey + 1 AS target FROM supplier), m AS (SELECT o_orderkey AS mention_id, o_custkey AS entity_id FROM orders)
SELECT 'orphan_entity' AS issue, CAST(id AS VARCHAR) AS id FROM e WHERE id NOT IN (SELECT entity_id FROM m)
UNION SELECT 'dangling_edge', CAST(edge_id AS VARCHAR) FROM ed WHERE source NOT IN (SELECT id FROM e) OR target NOT IN (SELECT id FROM e)
UNION SELECT 'dangling_mention', CAST(mention_id AS VARCHAR) FROM m WHERE entity_id NOT IN (SELECT id FROM e)"""


def _integrity(t):
    e = t.part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"))
    ed = t.supplier.select(F.col("s_suppkey").alias("edge_id"), F.col("s_suppkey").alias("source"), (F.col("s_suppkey") + 1).alias("target"))
    return e, ed, t.orders.select(F.col("o_orderkey").alias("mention_id"), F.col("o_custkey").alias("entity_id"))


@query("j_integrity_check", _INTEGRITY)
def j_integrity(t):
    return R.integrity(*_integrity(t))


@query("j_integrity_repair", "WITH e AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0 AND p_partkey IN (SELECT o_custkey FROM orders)) SELECT s_suppkey AS edge_id FROM supplier WHERE s_suppkey IN (SELECT id FROM e) AND s_suppkey + 1 IN (SELECT id FROM e)")
def j_repair(t):
    return R.repair(*_integrity(t))[1].select("edge_id")


@query("j_semi_join_both_ends", f"WITH {_EDGES} SELECT source, target, weight FROM e WHERE source IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND target IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def j_semi(t):
    return supply(t).join(t.supplier.where("s_nationkey < 5").select(F.col("s_suppkey").alias("source")), "source", "left_semi").join(t.part.where("p_size < 10").select(F.col("p_partkey").alias("target")), "target", "left_semi").select("source", "target", "weight")


@query("j_connected_with_direction", f"WITH {_EDGES} SELECT target AS other, 'out' AS direction FROM e WHERE source = 3 UNION ALL SELECT source, 'in' FROM e WHERE target = 3")
def j_connected(t):
    e = supply(t)
    return e.where("source = 3").select(F.col("target").alias("other"), F.lit("out").alias("direction")).unionByName(e.where("target = 3").select(F.col("source").alias("other"), F.lit("in").alias("direction")))


@query("j_siblings", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def j_siblings(t):
    n = t.nation
    return n.select("n_regionkey", F.col("n_nationkey").alias("a")).join(n.select("n_regionkey", F.col("n_nationkey").alias("b")), "n_regionkey").where("a <> b").select("a", "b")


@query("j_range_join_on_offset", "SELECT a.l_orderkey AS note_id, a.l_linenumber AS position, list_sort(list(DISTINCT b.l_partkey))[1] AS first_entity, count(DISTINCT b.l_partkey) AS near FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 1 WHERE a.l_returnflag = 'R' GROUP BY 1, 2")
def j_range(t):
    temporal = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("position"), F.lit("r").alias("text"), F.lit(None).cast("timestamp").alias("ts")).distinct()
    ents = t.lineitem.select(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("position"))
    return R.timeline(temporal, ents, 1).select("note_id", "position", F.element_at("entities", 1).alias("first_entity"), F.size("entities").cast("long").alias("near"))


@query("j_as_of_backward", "WITH p AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') SELECT c.event_id, p.value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def j_asof(t):
    c = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    p = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), "value")
    return as_of_join(c, p, ["user_id"], "ts", "p_ts", ["value"]).select("event_id", "value")


@query("j_as_of_forward", "WITH p AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') SELECT c.event_id, p.value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts <= p.ts")
def j_asof_forward(t):
    c = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    p = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), "value")
    return as_of_join(c, p, ["user_id"], "ts", "p_ts", ["value"], forward=True).select("event_id", "value")


@query("j_hydrate_top_k", "SELECT p_partkey, p_name, n FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20) JOIN part ON l_partkey = p_partkey")
def j_hydrate(t):
    top = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)
    return top.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_name", "n")


@query("j_scope_mapping", "SELECT s_suppkey AS id, CASE WHEN k.id IS NULL THEN 'n' || ':' || replace(lower(trim(s_name)), ' ', '_') ELSE CAST(k.id AS VARCHAR) END AS \"to\", k.id IS NULL AS created FROM supplier LEFT JOIN (SELECT s_suppkey AS id, lower(s_name) AS n FROM supplier WHERE s_suppkey % 2 = 0) k ON lower(s_name) = k.n")
def j_scope(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("N").alias("kind"))
    return R.map_scope(s, s.where("id % 2 = 0"))


@query("j_matching_event", "SELECT n_name AS text, min(r_regionkey) AS event_id FROM nation LEFT JOIN region ON contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name)) GROUP BY 1")
def j_event(t):
    return R.find_matching_event(t.nation.select(F.col("n_name").alias("text")), t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("event_id")))


# -- windows and sets ------------------------------------------------------------------


@query("w_rank_after_sort", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def w_rank(t):
    return t.customer.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("rank"))


@query("w_per_group_cap", "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 2")
def w_cap(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("n", F.row_number().over(w)).where("n <= 2").select("c_custkey", "c_nationkey")


@query("w_previous_value", "SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events".replace("value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)", "round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6)"))
def w_lag(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


@query("w_group_max_normalise", "SELECT vec_id, round(label / (max(label) OVER () + 1.0), 6) AS v FROM embeddings")
def w_max(t):
    return t.embeddings.select("vec_id", F.round(F.col("label") / (F.max("label").over(Window.partitionBy()) + 1.0), 6).alias("v"))


@query("w_recency_pointer", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events")
def w_recency(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("signup"))


@query("w_multi_key_page", "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def w_page(t):
    return t.orders.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("w_latest_row", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def w_latest(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("o_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey FROM nation")
def o_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).union(t.nation.select("n_regionkey")).distinct()


@query("o_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 3")
def o_intersect(t):
    return t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("k")).intersect(t.lineitem.where("l_quantity < 3").select("l_partkey"))


@query("o_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def o_except(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_totalprice > 100000").select("o_custkey"))


@query("o_array_union", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))), '') AS u FROM lineitem GROUP BY 1")
def o_array(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.array_union(F.collect_list("l_returnflag"), F.collect_list("l_linestatus"))), "").alias("u"))
