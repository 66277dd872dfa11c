"""Stored indexes, the search service, notes to a graph, and what else is composed of other operators."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import json_delta as J
from tessera.functions import vectors as V
from tessera.functions.ranking import estimate_capacity
from tessera.operators import cooccurrence as C
from tessera.operators import bindings, extraction, fusion, rag, records, scanning
from tessera.operators.service import SearchService, expanded_search
from tessera.operators.traversal import relatives, shared_dir
from tessera.operators.vector_search import PartitionedIndex
from tessera.plans.documents import _MARKED, TERMS, _fields, _score_sql, _top, marked
from tessera.plans.graphs import tree
from tessera.plans.registry import query
from tessera.plans.searches import Q
from tessera.sources import indexes as X
from tessera.sources import tables as S
from tessera.streaming import cdc as M


def folder(t, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(t.spark)}/indexes/{name}-{uuid.uuid4().hex}"


def stored(t) -> X.TextIndex:
    path = folder(t, "texts")
    X.save_text_index(t.documents, "doc_id", _fields(), path)
    return X.open_text_index(t.spark, path)


@query("b_search_stored_index", _score_sql(TERMS))
def b_stored(t):
    return _top(stored(t).search(TERMS, 20))


@query("b_stored_term_statistics", "WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2))) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY 1")
def b_stored_terms(t):
    return stored(t).terms.select("term", "df")


def service(t) -> SearchService:
    nodes = t.documents.select(F.col("doc_id").alias("id"), "lang", "source")
    points = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    n = t.lineitem.groupBy(F.col("l_suppkey").cast("long").alias("source"), F.col("l_partkey").cast("long").alias("target"))
    edges = n.agg((F.count("*") / 10).alias("weight"), F.min(F.when(F.col("l_returnflag") == "R", "causal").otherwise("temporal")).alias("kind")).where("source <> target")
    degree = edges.groupBy(F.col("source").alias("id")).agg((F.count("*") / 1000).alias("centrality"))
    return SearchService(nodes, stored(t), points, edges, degree)


@query("u_service_lexical", f"SELECT doc_id AS id, score FROM ({_score_sql(TERMS)}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def u_lexical(t):
    return service(t).search("lexical", 10, terms=TERMS).select("id", F.round("score", 6).alias("score"))


@query("u_service_semantic_filtered", f"WITH q AS (SELECT {[float(x) for x in Q]} AS v) SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) DESC, vec_id LIMIT 10")
def u_semantic(t):
    return service(t).search("semantic", 10, vector=Q, where=F.col("lang") == "en").select("id", F.round("score", 6).alias("score"))


@query("u_service_hybrid")
def u_hybrid(t):
    return service(t).search("hybrid", 10, terms=TERMS, vector=Q).select("id", F.round("score", 6).alias("score"), "mode")


@query("u_expanded_search")
def u_expanded(t):
    points = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    mentions = t.lineitem.select(F.col("l_orderkey").alias("note_id"), F.col("l_partkey").cast("long").alias("entity_id"))
    edges = t.lineitem.select(F.col("l_suppkey").cast("long").alias("source"), F.col("l_partkey").cast("long").alias("target"), F.lit(1.0).alias("weight")).distinct()
    return expanded_search(points, Q, 10, mentions, edges).select("id", F.round("score", 9).alias("score"))


@query("v_saved_index_search")
def v_saved(t):
    path = folder(t, "vectors")
    X.save_vectors(PartitionedIndex.build(t.embeddings, 16), path)
    return X.open_vectors(t.spark, path).search(Q, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("v_index_upsert_and_split", "SELECT vec_id, count(*) AS n FROM embeddings GROUP BY 1")
def v_upsert(t):
    index = PartitionedIndex.build(t.embeddings, 8).upsert(t.embeddings.where("label = 3")).split_large(60)
    return index.assigned.groupBy("vec_id").agg(F.count("*").alias("n"))


@query("v_pooled_means", "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS last FROM embeddings GROUP BY 1")
def v_pool(t):
    pooled = t.embeddings.groupBy("label").agg(F.collect_list("embedding").alias("vs")).select("label", V.pool(F.col("vs"), "mean").alias("p"))
    return pooled.select("label", F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(F.get("p", F.lit(63)), 6).alias("last"))


@query("e_saved_tree", "SELECT 0 AS level, count(*) AS nodes FROM embeddings")
def e_saved(t):
    path = folder(t, "tree")
    leaves = t.embeddings.select(F.col("vec_id").cast("string").alias("chunk_id"), (F.col("vec_id") % 4).alias("group_id"), "embedding")
    X.save_tree(rag.build_tree(leaves, 5), path)
    return X.open_tree(t.spark, path).where("level = 0").groupBy("level").agg(F.count("*").alias("nodes"))


_ENTITIES = rf"""WITH {_MARKED}, e AS (SELECT unnest(regexp_extract_all(text, '\[([A-Z_]+)(?::([A-Z_]+))?\|([^|\]]+?)(?:\|(\{{[^}}]*\}}))?\]', 3)) AS label, 'CHARACTER' AS kind, '' AS subtype FROM m
UNION ALL SELECT unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|([^\]]+))?\]\]', 1)), 'CONCEPT', '' FROM m UNION ALL SELECT unnest(regexp_extract_all(text, '#([a-zA-Z0-9_-]+)', 1)), 'CONCEPT', 'TAG' FROM m)"""


@query("t_process_notes", _ENTITIES + " SELECT kind, subtype, lower(trim(label)) AS name, count(*) AS frequency FROM e GROUP BY 1, 2, 3")
def t_notes(t):
    return extraction.process_notes(marked(t))["entities"].select("kind", "subtype", F.lower("name").alias("name"), "frequency")


@query("t_process_notes_edges")
def t_note_edges(t):
    return extraction.process_notes(marked(t))["edges"].select("a", "b", "weight", F.round("pmi_score", 6).alias("pmi_score"))


@query("t_disambiguate")
def t_disambiguate(t):
    kind = F.element_at(F.array(*map(F.lit, extraction.KINDS)), F.pmod(F.col("p_partkey"), F.lit(15)).cast("int") + 1)
    name = t.part.orderBy("p_partkey").first()["p_name"]
    return extraction.disambiguate(t.part.select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("text")), name, f"The old {name} walked home.", 8).withColumn("score", F.round("score", 6))


@query("t_scan_triples", rf"""WITH {_MARKED}, d AS (SELECT doc_id, '[[' || coalesce(a[1], 'x') || 'y -> KNOWS -> ' || coalesce(a[2], 'x') || 'z]] ' || text AS text FROM w)
SELECT doc_id, unnest(regexp_extract_all(text, '\[\[\s*([^\[\]]+?)\s*->\s*([^\[\]]+?)\s*->\s*([^\[\]]+?)\s*\]\]', 1)) AS subject, unnest(regexp_extract_all(text, '\[\[\s*([^\[\]]+?)\s*->\s*([^\[\]]+?)\s*->\s*([^\[\]]+?)\s*\]\]', 3)) AS object FROM d""")
def t_triples(t):
    w = F.split("text", r"\W+")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
    return scanning.scan_triples(t.documents.select("doc_id", F.concat(F.lit("[["), at(0), F.lit("y -> KNOWS -> "), at(1), F.lit("z]] "), F.col("text")).alias("text"))).select("doc_id", "subject", "object")


@query("a_link_relevance", "SELECT p_partkey, round(0.6 * CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.3 ELSE 0.5 END + 0.4 * CASE WHEN length(p_name || p_type || p_brand) > 50 THEN 0.8 ELSE 0.5 END, 6) AS relevance FROM part")
def a_relevance(t):
    place = F.element_at(F.array(F.lit("title"), F.lit("heading"), F.lit("footnote"), F.lit("body")), (F.col("p_size") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", F.round(scanning.link_relevance(place, F.concat("p_name", "p_type", "p_brand")), 6).alias("relevance"))


@query("n_timeline_near_entities", "SELECT l.event_id AS position, count(r.event_id) AS entities FROM events l LEFT JOIN events r ON l.user_id = r.user_id AND r.event_type = 'purchase' AND abs(l.event_id - r.event_id) <= 200 GROUP BY 1")
def n_timeline(t):
    e = t.events.select(F.col("user_id").alias("note_id"), F.col("event_type").alias("text"), F.col("event_id").alias("position"), "ts")
    found = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("entity_id"), F.col("event_id").alias("position"))
    return records.timeline(e, found).select("position", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("entities")).withColumn("entities", F.greatest("entities", F.lit(0)))


@query("j_causal_links_named", "SELECT l_orderkey, l_linenumber, s_name AS source_name, p_name AS target_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
def j_named(t):
    links = t.lineitem.where("l_returnflag = 'R'").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"), "l_orderkey", "l_linenumber")
    names = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name")).unionByName(t.part.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name")))
    return C.named_links(links, names).select("l_orderkey", "l_linenumber", "source_name", "target_name")


@query("m_mention_queue", "WITH e AS (SELECT user_id AS entity_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS r FROM events) SELECT r // 100 AS batch, entity_id, count(*) AS n FROM e GROUP BY 1, 2")
def m_queue(t):
    return M.mention_batches(t.events.select("event_id", "ts", F.col("user_id").alias("entity_id")))


@query("s_hydrated_relations", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY 1")
def s_hydrate(t):
    S.hydrate(t.spark, t.sf_dir, ("customer", "nation"))
    return S.run_query(t.spark, "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY 1", least=100)


@query("k_overwrite_scope", "SELECT o_orderstatus AS group_id, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END) AS BIGINT) AS total FROM orders GROUP BY 1")
def k_scope(t):
    path = folder(t, "scopes")
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("group_id"))
    S.overwrite_scope(rows, path)
    S.overwrite_scope(rows.where("group_id = 'F'").withColumn("o_custkey", F.lit(0).cast("long")), path)
    return t.spark.read.parquet(path).groupBy("group_id").agg(F.sum("o_custkey").cast("long").alias("total"))


@query("e_job_queue", """WITH j AS (SELECT event_id, user_id AS node_id, ts, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 2 END AS level FROM events WHERE user_id % 7 <> 0),
l AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) AS n FROM j) SELECT node_id, event_id, row_number() OVER (ORDER BY level, ts, event_id) AS place FROM l WHERE n = 1 AND level IS NOT NULL""")
def e_queue(t):
    kind = F.col("event_type")
    priority = F.when(kind == "purchase", "high").when(kind == "signup", "normal").when(kind == "view", "low").when(kind == "click", "normal")
    jobs = t.events.select("event_id", F.col("user_id").alias("node_id"), "ts", priority.alias("priority"))
    busy = t.events.where("user_id % 7 = 0").select(F.col("user_id").alias("node_id"))
    return M.job_queue(jobs, busy, order=("ts", "event_id")).select("node_id", "event_id", "place")


def _enrolled(t):
    kind = F.element_at(F.array(F.lit("PARENT_OF"), F.lit("begat"), F.lit("other")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rels = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rel_id"), kind.alias("type"))
    rules = t.spark.range(1).select(F.lit("family").alias("schema_id"), F.lit("PARENT_OF").alias("code"), F.lit("parent").alias("label"), F.array(F.lit("begat")).alias("keywords"))
    return bindings.enrol(rels, rules, t.region.select(F.col("r_regionkey").alias("network_id"), F.lit("family").alias("schema_id")))


@query("n_bulk_enrolment", "SELECT l_orderkey * 10 + l_linenumber AS rel_id, r_regionkey AS network_id, CASE l_suppkey % 3 WHEN 0 THEN 1.0 ELSE 0.75 END AS confidence FROM lineitem, region WHERE l_suppkey % 3 < 2")
def n_enrolment(t):
    return _enrolled(t)[0].select("rel_id", "network_id", "confidence")


@query("n_enrolment_counts", "SELECT count(*) FILTER (l_suppkey % 3 < 2) AS enrolled, count(*) FILTER (l_suppkey % 3 = 2) AS skipped FROM lineitem")
def n_enrolment_counts(t):
    return _enrolled(t)[1]


@query("r_narrative_relatives", """SELECT s_suppkey + 1000 AS node, 2 AS depth, s_name AS name, 'supplier' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0
UNION ALL SELECT n_nationkey + 100, 1, n_name, 'nation' FROM nation WHERE n_regionkey = 0""")
def r_narrative(t):
    one = lambda df, key, name, plus, kind: df.select((F.col(key) + plus).cast("long").alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"))
    return relatives(tree(t), 1, one(t.nation, "n_nationkey", "n_name", 100, "nation").unionByName(one(t.supplier, "s_suppkey", "s_name", 1000, "supplier")))


@query("b_estimate_capacity", """WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT i AS terms, n, CASE WHEN n <= 100 THEN 155000.0 WHEN n <= 1000 THEN 8600.0 WHEN n <= 10000 THEN 437.0 ELSE 437.0 * 10000 / n END AS base FROM n, range(1, 6) r(i))
SELECT terms, round(base / terms ** 1.5, 3) AS max_qps, round(base / terms ** 1.5 / 2, 3) AS sustained_qps FROM k""")
def b_capacity(t):
    n = t.documents.count()
    found = [(k, estimate_capacity(n, k)) for k in range(1, 6)]
    return t.spark.createDataFrame([(k, round(c["max_qps"], 3), round(c["sustained_qps"], 3)) for k, c in found], "terms long, max_qps double, sustained_qps double")


@query("e_model_choice", r"SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) > 8 OR (SELECT count(*) FROM documents) < 1000 THEN 'medium' ELSE 'small' END AS model FROM documents")
def e_model(t):
    return t.documents.select("doc_id", fusion.model_for(F.col("text"), t.documents.count()).alias("model"))


@query("z_validate_binding", """WITH c AS (SELECT min(o_custkey) AS k FROM orders), o AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_custkey = (SELECT k FROM c))
SELECT 'itself' AS attempt, 'a field cannot be bound to itself' AS reason UNION ALL SELECT 'taken', CASE WHEN (SELECT k FROM o) IS NOT NULL THEN 'the field is bound already' END
UNION ALL SELECT 'cycle', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = (SELECT k FROM o) AND o_custkey = (SELECT k FROM c)) THEN 'the binding closes a cycle' END UNION ALL SELECT 'fine', NULL""")
def z_validate(t):
    """Orders mirror their customer's balance; each attempt binds one more field."""
    made = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("source_entity_id"), F.lit("twice").alias("source_field_name"), F.concat(F.lit("c"), "o_custkey").alias("target_entity_id"), F.lit("balance").alias("target_field_name"))
    first = t.orders.agg(F.min(F.struct("o_custkey", "o_orderkey")).alias("f")).select("f.*").first()
    order, customer = (f"o{first['o_orderkey']}", "twice"), (f"c{first['o_custkey']}", "balance")
    attempts = [("itself", order, order), ("taken", order, ("x", "y")), ("cycle", customer, order), ("fine", ("x", "y"), order)]
    return t.spark.createDataFrame([(n, bindings.validate_binding(made, a, b)) for n, a, b in attempts], "attempt string, reason string")


@query("s_compiled_schema", "SELECT n_nationkey AS number, n_name AS title, n_name || ',' || n_regionkey AS tags FROM nation")
def s_schema(t):
    schema = S.compile_schema([{"name": "number", "type": "integer", "required": True}, {"name": "title", "type": "text"}, {"name": "tags", "type": "list"}])
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("number"), F.col("n_name").alias("title"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("tags"))
    path = folder(t, "schema")
    S.export_relations(rows, path)
    return S.import_relations(t.spark, path, schema).select("number", "title", F.array_join("tags", ",").alias("tags"))


@query("x_json_patches", """SELECT event_id, user_id AS n, event_type AS kind, CAST(NULL AS VARCHAR) AS gone, event_id % 2 = 0 AS conflicts FROM events""")
def x_patches(t):
    """Each event as JSON with a nested field set, a field added and one removed; two edits of it conflict where one is above the other."""

    @F.pandas_udf("patched string, conflicts boolean")
    def patched(event: pd.Series, user: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for e, u, k in zip(event, user, kind, strict=True):
            done = J.apply_patches({"a": {"n": 0}, "gone": 1}, [{"op": "replace", "path": ["a", "n"], "value": int(u)}, {"op": "add", "path": ["b", "kind"], "value": k}, {"op": "remove", "path": ["gone"]}])
            other = ("a",) if e % 2 == 0 else ("b",)
            out.append((json.dumps(done), J.deltas_conflict([{"path": ("a", "n")}], [{"path": other}])))
        return pd.DataFrame(out, columns=["patched", "conflicts"])

    rows = t.events.select("event_id", patched("event_id", "user_id", "event_type").alias("p"))
    get = lambda path: F.get_json_object("p.patched", path)
    return rows.select("event_id", get("$.a.n").cast("long").alias("n"), get("$.b.kind").alias("kind"), get("$.gone").alias("gone"), F.col("p.conflicts").alias("conflicts"))
