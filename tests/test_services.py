"""Rankings, graphs, vectors, the search service and notes to a graph against plain restatements."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import json_delta
from tessera.operators import extraction, fusion, service
from tessera.operators import graph_metrics as G
from tessera.operators import ranking as R
from tessera.operators import traversal as T
from tessera.operators import vector_search as V
from tessera.sources import indexes, tables
from tessera.streaming import cdc

SF = "/root/testdata/sf0.001"
WORDS = "sea fire gold king tower stone river night".split()


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 40))), rnd.choice(["en", "de"])) for i in range(60)] + [(60, "", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def fields():
    return {"title": F.substring_index("text", " ", 2), "content": F.col("text")}


def naive_scores(rows, terms, boosts, per_term):
    """Per-term saturated BM25F over fields, by document, with the parts of each term."""
    fields = {d: {"title": t.split()[:2], "content": t.split()} for d, t in rows if t.split()}
    n = len(fields)
    mean = {f: sum(len(x[f]) for x in fields.values()) / n for f in ("title", "content")}
    found = {}
    for d, parts in fields.items():
        out = []
        for w, boost in zip(terms, boosts, strict=True):
            df = sum(any(w in words for words in x.values()) for x in fields.values())
            s, mask, hit = 0.0, 0, False
            for f, words in parts.items():
                if w in words:
                    hit = True
                    s += {"title": 2.0, "content": 1.0}[f] * words.count(w) / (0.25 + 0.75 * len(words) / mean[f])
                    for p, x in enumerate(words):
                        mask |= (x == w) << min(int(p / len(words) * 16), 15)
            if hit:
                out.append((w, mask, boost * math.log(1 + max(0, (n - df + 0.5) / (df + 0.5))) * 2.2 * s / (1.2 + s)))
        if out:
            base = sum(p for *_, p in out)
            if per_term:
                base = 0.0
                for i, (_, mask, part) in enumerate(out):
                    shared = [(mask & m).bit_count() / 16 for _, m, _ in out[:i]]
                    base += part * (1 + 0.5 * (sum(shared) / i if i else 0))
            found[d] = (base, out)
    return found


def test_explained_and_augmented_scores(docs):
    terms, boosts = ["sea", "gold", "king", "tow"], [1.0, 1.0, 1.0, 0.3]
    want = naive_scores([(r["doc_id"], r["text"]) for r in docs.collect()], terms, boosts, False)
    got = R.score(R.build_postings(docs, "doc_id", fields()), terms, boosts=boosts).collect()
    assert {r["doc_id"]: pytest.approx(r["base"]) for r in got} == {d: b for d, (b, _) in want.items()}
    for r in got:
        assert [(t["term"], t["mask"]) for t in r["terms"]] == [(w, m) for w, m, _ in want[r["doc_id"]][1]]
        assert [t["part"] for t in r["terms"]] == pytest.approx([p for *_, p in want[r["doc_id"]][1]])


def test_per_term_proximity(docs):
    terms = ["sea", "gold", "king"]
    want = naive_scores([(r["doc_id"], r["text"]) for r in docs.collect()], terms, [1.0] * 3, True)
    got = R.score(R.build_postings(docs, "doc_id", fields()), terms, strategy="per_term", phrase=False).collect()
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in got} == {d: b for d, (b, _) in want.items()}


def test_stored_index_gives_the_same_and_reads_terms_only(spark, docs, tmp_path):
    indexes.save_text_index(docs, "doc_id", fields(), str(tmp_path), files=4)
    index = indexes.open_text_index(spark, str(tmp_path))
    for how in ({}, {"strategy": "idf"}, {"strategy": "pairwise"}, {"entropy": True, "similarity": True}):
        direct = R.search(R.build_postings(docs, "doc_id", fields()), ["sea", "fire"], 15, **how).select("doc_id", F.round("score", 9).alias("s"))
        assert sorted(map(tuple, index.search(["sea", "fire"], 15, **how).select("doc_id", F.round("score", 9).alias("s")).collect())) == sorted(map(tuple, direct.collect()))
    plan = index.search(["sea"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    stats = {r["term"]: r["df"] for r in index.terms.collect()}
    texts = [r["text"].split() for r in docs.collect()]
    assert stats == {w: sum(w in t for t in texts) for w in WORDS}


# -- vectors ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in middle[i % 12] + 0.3 * rng.normal(size=16)]) for i in range(900)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()


def exact(points, q, k):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in points.collect()]
    return [i for _, i in sorted((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 9), i) for i, v in rows)[:k]]


def test_recall_of_partitions_and_two_stages(spark, points, tmp_path):
    index = V.PartitionedIndex.build(points, 12)
    indexes.save_vectors(index, str(tmp_path))
    again = indexes.open_vectors(spark, str(tmp_path))
    coded = V.quantized(points, 16).cache()
    hits, staged, asked = 0, 0, [r["embedding"] for r in points.where("vec_id % 50 = 0").collect()]
    for q in asked:
        want = exact(points, np.array(q, float), 10)
        found = [r["vec_id"] for r in again.search(q, 10).collect()]
        hits += len(set(found) & set(want))
        staged += len(set(want) & {r["vec_id"] for r in V.two_stage_search(coded, q, 10, 12.0).collect()})
    assert hits >= 0.9 * 10 * len(asked) and staged >= 0.9 * 10 * len(asked)
    parts = index.split_large(60)
    assert len(parts.centroids) > 12 and parts.assigned.count() == 900 and parts.assigned.groupBy("cluster").count().agg(F.max("count")).first()[0] < 900 / 6
    new = spark.createDataFrame([(5, asked[0]), (5000, asked[1])], points.schema)
    fresh = index.upsert(new).assigned
    assert fresh.count() == 901 and [round(x, 5) for x in fresh.where("vec_id = 5").first()["embedding"]] == [round(x, 5) for x in asked[0]]


def test_scalar_codes_and_diversity(points):
    q = [float(x) for x in np.random.default_rng(5).normal(size=16)]
    v = np.array(q)
    got = V.search_quantized(V.quantized(points, 16), q, 10).collect()
    near = {r["vec_id"]: np.array(r["embedding"], float) for r in points.collect()}
    for r in got:
        x = near[r["vec_id"]]
        assert r["score"] == pytest.approx(x @ v / np.linalg.norm(x) / np.linalg.norm(v), abs=0.02)
    assert len(set(exact(points, v, 10)) & {r["vec_id"] for r in got}) >= 8
    ids, picked = exact(points, v, 20), []
    unit = {i: near[i] / np.linalg.norm(near[i]) for i in ids}
    while len(picked) < 10:
        value = lambda i: round(0.5 * unit[i] @ (v / np.linalg.norm(v)) - 0.5 * max((unit[i] @ unit[j] for j in picked), default=0.0), 12)
        picked.append(max((i for i in ids if i not in picked), key=lambda i: (value(i), -ids.index(i))))
    assert [r["vec_id"] for r in V.search_with_diversity(points, q, 10, 0.5).orderBy("rank").collect()] == picked


# -- graphs ----------------------------------------------------------------------------


def edges_of(spark, n=14, m=30, seed=3):
    rnd = random.Random(seed)
    rows = sorted({(rnd.randint(0, n - 1), rnd.randint(0, n - 1)) for _ in range(m)})
    return spark.createDataFrame([(a, b, rnd.randint(1, 9) / 10, rnd.random() < 0.5, i) for i, (a, b) in enumerate(rows) if a != b], "source long, target long, weight double, bidirectional boolean, seq long")


def test_weighted_traversal(spark):
    e = edges_of(spark)
    links = {}
    for r in e.collect():
        for a, b in [(r["source"], r["target"])] + [(r["target"], r["source"])] * r["bidirectional"]:
            if r["weight"] >= 0.2:
                links[a, b] = max(links.get((a, b), 0), r["weight"])
    seen, frontier = {2: (0, 1.0)}, {2: 1.0}
    for level in (1, 2):
        step = {}
        for (a, b), w in sorted(links.items()):
            if a in frontier and b not in seen:
                step.setdefault(b, (a, frontier[a] * w))
        frontier = {b: p for b, (_, p) in step.items()}
        seen |= {b: (level, p) for b, p in frontier.items()}
    got = {r["node"]: (r["distance"], pytest.approx(r["path_weight"])) for r in T.weighted_traverse(e, F.lit(2).cast("long")).collect()}
    assert got == {n: x for n, x in seen.items() if n != 2} and len(got) > 2


def test_family_and_labels(spark):
    typed = spark.createDataFrame([(1, 3, "PARENT_OF"), (2, 3, "PARENT_OF"), (1, 4, "PARENT_OF"), (3, 5, "PARENT_OF"), (3, 6, "SPOUSE_OF")], "source long, target long, type string")
    assert {tuple(r) for r in T.family_unit(typed, 3).collect()} == {(1, "parent"), (2, "parent"), (5, "child"), (4, "sibling"), (6, "spouse")}
    e = edges_of(spark)
    both = [(a, b, w) for a, b, w, *_ in e.collect()] + [(b, a, w) for a, b, w, *_ in e.collect()]
    label = {a: a for a, *_ in both}
    for _ in range(4):
        votes = {}
        for a, b, w in both:
            votes.setdefault(a, {}).setdefault(label[b], []).append(w)
        label = {a: min((-round(math.fsum(w), 9), c) for c, w in v.items())[1] for a, v in votes.items()}
    assert {r["node"]: r["community"] for r in G.label_propagation(e, 4).collect()} == label


def test_critical_nodes_betweenness_and_health(spark):
    e = edges_of(spark, 16, 22, 9).withColumn("group_id", F.lit(1))
    pairs = {frozenset((r["source"], r["target"])) for r in e.collect()}
    nodes = sorted(set(itertools.chain(*pairs)))

    def parts(left):
        left, count = set(left), 0
        while left:
            count, todo = count + 1, [left.pop()]
            while todo:
                x = todo.pop()
                near = {next(iter(p - {x})) for p in pairs if x in p} & left
                left -= near
                todo += near
        return count

    cut = [v for v in nodes if parts(set(nodes) - {v}) > parts(nodes)]
    assert sorted(r["node"] for r in G.critical_nodes(e, "group_id").collect()) == cut
    whole = spark.createDataFrame([(1, i) for i in range(20)], "group_id int, node long")
    lonely = 20 - len(nodes)
    assert G.health(whole, e, "group_id").first()["score"] == G.health_score(20, lonely, parts(nodes) + lonely, len(cut))

    def paths(a, b):
        """All shortest paths."""
        front, seen = [[a]], {a}
        while front and not any(p[-1] == b for p in front):
            front = [[*p, x] for p in front for x in nodes if frozenset((p[-1], x)) in pairs and x not in seen]
            seen |= {p[-1] for p in front}
        return [p for p in front if p[-1] == b]

    through = dict.fromkeys(nodes, 0.0)
    for a, b in itertools.combinations(nodes, 2):
        found = paths(a, b)
        for p in found:
            for v in p[1:-1]:
                through[v] += 1 / len(found)
    got = {r["node"]: r["betweenness"] for r in G.centralities(e, "group_id").collect()}
    top = max(through.values())
    scale = max(got.values()) / top  # the measure may be normalised by the pairs
    assert {v: pytest.approx(b, abs=1e-9) for v, b in got.items()} == {v: b * scale for v, b in through.items()}


# -- service and notes -----------------------------------------------------------------


def test_search_service(spark, docs, points, tmp_path):
    indexes.save_text_index(docs, "doc_id", fields(), str(tmp_path))
    e = edges_of(spark).select("source", "target", "weight", F.lit("causal").alias("kind"))
    s = service.SearchService(docs.select(F.col("doc_id").alias("id"), "lang"), indexes.open_text_index(spark, str(tmp_path)), points.withColumnRenamed("vec_id", "id"), e, e.select(F.col("source").alias("id"), F.lit(0.5).alias("centrality")).distinct())
    q = points.where("vec_id = 7").first()["embedding"]
    lexical = s.search("lexical", 8, terms=["sea", "gold"], where=F.col("lang") == "de").collect()
    assert len(lexical) == 8 and {r["lang"] for r in lexical} == {"de"}
    assert s.search("semantic", 5, vector=q).first()["id"] == 7
    hybrid = s.search("hybrid", 10, terms=["sea", "gold"], vector=q, least=0.0).collect()
    scores = [r["score"] for r in hybrid]
    assert len(hybrid) == 10 and scores == sorted(scores, reverse=True) and all(0 <= x <= 1.2 for x in scores)
    with pytest.raises(ValueError):
        s.search("psychic", 3)
    first = s.search("lexical", 3, terms=["sea"], cached=True)
    assert s.search("lexical", 3, terms=["sea"], cached=True) is first


def test_result_cache():
    now = [0.0]
    cache = service.ResultCache(2, 10, lambda: now[0])
    cache.set("a", 1)
    cache.set("b", 2)
    assert cache.get("a") == 1
    cache.set("c", 3)
    assert (cache.get("b"), cache.get("a"), cache.get("c")) == (None, 1, 3)
    now[0] = 11
    assert cache.get("a") is None


def test_notes_become_a_graph(spark):
    notes = [(1, "[CHARACTER:HERO|Ann|{'age': 3}] met [[Bob|Bobby]] #quest\n\n[CHARACTER:HERO|ann] left [BADKIND|x] and [ITEM|Sword|{oops]"), (2, "nothing"), (3, None)]
    made = extraction.process_notes(spark.createDataFrame(notes, "doc_id long, text string"), spark.createDataFrame([("CONCEPT", None, "bobby", "known-7")], "kind string, subtype string, name string, id string"))
    entities = {r["entity_id"]: r for r in made["entities"].collect()}
    assert set(entities) == {"CHARACTER:HERO:ann", "known-7", "CONCEPT:TAG:quest"}
    assert entities["CHARACTER:HERO:ann"]["frequency"] == 2 and entities["CHARACTER:HERO:ann"]["attributes"] == '{"age": 3}'
    assert {(r["a"], r["b"], r["weight"]) for r in made["edges"].collect()} == {("CHARACTER:HERO:ann", "known-7", 1), ("CHARACTER:HERO:ann", "CONCEPT:TAG:quest", 1), ("CONCEPT:TAG:quest", "known-7", 1)}
    assert made["episodes"].count() == 3 and made["mentions"].count() == 4
    none = extraction.process_notes(spark.createDataFrame([], "doc_id long, text string"))
    assert none["edges"].count() == none["entities"].count() == 0


def test_disambiguation_by_rank_and_context(spark):
    ents = spark.createDataFrame([("a", "LOCATION", "Ash tower"), ("b", "CHARACTER", "Ash"), ("c", "ITEM", "sword")], "id string, kind string, text string")
    sentence = "Far in Ash, and slept."
    got = {r["entity_id"]: r for r in extraction.disambiguate(ents, "Ash", sentence, sentence.index("Ash")).collect()}
    assert set(got) == {"a", "b"} and (got["a"]["confidence"], got["b"]["confidence"]) == ("high", "medium")
    plain = {r["id"]: r["score"] for r in R.search(R.build_postings(ents, "id", {"content": F.col("text")}), ["ash"], 5, "id").collect()}
    assert got["a"]["score"] == pytest.approx(1.2 * plain["a"]) and got["b"]["score"] == pytest.approx(plain["b"])


def test_failing_sink_is_tried_again(spark, tmp_path):
    source, tries, log = str(tmp_path / "in"), [], []
    rows = spark.createDataFrame([("a", "node", "INSERT", "{}", 1)], "id string, type string, operation string, payload string, seq long").withColumn("ts", F.timestamp_seconds("seq")).select("id", "type", "operation", "payload", "ts", "seq")
    rows.write.parquet(source)

    def sink(df, number):
        tries.append(time.monotonic())
        if len(tries) < 3:
            raise OSError("not yet")

    q = cdc.apply_stream(spark.readStream.schema(rows.schema).parquet(source), sink, str(tmp_path / "cp"), wait=0.2, telemetry=log)
    q.awaitTermination(60)
    assert len(tries) == 3 and tries[1] - tries[0] >= 0.2 and tries[2] - tries[1] >= 0.4
    assert log[0]["tries"] == 3 and log[0]["operations"] == {"INSERT": 1}


def test_deltas_schemas_and_models(spark, tmp_path):
    assert json_delta.conflicting_paths([{"path": ("a",)}, {"path": ("c",)}], [{"path": ("a", "b")}, {"path": ("d",)}]) == [("a",)]
    assert json_delta.merge_deltas([{"path": ("a",)}], [{"path": ("b",)}]) == [{"path": ("a",)}, {"path": ("b",)}]
    patched = json_delta.apply_patches({"a": 1, "b": {"c": 2}}, [{"op": "replace", "path": ["b", "c"], "value": 3}, {"op": "add", "path": ["x", "y"], "value": 1}, {"op": "remove", "path": ["a"]}])
    assert patched == {"b": {"c": 3}, "x": {"y": 1}}
    schema = tables.compile_schema([{"name": "n", "type": "integer", "required": True}, {"name": "tags", "type": "list"}])
    tables.export_relations(spark.createDataFrame([(1, ["a"])], schema), str(tmp_path / "rows"))
    assert tables.import_relations(spark, str(tmp_path / "rows"), schema).first().asDict() == {"n": 1, "tags": ["a"]}
    with pytest.raises(ValueError):
        tables.compile_schema([{"name": "n", "type": "odd"}])
    assert fusion.select_model("short", 10_000) == "small" and fusion.select_model("short", 10) == "medium"


@pytest.mark.parametrize(
    ("text", "intent", "strategy", "kinds", "confidence"),
    [
        ("Who is Frodo?", "entity_lookup", "ranked", ["fts", "entity", "graph"], 0.95),
        ("define honour", "entity_lookup", "ranked", ["fts", "entity", "graph"], 0.95),
        # "related to" is of meaning, too, and the letters "at" in it count as of time: the patterns know no word boundaries.
        ("how is Frodo related to Sam", "relationship", "weighted", ["history", "path", "graph", "vector"], 0.75),
        ("shortest route from Rome to Paris", "path_finding", "ranked", ["path", "graph"], 0.95),
        ("get all linked to Rome", "neighborhood", "ranked", ["fts", "graph"], 0.95),
        ("how has magic evolved", "evolution", "weighted", ["history", "vector", "graph"], 0.95),
        ("chronology of Rome", "timeline", "ranked", ["history", "fts"], 0.95),
        ("Rome during winter", "snapshot", "ranked", ["history", "entity"], 0.95),
        ("themes about loss", "semantic", "weighted", ["vector", "graph"], 0.95),
        ("meaning of honour", "conceptual", "union", ["vector", "fts", "entity"], 0.95),
        ("which clusters contain mages", "community", "ranked", ["community", "graph"], 0.95),
        ("dogs versus wolves", "comparison", "weighted", ["entity", "path", "vector", "graph"], 0.95),
        ("list all rings", "aggregation", "union", ["vector", "fts", "graph"], 0.95),
        ("tell me about rings", "exploratory", "weighted", ["vector", "entity", "graph", "fts"], 0.95),
        ("discover rings", "discovery", "weighted", ["vector", "community", "graph"], 0.95),
        ("rings", "exploratory", "weighted", ["vector", "entity", "graph", "fts"], 0.85),
        # Names and time make it complex: vector and graph search come on top.
        ("history of Rome, Paris and Oslo", "timeline", "ranked", ["history", "fts", "vector", "graph"], 0.95),
        # Of time only: the history comes first.
        ("list all rings that changed", "aggregation", "union", ["history", "vector", "fts", "graph"], 0.95),
    ],
)
def test_intents(text, intent, strategy, kinds, confidence):
    plan = fusion.classify_query(text)
    assert (plan["intent"], plan["strategy"], [m["type"] for m in plan["modalities"]], plan["confidence"]) == (intent, strategy, kinds, confidence)


def test_names_of_a_query():
    assert fusion.query_names('What links "the old well" to Tom Bombadil and You, or Rome?') == ["the old well", "Tom Bombadil", "Rome"]


def test_multi_modal_search_takes_what_it_has_names_for(spark):
    rows = lambda *r: lambda params, names: spark.createDataFrame(list(r), "id long, title string, score double")
    searches = {"fts": rows((1, "a", 2.0), (2, "A ", 1.0), (3, "a", 0.5)), "entity": rows((9, "z", 1.0)), "graph": rows((9, "z", 1.0))}
    out, plan = fusion.multi_modal_search("who is that", searches)  # no names: lexical only
    assert plan["used"] == ["fts"] and {r["id"] for r in out.collect()} == {1, 2}
    out, plan = fusion.multi_modal_search("who is Rome", searches)
    assert plan["used"] == ["fts", "entity", "graph"] and {r["id"] for r in out.collect()} == {1, 2, 9}
    assert fusion.multi_modal_search("who is Rome", {})[0] is None


def test_match_queries(spark):
    assert R.parse_match('a "b c" OR d* NOT (e AND f)')[0] == ("or", ("and", ("phrase", 0), ("phrase", 1)), ("not", ("phrase", 2), ("and", ("phrase", 3), ("phrase", 4))))
    for bad in ("", "a AND", "(a", "a)", "NOT a", '"..."'):
        with pytest.raises(ValueError):
            R.parse_match(bad)
    docs = spark.createDataFrame([(1, "red fox and red hen"), (2, "the fox, red"), (3, None), (4, ""), (5, "redder foxes"), (6, "Red FOX")], "doc_id long, text string")
    ids = lambda q: [r["doc_id"] for r in R.match_ranked(docs, q, limit=10).collect()]
    assert ids('"red fox"') == [6, 1]  # the shorter one ranks first
    assert sorted(ids("red*")) == [1, 2, 5, 6] and sorted(ids("fox*")) == [1, 2, 5, 6]
    assert ids("fox NOT hen NOT the") == [6] and sorted(ids("hen OR redder")) == [1, 5]
    assert sorted(ids('"red fo*"')) == [] and sorted(ids('"red fo"*')) == [1, 6]


def test_flow_of_sentences(spark):
    from tessera.functions import text as T

    rows = spark.createDataFrame([(1, [5, 6, 7, 6, 5]), (2, [1, 9, 30]), (3, []), (4, [4, 4, 20, 4, 4])], "id long, k array<int>")
    got = {r["id"]: (r["f"]["consecutive_patterns"], r["f"]["dominant_range"], r["f"]["has_monotony"]) for r in rows.select("id", T.flow_insights(F.col("k")).alias("f")).collect()}
    assert got == {1: (3, "short", True), 2: (0, "one", False), 3: (0, None, False), 4: (0, "short", False)}


def test_strong_components_without_groups(spark):
    rnd = random.Random(9)
    for pairs in ([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8)], [(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(45)], [(i, i + 1) for i in range(6)]):
        edges = spark.createDataFrame(pairs, "source long, target long")
        assert {r["node"]: r["component"] for r in G.strong_components_of(edges).collect()} == G.strong_components(pairs)
    assert G.strong_components_of(edges.limit(0)).collect() == []
