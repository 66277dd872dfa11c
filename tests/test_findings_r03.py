"""Findings of round 3, each against a plain restatement or its SQL."""

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.operators import bindings, rag, ranking, records, scanning, traversal
from tessera.plans import registry
from tessera.sources import indexes, tables

registry.load()
SF = "/root/testdata/sf0.001"


def both(spark, name: str, folder: str = SF) -> tuple[list, list]:
    """Sorted rows of a query and of its SQL over the Parquet tables of a folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in tables.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        try:
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        except duckdb.IOException:
            pass
    got = registry.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def odd_texts(alphabet: str, count: int = 400) -> list[str]:
    rnd = random.Random(4)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(count)]


def test_batch_inserts_are_appended(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    deltas = spark.createDataFrame([(1, "DELETE", None), (2, "UPDATE", "u"), (3, "INSERT", "i"), (4, "INSERT", "j")], "id long, operation string, name string")
    out, counts = tables.apply_batch(rows, deltas, "id")
    assert sorted(map(tuple, out.collect())) == [(2, "u"), (3, "c"), (3, "i"), (4, "j")]
    assert {tuple(r) for r in counts.collect()} == {("DELETE", 1), ("UPDATE", 1), ("INSERT", 2)}


def test_merged_entities_at_every_size(spark):
    got, want = both(spark, "n_merge_entities")
    assert got == want


def test_labelled_path_prefers_the_forward_type(spark):
    e = spark.createDataFrame([(1, 2, "KNOWS"), (2, 1, "KNOWS"), (3, 2, "OWNS"), (3, 4, "OWNS")], "source long, target long, type string")
    found = traversal.shortest_path(e, 1, 4, labels=True).collect()
    assert [tuple(r) for r in found] == [([1, 2, 3, 4], ["KNOWS", "INVERSE_OWNS", "OWNS"], 3)]
    assert traversal.shortest_path(e, 4, 9).isEmpty()
    assert [tuple(r) for r in traversal.shortest_path(e, 4, 4, labels=True).collect()] == [([4], [], 0)]


def test_labelled_path_query(spark, tmp_path):
    rows = [(1, 7), (9, 7), (9, 150), (150, 9)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = both(spark, "r_labelled_path", str(tmp_path))
    assert got == want == [("LINKS,LINKS,LINKS", 3)]


def test_document_text_keeps_the_white_space_of_its_blocks(spark, tmp_path):
    heads = ["", "\u00a0x", "\tx\u3000", "a\r", "plain", " led by a blank", *odd_texts("a \t\r\x0b\x1c\x85\u00a0\u2003\u2028\u3000")]
    spark.createDataFrame([(i, f"{h}\nmore") for i, h in enumerate(heads)] + [(-1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, "s_document_tree_text", str(tmp_path))
    assert got == want and len(got) > 100


def test_spans_are_counted_for_every_document(spark, tmp_path):
    texts = ["", "...", " . a.", "\u00a0", "one.\n\u00a0\ntwo", "a\n \t\nb!\n\n\n?", "x\x0b\n\x0b\ny", None, "? ! .", "\n\n", *odd_texts("ab.!?\n\n \t\r\f\x0b\x1c\x85\u00a0\u2028\u3000")]
    spark.createDataFrame(list(enumerate(texts)) + [(0, "again. and again")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, "t_sentences_and_paragraphs", str(tmp_path))
    assert got == want and len(got) == len(texts) + 1


def test_fuzzy_match_of_names_that_are_all_alike(spark):
    """Most letters are shared by all: no two names meet that are not near, and the nearest is found at every length."""
    rnd = random.Random(5)
    change = lambda w, n: "".join(c for i, c in enumerate(w) if i not in set(rnd.sample(range(len(w)), n)))
    labels = [f"Supplier#{i:09d}" for i in range(400)] + ["x" * n + "".join(rnd.choice("abcd") for _ in range(8)) for n in (10, 18, 30, 38, 55, 63, 80)]
    names = [change(w, n) for w in labels[::7] for n in range(5)] + ["", "a", "abc", "abcd"]
    entities = spark.createDataFrame([(i, w, ["ab", "zz"] if i == 3 else None) for i, w in enumerate(labels)], "id long, label string, aliases array<string>")
    got = {r["name"]: (r["distance"], r["entity_id"]) for r in scanning.fuzzy_match(spark.createDataFrame([(n,) for n in names], "name string"), entities).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE a (id BIGINT, w VARCHAR)")
    con.executemany("INSERT INTO a VALUES (?, lower(?))", [*enumerate(labels), (3, "ab"), (3, "zz")])
    con.execute("CREATE TABLE n (name VARCHAR)")
    con.executemany("INSERT INTO n VALUES (?)", [(n,) for n in set(names)])
    want = con.execute("SELECT name, min((levenshtein(lower(name), w), id)) FROM n, a WHERE levenshtein(lower(name), w) <= 3 GROUP BY 1").fetchall()
    assert got == {n: b for n, b in want}
    alike = spark.createDataFrame([(f"supplier#{i:09d}x",) for i in range(2000)], "name string")
    aliases = spark.createDataFrame([(i, f"supplier#{i:09d}") for i in range(2000)], "entity_id long, alias string")
    assert scanning._meeting(alike.withColumnRenamed("name", "low"), aliases, 1).count() < 2000 * 40


def test_intervals_of_a_full_day_are_shared_by_tasks(spark):
    """Every interval of one day against all: the pairs are right and no task holds the whole day."""
    n = 400
    e = spark.range(n).select("id", F.expr("timestamp'2020-01-05' + make_interval(0, 0, 0, 0, CAST(id % 24 AS INT))").alias("at"), F.expr("timestamp'2020-01-06' + make_interval(0, 0, 0, CAST(id % 3 AS INT))").alias("until"), F.lit("day").alias("granularity"))
    rows = {r["id"]: (r["at"], r["until"]) for r in e.collect()}
    want = {(i, o) for i, (a, b) in rows.items() for o, (c, d) in rows.items() if i != o and a >= c and b <= d}
    found = records.during_relations(e)
    assert {(r["source"], r["target"]) for r in found.collect()} == want
    assert max(found.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < len(want) / 3


class _Held:
    """Stands for a DataFrame: gives the function that a scanner runs over Arrow batches."""

    def __init__(self, df):
        self.schema = df.schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_workers_hold_the_rows_of_a_few_texts(spark):
    held = _Held(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["One. Two! " * 40] * 3000)], ["doc_id", "text"])
    for run, rows in ((scanning.sentence_table(held), 80), (rag.chunk_by_sentence(held, 40), None)):
        parts = list(run(iter([batch])))
        assert max(p.num_rows for p in parts) <= scanning.SLICE_ROWS + 80 * scanning.SLICE_TEXTS
        assert rows is None or sum(p.num_rows for p in parts) == rows * 3000
        ids = [i for p in parts for i in p.column(p.schema.get_field_index("doc_id")).to_pylist()]
        assert sorted(set(ids)) == list(range(3000)) and ids == sorted(ids)


def test_shortest_path_is_the_least_and_carries_no_paths(spark):
    rnd = random.Random(6)
    pairs = [(a, b) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(60)) if a != b]
    e = spark.createDataFrame(pairs, "source long, target long").coalesce(1)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in ((0, 39), (3, 17), (11, 28)):
        level, want = [[a]], None
        while level and want is None and len(level[0]) <= 11:
            want = min((p for p in level if p[-1] == b), default=None)
            level = [[*p, n] for p in level for n in near.get(p[-1], ()) if n not in p]
        assert [list(r["path"]) for r in traversal.shortest_path(e, a, b).collect()] == ([want] if want else [])


def test_enrolment_does_not_move_relationships(spark):
    rels = spark.range(1000).select(F.col("id").alias("rel_id"), F.when(F.col("id") % 2 == 0, "PARENT_OF").otherwise("other").alias("type"))
    rules = spark.createDataFrame([("family", "PARENT_OF", "parent", ["begat"])], "schema_id string, code string, label string, keywords array<string>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members, counts = bindings.enrol(rels, rules, spark.createDataFrame([(1, "family"), (2, "family")], "network_id long, schema_id string"))
        assert "Exchange hashpartitioning" not in members._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert members.count() == 1000 and tuple(counts.first()) == (500, 500)
    assert tuple(bindings.enrol(rels.where("rel_id < 0"), rules, spark.createDataFrame([(1, "family")], "network_id long, schema_id string"))[1].first()) == (0, 0)


def test_facts_and_joined_mentions(spark):
    docs = spark.createDataFrame([(1, "Ann loved Bob in London. Bob became very happy at night."), (2, "The old king Ann saw red Bob"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("e1", "Ann", "P", None), ("e2", "Bob", "P", None), ("e3", "old king", "P", ["red bob"])], "id string, label string, kind string, aliases array<string>")
    states = scanning.state_changes(docs, names).select("doc_id", F.col("entity").alias("subject"), F.lit("STATE").alias("verb"), F.col("state").alias("object"))
    want = scanning.quads(docs, names).select("doc_id", "subject", "verb", "object").unionByName(states)
    assert sorted(map(str, scanning.facts(docs, names).collect())) == sorted(map(str, want.collect())) and want.count() > 1
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scanning.find_mentions_by_join(docs, names)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = sorted((r["doc_id"], r["start"], r["end"], r["entity_id"], r["confidence"]) for r in found.collect())
    assert got == [(1, 0, 1, "e1", 1.0), (1, 2, 3, "e2", 1.0), (1, 5, 6, "e2", 1.0), (2, 1, 3, "e3", 1.0), (2, 3, 4, "e1", 1.0), (2, 5, 7, "e3", 0.95), (2, 6, 7, "e2", 1.0)]


def test_clusters_by_blocks_are_those_of_the_whole_matrix(monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK", 1 << 16)
    rng = np.random.default_rng(7)
    vectors, k = rng.normal(size=(3000, 16)), 600
    vectors[:50] = vectors[50:100]
    vectors[7] = 0

    def whole(v, k, rounds=10):
        unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
        centroids, label = v[[i * len(v) // k for i in range(k)]].astype(float), None
        for _ in range(rounds):
            new = (unit(v) @ unit(centroids).T).round(12).argmax(1)
            if label is not None and (new == label).all():
                break
            label = new
            for c in range(k):
                if (label == c).any():
                    centroids[c] = v[label == c].mean(0)
        return label

    want = whole(vectors, k)
    tracemalloc.start()
    got = chunking.cosine_kmeans(vectors, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all()
    assert peak < 3000 * k * 8 / 3 and (chunking.cluster_means(vectors, want, k)[0][want[0]] == vectors[want == want[0]].mean(0)).all()


def test_search_without_an_index_reads_the_texts_once(spark):
    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("sea fire gold king a".split()) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "")], "doc_id long, text string")
    fields = {"title": F.substring_index("text", " ", 2), "content": F.col("text")}
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    terms = ["sea", "gold"]
    found, lengths = ranking.term_postings(docs.withColumn("text", read("text")), "doc_id", fields, terms)
    got = ranking.search(found, terms, 20, lengths=lengths, entropy=True).select("doc_id", F.round("score", 9)).collect()
    want = ranking.search(ranking.build_postings(docs, "doc_id", fields), terms, 20, lengths=ranking.field_lengths(docs, "doc_id", fields), entropy=True).select("doc_id", F.round("score", 9)).collect()
    assert got == want and len(got) == 20
    assert seen.value <= 2 * docs.count()


def test_index_is_written_with_one_move_of_its_postings(spark, tmp_path):
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("sea fire gold king".split()) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "")], "doc_id long, text string")
    fields = {"title": F.substring_index("text", " ", 2), "content": F.col("text")}
    built = ranking.build_postings(docs, "doc_id", fields, doc_length=True)
    assert built._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    columns = ["doc_id", "field", "term", "tf", "field_length", "mask"]
    plain = ranking.build_postings(docs, "doc_id", fields)
    assert sorted(map(tuple, built.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    indexes.save_text_index(docs, "doc_id", fields, str(tmp_path), files=3)
    stored = indexes.open_text_index(spark, str(tmp_path))
    want = ranking.term_stats(plain, "doc_id").select("term", "df", F.round("entropy", 9)).collect()
    assert sorted(map(tuple, stored.terms.select("term", "df", F.round("entropy", 9)).collect())) == sorted(map(tuple, want))
    assert "doc_tf" in stored.postings.columns
