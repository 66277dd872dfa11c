"""Pure functions and small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking, json_delta, ranking, scan, transforms
from tessera.operators import graph_metrics as G
from tessera.operators.vector_search import mmr_order
from tessera.streaming.cdc import fold


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_ranking_constants(spark):
    assert one(spark, ranking.idf(F.lit(100), F.lit(10))) == pytest.approx(math.log1p(90.5 / 10.5))
    assert one(spark, ranking.idf(F.lit(100), F.lit(0))) == 0
    assert one(spark, ranking.normalized_tf(F.lit(5), F.lit(100), F.lit(100), 0.75)) == 5
    assert one(spark, ranking.normalized_tf(F.lit(5), F.lit(100), F.lit(0), 0.75)) == 0
    assert one(spark, ranking.saturate(F.lit(2.0), 1.2)) == pytest.approx(2.2 * 2 / 3.2)
    assert one(spark, ranking.pop_count(F.lit(0b0101))) == 2
    assert one(spark, ranking.pop_count(F.lit(0xFFFFFFFF).cast("long"))) == 32
    for masks, want in (([2, 4], True), ([2, 8], False), ([4, 2], False), ([1, 2, 4], True)):
        assert one(spark, ranking.is_phrase(F.array(*[F.lit(m).cast("long") for m in masks]))) is want


def test_capacity_model():
    assert ranking.estimate_capacity(100)["max_qps"] == 155_000
    assert ranking.estimate_capacity(100_000)["max_qps"] == pytest.approx(43.7)
    assert ranking.estimate_capacity(1_000, 4)["sustained_qps"] == pytest.approx(8_600 / 8 / 2)


def test_transforms_pass_text_and_zero(spark):
    chain = transforms.apply_chain(F.lit("abc"), "multiply:2|add:1")
    assert one(spark, chain) == "abc"
    assert one(spark, transforms.divide(F.lit("6"), 0)) == "6"
    assert one(spark, transforms.round_half_up(F.lit(-2.5))) == -2
    assert transforms.serialize_transform(transforms.parse_transform("round:2|uppercase")) == "round:2|uppercase"
    with pytest.raises(ValueError):
        transforms.parse_transform("explode")


@pytest.mark.parametrize(("operations", "want"), [
    (["INSERT", "UPDATE"], "INSERT"), (["UPDATE", "UPDATE"], "UPDATE"), (["INSERT", "DELETE"], None),
    (["DELETE", "INSERT"], "UPDATE"), (["DELETE", "UPDATE"], "DELETE"), (["UPDATE", "DELETE"], "DELETE"),
])
def test_coalescing_truth_table(operations, want):
    state = None
    for i, op in enumerate(operations):
        state = fold(state, op, {f"f{i}": i, "label": op})
    assert state[0] == want
    if operations == ["INSERT", "UPDATE"]:
        assert state[1] == {"f0": 0, "f1": 1, "label": "UPDATE"}


def test_scanner_finds_four_spans_a_paragraph():
    text = "".join(f"Paragraph {i} with [[Link{i}]] and [CHARACTER|Hero{i}] and #tag{i} @user{i} text. " for i in range(1000))
    spans = scan.scan_syntax(text)
    assert len(spans) == 4000
    assert [s["kind"] for s in spans[:4]] == ["wikilink", "entity", "tag", "mention"]
    assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))


def test_temporal_scan():
    found = scan.TemporalScanner(["Flob"]).scan("In chapter 3, the next day, Monday dawned before the Third Age 3019 in Flob.")
    assert [(m["kind"], m["text"]) for m in found] == [
        ("NARRATIVE_MARKER", "chapter 3"), ("RELATIVE", "the next day"), ("WEEKDAY", "Monday"), ("CONNECTOR", "before"), ("ERA", "Third Age 3019"), ("CUSTOM", "Flob"),
    ]


def test_dictionary_and_relations():
    d = scan.Dictionary([("a", "Frodo Baggins", "CHARACTER", None), ("b", "Sauron", "CHARACTER", ["Dark Lord"])])
    mentions = d.find("Frodo Baggins defeated the Dark Lord. BAGGINS left.")
    assert [(m["entity_id"], m["confidence"]) for m in mentions] == [("a", 1.0), ("b", 0.95), ("a", 0.9)]
    rel = scan.RelationScanner().extract("Frodo Baggins defeated the Dark Lord.", mentions[:2])
    assert [(r["subject"], r["relation"], r["object"]) for r in rel] == [("a", "DEFEATED", "b")]
    both = scan.RelationScanner().extract("Frodo Baggins is an ally of the Dark Lord.", scan.Dictionary([("a", "Frodo Baggins", "X", None), ("b", "Dark Lord", "X", None)]).find("Frodo Baggins is an ally of the Dark Lord."))
    assert {(r["subject"], r["object"]) for r in both if r["relation"] == "FRIEND_OF"} == {("a", "b"), ("b", "a")}


def test_chunks_and_passive():
    kinds = [c["kind"] for c in scan.chunk("The old wizard walked slowly through the dark forest")]
    assert kinds == ["NP", "VP", "PP"]
    ents = [{"entity_id": "d", "start": 0, "end": 10}, {"entity_id": "k", "start": 25, "end": 35}]
    row = scan.structured_relations("The dragon was killed by the knight", ents)[0]
    assert row["passive"] and row["flipped"] and (row["subject"], row["object"]) == ("k", "d")
    assert row["confidence"] == pytest.approx(0.7)


def test_pronouns_and_dialogue():
    r = scan.Resolver({"ann": (["Ann"], "female"), "bob": (["Bob"], "male")})
    assert [r.resolve(w) for w in ("Ann", "Bob", "she", "he", "nobody")] == ["ann", "bob", "ann", "bob", None]
    said = scan.attribute_dialogue('"Go," said Ann. Bob left.', scan.Resolver({"ann": (["Ann"], "female"), "bob": (["Bob"], "male")}))
    assert said[0]["speaker"] == "ann"


def test_aliases():
    assert scan.generate_aliases("Bilbo Baggins", "CHARACTER") == [("Baggins", 0.9)]
    assert scan.generate_aliases("Order of the Phoenix", "FACTION") == [("Phoenix", 0.75), ("OP", 0.7)]
    assert scan.generate_aliases("United Galactic Senate", "FACTION") == [("Senate", 0.75), ("UGS", 0.7)]
    assert scan.generate_aliases("Solo", "CHARACTER") == []


def test_mmr_reference_case():
    v = np.array([[0.9, 0.1], [0.88, 0.12], [0.5, 0.5]])
    assert mmr_order(np.array([1.0, 0.0]), v, 3, 1.0)[:2] == [0, 1]
    assert mmr_order(np.array([1.0, 0.0]), v, 2, 0.1) == [0, 2]


def test_chunk_bytes_covers_and_overlaps():
    text = "Ein Satz über Dinge. " * 400
    parts = chunking.chunk_bytes(text, 500, 50)
    data = text.encode()
    assert parts[0][0] == 0 and parts[-1][1] == len(data)
    assert all(a[1] > b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(data[a:b].decode() == p for a, b, p in parts)
    assert chunking.chunk_bytes("") == []


def test_json_delta_round_trip():
    a, b = {"x": 1, "n": {"k": [1, 2], "z": 0}, "gone": 1}, {"x": 2, "n": {"k": [2, 3], "z": 0}, "new": {}}
    delta = json_delta.calculate_delta(a, b)
    assert json_delta.apply_delta(a, delta) == b
    assert json_delta.calculate_delta([1, 2], [2, 1])[0]["op"] == "reorder"
    assert json_delta.deltas_conflict([{"path": ("a",)}], [{"path": ("a", "b")}])
    with pytest.raises(ValueError):
        json_delta.merge_deltas([{"path": ("a",)}], [{"path": ("a",)}])


def test_graph_algorithms():
    path = [(1, 2), (2, 3), (3, 4)]
    assert G.articulation_nodes(path) == [2, 3]
    assert G.articulation_nodes([*path, (4, 1)]) == []
    assert G.strong_components([(1, 2), (2, 1), (2, 3)]) == {1: 1, 2: 1, 3: 3}
    assert G.shortest_path_centrality(path)[2][0] == pytest.approx(2 / 3)
    assert G.health_score(0, 0, 0, 0) == 100 and G.health_score(10, 3, 2, 0) == 65
    two = [(a, b, 1.0) for g in ((1, 2, 3), (4, 5, 6)) for a in g for b in g if a < b] + [(3, 4, 1.0)]
    found = G.modularity_communities(two)
    assert found[1] == found[2] == found[3] != found[4] == found[5] == found[6]
