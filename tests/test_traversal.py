"""Walks over hierarchies and rings deeper than any fixed bound."""

from tessera.operators import bindings, traversal


def test_ring_of_many_nodes_is_a_cycle(spark):
    n = 34
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "source long, target long").coalesce(1)
    assert {r["node"] for r in traversal.has_cycle(ring).collect()} == set(range(n))


def test_deep_binding_chain_closes_a_ring(spark):
    n = 36
    rows = [(str(i), "f", str(i + 1), "f") for i in range(n)]
    held = spark.createDataFrame(rows, "source_entity_id string, source_field_name string, target_entity_id string, target_field_name string").coalesce(1)
    assert bindings.validate_binding(held, (str(n), "f"), ("0", "f")) == "the binding closes a cycle"


def test_depth_stays_an_argument(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "source long, target long").coalesce(1)
    assert {(r["node"], r["depth"]) for r in traversal.descendants(chain, 0, 3).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert {(r["node"], r["depth"]) for r in traversal.ancestors(chain, 6).collect()} == {(i, 6 - i) for i in range(6)}
