"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each family; the driver compares all of them.
CHOSEN = [
    "f_neq_missing_is_true", "x_arithmetic_passes_text", "x_consecutive_runs", "x_calendar", "a_binding_aggregates", "a_metadata_layer",
    "c_cooccurrence_graph_pmi", "j_as_of_backward", "j_integrity_check", "w_recency_pointer", "b_search_bm25f_proximity",
    "b_search_entropy_similarity", "v_two_stage", "u_weighted_fusion", "u_graph_signals", "r_closure", "g_pagerank", "g_components",
    "d_compare_states", "m_coalesce_operations", "m_session_window", "z_resolve_bindings", "k_transaction_batch", "n_ranking_quality",
]


def rows(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return round(float(v), 3) if isinstance(v, int | float) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted((tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"doc_id", "proximity", "phrase", "score"}
    assert set(e.oracle_sql()) <= set(e.queries())
