"""The pipeline keeps clean documents, drops what each stage is for, and loses nothing else."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, line_crf, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality classifier":
            gone = {r["doc_id"] for r in line_crf.score_quality(kept, labels).where("predicted = 0").collect()}
        elif name == "toxicity":
            gone = {r["doc_id"] for r in toxicity.score_toxicity(kept, labels).where("predicted = 1").collect()}
        elif name == "simhash near-dedup":
            gone = {r["doc_id"] for r in simhash.near_duplicates(kept).where("component_id <> doc_id").collect()}
        else:
            gone = {r["doc_id"] for r in decontaminate.contaminated_ids(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        assert after == before - gone
        kept = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Clean documents beside nulls, empty and very long texts, repeated rows and columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "word " * 50_000), (900_004, "x" * 300_000), (None, "no id at all"), (900_005, "twice the same row"), (900_005, "twice the same row")], "doc_id long, text string")
    for name in ("lang", "source"):
        odd = odd.withColumn(name, F.lit(None).cast("string"))
    rows = docs.unionByName(odd.withColumn("n_chars", F.length("text").cast("long")))
    for name in ("score", "predicted", "component_id", "fp", "copy", "start", "y"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)), ids=[n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd_rows, place):
    """Columns stay, rows without a doc_id stay, equal rows share their fate, and what is kept was there."""
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, odd_rows, SF).collect()
    before = odd_rows.collect()
    if name == "packing":
        assert sum(r["start"] == 0 for r in out) == len(before)
        assert sum(r["length"] for r in out if r["start"] == 0 and r["doc_id"] in (900_001, 900_002)) == 2
        return
    assert out and out[0].asDict().keys() == before[0].asDict().keys() and set(map(tuple, out)) <= set(map(tuple, before))
    ids = [r["doc_id"] for r in out]
    assert None in ids and ids.count(900_005) in (0, 2)
    if name == "benchmark decontamination":
        assert {900_001, 900_002, 900_003, 900_004} <= set(ids)
    if name == "simhash near-dedup":
        assert len({900_001, 900_002} & set(ids)) == 1 or any(r["doc_id"] not in (900_001, 900_002) and not (r["text"] or "").split() for r in out)
