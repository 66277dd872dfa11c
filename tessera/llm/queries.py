"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe_count, decontaminate, fertility, license_scan, line_crf, packing, sharding, simhash, style_tree, toxicity
from tessera.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score_quality(documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_uniform(rows, ["doc_id", "size", "text_crc32"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_decontamination": op1_decontamination,
        "op2_toxicity": op2_toxicity,
        "op3_token_counts": op3_token_counts,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_quality_rules": op5_quality_rules,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_main_text": op7_main_text,
        "op8_packing": op8_packing,
        "op9_license_scan": op9_license_scan,
        "op10_sharding": op10_sharding,
    }


def _license_sql() -> str:
    """The license scan as DuckDB SQL: the same grams, diagonals, votes, merges and tests."""
    rows = []
    for number, (w, label, base) in enumerate(license_scan._templates(license_scan.BASE_PHRASES, license_scan.TEMPLATES)):
        rows += [f"('{w[i]} {w[i + 1]}', {number}, {i}, {len(w) - 1}, '{label}', {str(base).lower()})" for i in range(len(w) - 1)]
    gap = license_scan.MERGE_GAP
    return f"""WITH t(gram, template, tpos, grams, label, is_base) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(lower(replace(text, chr(8490), chr(164))), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT r, words[i] || ' ' || words[i + 1] AS gram, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(words))) AS i FROM w)),
a AS (SELECT r, template, label, is_base, grams, pos - tpos AS diagonal, min(pos) AS low, max(pos) AS high, list(DISTINCT tpos) AS seen FROM g JOIN t USING (gram) GROUP BY r, template, label, is_base, grams, pos - tpos),
v AS (SELECT * FROM a WHERE len(seen) >= CASE WHEN is_base THEN grams ELSE least(grams, {license_scan.MIN_VOTES}) END),
f AS (SELECT *, CASE WHEN is_base OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {gap} THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM f),
m AS (SELECT r, template, label, is_base, grams, run, min(low) AS low, max(high) AS high, len(list_distinct(flatten(list(seen)))) / grams AS cover FROM n GROUP BY r, template, label, is_base, grams, run),
k AS (SELECT * FROM m WHERE cover >= CASE WHEN is_base THEN 1.0 ELSE {license_scan.MIN_COVER} END AND high - low + 1 <= grams + {2 * gap}),
s AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(low) FILTER (is_base) AS first_word, max(low) FILTER (is_base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM k GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM w LEFT JOIN s USING (r)"""


def oracle_sql() -> dict[str, str]:
    """The license scan alone: the others hold fitted models, XXH64, tokenizers, random draws or parsed pages."""
    return {"op9_license_scan": _license_sql()}
