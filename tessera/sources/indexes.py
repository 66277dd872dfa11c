"""Indexes kept as Parquet: postings with their statistics, vectors in clusters, trees.

Postings are ordered by term, so a search reads the row groups and pages of its
terms only; the corpus is one row and every posting knows its document's length,
so nothing else is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import ranking as R
from tessera.operators.vector_search import PartitionedIndex


@dataclass
class TextIndex:
    """postings (with doc_length), terms (term, df, entropy) and the corpus row."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    key: str = "doc_id"

    def search(self, terms: list[str], limit: int = 10, **how) -> DataFrame:
        return R.search(self.postings, terms, limit, self.key, corpus=self.corpus, **how)


def save_text_index(docs: DataFrame, key: str, fields: dict[str, Column], path: str, files: int | None = None) -> None:
    """Write the index of ``docs`` under ``path``: the texts are moved once, their postings once, by range of term.

    ``doc_tf``, the count in all fields, stands on one posting of a document and term, so that the statistics need no
    grouping by document.
    """
    spark = docs.sparkSession
    ordered = R.build_postings(docs, key, fields, doc_length=True)
    ordered = ordered.repartitionByRange(files, "term") if files else ordered.repartitionByRange("term")
    pair = Window.partitionBy("term", key)
    first = F.row_number().over(pair.orderBy("field", "field_length")) == 1
    ordered = ordered.withColumn("doc_tf", F.when(first, F.sum("tf").over(pair)))
    ordered.sortWithinPartitions("term", key).write.mode("overwrite").option("parquet.page.size", 64 << 10).parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    R.stats_of_counts(postings.where("doc_tf is not null").select("term", F.col("doc_tf").alias("tf"))).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    R.corpus_stats(R.field_lengths(docs, key, fields), key).write.mode("overwrite").parquet(f"{path}/corpus")


def open_text_index(spark: SparkSession, path: str, key: str = "doc_id") -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus")), key)


def save_vectors(index: PartitionedIndex, path: str) -> None:
    """Vectors by cluster, a folder each, and the centroids."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    spark = index.assigned.sparkSession
    index.assigned.repartition("cluster", F.pmod(F.xxhash64(index.key), F.lit(8))).write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
    spark.createDataFrame(rows, "cluster int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def open_vectors(spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding") -> PartitionedIndex:
    """The index as saved; a search reads the folders of the clusters it probes."""
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()])
    return PartitionedIndex(centroids, spark.read.parquet(f"{path}/vectors"), key, vector)


def save_tree(tree: DataFrame, path: str) -> None:
    """A retrieval tree by level."""
    tree.write.mode("overwrite").partitionBy("level").parquet(path)


def open_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
