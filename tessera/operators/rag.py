"""Chunk, embed, index, retrieve; and a tree of cluster means over chunks.

Vectors are input: an embedding model is a function from texts to a matrix
that ``embed`` runs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.functions import vectors as V
from tessera.operators.vector_search import search_knn

#: Texts that a worker cuts at once, and rows that a model reads at once.
SLICE_TEXTS, EMBED_ROWS = 32, 1024


def chunk(docs: DataFrame, size: int = 2048, overlap: int = 200, doc: str = "doc_id") -> DataFrame:
    """(chunk_id, doc, chunk_index, start, end, text) with byte offsets."""
    return _chunks(docs, doc, lambda t: C.chunk_bytes(t, size, overlap))


def chunk_by_sentence(docs: DataFrame, size: int = 512, overlap: int = 1, doc: str = "doc_id") -> DataFrame:
    return _chunks(docs, doc, lambda t: [(0, 0, p) for p in C.chunk_sentences(t, size, overlap)])


def _chunks(docs: DataFrame, doc: str, fn) -> DataFrame:
    """Chunks of fn(text); a worker holds those of a few texts, not of a whole Arrow batch."""
    kind = docs.schema[doc].dataType

    def run(batches):
        names = ["chunk_id", doc, "chunk_index", "start", "end", "text"]
        types = [pa.string(), None, pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            types[1] = batch.schema.field(0).type
            for at in range(0, batch.num_rows, SLICE_TEXTS):
                part = batch.slice(at, SLICE_TEXTS)
                rows = [(f"{key}_{i}", key, i, a, b, piece) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, (a, b, piece) in enumerate(fn(text or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(doc, "text").mapInArrow(run, f"chunk_id string, {doc} {kind.simpleString()}, chunk_index int, start long, end long, text string")


def embed(chunks: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "text", title: str | None = None) -> DataFrame:
    """Rows with ``embedding``; with ``title`` the model reads 'title\\n---\\ntext'.  Vectors are normalised."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), EMBED_ROWS):
                pdf = batch.iloc[at : at + EMBED_ROWS]
                inputs = [f"{a}\n---\n{b}" for a, b in zip(pdf[title], pdf[text], strict=True)] if title else list(pdf[text])
                m = np.asarray(model(inputs), float).reshape(len(inputs), -1)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                yield pdf.assign(embedding=list(np.divide(m, size, out=np.zeros_like(m), where=size > 0)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{fields}, embedding array<double>")


def needs_embedding(rows: DataFrame, embedded: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Rows whose content hash is not among those embedded (key, content_hash), one a key."""
    hashed = rows.withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    return hashed.join(embedded.select(key, "content_hash"), [key, "content_hash"], "left_anti").dropDuplicates([key])


def replace_note(index: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The index with the chunks of re-indexed documents in place of their old ones."""
    return index.join(chunks.select(doc).distinct(), doc, "left_anti").unionByName(chunks)


def index_stats(index: DataFrame, doc: str = "doc_id") -> DataFrame:
    return index.agg(F.count("*").alias("chunks"), F.countDistinct(doc).alias("notes"), F.max(F.size("embedding")).alias("dimensions"))


def search(index: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    return search_knn(index, query, k, key="chunk_id")


def search_hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, k: int, vector_weight: float = 0.5) -> DataFrame:
    """(id, score) lists of 3k each, over their own largest, mixed."""
    from tessera.operators.fusion import hybrid_max_fusion

    return hybrid_max_fusion(vector_hits, lexical_hits, k, vector_weight)


# -- tree of means ---------------------------------------------------------------------


def build_tree(chunks: DataFrame, target: int = 5, group: str = "group_id", chunk: str = "chunk_id") -> DataFrame:
    """(group, node_id, level, parent_id, embedding): leaves at level 0; each level clusters the last into
    ceil(n / target), two at least, until one node is left; a parent is its children's mean.

    One group's tree is built in one task: group by note, folder or any key
    whose chunks fit a worker.  Its memory grows with the group, its time with
    the square.  To search a tree more than once, write it first.
    """
    kind = chunks.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(chunk, kind="stable")
        key, ids, m = pdf[group].iloc[0], [str(c) for c in pdf[chunk]], np.vstack(pdf["embedding"]).astype(float)
        rows, level = [], 0
        while True:
            n = len(ids)
            if n == 1:
                rows.append((key, ids[0], level, None, m[0]))
                break
            k = 1 if n <= target else min(max(2, -(-n // target)), n - 1)
            label = C.cosine_kmeans(m, k) if k > 1 else np.zeros(n, int)
            used, place = np.unique(label, return_inverse=True)
            used = used.tolist()
            names = {c: f"{key}:L{level + 1}:{i}" for i, c in enumerate(used)}
            rows += [(key, i, level, names[int(c)], v) for i, c, v in zip(ids, label, m, strict=True)]
            m, ids, level = C.cluster_means(m, place, len(used))[0], [names[c] for c in used], level + 1
        return pd.DataFrame(rows, columns=[group, "node_id", "level", "parent_id", "embedding"])

    return chunks.select(group, chunk, "embedding").groupBy(group).applyInPandas(run, f"{group} {kind}, node_id string, level int, parent_id string, embedding array<double>")


def search_collapsed(tree: DataFrame, query: Sequence[float], k: int, leaves_only: bool = False) -> DataFrame:
    """Top-k over all nodes, or over the leaves."""
    return search_knn(tree, query, k, key="node_id", where=F.col("level") == 0 if leaves_only else None)


def search_traversal(tree: DataFrame, query: Sequence[float], k: int, beam: int = 3) -> DataFrame:
    """Descent from the roots: at each level the best max(beam, k) nodes are opened."""
    width = max(beam, k)
    top = tree.agg(F.max("level")).first()[0] or 0
    scored = tree.withColumn("score", V.scan_similarity(query)("embedding"))
    now = scored.where("parent_id is null").orderBy(F.desc(F.round("score", 9)), "node_id").limit(width)
    for _ in range(top):
        leaves = now.where("level = 0")
        below = scored.join(now.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
        now = leaves.unionByName(below.select(*leaves.columns)).orderBy(F.desc(F.round("score", 9)), "node_id").limit(width)
    return now.where("level = 0").orderBy(F.desc(F.round("score", 9)), "node_id").limit(k)


def search_tree_hybrid(tree: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Collapsed top 2k, inner nodes opened to the leaves under them, leaves once, top k."""
    top = tree.agg(F.max("level")).first()[0] or 0
    now, leaves = search_collapsed(tree, query, 2 * k).select("node_id", "level"), None
    links = tree.select("node_id", "level", "parent_id")
    for _ in range(top + 1):
        done = now.where("level = 0").select("node_id")
        leaves = done if leaves is None else leaves.unionByName(done)
        now = links.join(now.where("level > 0").select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id", "level")
    ids = leaves.dropDuplicates(["node_id"])
    return search_knn(tree.where("level = 0").join(ids, "node_id", "left_semi"), query, k, key="node_id")


def tree_stats(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count("*").alias("nodes"))
