"""Helpers the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to a Python worker.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Bytes of a table up to which a join may broadcast it, and the copies it is dealt in past that.
BROADCAST_BYTES, SALTS = 32 << 20, 16
#: A key is frequent from so many rows on, or from so small a part of all: there are MOST_HOT such keys at most.
LEAST_HOT, MOST_HOT = 1024, 100_000
#: Bytes of the labelled texts that a model is fitted on at most.
SAMPLE_BYTES = 64 << 20


class Numbers(dict):
    """Numbers words in the order they are first asked for; the new ones wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a master on this machine alone gets a temporary folder;
    on a cluster that is an error, for each node would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors and is computed once however
    often it is read.  The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts; ``rows`` is for narrow ones."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def join_small(rows: DataFrame, table: DataFrame, on: list[str], size: int) -> DataFrame:
    """Inner join with a table of ``size`` bytes, as counted: broadcast up to BROADCAST_BYTES, past it dealt in copies, so that no key's rows meet in one task."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on)
    dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(dealt, [*on, "salt"]).drop("salt")


def join_skewed(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join with a table of one row a key, whose column ``n`` is the number of the ``total`` rows that have it.

    Rows of frequent keys are joined by broadcast, others by a shuffle.  At
    most MOST_HOT keys are frequent, whatever the total.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    added = [c for c in table.columns if c not in (key, n)]
    hot = table.where(F.col(n) > limit).select(key, F.struct(*added).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    met = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in added])
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(table.where(F.col(n) <= limit).drop(n), key)
    return met.unionByName(rest)


def text_bytes() -> Column:
    """The UTF-8 bytes of ``text``, empty for null: Python then skips decoding."""
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")


def held_out() -> Column:
    """True where crc32 of doc_id as text is 0 modulo 5, and for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fold as (doc_id, text, y), by hash order of doc_id.

    Only doc_ids are ordered; the limited id set, at most ``limit`` rows, is
    then broadcast to fetch its texts, whole, as far as they fit in
    ``most_bytes`` together, none over a sixteenth of it.  Of the texts of a repeated doc_id the least
    counts.  Null labels, texts and ids are left out.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    present = docs.where(F.col("text").isNotNull()).select("doc_id")
    chosen = ids.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    once = rows.where(F.octet_length("text") <= most_bytes // 16).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over ``limit`` rows at most
    return once.withColumn("_bytes", so_far).where(F.col("_bytes") <= most_bytes).select("doc_id", text_bytes(), "y")
