"""Uniform shuffle into shards of exact size.

A fixed number of logical blocks is laid over the rows by hash.  From the
blocks' row counts the driver draws the hypergeometric communication matrix:
how many rows of each block go to each shard, given that shard sizes differ by
one at most.  Each block is permuted, cut into runs of those lengths, the runs
are exchanged, and each shard is permuted again.  Only DataFrame functions
touch rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Upper bounds of the driver's matrix and of the broadcast tables: blocks x shards.
MAX_BLOCKS = 4096


def shard_capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _draw_one(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """An exact hypergeometric draw; past numpy's limit by inversion outward from the mode."""
    if not good or not sample:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, sample - mode) - log_choose(good + bad, sample))
    left = rng.random() - at_mode
    up = down = mode
    p_up = p_down = at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block that go to each shard; columns sum to the shards' capacities."""
    rng = np.random.default_rng(seed)
    left = shard_capacities(sum(block_rows), shards)
    matrix = []
    for count in block_rows:
        row, todo, rest = [], count, sum(left)
        for capacity in left:
            rest -= capacity
            row.append(_draw_one(rng, capacity, rest, todo))
            todo -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _inline(spark, rows: list, schema: str) -> DataFrame:
    """A bounded driver-side table as a literal, without an RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_uniform(df: DataFrame, columns: list[str], shards: int = 8, seed: int = 20, block_rows: int = 1 << 16) -> DataFrame:
    """``columns`` of every row of ``df`` with (shard int, slot long).

    Shard sizes differ by one at most; slots count from 0 without gaps; given
    the seed the result depends on the rows alone.  ``columns`` must tell rows
    apart: rows equal in all of them are interchangeable, so their places are
    shared out in any order.  Nulls are values like any other.  An empty input
    gives no rows.  Runs two jobs: one writes ``columns``, one counts blocks
    (at most MAX_BLOCKS rows come to the driver).
    """
    spark = df.sparkSession
    rows = materialize(df.select(*columns), "shard-rows")
    total = rows.count()
    blocks = max(1, min(MAX_BLOCKS, math.ceil(total / block_rows)))
    parts = max(1, min(MAX_BLOCKS // shards, math.ceil(total / shards / block_rows)))
    key = lambda salt: F.xxhash64(*[F.col(c) for c in columns], F.lit(seed * 1000 + salt))
    block_of = F.pmod(key(1), F.lit(blocks)).cast("int")

    counts = dict(rows.groupBy(block_of.alias("b")).agg(F.count("*").alias("n")).collect())
    counts = [counts.get(b, 0) for b in range(blocks)]
    runs = [{"b": b, "ends": list(map(int, np.cumsum(row)))} for b, row in enumerate(communication_matrix(counts, shards, seed))]
    runs = _inline(spark, runs, "b int, ends array<bigint>")

    named = rows.select(F.struct(*columns).alias("row"), block_of.alias("b"), key(2).alias("k2"), key(3).alias("k3"))
    local = Window.partitionBy("b").orderBy("k2", "row")
    placed = (
        named.withColumn("r", F.row_number().over(local) - 1)
        .join(F.broadcast(runs), "b")
        .select("row", "k3", F.size(F.filter("ends", lambda end: end <= F.col("r"))).alias("shard"))
        .withColumn("part", F.pmod(F.col("k3"), F.lit(parts)).cast("int"))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    again = Window.partitionBy("shard", "part").orderBy("k3", "row")
    return (
        placed.withColumn("r", F.row_number().over(again) - 1)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("r")).cast("long").alias("slot"))
    )
