"""Places in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.traversal import _cut


def with_place(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of ``order``, which must tell rows apart.

    Rows are dealt by range of the order and written; each range is numbered
    for itself, and the numbers of rows in the ranges before are added.
    """
    dealt = _cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_r")).drop("_range", "_start", "_r")
