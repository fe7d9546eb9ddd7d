"""Gapless numbers of rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oriel.session import materialise


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in ``order``. Rows are sorted into ranges, ranges counted, and rows numbered in theirs."""
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    placed = materialise(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition: safe to broadcast
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + n).select(*rows.columns, name)
