"""Vectors in bounded blocks, met by bounded batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v) with v as doubles: rows with an id whose vector has only finite components
    (and one that is not 0, if asked). Rows of equal id count once, by their smallest vector."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def blocked(rows: DataFrame, total: int, size: int) -> DataFrame:
    """Deal rows evenly over about total / size partitions, in id order within each."""
    return rows.repartition(max(1, -(-total // size)), F.xxhash64("vec_id")).sortWithinPartitions("vec_id")


def met(index: DataFrame, queries: DataFrame, total: int, size: int) -> DataFrame:
    """Every index row beside every batch of queries: column ``queries`` is an array of (vec_id, v)."""
    n = max(1, -(-total // size))
    batches = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("batch"), F.struct("vec_id", "v").alias("q")).groupBy("batch").agg(F.collect_list("q").alias("queries"))
    return index.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(batches, "batch").drop("batch")
