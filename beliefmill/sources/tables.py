"""Typed scans and keyed upserts of belief tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefmill.schemas import SCHEMAS


def load_table(spark: SparkSession, path: str, name: str, archived: bool = False) -> DataFrame:
    """Scan with the fixed schema; archived beliefs are hidden unless asked for."""
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    if name == "memories" and not archived:
        df = df.where(~F.col("is_archived"))
    return df


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], policy: str, column: str | None = None,
           order: str | None = None) -> DataFrame:
    """Keyed upsert. Policies: keep (first wins), overwrite (last wins by
    ``order``), greatest, union (array column), add (counter column).

    Both sides are reduced per key with partial aggregation before the shuffle,
    so a hot key costs one row per task.
    """
    rest = [c for c in base.columns if c not in keys]
    stamp = F.col(order) if order else F.lit(0)
    both = base.select(*base.columns, F.lit(0).alias("_side"), (F.lit(None).cast("string") if not order else stamp.cast("string")).alias("_at")).unionByName(
        changes.select(*base.columns, F.lit(1).alias("_side"), (F.lit(None).cast("string") if not order else stamp.cast("string")).alias("_at")))
    pick = F.struct("_side", "_at", *rest)
    if policy == "keep":
        agg = [F.min(pick).alias("_r")]
    else:
        agg = [F.max(pick).alias("_r")]
    special = {"greatest": F.max, "add": F.sum}
    if policy in special:
        agg = [F.min(pick).alias("_r"), special[policy](column).alias("_v")]
    elif policy == "union":
        agg = [F.min(pick).alias("_r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias("_v")]
    out = both.groupBy(*keys).agg(*agg)
    cols = [F.col(k) for k in keys]
    for c in rest:
        cols.append(F.col("_v").alias(c) if c == column and policy in ("greatest", "add", "union") else F.col(f"_r.{c}").alias(c))
    return out.select(*cols)
