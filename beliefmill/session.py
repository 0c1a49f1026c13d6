"""Session helpers: time zone, evaluation instant, lineage cuts."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def local_session(app: str = "beliefmill", cpus: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def instant(now) -> Column:
    """Turn a string, datetime or column into a timestamp column (UTC session)."""
    if isinstance(now, Column):
        return now
    if isinstance(now, dt.datetime):
        now = now.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(now)).cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(HOUR_US))


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_US))


def prepare_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder named by the session; only a local master may fall
    back to a folder of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="beliefmill-ckpt-")
    sc.setCheckpointDir(shared)


def pin(df: DataFrame, split_by: str | None = None) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them from there;
    with ``split_by``, a read of one value of that column opens only its files.

    Later branches and retried tasks then all see the same rows, lost executors
    cost no lineage, and the plan above knows the real size and can prune columns.
    """
    spark = df.sparkSession
    prepare_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/pin-{uuid.uuid4().hex}"
    (df.write.partitionBy(split_by) if split_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


BROADCAST_ROWS = 200_000


def small_side(pinned: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a pinned table whose counted size is within the bound;
    beyond it Spark's own join choice stands. Counting reads only the pinned rows."""
    return F.broadcast(pinned) if pinned.count() <= rows else pinned


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
