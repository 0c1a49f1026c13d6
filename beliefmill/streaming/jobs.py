"""Streaming jobs. What waits, repeats or adds up is held by Spark's own keyed state under a
watermark. Each micro-batch appends its results to a table with one folder per batch, so a
replayed batch overwrites its own rows and nothing else; earlier rows are never rewritten.

Rows older than the watermark are dropped by Spark; ``dropped`` counts them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from beliefmill.operators import admission as ad
from beliefmill.operators import audit as au
from beliefmill.operators import dynamics as dy
from beliefmill.operators import ordering as od
from beliefmill.operators.learning import learning_counters
from beliefmill.session import pin, prepare_checkpoints


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    prepare_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drain(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a streaming frame over all available input and stop."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fn).start()
    q.awaitTermination()
    return q


def dropped(q: StreamingQuery) -> int:
    """Late rows among the micro-batches the query still reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])


def put(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def taken(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batches (below ``before``) with their ``batch``, or None before the first."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows if before is None else rows.where(F.col("batch") < before)


def append_closed(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what the watermark has closed to a table."""
    return drain(df, lambda b, i: put(b, out, i), checkpoint)


# -- windowed counts --------------------------------------------------------

def arriving(rows: DataFrame, at: str, delay: str, once: str | None) -> DataFrame:
    """Rows under a watermark, each value of ``once`` a single time."""
    rows = rows.withWatermark(at, delay)
    return rows.dropDuplicatesWithinWatermark([once]) if once else rows


def usage_stream(events: DataFrame, delay: str = "2 days", once: str | None = None) -> DataFrame:
    """Usage per tenant and day, final once the watermark has passed the day."""
    return arriving(events, "ts", delay, once).groupBy("tenant_id", F.window("ts", "1 day").alias("day")).agg(
        F.count_if(F.col("kind") == "written").alias("written"), F.count_if(F.col("kind") == "recall").alias("recalls"))


def usage_months(days: DataFrame) -> DataFrame:
    """Usage per tenant and calendar month from closed days."""
    return days.groupBy("tenant_id", F.date_trunc("month", "day.start").alias("month")).agg(F.sum("written").alias("written"), F.sum("recalls").alias("recalls"))


def learning_stream(mlog: DataFrame, width: str = "7 days", slide: str = "1 day", delay: str = "2 days", once: str | None = None) -> DataFrame:
    """Learning statistics per agent over sliding windows (tumbling where both lengths agree)."""
    return learning_counters(arriving(mlog, "created_at", delay, once), ["agent_id", F.window("created_at", width, slide)])


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", key: str = "user_id", once: str | None = None) -> DataFrame:
    """Sessions closed by a gap, with their size."""
    return arriving(events, "ts", delay, once).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def session_expiry_stream(events: DataFrame, gap: str, delay: str, archive: Callable[[DataFrame, int], None], checkpoint: str, key: str = "user_id", once: str | None = None) -> StreamingQuery:
    """Hand every closed session to ``archive`` once; append mode emits a session
    when the watermark has passed its end."""
    return drain(session_stream(events, gap, delay, key, once), archive, checkpoint)


# -- table-changing jobs ----------------------------------------------------

class FeedbackStream:
    """Running confidence per belief, folded in event order.

    Every event waits as an entry of its own in Spark's keyed state until the watermark has
    passed its slot; a repeated event meets its first there, so a hot belief fills no entry with
    many events. What a batch releases is older than all that follows, so it is folded into one
    clamped step per belief and appended. A belief stands at its stored confidence after its
    steps in order of batch; waiting events don't count yet.
    """

    def __init__(self, spark: SparkSession, mem: DataFrame, folder: str, delay: str = "24 hours", slot: str = "1 minute"):
        self.spark, self.mem, self.delay, self.slot = spark, mem, delay, slot
        self.steps = f"{folder}/steps"

    def released(self, signals: DataFrame) -> DataFrame:
        slot = F.window("created_at", self.slot)
        return signals.withWatermark("created_at", self.delay).groupBy(slot, "id", "memory_id", "signal_type", F.unix_micros("created_at").alias("at")).agg(
            F.count("*").alias("copies")).select("id", "memory_id", "signal_type", F.timestamp_micros("at").alias("created_at"))

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        # pinned, as range partitioning reads its input twice
        put(dy.fold_feedback(pin(rows)), self.steps, batch_id)

    def run(self, signals: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(self.released(signals), self.batch, checkpoint)

    def result(self) -> DataFrame:
        """(id, confidence, reinforcement_count) of all beliefs."""
        c, n = F.col("confidence").cast("double"), F.col("reinforcement_count").cast("double")
        steps = taken(self.spark, self.steps)
        if steps is None:
            return self.mem.select("id", c.alias("confidence"), n.cast("long").alias("reinforcement_count"))
        folded = od.compose_slices(steps.withColumnRenamed("batch", "_slice"), "memory_id", list(dy.STEPS))
        known = F.col("conf_fold").isNotNull()
        return self.mem.join(folded, self.mem.id == folded.memory_id, "left").select(
            "id", F.when(known, od.folded_confidence(c, F.col("conf_fold"))).otherwise(c).alias("confidence"),
            F.when(known, od.apply_triple(n, F.col("count_fold"))).otherwise(n).cast("long").alias("reinforcement_count"))


class AccessStream:
    """Access boosts. Spark's keyed state adds up the hits of a belief; a batch appends the new
    totals of the beliefs it touched, and the greatest total of a belief is its latest."""

    def __init__(self, spark: SparkSession, mem: DataFrame, folder: str):
        self.spark, self.mem, self.totals = spark, mem, f"{folder}/totals"

    def run(self, hits: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(dy.access_totals(hits), lambda b, i: put(b, self.totals, i), checkpoint, "update")

    def result(self) -> DataFrame:
        base = self.mem.select("id", F.col("confidence").cast("double").alias("confidence"), F.col("access_count").cast("long").alias("access_count"))
        totals = taken(self.spark, self.totals)
        if totals is None:
            return base
        latest = totals.groupBy("memory_id").agg(F.max("hits").alias("hits"), F.max("seen").alias("seen"))
        raised = dy.boosted(base, latest).select(F.col("id").alias("_id"), "new_confidence", "new_access_count")
        return base.join(raised, F.col("id") == F.col("_id"), "left").select(
            "id", F.coalesce("new_confidence", "confidence").alias("confidence"), F.coalesce("new_access_count", "access_count").alias("access_count"))


class SealStream:
    """Sealed log and chain heads per batch. A row delivered again within the delay is met by
    its id in Spark's keyed state, so at-least-once delivery does not fork a chain."""

    def __init__(self, spark: SparkSession, folder: str, delay: str = "30 days"):
        self.spark, self.delay = spark, delay
        self.sealed, self.ends = f"{folder}/log", f"{folder}/heads"

    def heads(self, before: int | None = None) -> DataFrame | None:
        rows = taken(self.spark, self.ends, before)
        return None if rows is None else rows.groupBy("tenant_id").agg(F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash"))

    def log(self) -> DataFrame | None:
        rows = taken(self.spark, self.sealed)
        return None if rows is None else rows.drop("batch")

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        put(au.seal_chain(pin(rows), self.heads(batch_id)), self.sealed, batch_id)
        put(au.chain_heads(self.spark.read.parquet(f"{self.sealed}/batch={batch_id}")), self.ends, batch_id)

    def run(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(arriving(rows, "created_at", self.delay, "id"), self.batch, checkpoint)


class AdmissionStream:
    """Each micro-batch, without repeats, judged in order against the stored rows and what
    the batches before have left of them. The lists of recent rows are those of ``mem``."""

    STORED = ["id", "tenant_id", "agent_id", "anchor_id", "session_id", "type", "content", "binding", "emb", "created_at"]

    def __init__(self, spark: SparkSession, mem: DataFrame, settings: DataFrame, folder: str):
        self.spark, self.mem, self.settings = spark, mem, settings
        self.out, self.entered = f"{folder}/decided", f"{folder}/entered"

    def stored(self, before: int) -> DataFrame:
        """The beliefs as the batches below ``before`` have left them."""
        rows = self.mem.select(*self.STORED, "is_archived")
        decided, entered = taken(self.spark, self.out, before), taken(self.spark, self.entered, before)
        if decided is None or entered is None:
            return rows
        gone = decided.where(F.col("decision") == "temporal").select(F.col("existing_id").alias("id"), F.lit(True).alias("_gone")).distinct()
        every = rows.unionByName(entered.drop("batch").withColumn("is_archived", F.lit(False)))
        return every.join(gone, "id", "left").withColumn("is_archived", F.col("is_archived") | F.coalesce("_gone", F.lit(False))).drop("_gone")

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        cols = ["id", "agent_id", "tenant_id", "decision", "existing_id", "sim", "tension_score", "quarantine_reason", "created_at"]
        decided = ad.decide_in_order(pin(rows), self.stored(batch_id), self.settings, recent=self.mem)
        put(ad.admitted_rows(decided).select(*self.STORED), self.entered, batch_id)
        put(decided.select(*cols), self.out, batch_id)

    def run(self, incoming: DataFrame, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
        return drain(arriving(incoming, "created_at", delay, "id"), self.batch, checkpoint)

    def result(self) -> DataFrame:
        return taken(self.spark, self.out).drop("batch")


PASSES = ("tuner", "expirer", "decay", "consolidation", "stats")


def run_pass(name: str, now, tables: dict[str, DataFrame], episodes_per_agent: int | None = None) -> DataFrame:
    """One periodic pass as a batch function of ``now``; scheduling is left to the caller.
    Consolidation takes all raw episodes unless told how many of an agent."""
    from beliefmill.operators import consolidate as co
    from beliefmill.operators import learning as ln
    from beliefmill.operators import lifecycle as lc

    t = tables
    if name == "tuner":
        return ln.tune_policies(ln.feedback_rollup(t["signals"], t["memories"]), t["policies"])
    if name == "expirer":
        return lc.expired(t["memories"], t["policies"], now)
    if name == "decay":
        return dy.decay_pass(t["memories"], t["settings"], now)
    if name == "consolidation":
        return co.process_raw(t["episodes"], episodes_per_agent)
    if name == "stats":
        return ln.learning_stats(t["mutation_log"], t["since"], now)
    raise ValueError(f"unknown pass {name}; one of {PASSES}")
