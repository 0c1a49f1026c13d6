"""Calibration, learning statistics, policy tuning, usage and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.functions import lexicon as lx
from beliefmill.functions import scalar as sc
from beliefmill.operators.similarity import top_by
from beliefmill.session import instant

MIN_SAMPLES = 30
OUTCOME_TYPES = ["feedback", "outcome", "contradiction"]
LEARNING_TYPES = ["feedback", "outcome", "reinforcement", "contradiction"]
NEWEST_MUTATIONS = 1000
MIN_TUNER_SIGNALS = 10


def calibration_samples(mlog: DataFrame) -> DataFrame:
    return mlog.where(
        F.col("mutation_type").isin(*OUTCOME_TYPES) & F.col("old_confidence").isNotNull() & F.col("new_confidence").isNotNull()
    ).select("id", "tenant_id", "agent_id", F.col("old_confidence").cast("double").alias("predicted"),
             (F.col("new_confidence") >= F.col("old_confidence")).alias("correct"))


def calibration_bins(samples: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    p = sc.clip(F.col("predicted"), 0.0, 1.0)
    y = F.col("correct").cast("double")
    return samples.groupBy(*by, F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed"),
        F.sum((p - y) * (p - y)).alias("sq")).withColumns({
            "lower": F.col("bin") / float(bins), "upper": (F.col("bin") + 1) / float(bins)})


def calibration(samples: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """ECE, MCE, Brier and the reliability diagram per group (bins first, then groups)."""
    b = calibration_bins(samples, by, bins)
    gap = F.abs(F.col("observed") - F.col("mean_predicted"))
    return b.groupBy(*by).agg(
        F.sum("n").alias("samples"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
        F.array_sort(F.collect_list(F.struct("lower", "upper", "n", "mean_predicted", "observed"))).alias("bins"),
    ).withColumn("insufficient", F.col("samples") < MIN_SAMPLES)


def learning_counters(rows: DataFrame, keys: list) -> DataFrame:
    """Counters, velocity and stability per key of the given change rows."""
    counts = F.col("mutation_type").isin(*LEARNING_TYPES)
    old, new = F.col("old_confidence"), F.col("new_confidence")

    def fb(kind):
        return F.count_if((F.col("mutation_type") == "feedback") & (F.col("reason") == f"feedback: {kind}"))

    def oc(kind):
        return F.count_if((F.col("mutation_type") == "outcome") & (F.col("reason") == f"outcome: {kind}"))

    out = rows.groupBy(*keys).agg(
        F.count_if(counts & (new > old)).alias("increases"), F.count_if(counts & (new < old)).alias("decreases"),
        F.count_if(F.col("mutation_type") == "contradiction").alias("contradictions"),
        F.count_if(F.col("mutation_type") == "reinforcement").alias("reinforced"),
        fb("helpful").alias("helpful"), fb("unhelpful").alias("unhelpful"), fb("ignored").alias("ignored"),
        fb("contradicted").alias("contradicted"), fb("outdated").alias("outdated"),
        oc("helpful").alias("success"), oc("unhelpful").alias("failure"),
        F.count_if((F.col("mutation_type") == "outcome") & F.col("reason").startswith("outcome:") & (F.length("reason") > 9)
                   & ~F.col("reason").isin("outcome: helpful", "outcome: unhelpful")).alias("neutral"),
    )
    moved = F.col("increases") + F.col("decreases")
    held = F.col("helpful") + F.col("success") + F.col("reinforced")
    lost = F.col("unhelpful") + F.col("contradicted") + F.col("outdated") + F.col("failure") + F.col("contradictions")
    return out.withColumns({
        "velocity": F.when(moved > 0, (F.col("increases") - F.col("decreases")) / moved),
        "stability": F.when(held + lost > 0, held / (held + lost))})


def learning_stats(mlog: DataFrame, start, end, newest: int | None = None) -> DataFrame:
    rows = mlog.where(F.col("created_at") >= instant(start))
    if newest:
        rows = top_by(rows, ["agent_id"], [F.desc("created_at"), F.desc("id")], newest)
    return learning_counters(rows.where(F.col("created_at") <= instant(end)), ["agent_id"])


def feedback_rollup(signals: DataFrame, mem: DataFrame) -> DataFrame:
    """Counts by (agent, type, signal); signals are counted per belief first."""
    per = signals.groupBy("memory_id", "signal_type").agg(F.count("*").alias("n"))
    return per.join(mem.select(F.col("id").alias("memory_id"), "agent_id", "type"), "memory_id").groupBy(
        "agent_id", F.col("type").alias("memory_type"), "signal_type").agg(F.sum("n").alias("n"))


def tune_policies(rollup: DataFrame, policies: DataFrame) -> DataFrame:
    def share(kind):
        return F.coalesce(F.sum(F.when(F.col("signal_type") == kind, F.col("n"))), F.lit(0)) / F.sum("n")

    per = rollup.groupBy("agent_id", "memory_type").agg(
        F.sum("n").alias("total"), share("ignored").alias("ignored"), share("helpful").alias("helpful"), share("unhelpful").alias("unhelpful"))
    enough = rollup.groupBy("agent_id").agg(F.sum("n").alias("agent_total")).where(F.col("agent_total") >= MIN_TUNER_SIGNALS)
    cur = per.join(enough, "agent_id").join(policies.select("agent_id", "memory_type", "max_memories", "priority_weight"), ["agent_id", "memory_type"], "left")
    w = F.coalesce(F.col("priority_weight").cast("double"), F.lit(1.0))
    m = F.coalesce("max_memories", F.lit(100))
    lower = F.when(F.col("ignored") > 0.7, F.greatest(F.lit(0.1), w - 0.1)).otherwise(w)
    return cur.select(
        "agent_id", "memory_type", "total",
        F.when(F.col("helpful") > 0.7, lower + 0.1).otherwise(lower).alias("new_weight"),
        F.when(F.col("unhelpful") > 0.7, F.greatest(F.lit(10), m - 10)).otherwise(m).alias("new_max"),
        ((F.col("ignored") > 0.7) | (F.col("helpful") > 0.7) | (F.col("unhelpful") > 0.7)).alias("changed"))


def usage_monthly(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.count_if(F.col("kind") == "written").alias("written"), F.count_if(F.col("kind") == "recall").alias("recalls"))


def quota_status(tenants: DataFrame, agents: DataFrame, memories: DataFrame) -> DataFrame:
    """Stored rows against the caps of the tenant's plan (unknown plans count as free)."""
    known = F.when(F.col("plan").isin(*lx.PLAN_LIMITS), F.col("plan")).otherwise("free")
    limits = lx.PLAN_LIMITS
    agent_cap = sc.lookup(F.col("plan_used"), {p: a for p, (a, _) in limits.items() if a is not None}, None)
    mem_cap = sc.lookup(F.col("plan_used"), {p: m for p, (_, m) in limits.items() if m is not None}, None)
    counted = tenants.withColumn("plan_used", known).join(agents, "tenant_id", "left").join(memories, "tenant_id", "left")
    a, m = F.coalesce("n_agents", F.lit(0)), F.coalesce("n_memories", F.lit(0))
    return counted.select("tenant_id", "plan_used", a.alias("n_agents"), m.alias("n_memories"),
                          F.coalesce(a >= agent_cap, F.lit(False)).alias("agents_full"), F.coalesce(m >= mem_cap, F.lit(False)).alias("memories_full"))
