"""Metacognition and overview tables, all keyed by agent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.functions import lexicon as lx
from beliefmill.functions import scalar as sc
from beliefmill.operators.beliefs import active, live
from beliefmill.operators.recall import with_success_rate
from beliefmill.operators.similarity import top_by
from beliefmill.session import instant



def days_before(now, n: int):
    return instant(now) - F.expr(f"INTERVAL {n} DAYS")


def tier_counts(mem: DataFrame) -> DataFrame:
    rows = mem.where(active()).select("agent_id", sc.tier(F.col("confidence")).alias("t"))
    return rows.groupBy("agent_id").agg(*[F.count_if(F.col("t") == x).alias(x) for x in lx.TIERS], F.count("*").alias("total"))


def adjusted_confidence(mem: DataFrame, contra: DataFrame, now) -> DataFrame:
    """Adjusted confidence with its factors and an explanation, per belief."""
    n = contra.groupBy(F.col("belief_id").alias("id")).agg(F.count("*").alias("n_contra"))
    at = instant(now)
    rows = mem.join(n, "id", "left").withColumns({
        "recency": sc.recency_factor(sc.last_confirmed(), at),
        "reinforcement": sc.reinforcement_factor(F.col("reinforcement_count")),
        "source_factor": sc.source_reliability(F.col("source")),
        "penalty": 0.1 * F.coalesce("n_contra", F.lit(0)),
    })
    x = (sc.logit(F.col("confidence")) + F.col("reinforcement") + F.log(F.greatest(F.col("recency"), F.lit(0.02)))
         + F.log("source_factor") - F.col("penalty"))
    out = rows.withColumn("adjusted", sc.clip(sc.sigmoid(x), 0.05, 1.0))
    level = (F.when(F.col("adjusted") >= 0.8, "High confidence").when(F.col("adjusted") >= 0.6, "Moderate confidence")
             .when(F.col("adjusted") >= 0.4, "Low confidence").otherwise("Very low confidence"))
    notes = F.concat_ws(
        "", level,
        F.when(F.col("recency") < 0.5, " - memory is stale (not recently verified)"),
        F.when(F.col("reinforcement") > 0.2, " - reinforced by repeated observations"),
        F.when(F.col("penalty") > 0, " - has contradicting information"),
        F.when(F.col("source_factor") < 0.8, " - from less reliable source"))
    return out.withColumn("explanation", notes).withColumn("factors", F.create_map(
        F.lit("recency"), "recency", F.lit("reinforcement"), "reinforcement", F.lit("contradictions"), -F.col("penalty"), F.lit("source"), "source_factor"))


def uncertainty(mem: DataFrame, contra: DataFrame, now) -> DataFrame:
    """Share of contradicted, weak and stale beliefs per agent and the advice."""
    hit = contra.select(F.col("belief_id").alias("id")).distinct().withColumn("_c", F.lit(True))
    stale = sc.last_confirmed() < days_before(now, 30)
    rows = mem.where(live()).join(hit, "id", "left").select(
        "agent_id", F.coalesce("_c", F.lit(False)).alias("c"), (F.col("confidence") < F.lit(0.6).cast("float")).alias("l"), stale.alias("s"))
    out = rows.groupBy("agent_id").agg(F.count("*").alias("total"), F.count_if("c").alias("contradicted"), F.count_if("l").alias("low"), F.count_if("s").alias("stale"))
    level = F.least(F.lit(1.0), (0.4 * F.col("contradicted") + 0.35 * F.col("low") + 0.25 * F.col("stale")) / F.col("total"))
    advice = (
        F.when(F.col("level") < 0.2, "Knowledge base is relatively certain. Continue normal operations.")
        .when(F.col("contradicted") > 0, F.format_string("Resolve %d contradicted beliefs by verifying with the user", "contradicted"))
        .when(F.col("low") > 0, F.format_string("Confirm %d low-confidence memories through conversation", "low"))
        .when(F.col("stale") > 0, F.format_string("Update %d stale memories that haven't been verified recently", "stale"))
        .otherwise("Review memory health and verify uncertain beliefs with the user."))
    return out.withColumn("level", level).withColumn("recommendation", advice)


def uncertainty_for_topic(mem: DataFrame, contra: DataFrame, now, topic_hits: DataFrame) -> DataFrame:
    """Same report over beliefs near a topic; agents without any keep all theirs.
    ``topic_hits`` lists (agent_id, id) at or above the similarity bound."""
    has = topic_hits.select("agent_id").distinct().withColumn("_t", F.lit(True))
    rows = mem.join(has, "agent_id", "left")
    near = rows.where(F.col("_t").isNotNull()).join(topic_hits.select("id").distinct(), "id", "left_semi")
    return uncertainty(near.unionByName(rows.where(F.col("_t").isNull())).drop("_t"), contra, now)


def procedure_assessment(proc: DataFrame) -> DataFrame:
    used = with_success_rate(proc).where(F.col("use_count") >= 5)
    return used.withColumn("verdict", F.when(F.col("success_rate") < 0.5, "underperforming").when(F.col("success_rate") >= 0.8, "effective")).where(
        F.col("verdict").isNotNull()).withColumn("recommendation", F.when(
            F.col("verdict") == "effective", "This approach is working well - consider applying to similar situations"
        ).otherwise("Consider retiring or modifying this approach - success rate is below 50%"))


def failure_patterns(ep: DataFrame, now) -> DataFrame:
    """Topics seen at least twice in failures of the last 30 days, three per agent."""
    recent = ep.where((F.col("outcome") == "failure") & (F.col("occurred_at") >= days_before(now, 30)) & (F.col("occurred_at") <= instant(now)))
    n = recent.select("agent_id", F.explode("topics").alias("topic")).groupBy("agent_id", "topic").agg(F.count("*").alias("frequency")).where("frequency >= 2")
    return top_by(n, ["agent_id"], [F.desc("frequency"), F.asc("topic")], 3).withColumns({
        "pattern": F.concat(F.lit("Recurring failures involving '"), "topic", F.lit("'")),
        "suggestion": F.concat(F.lit("Review and improve handling of '"), "topic", F.lit("' related situations"))})


def strategy(proc: DataFrame, patterns: DataFrame) -> DataFrame:
    n = procedure_assessment(proc).groupBy("agent_id").agg(
        F.count_if(F.col("verdict") == "effective").alias("effective"), F.count_if(F.col("verdict") == "underperforming").alias("underperforming"))
    p = patterns.groupBy("agent_id").agg(F.count("*").alias("patterns"))
    out = proc.select("agent_id").distinct().join(n, "agent_id", "left").join(p, "agent_id", "left").na.fill(0, ["effective", "underperforming", "patterns"])
    hints = F.filter(F.array(
        F.when(F.col("underperforming") > 0, F.format_string("Review %d underperforming strategies for potential improvements or retirement", "underperforming")),
        F.when(F.col("patterns") > 0, "Analyze recurring failure patterns to identify root causes"),
        F.when((F.col("effective") > 0) & (F.col("underperforming") > 0), "Consider applying patterns from effective strategies to improve underperforming ones"),
    ), lambda x: x.isNotNull())
    return out.withColumn("suggestions", F.when(F.size(hints) > 0, hints).otherwise(
        F.array(F.lit("Continue monitoring strategy effectiveness as more data is collected"))))


def reflect(mem: DataFrame, contra: DataFrame, proc: DataFrame, ep: DataFrame, now, sample: int | None = None) -> DataFrame:
    """Health score and action items per agent. The mean adjusted confidence is that of all live
    rows, or of the ``sample`` least recently used ones."""
    first = mem.where(live())
    if sample is not None:
        first = top_by(first, ["agent_id"], [F.asc_nulls_first("last_accessed_at"), F.asc("id")], sample).drop("rank")
    conf = adjusted_confidence(first, contra, now).groupBy("agent_id").agg(F.avg("adjusted").alias("avg_adjusted"))
    unc = uncertainty(mem, contra, now)
    strat = strategy(proc, failure_patterns(ep, now))
    j = unc.join(conf, "agent_id", "full_outer").join(strat, "agent_id", "full_outer")
    judged = F.col("effective") + F.col("underperforming")
    parts = [(F.col("avg_adjusted"), 0.4), (1 - F.col("level"), 0.3), (F.when(judged > 0, F.col("effective") / judged), 0.3)]
    total = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in parts), F.lit(0.0))
    items = F.filter(F.array(
        F.when(F.col("contradicted") > 0, F.format_string("PRIORITY: Resolve %d contradicted beliefs", "contradicted")),
        F.when(F.col("underperforming") > 0, F.format_string("Review %d underperforming strategies", "underperforming")),
        F.when(F.col("low") > 3, F.format_string("Verify %d low-confidence memories", "low")),
        F.when(F.col("stale") > 5, F.format_string("Update %d stale memories", "stale")),
        F.when(F.col("patterns") > 0, "Investigate recurring failure patterns"),
    ), lambda x: x.isNotNull())
    return j.select("agent_id", F.when(weight > 0, total / weight).otherwise(0.5).alias("health"),
                    F.when(F.size(items) > 0, items).otherwise(F.array(F.lit("Memory system is healthy - continue monitoring"))).alias("items"))


def memory_health(mem: DataFrame, ep: DataFrame, proc: DataFrame, sch: DataFrame, contra: DataFrame, now) -> DataFrame:
    rows = mem.where(live())
    at = instant(now)
    base = rows.groupBy("agent_id").agg(
        F.count("*").alias("semantic"), F.count_if(F.col("confidence") < F.lit(0.3).cast("float")).alias("at_risk"),
        F.count_if(F.col("last_accessed_at") >= days_before(at, 1)).alias("recent"),
        F.array_sort(F.collect_set(F.when(F.col("confidence") < F.lit(0.5).cast("float"), F.col("type")))).alias("weak_types"),
        F.avg(F.col("confidence").cast("double")).alias("avg_confidence"))
    raw = ep.where(F.col("consolidation_status") == "raw").groupBy("agent_id").agg(F.count("*").alias("raw_episodes"), F.min("occurred_at").alias("oldest_raw"))
    procs = proc.groupBy("agent_id").agg(F.count("*").alias("procedures"))
    schs = sch.groupBy("agent_id").agg(F.count("*").alias("schemas"))
    owner = mem.select(F.col("id").alias("belief_id"), "agent_id")
    per = contra.groupBy("belief_id").agg(F.count("*").alias("n"))
    con = per.join(owner, "belief_id").groupBy("agent_id").agg(F.sum("n").alias("contradictions"))
    out = base
    for side in (raw, procs, schs, con):
        out = out.join(side, "agent_id", "left")
    return out.na.fill(0, ["raw_episodes", "procedures", "schemas", "contradictions"])


def contradiction_counts(mem: DataFrame, contra: DataFrame) -> DataFrame:
    per = contra.groupBy(F.col("belief_id").alias("id")).agg(F.count("*").alias("n"))
    return per.join(mem.select("id", "agent_id"), "id").groupBy("agent_id").agg(F.sum("n").alias("contradictions"))


def dashboard(mem: DataFrame, contra: DataFrame, stats: DataFrame) -> DataFrame:
    review = mem.where(F.col("needs_review") & active()).groupBy("agent_id").agg(F.count("*").alias("review"))
    return (tier_counts(mem).join(review, "agent_id", "left").join(contradiction_counts(mem, contra), "agent_id", "left")
            .join(stats.select("agent_id", "velocity", "stability"), "agent_id", "left").na.fill(0, ["review", "contradictions"]))


def mind(mem: DataFrame, proc: DataFrame, sch: DataFrame, ep: DataFrame) -> DataFrame:
    """The top rows of every kind per agent: (agent_id, section, pos, id, text)."""
    rows = mem.where(live())
    beliefs = top_by(rows, ["agent_id"], [F.desc("confidence"), F.asc("id")], 20, "pos").select(
        "agent_id", F.lit("belief").alias("section"), "pos", "id", F.col("content").alias("text"))
    weight = F.col("success_rate") * (F.col("use_count") + 1)
    procs = top_by(with_success_rate(proc).withColumn("_w", weight), ["agent_id"], [F.desc("_w"), F.asc("id")], 10, "pos").select(
        "agent_id", F.lit("procedure").alias("section"), "pos", "id", sc.truncate_text(F.col("action_template"), 200).alias("text"))
    schs = top_by(sch, ["agent_id"], [F.desc("confidence"), F.asc("id")], 10, "pos").select(
        "agent_id", F.lit("schema").alias("section"), "pos", "id", F.col("name").alias("text"))
    eps = top_by(ep, ["agent_id"], [F.desc("occurred_at"), F.asc("id")], 10, "pos").select(
        "agent_id", F.lit("episode").alias("section"), "pos", "id", sc.truncate_text(F.col("raw_content"), 300).alias("text"))
    return beliefs.unionByName(procs).unionByName(schs).unionByName(eps)


def mind_totals(mem: DataFrame, proc: DataFrame, sch: DataFrame, ep: DataFrame) -> DataFrame:
    a = mem.where(live()).groupBy("agent_id").agg(
        F.count("*").alias("memories"), F.avg(F.col("confidence").cast("double")).alias("avg_confidence"),
        F.count_if(F.col("confidence") < F.lit(0.4).cast("float")).alias("at_risk"))
    e = ep.groupBy("agent_id").agg(F.count("*").alias("episodes"), F.count_if(F.col("consolidation_status") == "archived").alias("archived"))
    return (a.join(proc.groupBy("agent_id").agg(F.count("*").alias("procedures")), "agent_id", "left")
            .join(sch.groupBy("agent_id").agg(F.count("*").alias("schemas")), "agent_id", "left").join(e, "agent_id", "left")
            .na.fill(0, ["procedures", "schemas", "episodes", "archived"]))


def entity_counts(ent: DataFrame, mentions: DataFrame) -> DataFrame:
    n = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    return ent.join(n, "entity_id", "left").na.fill(0, ["mentions"])


def cluster_theme(members: DataFrame) -> DataFrame:
    """(cluster_id, theme): most frequent type, the lower name on a tie."""
    n = members.groupBy("cluster_id", "type").agg(F.count("*").alias("n"))
    return n.groupBy("cluster_id").agg(F.concat(F.min_by("type", F.struct(-F.col("n"), "type")), F.lit("-cluster")).alias("theme"))


def belief_cube(mem: DataFrame) -> DataFrame:
    rows = mem.where(active()).select(sc.tier(F.col("confidence")).alias("tier"), "type", "provenance", "binding", F.col("confidence").cast("double").alias("c"))
    return rows.cube("tier", "type", "provenance", "binding").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("c").alias("avg_confidence"))


def contradiction_pairs(contra: DataFrame, mem: DataFrame, n: int = 500) -> DataFrame:
    a = mem.select(F.col("id").alias("belief_id"), "agent_id", F.col("content").alias("belief"), F.col("confidence").alias("belief_confidence"))
    b = mem.select(F.col("id").alias("contradicted_by_id"), F.col("content").alias("other"), F.col("confidence").alias("other_confidence"))
    pairs = contra.join(a, "belief_id").join(b, "contradicted_by_id")
    return top_by(pairs, ["agent_id"], [F.desc("detected_at"), F.asc("belief_id"), F.asc("contradicted_by_id")], n)


def review_queue(queue: DataFrame, mem: DataFrame, contra: DataFrame) -> DataFrame:
    """One row per queued belief and conflict (an archived other side shows nulls)."""
    other = mem.where(active()).select(F.col("id").alias("contradicted_by_id"), F.col("content").alias("other"), F.col("confidence").alias("other_confidence"))
    c = contra.select(F.col("belief_id").alias("id"), "contradicted_by_id")
    return queue.join(c, "id", "left").join(other, "contradicted_by_id", "left")
