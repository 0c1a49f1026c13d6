"""Calibration, learning statistics, tuner, usage."""

from pyspark.sql import functions as F

from beliefmill.operators import learning as ln
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query

SAMPLES = "s AS (SELECT id, tenant_id, agent_id, old_confidence::DOUBLE AS p, (new_confidence >= old_confidence)::INT AS y FROM mlog WHERE mutation_type IN ('feedback', 'outcome', 'contradiction') AND old_confidence IS NOT NULL AND new_confidence IS NOT NULL)"
BINS = f"{SAMPLES}, b AS (SELECT tenant_id, agent_id, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob, sum((p - y) * (p - y)) AS sq FROM s GROUP BY ALL)"


@query("calibration_samples", "mlog", f"WITH {SAMPLES} SELECT id, round(p, 6) AS predicted, y = 1 AS correct FROM s")
def calibration_samples(t):
    return ln.calibration_samples(t.mlog).select("id", r6("predicted", "predicted"), "correct")


@query("calibration_bins", "mlog", f"WITH {BINS} SELECT tenant_id, agent_id, bin, n, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed FROM b")
def calibration_bins(t):
    return ln.calibration_bins(ln.calibration_samples(t.mlog), ["tenant_id", "agent_id"]).select(
        "tenant_id", "agent_id", "bin", "n", r6("mean_predicted", "mean_predicted"), r6("observed", "observed"))


@query("calibration", "mlog", f"""
WITH {SAMPLES}, b AS (SELECT tenant_id, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob, sum((p - y) * (p - y)) AS sq FROM s GROUP BY ALL)
SELECT tenant_id, sum(n)::BIGINT AS samples, round(sum(n * abs(ob - mp)) / sum(n), 6) AS ece, round(max(abs(ob - mp)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier, sum(n) < 30 AS insufficient, count(*) AS n_bins FROM b GROUP BY 1""")
def calibration(t):
    return ln.calibration(ln.calibration_samples(t.mlog), ["tenant_id"]).select(
        "tenant_id", "samples", r6("ece", "ece"), r6("mce", "mce"), r6("brier", "brier"), "insufficient", F.size("bins").cast("long").alias("n_bins"))


@query("calibration_by_agent", "mlog", f"""
WITH {BINS} SELECT tenant_id, agent_id, sum(n)::BIGINT AS samples, round(sum(n * abs(ob - mp)) / sum(n), 6) AS ece, round(max(abs(ob - mp)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM b GROUP BY 1, 2""")
def calibration_by_agent(t):
    return ln.calibration(ln.calibration_samples(t.mlog), ["tenant_id", "agent_id"]).select(
        "tenant_id", "agent_id", "samples", r6("ece", "ece"), r6("mce", "mce"), r6("brier", "brier"))


def stats_sql(rows, key):
    f = lambda k: f"count(*) FILTER (mutation_type = 'feedback' AND reason = 'feedback: {k}')"
    o = lambda k: f"count(*) FILTER (mutation_type = 'outcome' AND reason = 'outcome: {k}')"
    lt = "mutation_type IN ('feedback', 'outcome', 'reinforcement', 'contradiction')"
    return f"""c AS (SELECT {key}, count(*) FILTER ({lt} AND new_confidence > old_confidence) AS increases, count(*) FILTER ({lt} AND new_confidence < old_confidence) AS decreases,
 count(*) FILTER (mutation_type = 'contradiction') AS contradictions, {f('helpful')} AS helpful, {f('unhelpful')} AS unhelpful, {f('ignored')} AS ignored, {f('contradicted')} AS contradicted, {f('outdated')} AS outdated,
 {o('helpful')} AS success, {o('unhelpful')} AS failure FROM {rows} GROUP BY ALL)
SELECT *, round((increases - decreases) / nullif(increases + decreases, 0)::DOUBLE, 6) AS velocity,
 round((helpful + success) / nullif(helpful + success + unhelpful + contradicted + outdated + failure + contradictions, 0)::DOUBLE, 6) AS stability FROM c"""


STAT_COLS = ["increases", "decreases", "contradictions", "helpful", "unhelpful", "ignored", "contradicted", "outdated", "success", "failure"]


def stat_cols(df, *keys):
    return df.select(*keys, *STAT_COLS, r6("velocity", "velocity"), r6("stability", "stability"))


@query("learning_stats", "mlog", f"""
WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id DESC) AS rk FROM mlog WHERE created_at >= TIMESTAMP '2024-01-08 00:00:00') x
  WHERE rk <= 1000 AND created_at <= TIMESTAMP '2024-01-28 00:00:00'), {stats_sql('w', 'agent_id')}""")
def learning_stats(t):
    return stat_cols(ln.learning_stats(t.mlog, "2024-01-08 00:00:00", "2024-01-28 00:00:00", newest=ln.NEWEST_MUTATIONS), "agent_id")


@query("learning_stats_all", "mlog", f"""
WITH w AS (SELECT * FROM mlog WHERE created_at >= TIMESTAMP '2024-01-08 00:00:00' AND created_at <= TIMESTAMP '2024-01-28 00:00:00'), {stats_sql('w', 'agent_id')}""")
def learning_stats_all(t):
    return stat_cols(ln.learning_stats(t.mlog, "2024-01-08 00:00:00", "2024-01-28 00:00:00", newest=None), "agent_id")


@query("feedback_rollup", "signals mem", "SELECT m.agent_id, m.type AS memory_type, s.signal_type, count(*) AS n FROM signals s JOIN mem m ON m.id = s.memory_id GROUP BY ALL")
def feedback_rollup(t):
    return ln.feedback_rollup(t.signals, t.mem)


@query("tune_policies", "signals mem policies", """
WITH sk AS (SELECT s.*, m.agent_id, m.type FROM signals s JOIN mem m ON m.id = s.memory_id WHERE NOT (m.type = 'preference' AND s.signal_type NOT IN ('ignored')) AND NOT (m.type = 'decision' AND s.signal_type NOT IN ('unhelpful')) AND NOT (m.type = 'fact' AND s.signal_type <> 'helpful')),
p AS (SELECT agent_id, type AS memory_type, count(*) AS total, avg((signal_type = 'ignored')::INT) AS ig, avg((signal_type = 'helpful')::INT) AS he, avg((signal_type = 'unhelpful')::INT) AS un FROM sk GROUP BY ALL),
e AS (SELECT agent_id FROM sk GROUP BY 1 HAVING count(*) >= 10),
j AS (SELECT p.*, coalesce(priority_weight::DOUBLE, 1.0) AS w, coalesce(max_memories, 100) AS m FROM p JOIN e USING (agent_id) LEFT JOIN policies q ON q.agent_id = p.agent_id AND q.memory_type = p.memory_type)
SELECT agent_id, memory_type, total, round(CASE WHEN ig > 0.7 THEN greatest(0.1, w - 0.1) ELSE w END + CASE WHEN he > 0.7 THEN 0.1 ELSE 0 END, 6) AS new_weight,
 CASE WHEN un > 0.7 THEN greatest(10, m - 10) ELSE m END AS new_max, ig > 0.7 OR he > 0.7 OR un > 0.7 AS changed FROM j""")
def tune_policies(t):
    m = t.mem.select(F.col("id").alias("memory_id"), "type")
    skewed = t.signals.join(m, "memory_id").where(
        ~((F.col("type") == "preference") & (F.col("signal_type") != "ignored")) & ~((F.col("type") == "decision") & (F.col("signal_type") != "unhelpful"))
        & ~((F.col("type") == "fact") & (F.col("signal_type") != "helpful"))).drop("type")
    return ln.tune_policies(ln.feedback_rollup(skewed, t.mem), t.policies).select("agent_id", "memory_type", "total", r6("new_weight", "new_weight"), "new_max", "changed")


@query("usage_monthly", "usage_events", "SELECT tenant_id, strftime(ts, '%Y-%m') AS month, count(*) FILTER (kind = 'written') AS written, count(*) FILTER (kind = 'recall') AS recalls FROM usage_events GROUP BY ALL")
def usage_monthly(t):
    return ln.usage_monthly(t.usage_events).withColumn("month", F.date_format("month", "yyyy-MM"))


@query("quota_status", "tenants mem", """
SELECT t.tenant_id, CASE t.tenant_id WHEN 1 THEN 'developer' ELSE 'free' END AS plan_used, a.n AS n_agents, a.m AS n_memories, a.n >= CASE t.tenant_id WHEN 1 THEN 5 ELSE 1 END AS agents_full, a.m >= CASE t.tenant_id WHEN 1 THEN 50000 ELSE 1000 END AS memories_full
FROM tenants t JOIN (SELECT tenant_id, count(DISTINCT agent_id) AS n, count(*) AS m FROM mem WHERE NOT is_archived GROUP BY 1) a ON a.tenant_id = t.tenant_id""")
def quota_status(t):
    live = t.mem.where(~F.col("is_archived"))
    agents = live.select("tenant_id", "agent_id").distinct().groupBy("tenant_id").agg(F.count("*").alias("n_agents"))
    return ln.quota_status(t.tenants, agents, live.groupBy("tenant_id").agg(F.count("*").alias("n_memories")))
