"""Metacognition, dashboards and counts."""

from pyspark.sql import functions as F

from beliefmill.operators import beliefs as bl
from beliefmill.operators import insight as ins
from beliefmill.operators import learning as ln
from beliefmill.operators.similarity import score_queries
from beliefmill.plans.belief_queries import TIER, pos
from beliefmill.plans.learning_queries import stats_sql
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW

LIVE = "NOT is_archived AND binding <> 'quarantine'"
CONF_AT = "coalesce(last_verified_at, last_accessed_at, updated_at)"
ADJ = f"""adj AS (SELECT m.*, exp(-((epoch_us(:now) - epoch_us({CONF_AT})) / 86400000000.0::DOUBLE) / 30.0) AS rec, CASE WHEN reinforcement_count <= 0 THEN 0 ELSE least(0.5, 0.1 * ln(reinforcement_count + 1.0::DOUBLE)) END AS rei,
  CASE source WHEN 'user_statement' THEN 1.0 WHEN 'tool_output' THEN 0.9 WHEN 'extraction' THEN 0.8 WHEN 'agent_inference' THEN 0.7 ELSE 0.75 END::DOUBLE AS src, 0.1::DOUBLE * coalesce(n, 0) AS pen
  FROM %s m LEFT JOIN (SELECT belief_id, count(*) AS n FROM contra GROUP BY 1) k ON k.belief_id = m.id),
adj2 AS (SELECT *, least(greatest(1 / (1 + exp(-(ln(least(greatest(confidence::DOUBLE, 0.01), 0.99) / (1 - least(greatest(confidence::DOUBLE, 0.01), 0.99))) + rei + ln(greatest(rec, 0.02)) + ln(src) - pen))), 0.05), 1.0) AS adjusted FROM adj)"""


@query("tier_counts", "mem", f"SELECT agent_id, count(*) FILTER (t = 'hot') AS hot, count(*) FILTER (t = 'warm') AS warm, count(*) FILTER (t = 'cold') AS cold, count(*) FILTER (t = 'archive') AS archive, count(*) AS total FROM (SELECT agent_id, {TIER} AS t FROM mem WHERE NOT is_archived) x GROUP BY 1")
def tier_counts(t):
    return ins.tier_counts(t.mem)


@query("type_counts", "mem", f"SELECT agent_id, type, count(*) AS n FROM mem WHERE NOT is_archived GROUP BY ALL")
def type_counts(t):
    return t.mem.where(bl.active()).groupBy("agent_id", "type").agg(F.count("*").alias("n"))


@query("agents_with_memories", "mem", "SELECT tenant_id, count(DISTINCT agent_id) AS agents FROM mem WHERE NOT is_archived GROUP BY 1")
def agents_with_memories(t):
    return t.mem.where(bl.active()).select("tenant_id", "agent_id").distinct().groupBy("tenant_id").agg(F.count("*").alias("agents"))


@query("feedback_counts", "signals mem", "SELECT agent_id, count(*) AS n FROM signals s JOIN mem m ON m.id = s.memory_id GROUP BY 1")
def feedback_counts(t):
    return ln.feedback_rollup(t.signals, t.mem).groupBy("agent_id").agg(F.sum("n").alias("n"))


@query("contradiction_counts", "contra mem", "SELECT agent_id, count(*) AS contradictions FROM contra c JOIN mem m ON m.id = c.belief_id GROUP BY 1")
def contradiction_counts(t):
    return ins.contradiction_counts(t.mem, t.contra)


@query("adjusted_confidence", "mem contra", f"""
WITH {ADJ % 'mem'} SELECT id, round(adjusted, 6) AS adjusted, round(rec, 6) AS recency, round(rei, 6) AS reinforcement, round(pen, 6) AS penalty,
 CASE WHEN adjusted >= 0.8 THEN 'High confidence' WHEN adjusted >= 0.6 THEN 'Moderate confidence' WHEN adjusted >= 0.4 THEN 'Low confidence' ELSE 'Very low confidence' END
 || CASE WHEN rec < 0.5 THEN ' - memory is stale (not recently verified)' ELSE '' END || CASE WHEN rei > 0.2 THEN ' - reinforced by repeated observations' ELSE '' END
 || CASE WHEN pen > 0 THEN ' - has contradicting information' ELSE '' END || CASE WHEN src < 0.8 THEN ' - from less reliable source' ELSE '' END AS explanation FROM adj2""")
def adjusted_confidence(t):
    return ins.adjusted_confidence(t.mem, t.contra, NOW).select("id", r6("adjusted", "adjusted"), r6("recency", "recency"), r6("reinforcement", "reinforcement"), r6("penalty", "penalty"), "explanation")


UNC = f"""u0 AS (SELECT agent_id, count(*) AS total, count(*) FILTER (id IN (SELECT belief_id FROM contra)) AS contradicted, count(*) FILTER (confidence < 0.6::FLOAT) AS low, count(*) FILTER ({CONF_AT} < :now - INTERVAL 30 DAY) AS stale FROM %s WHERE {LIVE} GROUP BY 1),
u AS (SELECT *, least(1.0, (0.4::DOUBLE * contradicted + 0.35 * low + 0.25 * stale) / total) AS level FROM u0)"""
ADVICE = """CASE WHEN level < 0.2 THEN 'Knowledge base is relatively certain. Continue normal operations.' WHEN contradicted > 0 THEN 'Resolve ' || contradicted || ' contradicted beliefs by verifying with the user'
 WHEN low > 0 THEN 'Confirm ' || low || ' low-confidence memories through conversation' WHEN stale > 0 THEN 'Update ' || stale || ' stale memories that haven''t been verified recently' ELSE 'Review memory health and verify uncertain beliefs with the user.' END"""


@query("uncertainty", "mem contra", f"WITH {UNC % 'mem'} SELECT agent_id, total, contradicted, low, stale, round(level, 6) AS level, {ADVICE} AS recommendation FROM u")
def uncertainty(t):
    return ins.uncertainty(t.mem, t.contra, NOW).withColumn("level", F.round("level", 6))


@query("uncertainty_topic", "mem contra vecs queries", f"""
WITH hits AS (SELECT DISTINCT m.agent_id, m.id FROM mem m JOIN vecs v ON v.vec_id = m.id JOIN queries q ON q.agent_id = m.agent_id WHERE {LIVE} AND list_cosine_similarity(v.emb, q.vec::DOUBLE[]) >= 0.5),
sub AS (SELECT * FROM mem WHERE id IN (SELECT id FROM hits) OR agent_id NOT IN (SELECT agent_id FROM hits)), {UNC % 'sub'}
SELECT agent_id, total, contradicted, low, stale, round(level, 6) AS level, {ADVICE} AS recommendation FROM u""")
def uncertainty_topic(t):
    hits = score_queries(t.memv.where(bl.live()), t.queries, min_sim=0.5, scope=("agent_id",), keep=("agent_id",)).select("agent_id", "id").distinct()
    return ins.uncertainty_for_topic(t.mem, t.contra, NOW, hits).withColumn("level", F.round("level", 6))


ASSESS = "a AS (SELECT * FROM (SELECT *, CASE WHEN sr < 0.5 THEN 'underperforming' WHEN sr >= 0.8 THEN 'effective' END AS verdict FROM (SELECT *, success_count::DOUBLE / use_count AS sr FROM proc WHERE use_count >= 5) x) y WHERE verdict IS NOT NULL)"
FAILP = """fp0 AS (SELECT agent_id, topic, count(*) AS frequency FROM (SELECT agent_id, unnest([lang, source]) AS topic FROM ep WHERE outcome = 'failure' AND occurred_at >= :now - INTERVAL 30 DAY AND occurred_at <= :now) x GROUP BY ALL HAVING count(*) >= 2),
fp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY frequency DESC, topic) AS rank FROM fp0) z WHERE rank <= 3)"""
STRAT = f"""{ASSESS}, {FAILP},
st AS (SELECT g.agent_id, coalesce(e, 0) AS effective, coalesce(u, 0) AS underperforming, coalesce(p, 0) AS patterns FROM (SELECT DISTINCT agent_id FROM proc) g
 LEFT JOIN (SELECT agent_id, count(*) FILTER (verdict = 'effective') AS e, count(*) FILTER (verdict = 'underperforming') AS u FROM a GROUP BY 1) n ON n.agent_id = g.agent_id
 LEFT JOIN (SELECT agent_id, count(*) AS p FROM fp GROUP BY 1) f ON f.agent_id = g.agent_id)"""


def _ep(t):
    return t.ep.withColumn("topics", F.array("lang", "source"))


@query("procedure_assessment", "proc", f"WITH {ASSESS} SELECT id, verdict, round(sr, 6) AS success_rate FROM a")
def procedure_assessment(t):
    return ins.procedure_assessment(t.proc).select("id", "verdict", r6("success_rate", "success_rate"))


@query("failure_patterns", "ep", f"WITH {FAILP} SELECT agent_id, topic, frequency, rank, 'Recurring failures involving ''' || topic || '''' AS pattern FROM fp")
def failure_patterns(t):
    return ins.failure_patterns(_ep(t), NOW).select("agent_id", "topic", "frequency", pos("rank"), "pattern")


@query("strategy", "proc ep", f"""
WITH {STRAT} SELECT agent_id, effective, underperforming, patterns, CASE WHEN underperforming = 0 AND patterns = 0 THEN 'Continue monitoring strategy effectiveness as more data is collected' ELSE
 array_to_string(list_filter([CASE WHEN underperforming > 0 THEN 'Review ' || underperforming || ' underperforming strategies for potential improvements or retirement' END, CASE WHEN patterns > 0 THEN 'Analyze recurring failure patterns to identify root causes' END,
 CASE WHEN effective > 0 AND underperforming > 0 THEN 'Consider applying patterns from effective strategies to improve underperforming ones' END], lambda x: x IS NOT NULL), '; ') END AS suggestions FROM st""")
def strategy(t):
    return ins.strategy(t.proc, ins.failure_patterns(_ep(t), NOW)).withColumn("suggestions", F.array_join("suggestions", "; "))


@query("reflect", "mem contra proc ep", f"""
WITH rows_of AS (SELECT * FROM mem WHERE {LIVE}), {ADJ % 'rows_of'}, {UNC % 'mem'}, {STRAT},
j AS (SELECT agent_id, avg_adjusted, level, contradicted, low, stale, effective, underperforming, patterns FROM u JOIN (SELECT agent_id, avg(adjusted) AS avg_adjusted FROM adj2 GROUP BY 1) c USING (agent_id) JOIN st USING (agent_id))
SELECT agent_id, round((0.4 * avg_adjusted + 0.3 * (1 - level) + CASE WHEN effective + underperforming > 0 THEN 0.3 * effective / (effective + underperforming) ELSE 0 END) / CASE WHEN effective + underperforming > 0 THEN 1.0 ELSE 0.7 END, 6) AS health,
 array_to_string(list_filter([CASE WHEN contradicted > 0 THEN 'PRIORITY: Resolve ' || contradicted || ' contradicted beliefs' END, CASE WHEN underperforming > 0 THEN 'Review ' || underperforming || ' underperforming strategies' END,
  CASE WHEN low > 3 THEN 'Verify ' || low || ' low-confidence memories' END, CASE WHEN stale > 5 THEN 'Update ' || stale || ' stale memories' END, CASE WHEN patterns > 0 THEN 'Investigate recurring failure patterns' END], lambda x: x IS NOT NULL), '; ') AS items FROM j""")
def reflect(t):
    return ins.reflect(t.mem, t.contra, t.proc, _ep(t), NOW).select("agent_id", r6("health", "health"), F.array_join("items", "; ").alias("items"))


@query("memory_health", "mem ep proc sch contra", f"""
WITH b AS (SELECT agent_id, count(*) AS semantic, count(*) FILTER (confidence < 0.3::FLOAT) AS at_risk, count(*) FILTER (last_accessed_at >= :now - INTERVAL 1 DAY) AS recent,
 coalesce(array_to_string(list_sort(list_distinct(list(type) FILTER (confidence < 0.5::FLOAT))), ','), '') AS weak_types, round(avg(confidence::DOUBLE), 6) AS avg_confidence FROM mem WHERE {LIVE} GROUP BY 1)
SELECT b.*, coalesce(r.n, 0) AS raw_episodes, r.o AS oldest_raw, coalesce(p.n, 0) AS procedures, coalesce(s.n, 0) AS schemas, coalesce(c.n, 0) AS contradictions FROM b
LEFT JOIN (SELECT agent_id, count(*) AS n, epoch(min(occurred_at))::BIGINT AS o FROM ep WHERE consolidation_status = 'raw' GROUP BY 1) r USING (agent_id)
LEFT JOIN (SELECT agent_id, count(*) AS n FROM proc GROUP BY 1) p USING (agent_id) LEFT JOIN (SELECT agent_id, count(*) AS n FROM sch GROUP BY 1) s USING (agent_id)
LEFT JOIN (SELECT m.agent_id, count(*) AS n FROM contra k JOIN mem m ON m.id = k.belief_id GROUP BY 1) c USING (agent_id)""")
def memory_health(t):
    return ins.memory_health(t.mem, t.ep, t.proc, t.sch, t.contra, NOW).withColumns({
        "weak_types": F.array_join("weak_types", ","), "avg_confidence": F.round("avg_confidence", 6), "oldest_raw": F.unix_timestamp("oldest_raw")})


@query("dashboard", "mem contra mlog", f"""
WITH tc AS (SELECT agent_id, count(*) FILTER (t = 'hot') AS hot, count(*) AS total, count(*) FILTER (needs_review) AS review FROM (SELECT *, {TIER} AS t FROM mem WHERE NOT is_archived) x GROUP BY 1),
cc AS (SELECT agent_id, count(*) AS contradictions FROM contra c JOIN mem m ON m.id = c.belief_id GROUP BY 1), ls AS (WITH w AS (SELECT * FROM mlog), {stats_sql('w', 'agent_id')})
SELECT tc.agent_id, hot, total, review, coalesce(cc.contradictions, 0) AS contradictions, velocity, stability FROM tc LEFT JOIN cc USING (agent_id) LEFT JOIN ls USING (agent_id)""")
def dashboard(t):
    stats = ln.learning_stats(t.mlog, "2023-01-01 00:00:00", NOW, newest=None)
    return ins.dashboard(t.mem, t.contra, stats).select("agent_id", "hot", "total", "review", "contradictions", r6("velocity", "velocity"), r6("stability", "stability"))


@query("mind", "mem proc sch ep", f"""
WITH b AS (SELECT agent_id, 'belief' AS section, row_number() OVER (PARTITION BY agent_id ORDER BY confidence DESC, id) AS pos, id, content AS text FROM mem WHERE {LIVE}),
p AS (SELECT agent_id, 'procedure' AS section, row_number() OVER (PARTITION BY agent_id ORDER BY (CASE WHEN use_count > 0 THEN success_count::DOUBLE / use_count ELSE 0 END) * (use_count + 1) DESC, id) AS pos, id, action_template AS text FROM proc),
s AS (SELECT agent_id, 'schema' AS section, row_number() OVER (PARTITION BY agent_id ORDER BY confidence DESC, id) AS pos, id, name AS text FROM sch),
e AS (SELECT agent_id, 'episode' AS section, row_number() OVER (PARTITION BY agent_id ORDER BY occurred_at DESC, id) AS pos, id, CASE WHEN length(raw_content) <= 300 THEN raw_content ELSE substring(raw_content, 1, 297) || '...' END AS text FROM ep)
SELECT * FROM b WHERE pos <= 20 UNION ALL SELECT * FROM p WHERE pos <= 10 UNION ALL SELECT * FROM s WHERE pos <= 10 UNION ALL SELECT * FROM e WHERE pos <= 10""")
def mind(t):
    return ins.mind(t.mem, t.proc, t.sch, t.ep).withColumn("pos", F.col("pos").cast("long"))


@query("mind_totals", "mem proc sch ep", f"""
SELECT a.*, coalesce(p.n, 0) AS procedures, coalesce(s.n, 0) AS schemas, coalesce(e.n, 0) AS episodes, coalesce(e.ar, 0) AS archived
FROM (SELECT agent_id, count(*) AS memories, round(avg(confidence::DOUBLE), 6) AS avg_confidence, count(*) FILTER (confidence < 0.4::FLOAT) AS at_risk FROM mem WHERE {LIVE} GROUP BY 1) a
LEFT JOIN (SELECT agent_id, count(*) AS n FROM proc GROUP BY 1) p USING (agent_id) LEFT JOIN (SELECT agent_id, count(*) AS n FROM sch GROUP BY 1) s USING (agent_id)
LEFT JOIN (SELECT agent_id, count(*) AS n, count(*) FILTER (consolidation_status = 'archived') AS ar FROM ep GROUP BY 1) e USING (agent_id)""")
def mind_totals(t):
    return ins.mind_totals(t.mem, t.proc, t.sch, t.ep).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("entity_counts", "ent mentions", "SELECT e.entity_id, e.name, count(m.memory_id) AS mentions FROM ent e LEFT JOIN mentions m ON m.entity_id = e.entity_id GROUP BY 1, 2")
def entity_counts(t):
    return ins.entity_counts(t.ent, t.mentions).select("entity_id", "name", "mentions")


@query("cluster_theme", "mem", "SELECT binding AS cluster_id, arg_min(type, (-n, type)) || '-cluster' AS theme FROM (SELECT binding, type, count(*) AS n FROM mem GROUP BY ALL) x GROUP BY 1")
def cluster_theme(t):
    return ins.cluster_theme(t.mem.select(F.col("binding").alias("cluster_id"), "type"))


@query("belief_cube", "mem", f"""
SELECT tier, type, provenance, binding, (grouping(tier) * 8 + grouping(type) * 4 + grouping(provenance) * 2 + grouping(binding))::BIGINT AS level, count(*) AS n, round(avg(c), 6) AS avg_confidence
FROM (SELECT {TIER} AS tier, type, provenance, binding, confidence::DOUBLE AS c FROM mem WHERE NOT is_archived) x GROUP BY CUBE (tier, type, provenance, binding)""")
def belief_cube(t):
    return ins.belief_cube(t.mem).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("contradiction_pairs", "contra mem", """
SELECT agent_id, belief_id, contradicted_by_id, belief, other, rank FROM (SELECT a.agent_id, c.belief_id, c.contradicted_by_id, a.content AS belief, b.content AS other, row_number() OVER (PARTITION BY a.agent_id ORDER BY detected_at DESC, c.belief_id, c.contradicted_by_id) AS rank
 FROM contra c JOIN mem a ON a.id = c.belief_id JOIN mem b ON b.id = c.contradicted_by_id) x WHERE rank <= 500""")
def contradiction_pairs(t):
    return ins.contradiction_pairs(t.contra, t.mem).select("agent_id", "belief_id", "contradicted_by_id", "belief", "other", pos("rank"))


@query("review_queue", "contra mem", """
WITH q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY updated_at DESC, id) AS rank FROM mem WHERE needs_review AND NOT is_archived) x WHERE rank <= 100)
SELECT q.id, q.rank, c.contradicted_by_id, o.content AS other, round(o.confidence::DOUBLE, 6) AS other_confidence FROM q LEFT JOIN contra c ON c.belief_id = q.id LEFT JOIN mem o ON o.id = c.contradicted_by_id AND NOT o.is_archived""")
def review_queue(t):
    return ins.review_queue(bl.needs_review(t.mem).select("id", "rank"), t.mem, t.contra).select("id", pos("rank"), "contradicted_by_id", "other", r6("other_confidence", "other_confidence"))
