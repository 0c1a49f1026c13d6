"""Feedback, reinforcement, access and decay queries."""

from pyspark.sql import functions as F

from beliefmill.operators import beliefs as bl
from beliefmill.operators import dynamics as dy
from beliefmill.plans.belief_queries import HRS, TIER
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW

CLAMP = "least(greatest({x}, 0.01), 0.99)"
EFFECT = "CASE signal_type WHEN 'helpful' THEN 0.3 WHEN 'unhelpful' THEN -0.5 WHEN 'used' THEN 0.1 WHEN 'ignored' THEN -0.1 WHEN 'contradicted' THEN -1.0 ELSE -0.8 END::DOUBLE"
CEFFECT = "CASE signal_type WHEN 'helpful' THEN 1 WHEN 'unhelpful' THEN -1 WHEN 'contradicted' THEN -2 WHEN 'outdated' THEN -1 ELSE 0 END::DOUBLE"
FOLD = "list_reduce(deltas, lambda acc, x: least(greatest(1 / (1 + exp(-(ln(least(greatest(acc, 0.01), 0.99) / (1 - least(greatest(acc, 0.01), 0.99))) + x))), 0.01), 0.99), c)"
CFOLD = "list_reduce(counts, lambda acc, x: greatest(acc + x, 0), n)"


def fold_sql(events, extra=""):
    return f"""
WITH {events}, g AS (SELECT memory_id, list({EFFECT} ORDER BY created_at, id) AS deltas, list({CEFFECT} ORDER BY created_at, id) AS counts, count(*) AS n_events,
  bool_or(signal_type = 'contradicted') AS review FROM ev GROUP BY memory_id),
j AS (SELECT g.*, m.confidence::DOUBLE AS c, m.reinforcement_count::DOUBLE AS n FROM g JOIN mem m ON m.id = g.memory_id)
SELECT memory_id, n_events AS n, round({FOLD}, 6) AS new_confidence, {CFOLD}::BIGINT AS new_count, review FROM j"""


@query("apply_feedback", "signals mem", fold_sql("ev AS (SELECT * FROM signals)"))
def apply_feedback(t):
    return dy.apply_feedback(t.mem, t.signals).select("memory_id", "n", r6("new_confidence", "new_confidence"), "new_count", "review")


@query("feedback_log", "signals mem", f"""
WITH e AS (SELECT s.*, m.confidence::DOUBLE AS c, m.reinforcement_count::DOUBLE AS n, list({EFFECT}) OVER w AS deltas, list({CEFFECT}) OVER w AS counts
  FROM signals s JOIN mem m ON m.id = s.memory_id WINDOW w AS (PARTITION BY s.memory_id ORDER BY s.created_at, s.id ROWS UNBOUNDED PRECEDING))
SELECT memory_id, id AS event_id, round({FOLD}, 6) AS new_confidence, {CFOLD}::BIGINT AS new_count, 'feedback: ' || signal_type AS reason FROM e""")
def feedback_log(t):
    return dy.feedback_log(t.mem, dy.feedback_events(t.signals)).select("memory_id", "event_id", r6("new_confidence", "new_confidence"), "new_count", "reason")


@query("feedback_log_steps", "signals mem", f"""
WITH e AS (SELECT s.*, m.confidence::DOUBLE AS c, list({EFFECT}) OVER w AS deltas
  FROM signals s JOIN mem m ON m.id = s.memory_id WINDOW w AS (PARTITION BY s.memory_id ORDER BY s.created_at, s.id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT memory_id, id, created_at, c, {FOLD} AS new FROM e)
SELECT memory_id, count(*) AS n, round(sum(new - old), 5) AS net, round(max(abs(new - old)), 5) AS largest
FROM (SELECT memory_id, new, coalesce(lag(new) OVER (PARTITION BY memory_id ORDER BY created_at, id), c) AS old FROM f) x GROUP BY memory_id""")
def feedback_log_steps(t):
    log = dy.feedback_log(t.mem, dy.feedback_events(t.signals))
    d = F.col("new_confidence") - F.col("old_confidence")
    return log.groupBy("memory_id").agg(F.count("*").alias("n"), F.round(F.sum(d), 5).alias("net"), F.round(F.max(F.abs(d)), 5).alias("largest"))


@query("apply_implicit", "signals mem", fold_sql("ev AS (SELECT * FROM signals WHERE ((id * 13) % 100) / 100.0 >= 0.6)"))
def apply_implicit(t):
    detected = t.signals.withColumn("confidence", ((F.col("id") * 13) % 100 / 100.0).cast("float"))
    return dy.apply_feedback(t.mem, dy.implicit_signals(detected)).select("memory_id", "n", r6("new_confidence", "new_confidence"), "new_count", "review")


@query("apply_outcomes", "ep ep_usage mem", fold_sql("""ev AS (SELECT e.id, u.memory_id, e.occurred_at AS created_at, CASE e.outcome WHEN 'success' THEN 'helpful' ELSE 'unhelpful' END AS signal_type
  FROM (SELECT DISTINCT episode_id, memory_id FROM ep_usage) u JOIN ep e ON e.id = u.episode_id WHERE e.outcome IN ('success', 'failure'))"""))
def apply_outcomes(t):
    return dy.apply_outcomes(t.mem, t.ep, t.ep_usage).select("memory_id", "n", r6("new_confidence", "new_confidence"), "new_count", "review")


LGC = "ln(least(greatest(confidence::DOUBLE, 0.01), 0.99) / (1 - least(greatest(confidence::DOUBLE, 0.01), 0.99)))"


@query("reinforce", "mem", f"SELECT id, round(greatest(confidence::DOUBLE, least(greatest(1 / (1 + exp(-({LGC} + 0.3))), 0.01), 0.99)), 6) AS new_confidence, reinforcement_count + 1 AS new_count FROM mem")
def reinforce(t):
    return dy.reinforce(t.mem, bl.resolve_settings(t.tenants, t.settings_raw)).select("id", r6("new_confidence", "new_confidence"), "new_count")


@query("penalize", "mem", f"SELECT id, round(least(greatest(1 / (1 + exp(-({LGC} - 0.5))), 0.01), 0.99), 6) AS new_confidence, greatest(0, reinforcement_count - 1) AS new_count FROM mem")
def penalize(t):
    return dy.penalize(t.mem, bl.resolve_settings(t.tenants, t.settings_raw)).select("id", r6("new_confidence", "new_confidence"), "new_count")


@query("apply_access", "hits mem", """
SELECT m.id, count(*) AS hits, round(greatest(m.confidence::DOUBLE, least(m.confidence::DOUBLE + 0.02 * count(*), 0.99)), 6) AS new_confidence, (m.access_count + count(*))::BIGINT AS new_access_count
FROM mem m JOIN hits h ON h.memory_id = m.id GROUP BY m.id, m.confidence, m.access_count""")
def apply_access(t):
    return dy.apply_access(t.mem, t.hits).select("id", "hits", r6("new_confidence", "new_confidence"), F.col("new_access_count").cast("long").alias("new_access_count"))


COMP = """e AS (SELECT m.*, v.emb, m.confidence::DOUBLE AS c FROM mem m JOIN vecs v ON v.vec_id = m.id WHERE NOT m.is_archived AND m.binding <> 'quarantine'),
p AS (SELECT a.id AS lid, b.id AS rid, a.c AS lc, b.c AS rc, list_cosine_similarity(a.emb, b.emb) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY b.last_accessed_at NULLS FIRST, b.id) AS rn
  FROM e a JOIN e b ON a.agent_id = b.agent_id AND a.type = b.type AND a.id <> b.id WHERE list_cosine_similarity(a.emb, b.emb) >= 0.7),
comp AS (SELECT lid AS id, count(*) AS nc, sum(CASE WHEN rc > lc THEN (rc - lc) * sim ELSE 0 END) / (1 + any_value(lc)) AS f FROM p WHERE rn <= 10 GROUP BY lid)"""


@query("competitors", "mem vecs", f"WITH {COMP} SELECT lid, rid, round(sim, 6) AS sim FROM p WHERE rn <= 10")
def competitors(t):
    return dy.competitors(t.memv).select("lid", "rid", r6("sim", "sim"))


@query("competition", "mem vecs", f"WITH {COMP} SELECT id, nc AS n_competitors, round(0.5 * f, 6) AS competition FROM comp")
def competition(t):
    return dy.competition(t.memv, 0.5).select("id", "n_competitors", r6("competition", "competition"))


DECAY = f"""{COMP},
d0 AS (SELECT e.id, e.agent_id, e.c, e.reinforcement_count AS r, {HRS} AS h, CASE e.tenant_id WHEN 0 THEN 0.002 ELSE 0.001 END::DOUBLE AS rate, CASE e.tenant_id WHEN 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS fl,
  0.5 * coalesce(f, 0) AS k, coalesce(nc, 0) AS nc FROM e LEFT JOIN comp ON comp.id = e.id),
d1 AS (SELECT *, fl + (c - fl) * exp(-(rate * (1 + k)) * h) AS f0 FROM d0),
d2 AS (SELECT *, CASE WHEN r > 0 THEN f0 + (c - f0) * (1 - 1 / (1 + 0.15 * ln(r + 1.0::DOUBLE))) ELSE f0 END AS f1 FROM d1),
d3 AS (SELECT *, CASE WHEN h < 1 THEN c ELSE least(greatest(f1, fl), c) END AS nw FROM d2),
d AS (SELECT *, abs(nw - c) >= 0.001 AS changed, abs(nw - c) >= 0.001 AND nw::FLOAT < 0.15::FLOAT AS archived,
  {TIER.replace('confidence::DOUBLE', 'c')} AS from_tier, {TIER.replace('confidence::DOUBLE', 'nw')} AS to_tier FROM d3)"""


def _settings(t):
    return bl.resolve_settings(t.tenants, t.settings_raw)


@query("decay_pass", "mem vecs", f"WITH {DECAY} SELECT id, round(nw, 6) AS new_confidence, nc AS n_competitors, round(rate * (1 + k), 9) AS effective_rate, changed, archived FROM d")
def decay_pass(t):
    return dy.decay_pass(t.memv, _settings(t), NOW).select("id", r6("new_confidence", "new_confidence"), "n_competitors", F.round("effective_rate", 9).alias("effective_rate"), "changed", "archived")


@query("tier_transitions", "mem vecs", f"WITH {DECAY} SELECT id, from_tier, to_tier, 'decay' AS reason FROM d WHERE changed AND from_tier <> to_tier")
def tier_transitions(t):
    return dy.tier_transitions(dy.decay_pass(t.memv, _settings(t), NOW))


@query("decay_log", "mem vecs", f"WITH {DECAY} SELECT id AS memory_id, round(c, 6) AS old_confidence, round(nw, 6) AS new_confidence, CASE WHEN archived THEN 'decay: archived below confidence floor' ELSE 'decay: competition-aware confidence decay' END AS reason FROM d WHERE changed")
def decay_log(t):
    return dy.decay_log(dy.decay_pass(t.memv, _settings(t), NOW), NOW).select("memory_id", r6("old_confidence", "old_confidence"), r6("new_confidence", "new_confidence"), "reason")


@query("decay_summary", "mem vecs", f"WITH {DECAY} SELECT agent_id, count(*) AS processed, count(*) FILTER (changed AND NOT archived) AS decayed, count(*) FILTER (archived) AS archived, count(*) FILTER (changed AND from_tier <> to_tier) AS transitions FROM d GROUP BY 1")
def decay_summary(t):
    return dy.decay_summary(dy.decay_pass(t.memv, _settings(t), NOW))


EPS = "CASE WHEN consolidation_status = 'archived' THEN memory_strength::DOUBLE ELSE greatest(0, memory_strength::DOUBLE * exp(-(decay_rate::DOUBLE) * ((epoch_us(:now) - epoch_us(last_accessed_at)) / 86400000000.0::DOUBLE))) END"


@query("decay_episodes", "ep", f"SELECT id, round(s, 6) AS strength, consolidation_status <> 'archived' AND s < 0.15 AS archive FROM (SELECT *, {EPS} AS s FROM ep) x")
def decay_episodes(t):
    return dy.decay_episodes(t.ep, NOW).select("id", r6("strength", "strength"), "archive")


@query("decay_procedures", "proc", """
WITH a AS (SELECT *, confidence::DOUBLE AS c, use_count > 5 AND (CASE WHEN use_count > 0 THEN success_count::DOUBLE / use_count ELSE 0 END) < 0.2 AS failing,
  greatest(0.1, confidence::DOUBLE * exp(-0.01 * ((epoch_us(:now) - epoch_us(last_used_at)) / 86400000000.0::DOUBLE))) AS f FROM proc)
SELECT id, failing AS archived, round(CASE WHEN NOT failing AND last_used_at IS NOT NULL AND abs(f - c) > 0.001 THEN f ELSE c END, 6) AS new_confidence FROM a""")
def decay_procedures(t):
    return dy.decay_procedures(t.proc, NOW).select("id", "archived", r6("new_confidence", "new_confidence"))


@query("decay_edges", "edges", """
SELECT source_id, target_id, relation_type, round(CASE WHEN h > 1 THEN greatest(0.05, strength::DOUBLE * exp(-0.0005 * h)) ELSE strength::DOUBLE END, 6) AS strength
FROM (SELECT *, (epoch_us(:now) - epoch_us(created_at)) / 3600000000.0::DOUBLE AS h FROM edges) x""")
def decay_edges(t):
    return dy.decay_edges(t.edges, NOW).select("source_id", "target_id", "relation_type", r6("strength", "strength"))
