"""Admission queries."""

from pyspark.sql import functions as F

from beliefmill.functions import lexicon as lx
from beliefmill.operators import admission as ad
from beliefmill.operators import beliefs as bl
from beliefmill.plans.belief_queries import score_sql
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.session import pin

LIVE = "NOT is_archived AND binding <> 'quarantine'"
SAME = "m.tenant_id = i.tenant_id AND m.agent_id = i.agent_id AND m.anchor_id IS NOT DISTINCT FROM i.anchor_id AND m.session_id IS NOT DISTINCT FROM i.session_id"
IV = "iv AS (SELECT i.*, v.emb FROM incoming i JOIN vecs v ON v.vec_id = i.vec_id), mv AS (SELECT m.*, v.emb FROM mem m JOIN vecs v ON v.vec_id = m.id)"
SIMP = f"""{IV}, sp AS (SELECT i.id AS incoming_id, m.id AS existing_id, list_cosine_similarity(i.emb, m.emb) AS score, 0 AS typed, 0 AS age FROM iv i JOIN mv m ON {SAME} WHERE {LIVE.replace('is_arch', 'm.is_arch').replace('AND binding', 'AND m.binding')} AND list_cosine_similarity(i.emb, m.emb) >= 0.25),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, agent_id, type ORDER BY created_at DESC, id) AS age FROM mv WHERE NOT is_archived AND type IN ('preference', 'constraint')) x WHERE age <= 15),
ty AS (SELECT i.id AS incoming_id, m.id AS existing_id, 1.0::DOUBLE AS score, 1 AS typed, m.age FROM iv i JOIN rt m ON {SAME} AND m.type = i.type WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.incoming_id = i.id AND sp.existing_id = m.id)),
cand AS (SELECT * FROM sp UNION ALL SELECT * FROM ty)"""


def _incoming(t):
    return t.with_vec(t.incoming)


@query("admission_candidates", "mem vecs incoming", f"WITH {SIMP} SELECT incoming_id, existing_id, round(score, 6) AS score, typed = 1 AS typed FROM cand")
def admission_candidates(t):
    return ad.admission_candidates(_incoming(t), t.memv).select("incoming_id", "existing_id", r6("score", "score"), "typed")


JUDGE = f"""pj AS (SELECT c.*, list_cosine_similarity(i.emb, m.emb) AS sim, {score_sql(lx.TEMPORAL_MARKERS, 'lower(trim(i.content))')} AS tm, {score_sql(lx.NEGATION_MARKERS, 'lower(trim(i.content))')} AS ng
  FROM cand c JOIN iv i ON i.id = c.incoming_id JOIN mv m ON m.id = c.existing_id),
tj AS (SELECT *, CASE WHEN sim < 0.5 OR sim >= 0.85 THEN 'none' WHEN tm >= 0.3 THEN 'temporal' WHEN ng >= 0.35 THEN 'hard' WHEN sim >= 0.7 THEN 'soft' ELSE 'none' END AS kind,
  CASE WHEN sim < 0.5 OR sim >= 0.85 THEN 0 WHEN tm >= 0.3 THEN tm WHEN ng >= 0.35 THEN ng * (1 - 0.3 * (sim - 0.5) / 0.35) WHEN sim >= 0.7 THEN (sim - 0.7) / 0.15 ELSE 0 END::DOUBLE AS ts FROM pj),
hj AS (SELECT *, kind = 'temporal' OR (kind = 'hard' AND ts > 0.25) OR (kind = 'soft' AND ts >= 0.3) AS act FROM tj),
fj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incoming_id ORDER BY (NOT act)::INT, typed, CASE WHEN typed = 0 THEN -sim ELSE age END, existing_id) AS rk FROM hj WHERE act OR sim >= 0.85) x WHERE rk = 1),
fw AS (SELECT i.*, i.binding <> 'canon' AND i.tenant_id = 0 AND i.provenance IN ('inferred', 'agent') AS held FROM incoming i),
dec AS (SELECT w.id, w.agent_id, w.tenant_id, w.created_at, w.provenance, CASE WHEN held THEN 'quarantine' WHEN f.act THEN f.kind WHEN f.existing_id IS NOT NULL THEN 'reinforce' ELSE 'insert' END AS decision, f.existing_id AS ex, f.sim AS sm, f.ts FROM fw w LEFT JOIN fj f ON f.incoming_id = w.id)"""


@query("pair_tension", "mem vecs incoming", f"WITH {SIMP}, {JUDGE} SELECT incoming_id, existing_id, kind, round(ts, 6) AS score, kind <> 'none' AND ts < 0.65 AS ambiguous FROM tj")
def pair_tension(t):
    inc, mem = _incoming(t), t.memv
    x = F.col("t")
    return ad.candidate_tensions(inc, mem).select("incoming_id", "existing_id", x["kind"].alias("kind"), r6(x["score"], "score"), x["ambiguous"].alias("ambiguous"))


def _decided(t):
    return ad.decide(_incoming(t), t.memv, bl.resolve_settings(t.tenants, t.settings_raw))


@query("admit_decisions", "mem vecs incoming", f"""WITH {SIMP}, {JUDGE} SELECT id, decision, CASE WHEN decision IN ('quarantine', 'insert') THEN NULL ELSE ex END AS existing_id, CASE WHEN decision IN ('quarantine', 'insert') THEN NULL ELSE round(sm, 6) END AS sim,
 CASE WHEN decision IN ('hard', 'temporal', 'soft') THEN round(ts, 6) END AS tension_score FROM dec""")
def admit_decisions(t):
    return _decided(t).select("id", "decision", "existing_id", r6("sim", "sim"), r6("tension_score", "tension_score"))


# verdicts on two thirds of the ambiguous pairs: no tension, or a hard one
RULED = JUDGE.replace("hj AS (SELECT *,", """vj AS (SELECT * REPLACE (CASE WHEN ruled AND r = 0 THEN 'none' WHEN ruled AND r = 1 THEN 'hard' ELSE kind END AS kind, CASE WHEN ruled AND r = 0 THEN 0.0 WHEN ruled AND r = 1 THEN 0.9 ELSE ts END::DOUBLE AS ts)
  FROM (SELECT *, kind <> 'none' AND ts < 0.65 AS ruled, (incoming_id + existing_id) % 3 AS r FROM tj)),
hj AS (SELECT *,""").replace("act FROM tj)", "act FROM vj)")


# one row of every scope per step, with the list of rows that have left
ORDERED = f"""RECURSIVE iv AS (SELECT i.*, v.emb, i.binding <> 'canon' AND i.tenant_id = 0 AND i.provenance IN ('inferred', 'agent') AS held,
  dense_rank() OVER (ORDER BY i.tenant_id, i.agent_id, i.anchor_id, i.session_id) AS sid, row_number() OVER (PARTITION BY i.tenant_id, i.agent_id, i.anchor_id, i.session_id ORDER BY i.created_at, i.id) AS pos
  FROM arriving i JOIN vecs v ON v.vec_id = i.vec_id),
mv AS (SELECT m.*, v.emb FROM mem m JOIN vecs v ON v.vec_id = m.id),
pool AS (SELECT id, tenant_id, agent_id, anchor_id, session_id, emb, 0 AS pos, -1 AS late FROM mv WHERE {LIVE} UNION ALL SELECT id, tenant_id, agent_id, anchor_id, session_id, emb, pos, -1 FROM iv WHERE NOT held),
rt AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, agent_id, type ORDER BY created_at DESC, id) AS late FROM mv WHERE NOT is_archived AND type IN ('preference', 'constraint')),
met AS (SELECT i.id AS incoming_id, i.content, m.id AS rid, m.pos AS rat, m.late, list_cosine_similarity(i.emb, m.emb) AS sim FROM iv i JOIN pool m ON {SAME} AND m.pos < i.pos WHERE NOT i.held
  UNION ALL SELECT i.id, i.content, m.id, 0, m.late, list_cosine_similarity(i.emb, m.emb) FROM iv i JOIN rt m ON {SAME} AND m.type = i.type WHERE NOT i.held AND m.binding = 'quarantine' AND m.late <= 15),
tj AS (SELECT *, CASE WHEN sim < 0.5 OR sim >= 0.85 THEN 'none' WHEN tm >= 0.3 THEN 'temporal' WHEN ng >= 0.35 THEN 'hard' WHEN sim >= 0.7 THEN 'soft' ELSE 'none' END AS kind,
  CASE WHEN sim < 0.5 OR sim >= 0.85 THEN 0 WHEN tm >= 0.3 THEN tm WHEN ng >= 0.35 THEN ng * (1 - 0.3 * (sim - 0.5) / 0.35) WHEN sim >= 0.7 THEN (sim - 0.7) / 0.15 ELSE 0 END::DOUBLE AS ts
  FROM (SELECT *, {score_sql(lx.TEMPORAL_MARKERS, 'lower(trim(content))')} AS tm, {score_sql(lx.NEGATION_MARKERS, 'lower(trim(content))')} AS ng FROM met) q),
c AS (SELECT *, kind = 'temporal' OR (kind = 'hard' AND ts > 0.25) OR (kind = 'soft' AND ts >= 0.3) AS act FROM tj WHERE sim >= 0.85 OR kind = 'temporal' OR (kind = 'hard' AND ts > 0.25) OR (kind = 'soft' AND ts >= 0.3)),
run(sid, pos, dead, id, ex, sm, ts, decision) AS (
  SELECT DISTINCT sid, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR FROM iv
  UNION ALL
  SELECT sid, pos, CASE d WHEN 'reinforce' THEN list_append(dead, id) WHEN 'temporal' THEN list_append(dead, f.rid) ELSE dead END, id, f.rid, f.sim, f.ts, d
  FROM (SELECT *, CASE WHEN held THEN 'quarantine' WHEN f IS NULL THEN 'insert' WHEN f.act THEN f.kind ELSE 'reinforce' END AS d
    FROM (SELECT r.sid, r.pos + 1 AS pos, r.dead, o.id, o.held, arg_min(struct_pack(rid := c.rid, sim := c.sim, act := c.act, kind := c.kind, ts := c.ts), [(NOT c.act)::INT::DOUBLE, c.late::DOUBLE, -round(c.sim, 12), c.rat::DOUBLE, c.rid::DOUBLE]) FILTER (c.rid IS NOT NULL) AS f
      FROM run r JOIN iv o ON o.sid = r.sid AND o.pos = r.pos + 1 LEFT JOIN c ON c.incoming_id = o.id AND NOT list_contains(r.dead, c.rid) GROUP BY r.sid, r.pos, r.dead, o.id, o.held) y) z)
SELECT id, decision, CASE WHEN decision NOT IN ('quarantine', 'insert') THEN ex END AS existing_id, CASE WHEN decision NOT IN ('quarantine', 'insert') THEN round(sm, 6) END AS sim FROM run WHERE id IS NOT NULL"""


@query("admit_in_order", "mem vecs incoming", f"WITH {ORDERED.replace('RECURSIVE iv', 'RECURSIVE arriving AS (SELECT * FROM incoming), iv', 1)}")
def admit_in_order(t):
    out = ad.decide_in_order(_incoming(t), t.memv, bl.resolve_settings(t.tenants, t.settings_raw))
    return out.select("id", "decision", "existing_id", r6("sim", "sim"))


@query("admit_verdicts", "mem vecs incoming", f"""WITH {SIMP}, {RULED} SELECT id, decision, CASE WHEN decision IN ('quarantine', 'insert') THEN NULL ELSE ex END AS existing_id, CASE WHEN decision IN ('hard', 'temporal', 'soft') THEN round(ts, 6) END AS tension_score FROM dec""")
def admit_verdicts(t):
    r = F.pmod(F.col("incoming_id") + F.col("existing_id"), F.lit(3))
    verdicts = pair_tension(t).where(F.col("ambiguous") & (r < 2)).select("incoming_id", "existing_id", F.when(r == 0, "none").otherwise("hard").alias("kind"), F.when(r == 0, 0.0).otherwise(0.9).alias("score"))
    out = ad.decide(_incoming(t), t.memv, bl.resolve_settings(t.tenants, t.settings_raw), verdicts=pin(verdicts))
    return out.select("id", "decision", "existing_id", r6("tension_score", "tension_score"))


@query("admit_rows", "mem vecs incoming", f"""WITH {SIMP}, {JUDGE} SELECT id, decision, round(CASE WHEN decision = 'hard' THEN 0.7 ELSE CASE provenance WHEN 'user' THEN 0.9 WHEN 'tool' THEN 0.8 WHEN 'agent' THEN 0.72 WHEN 'derived' THEN 0.5 ELSE 0.4 END END::DOUBLE, 6) AS confidence FROM dec WHERE decision <> 'reinforce'""")
def admit_rows(t):
    return ad.admitted_rows(_decided(t)).select("id", "decision", r6("confidence", "confidence"))


@query("admit_effects", "mem vecs incoming", f"""WITH {SIMP}, {JUDGE},
ev AS (SELECT ex AS id, list(decision ORDER BY created_at, id) AS ds, count(*) FILTER (decision = 'reinforce') AS rf, bool_or(decision = 'temporal') AS archived FROM dec WHERE decision IN ('hard', 'soft', 'temporal', 'reinforce') GROUP BY ex),
st AS (SELECT m.id, m.binding, m.anchor_id, (m.reinforcement_count + rf) AS cnt, rf, archived, m.confidence::DOUBLE AS c, list_transform(ds, lambda d: CASE d WHEN 'hard' THEN -0.2 WHEN 'soft' THEN -0.1 WHEN 'reinforce' THEN 0.05 ELSE 0 END::DOUBLE) AS dl FROM ev JOIN mem m ON m.id = ev.id)
SELECT id, round(list_reduce(dl, lambda acc, d: CASE WHEN d < 0 THEN greatest(0.1, acc + d) WHEN d > 0 THEN least(0.99, acc + d) ELSE acc END, c), 6) AS new_confidence, cnt::BIGINT AS new_count, archived,
 binding = 'session' AND anchor_id IS NOT NULL AND rf > 0 AND cnt >= 3 AS promoted FROM st""")
def admit_effects(t):
    return ad.admission_effects(_decided(t), t.mem).select("id", r6("new_confidence", "new_confidence"), F.col("new_count").cast("long").alias("new_count"), "archived", "promoted")


@query("admit_contradictions", "mem vecs incoming", f"WITH {SIMP}, {JUDGE} SELECT ex AS belief_id, id AS contradicted_by_id FROM dec WHERE decision = 'hard'")
def admit_contradictions(t):
    return ad.contradiction_rows(_decided(t)).select("belief_id", "contradicted_by_id")


@query("admit_log", "mem vecs incoming", f"""WITH {SIMP}, {JUDGE} SELECT ex AS memory_id, id AS source_id, CASE decision WHEN 'hard' THEN '{ad.REASONS["hard"]}' WHEN 'soft' THEN '{ad.REASONS["soft"]}' ELSE '{ad.REASONS["temporal"]}' END AS reason FROM dec WHERE decision IN ('hard', 'soft', 'temporal')""")
def admit_log(t):
    return ad.admission_log(_decided(t)).select("memory_id", "source_id", "reason")


@query("promote_sessions", "mem", """
SELECT id, binding = 'session' AND anchor_id IS NOT NULL AND reinforcement_count >= 3 AS promoted, CASE WHEN binding = 'session' AND anchor_id IS NOT NULL AND reinforcement_count >= 3 THEN 'anchored' ELSE binding END AS binding FROM mem""")
def promote_sessions(t):
    return ad.promote_sessions(t.mem).select("id", "promoted", "binding")
