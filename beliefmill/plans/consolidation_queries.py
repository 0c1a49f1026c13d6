"""Consolidation queries."""

from pyspark.sql import functions as F

from beliefmill.operators import beliefs as bl
from beliefmill.operators import consolidate as co
from beliefmill.plans.dynamics_queries import DECAY
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW

EV = "ev AS (SELECT e.*, v.emb FROM ep e JOIN vecs v ON v.vec_id = e.vec_id)"
MV = "mv AS (SELECT m.*, v.emb FROM mem m JOIN vecs v ON v.vec_id = m.id WHERE NOT is_archived AND binding <> 'quarantine')"


def _ep(t):
    return t.with_vec(t.ep)


@query("episode_associations", "ep vecs", f"""
WITH {EV} SELECT lid AS episode_id, rid AS other_id, round(sim, 6) AS strength FROM (SELECT a.id AS lid, b.id AS rid, list_cosine_similarity(a.emb, b.emb) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.emb, b.emb), 9) DESC, b.id) AS rk
 FROM ev a JOIN ev b ON a.agent_id = b.agent_id AND a.tenant_id = b.tenant_id WHERE list_cosine_similarity(a.emb, b.emb) >= 0.7) x WHERE rk <= 5 AND lid <> rid""")
def episode_associations(t):
    return co.episode_associations(_ep(t)).select("episode_id", "other_id", r6("strength", "strength"))


@query("episode_memory_links", "ep mem vecs", f"WITH {EV}, {MV} SELECT a.id AS source_id, b.id AS target_id, round(list_cosine_similarity(a.emb, b.emb), 6) AS strength FROM ev a JOIN mv b ON a.agent_id = b.agent_id AND a.tenant_id = b.tenant_id WHERE list_cosine_similarity(a.emb, b.emb) >= 0.7")
def episode_memory_links(t):
    return co.episode_memory_links(_ep(t), t.memv).select("source_id", "target_id", r6("strength", "strength"))


@query("encode_episodes", "ep", """
SELECT id, round(CASE WHEN importance_score = 0 THEN 0.5 ELSE importance_score END::FLOAT::DOUBLE, 6) AS importance, 1.0::DOUBLE AS strength, 'raw' AS status, dayname(occurred_at) AS day_of_week FROM ep""")
def encode_episodes(t):
    return co.encode_episodes(t.ep).select("id", r6("importance_score", "importance"), r6("memory_strength", "strength"), F.col("consolidation_status").alias("status"), "day_of_week")


@query("process_raw", "ep", "SELECT id, 'processed' AS status FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY occurred_at, id) AS rk FROM ep WHERE consolidation_status = 'raw') x WHERE rk <= 50")
def process_raw(t):
    return co.process_raw(t.ep, 50).select("id", F.col("consolidation_status").alias("status"))


@query("extractable_episodes", "ep", "SELECT id, importance_score < 0.6::FLOAT AND outcome NOT IN ('success', 'failure') AS skip FROM ep WHERE consolidation_status = 'processed'")
def extractable_episodes(t):
    return co.extractable(t.ep).select("id", "skip")


def _extracted(t):
    x = t.ep.select(F.col("id").alias("belief_key"), F.col("id").alias("episode_id"), F.col("raw_content").alias("content"), F.lit("fact").alias("type"),
                    F.when(F.col("id") % 2 == 0, "implicit_inference").otherwise("").alias("evidence"), F.lit(0.7).alias("confidence"), "vec_id")
    return t.with_vec(x)


CB = f"""{MV}, xb AS (SELECT e.id, e.agent_id, e.tenant_id, v.emb FROM ep e JOIN vecs v ON v.vec_id = e.vec_id WHERE consolidation_status = 'processed' AND NOT (importance_score < 0.6::FLOAT AND outcome NOT IN ('success', 'failure'))),
nr AS (SELECT * FROM (SELECT x.id, m.id AS target_id, row_number() OVER (PARTITION BY x.id ORDER BY list_cosine_similarity(x.emb, m.emb) DESC, m.id) AS rk FROM xb x JOIN mv m ON m.agent_id = x.agent_id AND m.tenant_id = x.tenant_id WHERE list_cosine_similarity(x.emb, m.emb) >= 0.85) y WHERE rk = 1),
dc AS (SELECT xb.id, nr.target_id, CASE WHEN nr.target_id IS NULL THEN 'insert' ELSE 'reinforce' END AS action FROM xb LEFT JOIN nr ON nr.id = xb.id)"""


@query("consolidate_beliefs", "ep mem vecs", f"WITH {CB} SELECT id AS belief_key, action, target_id, CASE WHEN action = 'insert' THEN round(0.8 * CASE WHEN id % 2 = 0 THEN 0.625 ELSE 0.7 END::DOUBLE, 6) END AS new_confidence FROM dc")
def consolidate_beliefs(t):
    return co.consolidate_beliefs(_ep(t), t.memv, _extracted(t)).select("belief_key", "action", "target_id", r6("new_confidence", "new_confidence"))


@query("belief_reinforcements", "ep mem vecs", f"WITH {CB} SELECT m.id, count(*) AS n, round(least(m.confidence::DOUBLE + 0.05 * count(*), 0.99), 6) AS new_confidence, (m.reinforcement_count + count(*))::BIGINT AS new_count FROM dc JOIN mem m ON m.id = dc.target_id GROUP BY m.id, m.confidence, m.reinforcement_count")
def belief_reinforcements(t):
    return co.belief_reinforcements(co.consolidate_beliefs(_ep(t), t.memv, _extracted(t)), t.mem).select("id", "n", r6("new_confidence", "new_confidence"), F.col("new_count").cast("long").alias("new_count"))


@query("derived_associations", "ep mem vecs", f"WITH {CB} SELECT id AS source_id, id AS target_id, 0.9::DOUBLE AS strength FROM dc WHERE action = 'insert'")
def derived_associations(t):
    return co.derived_associations(co.consolidate_beliefs(_ep(t), t.memv, _extracted(t))).select("source_id", "target_id", "strength")


def _patterns(t):
    return t.with_vec(t.ep.select(F.col("id").alias("episode_id"), F.concat(F.lit("when "), "lang").alias("trigger_pattern"), F.lit("do it").alias("action_template"), "vec_id"))


LP = """pv AS (SELECT p.*, v.emb FROM proc p JOIN vecs v ON v.vec_id = p.vec_id), gd AS (SELECT e.id, e.agent_id, e.tenant_id, v.emb FROM ep e JOIN vecs v ON v.vec_id = e.vec_id WHERE outcome = 'success' AND importance_score >= 0.6::FLOAT AND occurred_at >= :now - INTERVAL 20 DAY AND occurred_at <= :now),
np AS (SELECT * FROM (SELECT g.id, p.id AS procedure_id, row_number() OVER (PARTITION BY g.id ORDER BY round(list_cosine_similarity(g.emb, p.emb), 9) DESC, p.id) AS rk FROM gd g JOIN pv p ON p.agent_id = g.agent_id AND p.tenant_id = g.tenant_id WHERE list_cosine_similarity(g.emb, p.emb) >= 0.75) y WHERE rk = 1),
lr AS (SELECT gd.id AS episode_id, procedure_id, CASE WHEN procedure_id IS NULL THEN 'learn' ELSE 'reinforce' END AS action FROM gd LEFT JOIN np ON np.id = gd.id)"""


@query("learn_procedures", "ep proc vecs", f"WITH {LP} SELECT * FROM lr")
def learn_procedures(t):
    return co.learn_procedures(_ep(t), _patterns(t), t.with_vec(t.proc), NOW, theta=0.75, days=20).select("episode_id", "procedure_id", "action")


@query("procedure_reinforcements", "ep proc vecs", f"WITH {LP} SELECT p.id, count(*) AS n, round(least(p.confidence::DOUBLE + 0.05 * count(*), 0.99), 6) AS new_confidence FROM lr JOIN proc p ON p.id = lr.procedure_id GROUP BY p.id, p.confidence")
def procedure_reinforcements(t):
    learned = co.learn_procedures(_ep(t), _patterns(t), t.with_vec(t.proc), NOW, theta=0.75, days=20)
    return co.procedure_reinforcements(learned, t.proc).select("id", "n", r6("new_confidence", "new_confidence"))


@query("failed_procedures", "ep proc vecs", """
WITH pv AS (SELECT p.*, v.emb FROM proc p JOIN vecs v ON v.vec_id = p.vec_id), f AS (SELECT e.*, v.emb FROM ep e JOIN vecs v ON v.vec_id = e.vec_id WHERE outcome = 'failure')
SELECT procedure_id, count(*) AS failures FROM (SELECT f.id, p.id AS procedure_id, row_number() OVER (PARTITION BY f.id ORDER BY round(list_cosine_similarity(f.emb, p.emb), 9) DESC, p.id) AS rk FROM f JOIN pv p ON p.agent_id = f.agent_id AND p.tenant_id = f.tenant_id WHERE list_cosine_similarity(f.emb, p.emb) >= 0.75) y WHERE rk = 1 GROUP BY 1""")
def failed_procedures(t):
    return co.failed_procedures(_ep(t), t.with_vec(t.proc))


@query("record_uses", "proc", """
SELECT p.id, (use_count + coalesce(n, 0))::BIGINT AS use_count, (success_count + coalesce(ok, 0))::BIGINT AS success_count, floor(epoch(greatest(last_used_at, at_)))::BIGINT AS last_used FROM proc p
LEFT JOIN (SELECT user_id AS id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ok, max(CAST(ts AS TIMESTAMP)) AS at_ FROM events GROUP BY 1) u ON u.id = p.id""")
def record_uses(t):
    uses = t.events.select(F.col("user_id").alias("procedure_id"), (F.col("event_type") == "purchase").alias("success"), F.col("ts").cast("timestamp").alias("ts"))
    return co.record_uses(t.proc, uses).select("id", F.col("use_count").cast("long").alias("use_count"), F.col("success_count").cast("long").alias("success_count"), F.unix_timestamp("last_used_at").alias("last_used"))


@query("new_versions", "proc", "SELECT id + 1000000 AS id, id AS previous_version_id, 2 AS version, action_template || ' v2' AS action_template FROM proc WHERE use_count > 10")
def new_versions(t):
    ch = t.proc.where("use_count > 10").select("id", (F.col("id") + 1000000).alias("new_id"), F.concat("action_template", F.lit(" v2")).alias("action_template"))
    return co.new_versions(t.proc, ch).select("id", "previous_version_id", "version", "action_template")


@query("merge_redundant")
def merge_redundant(t):
    return co.merge_redundant(t.memv).select("id", "agent_id", "archived", r6("new_confidence", "new_confidence"), "new_count")


@query("cluster_beliefs")
def cluster_beliefs(t):
    return co.cluster(t.memv)


@query("cluster_on_demand")
def cluster_on_demand(t):
    return co.cluster(t.memv, mode="pair")


POOL = "pool AS (SELECT * FROM mem WHERE NOT is_archived AND binding <> 'quarantine' AND confidence >= 0.6::FLOAT AND created_at <= :now - INTERVAL 1 DAY)"
FS = f"""{POOL}, mb AS (SELECT agent_id || ':' || label AS cluster_id, agent_id, label, id, access_count FROM pool), sz AS (SELECT cluster_id, agent_id, label, count(*) AS n FROM mb GROUP BY ALL HAVING count(*) >= 5),
pt AS (SELECT sz.*, coalesce(s.schema_type, 'user_archetype') AS schema_type, coalesce(s.name, 'Pattern ' || sz.label) AS name, s.id AS schema_id, s.confidence::DOUBLE AS c FROM sz LEFT JOIN (SELECT agent_id, label, min(id) AS id FROM sch GROUP BY 1, 2) f ON f.agent_id = sz.agent_id AND f.label = sz.label LEFT JOIN sch s ON s.id = f.id),
fr AS (SELECT schema_id, mb.id AS memory_id, c FROM pt JOIN mb ON mb.cluster_id = pt.cluster_id WHERE schema_id IS NOT NULL AND mb.access_count >= 2)"""


def _formed(t):
    pool = co.evidence_pool(t.mem, NOW)
    members = pool.select(F.concat_ws(":", F.col("agent_id").cast("string"), F.col("label").cast("string")).alias("cluster_id"), "agent_id", "label", "id")
    first = t.sch.groupBy("agent_id", "label").agg(F.min_by(F.struct("schema_type", "name"), "id").alias("s"))
    pats = members.select("cluster_id", "agent_id", "label").distinct().join(first, ["agent_id", "label"], "left").select(
        "cluster_id", F.coalesce("s.schema_type", F.lit("user_archetype")).alias("schema_type"), F.coalesce("s.name", F.concat(F.lit("Pattern "), F.col("label").cast("string"))).alias("name"))
    # beliefs seen less than twice already count as evidence
    known = t.sch.select(F.col("id").alias("schema_id"), "label").join(t.mem.where("access_count < 2").select(F.col("id").alias("memory_id"), "label"), "label").select("schema_id", "memory_id")
    return co.form_schemas(members, pats, t.sch, known), members


@query("form_schemas_updated", "mem sch", f"WITH {FS} SELECT schema_id, count(*) AS added, round(least(0.95, any_value(c) + 0.02 * count(*)), 6) AS new_confidence FROM fr GROUP BY 1")
def form_schemas_updated(t):
    return _formed(t)[0][0].select("schema_id", "added", r6("new_confidence", "new_confidence"))


@query("form_schemas_new", "mem sch", f"WITH {FS} SELECT cluster_id, schema_type, name, n AS evidence_count, round(least(0.8, 0.5 + 0.05 * n)::DOUBLE, 6) AS confidence FROM pt WHERE schema_id IS NULL")
def form_schemas_new(t):
    return _formed(t)[0][1].select("cluster_id", "schema_type", "name", "evidence_count", r6("confidence", "confidence"))


@query("form_schemas_evidence", "mem sch", f"WITH {FS} SELECT schema_id, memory_id FROM fr")
def form_schemas_evidence(t):
    return _formed(t)[0][2]


@query("schema_associations", "mem sch", f"WITH {FS} SELECT mb.id AS source_id, name AS target_id, 0.8::DOUBLE AS strength FROM pt JOIN mb ON mb.cluster_id = pt.cluster_id WHERE schema_id IS NULL")
def schema_associations(t):
    (_, new, _), members = _formed(t)
    return co.schema_associations(new, members).select("source_id", "target_id", "strength")


@query("contradict_schemas", "sch", "SELECT s.id, count(*) AS contradictions, round(greatest(0.1, confidence::DOUBLE - 0.1 * count(*)), 6) AS new_confidence FROM sch s JOIN events e ON e.user_id = s.id AND e.event_type = 'error' GROUP BY s.id, s.confidence")
def contradict_schemas(t):
    ev = t.events.where("event_type = 'error'").select(F.col("user_id").alias("schema_id"))
    return co.contradict_schemas(t.sch, ev).select("id", "contradictions", r6("new_confidence", "new_confidence"))


@query("validate_schemas", "sch", "SELECT id, epoch(:now)::BIGINT AS validated FROM sch WHERE confidence >= 0.5::FLOAT")
def validate_schemas(t):
    return co.validate_schemas(t.sch, t.sch.where(F.col("confidence") >= F.lit(0.5).cast("float")), NOW).select("id", F.unix_timestamp("last_validated_at").alias("validated"))


@query("forget_beliefs", "mem vecs", f"WITH {DECAY} SELECT agent_id, count(*) FILTER (changed AND NOT archived) AS decayed, count(*) FILTER (archived) AS archived FROM d GROUP BY 1")
def forget_beliefs(t):
    parts = co.forget(t.memv, t.ep, t.proc, t.edges, bl.resolve_settings(t.tenants, t.settings_raw), NOW)
    return parts["beliefs"].groupBy("agent_id").agg(F.count_if(F.col("changed") & ~F.col("archived")).alias("decayed"), F.count_if("archived").alias("archived"))


@query("consolidate_counts")
def consolidate_counts(t):
    return co.consolidate_counts(t.memv, _ep(t), t.with_vec(t.proc), t.edges, bl.resolve_settings(t.tenants, t.settings_raw), _extracted(t), _patterns(t), NOW)
