"""Expiry, policies, sessions, quarantine, overrides, erasure, repair."""

from pyspark.sql import functions as F

from beliefmill.operators import lifecycle as lc
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW

GONE = """gone AS (SELECT m.*, CASE WHEN expires_at < :now THEN 'deletion: ttl expired' ELSE 'deletion: retention policy' END AS why FROM mem m LEFT JOIN policies p ON p.agent_id = m.agent_id AND p.memory_type = m.type
 WHERE expires_at < :now OR m.created_at < :now - INTERVAL 1 DAY * p.retention_days)"""


@query("expire_kept", "mem policies", f"WITH {GONE} SELECT id FROM mem WHERE id NOT IN (SELECT id FROM gone)")
def expire_kept(t):
    return lc.expire(t.mem, t.policies, NOW)[0].select("id")


@query("expire_log", "mem policies", f"WITH {GONE} SELECT id AS memory_id, why AS reason, sha256(content) AS content_hash, content AS content_snapshot FROM gone")
def expire_log(t):
    return lc.expire(t.mem, t.policies, NOW)[1].select("memory_id", "reason", "content_hash", "content_snapshot")


EXC = """r AS (SELECT m.id, m.agent_id, m.tenant_id, m.type, p.max_memories, row_number() OVER (PARTITION BY m.agent_id, m.type ORDER BY m.created_at DESC, m.id DESC) AS rk FROM mem m JOIN policies p ON p.agent_id = m.agent_id AND p.memory_type = m.type WHERE NOT m.is_archived),
x AS (SELECT * FROM r WHERE rk > max_memories)"""


@query("policy_excess", "mem policies", f"WITH {EXC} SELECT id FROM x")
def policy_excess(t):
    return lc.policy_excess(t.mem, t.policies).select("id")


@query("enforce_policies", "mem policies", f"WITH {EXC} SELECT id FROM mem WHERE id NOT IN (SELECT id FROM x)")
def enforce_policies(t):
    return lc.enforce_policies(t.mem, t.policies)[0].select("id")


@query("policy_summaries", "mem policies", f"WITH {EXC} SELECT agent_id, type, min(tenant_id) AS tenant_id, 'Summary of ' || type AS content, 'auto-summarize' AS source, 0.8::DOUBLE AS confidence FROM x GROUP BY agent_id, type")
def policy_summaries(t):
    s = t.policies.select("agent_id", "memory_type", F.concat(F.lit("Summary of "), "memory_type").alias("content"))
    return lc.enforce_policies(t.mem, t.policies, s)[1]


@query("expired_session_memories", "mem sessions", "SELECT id FROM mem WHERE NOT is_archived AND binding = 'session' AND session_id IN (SELECT session_id FROM sessions WHERE expires_at < :now)")
def expired_session_memories(t):
    return lc.expired_session_memories(t.mem, t.sessions, NOW).select("id")


@query("session_archive_log", "mem sessions", "SELECT id AS memory_id, 'archive: session expired' AS reason, sha256(content) AS content_hash FROM mem WHERE NOT is_archived AND binding = 'session' AND session_id IN (SELECT session_id FROM sessions WHERE expires_at < :now)")
def session_archive_log(t):
    return lc.log_rows(lc.expired_session_memories(t.mem, t.sessions, NOW), "archive", "archive: session expired", NOW).select("memory_id", "reason", "content_hash")


@query("end_sessions", "sessions", "SELECT id, CASE WHEN status = 'active' THEN 'ended' ELSE status END AS status, epoch(CASE WHEN status = 'active' THEN :now + INTERVAL 24 HOUR ELSE expires_at END)::BIGINT AS ends FROM sessions")
def end_sessions(t):
    return lc.end_sessions(t.sessions, t.sessions, NOW).select("id", "status", F.unix_timestamp("expires_at").alias("ends"))


@query("expire_sessions", "sessions", "SELECT id, CASE WHEN expires_at < :now THEN 'expired' ELSE status END AS status FROM sessions")
def expire_sessions(t):
    return lc.expire_sessions(t.sessions, NOW).select("id", "status")


@query("release_quarantine", "mem", "SELECT id, CASE WHEN session_id IS NOT NULL THEN 'session' WHEN anchor_id IS NOT NULL THEN 'anchored' ELSE 'private' END AS binding FROM mem WHERE binding = 'quarantine' AND needs_review")
def release_quarantine(t):
    return lc.release(t.mem, t.mem.where("needs_review"), NOW)[0].select("id", "binding")


@query("reject_quarantine", "mem", "SELECT id AS memory_id, 'reject: discarded untrusted write' AS reason, content AS content_snapshot FROM mem WHERE binding = 'quarantine' AND NOT needs_review")
def reject_quarantine(t):
    return lc.reject(t.mem, t.mem.where("NOT needs_review"), NOW)[1].select("memory_id", "reason", "content_snapshot")


@query("archive_restore", "mem", "SELECT id, CASE WHEN type = 'fact' THEN false ELSE is_archived OR needs_review END AS is_archived FROM mem")
def archive_restore(t):
    a = lc.archive(t.mem, t.mem.where("needs_review"))
    return lc.restore(a, t.mem.where("type = 'fact'")).select("id", "is_archived")


@query("flag_review", "mem contra", "SELECT id, needs_review OR id IN (SELECT belief_id FROM contra) AS needs_review FROM mem")
def flag_review(t):
    return lc.flag_review(t.mem, t.contra.select(F.col("belief_id").alias("id"))).select("id", "needs_review")


def _changes(t):
    return t.mem.where("needs_review").select("id", F.when(F.col("label") < 5, 0.33).alias("confidence"), F.when(F.col("label") >= 5, F.concat(F.lit("Corrected "), "content")).alias("content"),
                                              F.lit("operator fix").alias("reason"), F.lit("user").alias("actor"))


@query("override", "mem", "SELECT id, round((CASE WHEN label < 5 THEN 0.33::FLOAT ELSE confidence END)::DOUBLE, 6) AS confidence, CASE WHEN label >= 5 THEN 'Corrected ' || content ELSE content END AS content FROM mem WHERE needs_review")
def override(t):
    return lc.override(t.mem, _changes(t), NOW)[0].select("id", r6("confidence", "confidence"), "content")


@query("override_log", "mem", """
SELECT id AS memory_id, 'operator fix' AS reason, 'user' AS actor_type, sha256(content) AS content_hash, CASE WHEN label >= 5 THEN '{"new_content_hash":"' || sha256('Corrected ' || content) || '"}' END AS metadata FROM mem WHERE needs_review""")
def override_log(t):
    return lc.override(t.mem, _changes(t), NOW)[1].select("memory_id", "reason", "actor_type", "content_hash", "metadata")


@query("resolve_contradictions", "mem contra", "SELECT id, is_archived OR id IN (SELECT contradicted_by_id FROM contra) AS is_archived, needs_review AND id NOT IN (SELECT belief_id FROM contra) AS needs_review FROM mem")
def resolve_contradictions(t):
    return lc.resolve_contradictions(t.mem, t.contra.select(F.col("belief_id").alias("keeper"), F.col("contradicted_by_id").alias("loser"))).select("id", "is_archived", "needs_review")


@query("redact", "mem", "SELECT id, '[REDACTED]' AS content FROM mem WHERE needs_review")
def redact(t):
    return lc.redact(t.mem, t.mem.where("needs_review"), "request", NOW)[0].select("id", "content")


@query("redact_log", "mem", "SELECT id AS memory_id, 'request' AS reason, sha256(content) AS content_hash, NULL::VARCHAR AS content_snapshot FROM mem WHERE needs_review")
def redact_log(t):
    return lc.redact(t.mem, t.mem.where("needs_review"), "request", NOW)[1].select("memory_id", "reason", "content_hash", "content_snapshot")


SUBJ = """own AS (SELECT tenant_id, id FROM mem WHERE anchor_id IS NOT NULL AND NOT is_archived),
clo AS (SELECT * FROM own UNION SELECT c.tenant_id, e.source_id FROM clo c JOIN edges e ON e.target_id = c.id AND e.relation_type = 'derived_from' JOIN mem m ON m.id = e.source_id AND m.tenant_id = c.tenant_id WHERE NOT m.is_archived),
gone AS (SELECT id, true AS direct FROM mem WHERE anchor_id IS NOT NULL UNION SELECT id, false FROM clo WHERE id NOT IN (SELECT id FROM mem WHERE anchor_id IS NOT NULL))"""


def _subjects(t):
    return t.mem.where("anchor_id IS NOT NULL").select("tenant_id", "anchor_id").distinct()


@query("purge_subject_log", "mem edges", f"""WITH RECURSIVE {SUBJ} SELECT g.id AS memory_id, CASE WHEN direct THEN 'deletion: anchor purge (erasure)' ELSE 'deletion: derived from purged subject (erasure)' END AS reason, sha256(content) AS content_hash, NULL::VARCHAR AS content_snapshot FROM gone g JOIN mem ON mem.id = g.id""")
def purge_subject_log(t):
    return lc.purge_subject(_subjects(t), t.mem, t.mentions, t.edges, t.assoc, NOW)[1].select("memory_id", "reason", "content_hash", "content_snapshot")


@query("purge_subject_kept", "mem edges mentions assoc", f"""WITH RECURSIVE {SUBJ} SELECT 'belief' AS kind, count(*) AS n FROM mem WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'mention', count(*) FROM mentions WHERE memory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edge', count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'assoc', count(*) FROM assoc WHERE NOT (source_type = 'semantic' AND source_id IN (SELECT id FROM gone)) AND NOT (target_type = 'semantic' AND target_id IN (SELECT id FROM gone))""")
def purge_subject_kept(t):
    kept, _, mentions, edges, assoc = lc.purge_subject(_subjects(t), t.mem, t.mentions, t.edges, t.assoc, NOW)
    parts = [d.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, d in (("belief", kept), ("mention", mentions), ("edge", edges), ("assoc", assoc))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("shred_subject")
def shred_subject(t):
    ent = t.ent.withColumn("aliases", F.array("alias"))
    rows = lc.shred_subject(_subjects(t), t.mem, ent, t.mentions, t.edges, t.assoc, NOW)[0]
    return rows.select("id", lc.is_shredded(F.col("content")).alias("shredded"))


@query("shred_log", "mem edges", f"""WITH RECURSIVE {SUBJ} SELECT id AS memory_id, 'erasure' AS reason, sha256(content) AS content_hash FROM mem WHERE id IN (SELECT id FROM clo) UNION ALL SELECT DISTINCT anchor_id, 'subject erasure (GDPR): erasure', NULL FROM (SELECT DISTINCT tenant_id, anchor_id FROM mem WHERE anchor_id IS NOT NULL) a""".replace("UNION ALL SELECT DISTINCT anchor_id", "UNION ALL SELECT anchor_id"))
def shred_log(t):
    ent = t.ent.withColumn("aliases", F.array("alias"))
    return lc.shred_subject(_subjects(t), t.mem, ent, t.mentions, t.edges, t.assoc, NOW)[1].select("memory_id", "reason", "content_hash")


@query("scrub_entities", "ent mem", "SELECT entity_id, 'erased-' || entity_id AS name, NULL::VARCHAR AS external_id FROM ent e WHERE EXISTS (SELECT 1 FROM mem m WHERE m.anchor_id = e.entity_id AND m.tenant_id = e.tenant_id)")
def scrub_entities(t):
    return lc.scrub_entities(t.ent, t.mem.where("anchor_id IS NOT NULL").select("tenant_id", "anchor_id")).select("entity_id", "name", "external_id")


@query("upsert_anchors", "ent", """
SELECT tenant_id, external_id, name || ' II' AS name, entity_type, array_to_string(list_sort([alias, 'aka ' || entity_id]), '|') AS aliases FROM ent WHERE is_anchor""")
def upsert_anchors(t):
    base = t.ent.where("is_anchor").select("tenant_id", "external_id", "name", "entity_type", F.array("alias").alias("aliases"), "entity_id")
    more = base.withColumns({"name": F.concat("name", F.lit(" II")), "aliases": F.array(F.concat(F.lit("aka "), F.col("entity_id").cast("string")))})
    return lc.upsert_anchors(base, more).withColumn("aliases", F.array_join("aliases", "|"))


@query("record_usage", "ep_usage", "SELECT episode_id, memory_id, usage_type, round(CASE usage_type WHEN 'retrieved' THEN 0.9 ELSE 0.8 END::FLOAT::DOUBLE, 6) AS relevance FROM (SELECT DISTINCT episode_id, memory_id, usage_type FROM ep_usage) x")
def record_usage(t):
    more = t.ep_usage.where("usage_type = 'retrieved'").withColumn("relevance", F.lit(0.9).cast("float"))
    return lc.record_usage(t.ep_usage, more).select("episode_id", "memory_id", "usage_type", r6("relevance", "relevance"))


@query("touch_episodes", "ep", """
SELECT e.id, count(*) AS accesses, floor(epoch(greatest(e.last_accessed_at, max(CAST(v.ts AS TIMESTAMP)))))::BIGINT AS seen FROM ep e JOIN events v ON v.user_id = e.id GROUP BY e.id, e.last_accessed_at""")
def touch_episodes(t):
    acc = t.events.select(F.col("user_id").alias("episode_id"), F.col("ts").cast("timestamp").alias("ts"))
    return lc.touch_episodes(t.ep, acc).select("id", "accesses", F.unix_timestamp("last_accessed_at").alias("seen"))


@query("normalise_confidence", "mem", "SELECT id, round(least(c, 0.99::FLOAT)::DOUBLE, 6) AS confidence FROM (SELECT id, (confidence * 1.1)::FLOAT AS c FROM mem) x")
def normalise_confidence(t):
    raw = t.mem.withColumn("confidence", (F.col("confidence") * F.lit(1.1).cast("double")).cast("float"))
    return lc.normalise_confidence(raw).select("id", r6("confidence", "confidence"))


@query("backfill_association_tenants", "assoc mem ep", """
WITH o AS (SELECT 'semantic' AS ty, id, tenant_id FROM mem WHERE NOT is_archived UNION ALL SELECT 'episodic', id, tenant_id FROM ep)
SELECT a.source_type, a.source_id, a.target_id, o.tenant_id, o.id IS NULL AS dangling FROM assoc a LEFT JOIN o ON o.ty = a.source_type AND o.id = a.source_id""")
def backfill_association_tenants(t):
    owners = t.mem.where("NOT is_archived").select(F.lit("semantic").alias("type"), "id", "tenant_id").unionByName(t.ep.select(F.lit("episodic").alias("type"), "id", "tenant_id"))
    ok, bad = lc.backfill_association_tenants(t.assoc, owners)
    cols = ["source_type", "source_id", "target_id"]
    return ok.select(*cols, "tenant_id", F.lit(False).alias("dangling")).unionByName(bad.select(*cols, F.lit(None).cast("long").alias("tenant_id"), F.lit(True).alias("dangling")))


@query("backfill_entity_tenants", "ent mem", "SELECT entity_id, m.tenant_id FROM ent e JOIN (SELECT DISTINCT agent_id, tenant_id FROM mem) m ON m.agent_id = e.agent_id")
def backfill_entity_tenants(t):
    bare = t.ent.withColumn("tenant_id", F.lit(None).cast("long"))
    return lc.backfill_entity_tenants(bare, t.mem.select("agent_id", "tenant_id"))[0].select("entity_id", "tenant_id")


@query("backfill_log_identity", "mlog mem", "SELECT l.id, m.tenant_id, m.anchor_id, m.binding FROM mlog l LEFT JOIN mem m ON m.id = l.memory_id")
def backfill_log_identity(t):
    bare = t.mlog.withColumn("tenant_id", F.lit(None).cast("long"))
    return lc.backfill_log_identity(bare, t.mem).select("id", "tenant_id", "anchor_id", "binding")
