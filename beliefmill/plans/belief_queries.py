"""Scans, listings, predicates, scalar functions and sources."""

from pyspark.sql import functions as F

from beliefmill.functions import lexicon as lx
from beliefmill.functions import scalar as sc
from beliefmill.functions import vectors as vc
from beliefmill.operators import beliefs as bl
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW
from beliefmill.session import instant
from beliefmill.sources import conversations as cv
from beliefmill.sources import tables as tb
from beliefmill.sources.embedder import reembed

TIER = "CASE WHEN confidence::DOUBLE > 0.85 THEN 'hot' WHEN confidence::DOUBLE > 0.7 THEN 'warm' WHEN confidence::DOUBLE > 0.4 THEN 'cold' ELSE 'archive' END"
LG = "ln(least(greatest(confidence::DOUBLE, 0.01), 0.99) / (1 - least(greatest(confidence::DOUBLE, 0.01), 0.99)))"


def pos(c):
    return F.col(c).cast("long").alias(c)


@query("active_memories", "mem", "SELECT id, agent_id, tenant_id, type, round(confidence::DOUBLE, 6) AS confidence FROM mem WHERE NOT is_archived")
def active_memories(t):
    return t.mem.where(bl.active()).select("id", "agent_id", "tenant_id", "type", r6("confidence", "confidence"))


@query("write_defaults", "incoming", """
SELECT id, coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE provenance END, ''), 'agent') AS provenance,
  CASE WHEN binding = 'canon' THEN 'canon' WHEN session_id IS NOT NULL THEN 'session' WHEN anchor_id IS NOT NULL THEN 'anchored' ELSE 'private' END AS binding,
  round(CASE coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE provenance END, ''), 'agent') WHEN 'user' THEN 0.9 WHEN 'tool' THEN 0.8 WHEN 'agent' THEN 0.72 WHEN 'derived' THEN 0.5 ELSE 0.4 END::DOUBLE, 6) AS confidence,
  round(CASE WHEN binding = 'canon' THEN 0.01 WHEN session_id IS NOT NULL THEN 0.2 ELSE 0.05 END::DOUBLE, 6) AS decay_rate, 1 AS reinforcement_count, 0 AS access_count
FROM incoming""")
def write_defaults(t):
    raw = t.incoming.withColumns({
        "provenance": F.when(F.col("id") % 3 == 0, "").otherwise(F.col("provenance")),
        "binding": F.when(F.col("binding") == "canon", "canon").otherwise(""),
        "confidence": F.lit(0.0).cast("float"), "decay_rate": F.lit(0.0).cast("float"), "reinforcement_count": F.lit(0)})
    return bl.with_write_defaults(raw, NOW).select("id", "provenance", "binding", r6("confidence", "confidence"),
                                                   r6("decay_rate", "decay_rate"), "reinforcement_count", "access_count")


@query("list_page", "mem", """
WITH f AS (SELECT *, count(*) OVER (PARTITION BY agent_id) AS total, row_number() OVER (PARTITION BY agent_id ORDER BY confidence DESC, created_at DESC, id) AS pos FROM mem WHERE NOT is_archived)
SELECT agent_id, id, pos, total FROM f WHERE pos > 5 AND pos <= 25""")
def list_page(t):
    return bl.list_page(t.mem, 20, 5).select("agent_id", "id", pos("pos"), "total")


@query("tier_columns", "mem", f"""
SELECT id, {TIER} AS tier, CASE {TIER} WHEN 'hot' THEN 'confidence > 0.85' WHEN 'warm' THEN '0.70 < confidence <= 0.85' WHEN 'cold' THEN '0.40 < confidence <= 0.70' ELSE 'confidence <= 0.40' END AS reason,
  CASE WHEN confidence >= 0.7::FLOAT THEN 'healthy' WHEN confidence >= 0.4::FLOAT THEN 'decaying' ELSE 'at_risk' END AS status,
  {TIER} = 'hot' AS auto_inject, CASE {TIER} WHEN 'hot' THEN 0.0 WHEN 'warm' THEN 0.5 WHEN 'cold' THEN 0.75 ELSE 1.0 END::DOUBLE AS threshold,
  {TIER} IN ('cold', 'archive') AS summarize, CASE {TIER} WHEN 'hot' THEN 0.5 WHEN 'warm' THEN 1.0 WHEN 'cold' THEN 1.5 ELSE 2.0 END::DOUBLE AS multiplier FROM mem""")
def tier_columns(t):
    tier = sc.tier(F.col("confidence"))
    b = sc.tier_behaviour(tier)
    return t.mem.select("id", tier.alias("tier"), sc.tier_reason(F.col("confidence")).alias("reason"),
                        sc.decay_status(F.col("confidence")).alias("status"), b["auto_inject"].alias("auto_inject"),
                        b["retrieval_threshold"].alias("threshold"), b["summarize_on_access"].alias("summarize"), b["decay_multiplier"].alias("multiplier"))


@query("memories_in_tier", "mem", """
SELECT agent_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY confidence DESC, id) AS rank FROM mem
  WHERE NOT is_archived AND confidence::DOUBLE > 0.4 AND confidence::DOUBLE <= 0.7) x WHERE rank <= 100""")
def memories_in_tier(t):
    return bl.memories_in_tier(t.mem, "cold").select("agent_id", "id", pos("rank"))


@query("hot_memories", "mem", """
SELECT agent_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY confidence DESC, id) AS rank FROM mem
  WHERE NOT is_archived AND confidence::DOUBLE > 0.85) x WHERE rank <= 20""")
def hot_memories(t):
    return bl.hot_memories(t.mem).select("agent_id", "id", pos("rank"))


@query("browse_archive_tier", "mem", "SELECT id, type FROM mem WHERE (confidence::DOUBLE <= 0.4 OR is_archived) AND provenance = 'tool'")
def browse_archive_tier(t):
    return bl.browse(t.mem, tier="archive", provenance="tool").select("id", "type")


@query("browse_warm_facts", "mem", f"SELECT id, binding FROM mem WHERE NOT is_archived AND {TIER} = 'warm' AND type = 'fact'")
def browse_warm_facts(t):
    return bl.browse(t.mem, tier="warm", mem_type="fact").select("id", "binding")


@query("recall_scope", "mem", """
SELECT id FROM mem WHERE NOT is_archived AND binding <> 'quarantine' AND anchor_id IS NULL AND session_id IS NULL AND confidence >= 0.2::FLOAT
 AND coalesce(event_date, created_at) >= TIMESTAMP '2024-01-05 00:00:00' AND coalesce(event_date, created_at) <= TIMESTAMP '2024-01-20 00:00:00'""")
def recall_scope(t):
    from beliefmill.operators.recall import recall_scope as scope
    return scope(t.mem, min_confidence=0.2, date_from="2024-01-05 00:00:00", date_to="2024-01-20 00:00:00").select("id")


@query("binding_of", "mem", "SELECT id, CASE WHEN session_id IS NOT NULL THEN 'session' WHEN anchor_id IS NOT NULL THEN 'anchored' ELSE 'private' END AS derived FROM mem")
def binding_of(t):
    return t.mem.select("id", sc.binding_of(F.col("anchor_id"), F.col("session_id")).alias("derived"))


@query("validate", "mem", """
SELECT id, array_to_string(list_filter([
  CASE WHEN (b IN ('canon', 'private') AND (anchor_id IS NOT NULL OR session_id IS NOT NULL)) OR (b = 'anchored' AND (anchor_id IS NULL OR session_id IS NOT NULL)) OR (b = 'session' AND session_id IS NULL) THEN 'binding_ids' END,
  CASE WHEN c > 1 OR c < 0 THEN 'confidence_range' END, CASE WHEN ty NOT IN ('preference', 'fact', 'decision', 'constraint', 'belief') THEN 'type_domain' END], lambda x: x IS NOT NULL), ',') AS broken
FROM (SELECT *, CASE WHEN id % 6 = 1 THEN 'anchored' ELSE binding END AS b, confidence::DOUBLE * 1.2::DOUBLE AS c, CASE WHEN label = 3 THEN 'rumour' ELSE type END AS ty FROM mem) x""")
def validate(t):
    dirty = t.mem.withColumns({
        "binding": F.when(F.col("id") % 6 == 1, "anchored").otherwise(F.col("binding")),
        "confidence": F.col("confidence").cast("double") * 1.2, "type": F.when(F.col("label") == 3, "rumour").otherwise(F.col("type"))})
    return bl.validate(dirty).select("id", F.array_join("violations", ",").alias("broken"))


@query("resolve_settings", "tenants settings_raw", """
SELECT tenant_id, CASE tenant_id WHEN 0 THEN 0.002 ELSE 0.001 END::DOUBLE AS decay_base_rate, CASE tenant_id WHEN 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS decay_floor,
  0.5::DOUBLE AS competition_weight, tenant_id = 0 AS firewall_enabled, CASE tenant_id WHEN 0 THEN 'inferred,agent' ELSE '' END AS provenances FROM tenants""")
def resolve_settings(t):
    return bl.resolve_settings(t.tenants, t.settings_raw).select(
        "tenant_id", "decay_base_rate", "decay_floor", "competition_weight", "firewall_enabled", F.array_join("quarantine_provenances", ",").alias("provenances"))


@query("firewall", "incoming settings_raw", """
SELECT id, CASE WHEN binding = 'canon' THEN NULL WHEN id % 50 = 0 THEN 'caller marked write untrusted'
  WHEN tenant_id = 0 AND provenance IN ('inferred', 'agent') THEN 'firewall policy: provenance ''' || provenance || ''' quarantined' END AS reason FROM incoming""")
def firewall(t):
    rows = t.incoming.withColumn("untrusted", F.col("id") % 50 == 0)
    return bl.firewall(rows, bl.resolve_settings(t.tenants, t.settings_raw), "untrusted").select("id", F.col("quarantine_reason").alias("reason"))


@query("quarantine_queue", "mem", """
SELECT tenant_id, id, pos, total FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id) AS total, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id) AS pos
 FROM mem WHERE binding = 'quarantine' AND NOT is_archived) x WHERE pos <= 50""")
def quarantine_queue(t):
    return bl.quarantine_queue(t.mem).select("tenant_id", "id", pos("pos"), "total")


@query("needs_review", "mem", """
SELECT agent_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY updated_at DESC, id) AS rank FROM mem WHERE needs_review AND NOT is_archived) x WHERE rank <= 100""")
def needs_review(t):
    return bl.needs_review(t.mem).select("agent_id", "id", pos("rank"))


@query("subject_profile", "mem", """
SELECT tenant_id, anchor_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, anchor_id ORDER BY confidence DESC, created_at DESC, id) AS rank FROM mem WHERE anchor_id IS NOT NULL AND NOT is_archived) x WHERE rank <= 100""")
def subject_profile(t):
    return bl.by_anchor(t.mem).select("tenant_id", "anchor_id", "id", pos("rank"))


@query("canon_list", "mem", """
SELECT tenant_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY confidence DESC, created_at DESC, id) AS rank FROM mem WHERE binding = 'canon' AND NOT is_archived) x WHERE rank <= 100""")
def canon_list(t):
    return bl.canon(t.mem).select("tenant_id", "id", pos("rank"))


@query("canon_dedupe", "mem incoming", """
SELECT i.id, arg_min(m.id, (m.created_at, m.id)) AS canon_id FROM incoming i JOIN mem m ON m.tenant_id = i.tenant_id AND m.content = i.content
WHERE m.binding = 'canon' AND NOT m.is_archived GROUP BY i.id""")
def canon_dedupe(t):
    return bl.canon_dedupe(t.incoming, t.mem).select("id", "canon_id")


@query("same_scope", "mem incoming", """
SELECT i.id, count(*) AS n FROM incoming i JOIN mem m ON m.agent_id = i.agent_id AND m.anchor_id IS NOT DISTINCT FROM i.anchor_id AND m.session_id IS NOT DISTINCT FROM i.session_id GROUP BY i.id""")
def same_scope(t):
    per = t.mem.groupBy("agent_id", "anchor_id", "session_id").agg(F.count("*").alias("n"))
    i = t.incoming
    return i.join(per, (i.agent_id == per.agent_id) & i.anchor_id.eqNullSafe(per.anchor_id) & i.session_id.eqNullSafe(per.session_id)).select(i.id, "n")


@query("episodes_in_range", "ep", "SELECT id, agent_id FROM ep WHERE occurred_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def episodes_in_range(t):
    return bl.episodes_in_range(t.ep, "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("id", "agent_id")


@query("episodes_by_importance", "ep", """
SELECT agent_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY importance_score DESC, occurred_at DESC, id) AS rank FROM ep WHERE importance_score >= 0.7::FLOAT) x WHERE rank <= 50""")
def episodes_by_importance(t):
    return bl.episodes_by_importance(t.ep, 0.7).select("agent_id", "id", pos("rank"))


@query("episodes_by_status", "ep", """
SELECT agent_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY occurred_at, id) AS rank FROM ep WHERE consolidation_status = 'raw') x WHERE rank <= 50""")
def episodes_by_status(t):
    return bl.episodes_by_status(t.ep, "raw").select("agent_id", "id", pos("rank"))


@query("conversation_episodes", "ep", """
SELECT id, conversation_id, message_sequence, epoch(occurred_at)::BIGINT AS sec FROM ep""")
def conversation_episodes(t):
    return t.ep.orderBy("conversation_id", "message_sequence", "occurred_at").select(
        "id", "conversation_id", "message_sequence", F.unix_timestamp("occurred_at").alias("sec"))


@query("weak_episodes", "ep", "SELECT id FROM ep WHERE memory_strength < 0.35::FLOAT AND consolidation_status <> 'archived'")
def weak_episodes(t):
    return bl.weak_episodes(t.ep, 0.35).select("id")


@query("recall_episodes", "ep", """
SELECT agent_id, id, rank, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY occurred_at DESC, id) AS rank FROM ep WHERE occurred_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00') x WHERE rank <= 50""")
def recall_episodes(t):
    return bl.recall_episodes(t.ep, start="2024-01-10 00:00:00", end="2024-01-20 00:00:00").select("agent_id", "id", pos("rank"), "score")


@query("procedure_list", "proc", "SELECT id, agent_id, round(CASE WHEN use_count > 0 THEN success_count::DOUBLE / use_count ELSE 0 END, 6) AS success_rate FROM proc")
def procedure_list(t):
    from beliefmill.operators.recall import with_success_rate
    return with_success_rate(t.proc).select("id", "agent_id", r6("success_rate", "success_rate"))


@query("schema_by_name", "sch", "SELECT agent_id, schema_type, name, arg_max(id, (confidence, -id)) AS id FROM sch GROUP BY ALL")
def schema_by_name(t):
    return t.sch.groupBy("agent_id", "schema_type", "name").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("id"))


@query("latest_session", "sessions", "SELECT external_id, arg_max(id, (created_at, id)) AS session FROM sessions GROUP BY 1")
def latest_session(t):
    return bl.latest_session(t.sessions)


@query("mutation_trail", "mlog", """
SELECT memory_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, id DESC) AS rank FROM mlog) x WHERE rank <= 100""")
def mutation_trail(t):
    return bl.mutation_trail(t.mlog).select("memory_id", "id", pos("rank"))


@query("mutation_feed", "mlog", "SELECT id, agent_id, mutation_type, reason FROM mlog WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00'")
def mutation_feed(t):
    return bl.mutation_feed(t.mlog, "2024-01-15 00:00:00").select("id", "agent_id", "mutation_type", "reason")


@query("signals_by_agent", "signals mem", "SELECT s.id, m.agent_id, s.memory_id, s.signal_type FROM signals s JOIN mem m ON m.id = s.memory_id")
def signals_by_agent(t):
    return t.signals.join(t.mem.select(F.col("id").alias("memory_id"), "agent_id"), "memory_id").select("id", "agent_id", "memory_id", "signal_type")


@query("usage_by_memory", "ep_usage", "SELECT memory_id, count(*) AS n, round(avg(relevance::DOUBLE), 6) AS mean_relevance FROM ep_usage GROUP BY 1")
def usage_by_memory(t):
    return t.ep_usage.groupBy("memory_id").agg(F.count("*").alias("n"), r6(F.avg(F.col("relevance").cast("double")), "mean_relevance"))


@query("anchors", "ent", "SELECT entity_id, name, external_id FROM ent WHERE is_anchor AND entity_type = 'person'")
def anchors(t):
    return bl.anchors(t.ent, "person").select("entity_id", "name", "external_id")


# -- scalar functions -------------------------------------------------------

@query("log_odds", "mem", f"SELECT id, round({LG}, 6) AS logit, round(least(greatest(1 / (1 + exp(-({LG} + 0.3))), 0.01), 0.99), 6) AS up, round(least(greatest(1 / (1 + exp(-({LG} - 0.5))), 0.01), 0.99), 6) AS down FROM mem")
def log_odds(t):
    c = F.col("confidence")
    return t.mem.select("id", r6(sc.logit(c), "logit"), r6(sc.log_odds_shift(c, F.lit(0.3)), "up"), r6(sc.log_odds_shift(c, F.lit(-0.5)), "down"))


@query("priors", "mem", """
SELECT id, CASE provenance WHEN 'user' THEN 0.9 WHEN 'tool' THEN 0.8 WHEN 'agent' THEN 0.72 WHEN 'derived' THEN 0.5 ELSE 0.4 END::DOUBLE AS prov,
 CASE binding WHEN 'session' THEN 0.2 WHEN 'canon' THEN 0.01 ELSE 0.05 END::DOUBLE AS rate,
 CASE source WHEN 'user_statement' THEN 1.0 WHEN 'tool_output' THEN 0.9 WHEN 'extraction' THEN 0.8 WHEN 'agent_inference' THEN 0.7 ELSE 0.75 END::DOUBLE AS reliability,
 CASE id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.625 WHEN 2 THEN 0.425 ELSE 0.5 END::DOUBLE AS evidence FROM mem""")
def priors(t):
    ev = F.element_at(F.array(*[F.lit(e) for e in lx.EVIDENCE_TYPES + ["hearsay"]]), (F.col("id") % 4 + 1).cast("int"))
    return t.mem.select("id", sc.provenance_prior(F.col("provenance")).alias("prov"), sc.binding_decay_rate(F.col("binding")).alias("rate"),
                        sc.source_reliability(F.col("source")).alias("reliability"), sc.evidence_prior(ev).alias("evidence"))


HRS = "(epoch_us(:now) - epoch_us(coalesce(last_accessed_at, created_at))) / 3600000000.0::DOUBLE"


@query("decay_formula", "mem", f"""
WITH a AS (SELECT *, confidence::DOUBLE AS c, {HRS} AS h FROM mem), b AS (SELECT *, 0.1 + (c - 0.1) * exp(-0.001 * h) AS f FROM a),
g AS (SELECT *, CASE WHEN reinforcement_count > 0 THEN f + (c - f) * (1 - 1 / (1 + 0.15 * ln(reinforcement_count + 1.0::DOUBLE))) ELSE f END AS k FROM b)
SELECT id, round(CASE WHEN h < 1 THEN c ELSE least(greatest(k, 0.1), c) END, 6) AS decayed,
  round(CASE WHEN last_accessed_at IS NULL THEN c ELSE greatest(c * exp(-0.001 * h), 0.01) END, 6) AS simple FROM g""")
def decay_formula(t):
    hours = sc.hours_between(instant(NOW), F.coalesce("last_accessed_at", "created_at"))
    return t.mem.select(
        "id", r6(sc.decayed_confidence(F.col("confidence"), hours, F.col("reinforcement_count"), F.lit(0.0), 0.001, 0.1), "decayed"),
        r6(sc.simple_decay(F.col("confidence"), F.col("last_accessed_at"), instant(NOW)), "simple"))


@query("feedback_effects", "signals", """
SELECT signal_type, count(*) AS n, round(max(CASE signal_type WHEN 'helpful' THEN 0.3 WHEN 'unhelpful' THEN -0.5 WHEN 'used' THEN 0.1 WHEN 'ignored' THEN -0.1 WHEN 'contradicted' THEN -1.0 ELSE -0.8 END::DOUBLE), 6) AS delta,
 max(CASE signal_type WHEN 'helpful' THEN 1 WHEN 'unhelpful' THEN -1 WHEN 'contradicted' THEN -2 WHEN 'outdated' THEN -1 ELSE 0 END)::BIGINT AS count_delta FROM signals GROUP BY 1""")
def feedback_effects(t):
    s = F.col("signal_type")
    return t.signals.groupBy("signal_type").agg(F.count("*").alias("n"), r6(F.max(sc.feedback_delta(s)), "delta"),
                                                F.max(sc.feedback_count_delta(s)).cast("long").alias("count_delta"))


@query("cosine_norms", "vecs queries", """
SELECT v.vec_id, q.query_id, round(list_cosine_similarity(v.emb, q.vec::DOUBLE[]), 6) AS sim, round(list_inner_product(v.emb, q.vec::DOUBLE[]), 6) AS dot
FROM vecs v JOIN queries q ON q.query_id = v.label""")
def cosine_norms(t):
    v, q = t.vecs, t.queries
    return v.join(q, q.query_id == v.label).select("vec_id", "query_id", r6(vc.cosine(F.col("emb"), F.col("vec")), "sim"), r6(vc.dot(F.col("emb"), F.col("vec")), "dot"))


@query("vector_means", "vecs queries", """
WITH a AS (SELECT v.vec_id, list_transform(list_zip(v.emb, q.vec), lambda p: (p[1] + p[2]::DOUBLE) / 2) AS m, list_transform(list_zip(v.emb, q.vec), lambda p: p[1] + (p[2]::DOUBLE - p[1]) / 3) AS r FROM vecs v JOIN queries q ON q.query_id = v.label)
SELECT vec_id, round(list_sum(m), 6) AS mean_sum, round(list_sum(r), 6) AS running_sum FROM a""")
def vector_means(t):
    v, q = t.vecs, t.queries
    vec = F.col("vec").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return v.join(q, q.query_id == v.label).select(
        "vec_id", r6(total(vc.mean_of_two(F.col("emb"), vec)), "mean_sum"), r6(total(vc.running_mean(F.col("emb"), vec, F.lit(3))), "running_sum"))


@query("day_parts", "ep", """
SELECT id, CASE WHEN hour(occurred_at) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(occurred_at) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(occurred_at) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS part, dayname(occurred_at) AS weekday FROM ep""")
def day_parts(t):
    return t.ep.select("id", sc.time_of_day(F.col("occurred_at")).alias("part"), sc.weekday(F.col("occurred_at")).alias("weekday"))


@query("event_dates", "mem", """
SELECT id, CASE WHEN id % 3 = 0 THEN epoch(TIMESTAMP '2024-03-05 14:30:00')::BIGINT WHEN id % 3 = 1 THEN epoch(TIMESTAMP '2023-07-04 00:00:00')::BIGINT
  WHEN contains(content, '[DATE:') THEN epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT END AS at FROM mem""")
def event_dates(t):
    meta = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("session_date"), F.lit("2024/03/05 (Tue) 14:30"))).when(
        F.col("id") % 3 == 1, F.create_map(F.lit("event_date"), F.lit("July 4, 2023")))
    return t.mem.select("id", F.unix_timestamp(sc.event_date(F.col("content"), meta)).alias("at"))


def any_sql(words, col="c"):
    return "(" + " OR ".join("contains(" + col + ", '" + w.replace("'", "''") + "')" for w in words) + ")"


def score_sql(words, col):
    return "least(1.0::DOUBLE, 0.35::DOUBLE * (" + " + ".join("contains(" + col + ", '" + w.replace("'", "''") + "')::INT" for w in words) + "))"


@query("classify_type", "mem", f"""
SELECT id, CASE WHEN {any_sql(lx.PREFERENCE_WORDS)} THEN 'preference' WHEN {any_sql(lx.DECISION_WORDS)} THEN 'decision' WHEN {any_sql(lx.CONSTRAINT_WORDS)} THEN 'constraint' ELSE 'fact' END AS kind FROM (SELECT id, lower(content) AS c FROM mem) x""")
def classify_type(t):
    return t.mem.select("id", sc.classify_type(F.col("content")).alias("kind"))


@query("classify_documents", "ep", f"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {any_sql(lx.PREFERENCE_WORDS)} THEN 'preference' WHEN {any_sql(lx.DECISION_WORDS)} THEN 'decision' WHEN {any_sql(lx.CONSTRAINT_WORDS)} THEN 'constraint' ELSE 'fact' END AS kind FROM (SELECT lower(raw_content) AS c FROM ep) x) y GROUP BY kind""")
def classify_documents(t):
    return t.ep.select(sc.classify_type(F.col("raw_content")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("marker_scores", "mem", f"SELECT id, round({score_sql(lx.TEMPORAL_MARKERS, 'c')}, 6) AS temporal, round({score_sql(lx.NEGATION_MARKERS, 'c')}, 6) AS negation FROM (SELECT id, lower(content) AS c FROM mem) x")
def marker_scores(t):
    c = F.lower("content")
    return t.mem.select("id", r6(sc.marker_score(c, lx.TEMPORAL_MARKERS), "temporal"), r6(sc.marker_score(c, lx.NEGATION_MARKERS), "negation"))


@query("content_hashes", "ep", "SELECT id, sha256(raw_content) AS h, CASE WHEN length(raw_content) <= 200 THEN raw_content ELSE substring(raw_content, 1, 197) || '...' END AS short FROM ep")
def content_hashes(t):
    return t.ep.select("id", sc.content_hash(F.col("raw_content")).alias("h"), sc.truncate_text(F.col("raw_content"), 200).alias("short"))


@query("schema_scores", "sch", """
SELECT id, round((len(list_filter([ctx1, ctx2], lambda s: list_contains(list_transform(['Deep coding work', 'PLANNING'], lambda i: contains(lower(i), lower(s))), true))) / 2.0)::DOUBLE, 6) AS ctx,
 round((CASE WHEN lower(time_preference) = 'morning' THEN 1.0 WHEN contains(lower(work_hours), 'morning') THEN 0.8 ELSE 0 END)::DOUBLE, 6) AS tm, round(least(0.8, 0.5 + 0.05 * (id % 9))::DOUBLE, 6) AS init FROM sch""")
def schema_scores(t):
    attrs = F.create_map(F.lit("time_preference"), "time_preference", F.lit("work_hours"), "work_hours")
    inputs = F.array(F.lit("Deep coding work"), F.lit("PLANNING"))
    return t.sch.select("id", r6(sc.context_match(F.array("ctx1", "ctx2"), inputs), "ctx"), r6(sc.time_match(attrs, F.lit("Morning")), "tm"),
                        r6(sc.initial_schema_confidence(F.col("id") % 9), "init"))


@query("evidence_arrays", "mem", """
WITH e AS (SELECT id, label, [id % 7, label, access_count::BIGINT] AS ids FROM mem)
SELECT id, len(ids)::BIGINT + 1 AS appended, len(list_filter(ids, lambda x: x <> label))::BIGINT AS removed, len(list_distinct(list_concat(ids, [id, -1::BIGINT])))::BIGINT AS united FROM e""")
def evidence_arrays(t):
    ids = F.array(F.col("id") % 7, F.col("label").cast("long"), F.col("access_count").cast("long"))
    n = lambda c: F.size(c).cast("long")
    return t.mem.select("id", n(F.array_append(ids, F.col("id"))).alias("appended"), n(F.array_remove(ids, F.col("label").cast("long"))).alias("removed"),
                        n(F.array_union(ids, F.array(F.col("id"), F.lit(-1).cast("long")))).alias("united"))


@query("json_props", "events", """
SELECT event_id, json_extract_string(props, '$.k') AS k, (event_id % 3)::BIGINT AS meta FROM events""")
def json_props(t):
    made = F.parse_json(F.to_json(F.struct((F.col("event_id") % 3).alias("m"))))
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.variant_get(made, "$.m", "bigint").alias("meta"))


# -- sources ----------------------------------------------------------------

@query("conversation_user_memories", "turns", """
SELECT conv_id, agent_id, string_agg('User: ' || text, chr(10) ORDER BY turn) AS content, 0.9::DOUBLE AS confidence FROM turns WHERE role = 'user' GROUP BY ALL""")
def conversation_user_memories(t):
    return cv.conversation_user_memories(t.turns).select("conv_id", "agent_id", "content", r6("confidence", "confidence"))


@query("enumeration_memories", "ep", """
SELECT id, (CASE WHEN id % 2 = 0 THEN 'agent' ELSE 'user' END) AS provenance FROM ep WHERE len(regexp_extract_all(raw_content || chr(10) || '1. a' || chr(10) || ' 2) b' || chr(10) || '3. c' || chr(10) || (CASE WHEN id % 2 = 0 THEN '4. d' ELSE 'x' END), '(?m)^\\s*\\d+[.)]\\s')) >= 4""")
def enumeration_memories(t):
    text = F.concat("raw_content", F.lit("\n1. a\n 2) b\n3. c\n"), F.when(F.col("id") % 2 == 0, "4. d").otherwise("x"))
    turns = t.ep.select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), "agent_id", F.when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), text.alias("text"))
    return cv.enumeration_memories(turns).select(F.col("conv_id").alias("id"), "provenance")


FACTS = """facts AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS source, CASE WHEN turn % 4 = 3 OR conv_id % 5 = 0 THEN '  ' ELSE text END AS content,
  CASE WHEN turn % 3 = 0 THEN 'decision' ELSE 'gossip' END AS type, CASE turn % 3 WHEN 1 THEN 'implicit_inference' ELSE 'nonsense' END AS evidence, CASE WHEN turn % 5 = 0 THEN 0.66 ELSE 0 END::FLOAT AS confidence FROM turns)"""


@query("ingest_facts", "turns", f"""
WITH {FACTS} SELECT conv_id, content, CASE WHEN type = 'decision' THEN type ELSE 'fact' END AS type, CASE source WHEN 'assistant' THEN 'agent' ELSE 'user' END AS provenance,
 round((CASE WHEN confidence = 0 THEN CASE evidence WHEN 'implicit_inference' THEN 0.625 ELSE 0.9 END ELSE confidence END)::FLOAT::DOUBLE, 6) AS confidence FROM facts WHERE trim(content) <> ''""")
def ingest_facts(t):
    return cv.ingest_facts(_facts(t), cv.conversation_user_memories(t.turns))[0].select("conv_id", "content", "type", "provenance", r6("confidence", "confidence"))


def _facts(t):
    return t.turns.select(
        "conv_id", F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("source"),
        F.when((F.col("turn") % 4 == 3) | (F.col("conv_id") % 5 == 0), "  ").otherwise(F.col("text")).alias("content"),
        F.when(F.col("turn") % 3 == 0, "decision").otherwise("gossip").alias("type"),
        F.when(F.col("turn") % 3 == 1, "implicit_inference").otherwise("nonsense").alias("evidence"),
        F.when(F.col("turn") % 5 == 0, 0.66).otherwise(0.0).cast("float").alias("confidence"))


@query("ingest_facts_left", "turns", f"WITH {FACTS} SELECT DISTINCT conv_id FROM turns WHERE role = 'user' AND conv_id NOT IN (SELECT conv_id FROM facts WHERE trim(content) <> '')")
def ingest_facts_left(t):
    return cv.ingest_facts(_facts(t), cv.conversation_user_memories(t.turns))[1].select("conv_id")


@query("store_extracted", "turns", """
SELECT conv_id, turn, 'extraction' AS source, round((CASE turn % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.33 END)::FLOAT::DOUBLE, 6) AS confidence FROM turns""")
def store_extracted(t):
    rows = t.turns.select("conv_id", "turn", F.lit(0.33).cast("float").alias("confidence"),
                          F.when(F.col("turn") % 3 == 0, "explicit_statement").when(F.col("turn") % 3 == 1, "odd").otherwise("").alias("evidence"))
    return cv.store_extracted(rows).select("conv_id", "turn", "source", r6("confidence", "confidence"))


@query("reembed", "mem")
def reembed_query(t):
    return reembed(t.mem, 64).select("id", F.size("emb").alias("width"))


@query("upsert_keep", "contra", "SELECT belief_id, contradicted_by_id, min(sec) AS sec FROM (SELECT belief_id, contradicted_by_id, floor(epoch(detected_at))::BIGINT AS sec FROM contra UNION ALL SELECT belief_id, contradicted_by_id + belief_id % 2, floor(epoch(detected_at))::BIGINT + 99999999 FROM contra) x GROUP BY 1, 2")
def upsert_keep(t):
    base = t.contra.select("belief_id", "contradicted_by_id", F.unix_timestamp("detected_at").alias("sec"))
    more = base.select("belief_id", (F.col("contradicted_by_id") + F.col("belief_id") % 2).alias("contradicted_by_id"), (F.col("sec") + 99999999).alias("sec"))
    return tb.upsert(base, more, ["belief_id", "contradicted_by_id"], "keep")


@query("upsert_overwrite", "policies", "SELECT agent_id, memory_type, max_memories + agent_id AS max_memories FROM policies")
def upsert_overwrite(t):
    base = t.policies.select("agent_id", "memory_type", "max_memories")
    return tb.upsert(base, base.withColumn("max_memories", (F.col("max_memories") + F.col("agent_id")).cast("int")), ["agent_id", "memory_type"], "overwrite")


@query("upsert_greatest", "edges", "SELECT source_id, target_id, relation_type, round(greatest(strength::DOUBLE, 0.5), 6) AS strength FROM edges")
def upsert_greatest(t):
    base = t.edges.select("source_id", "target_id", "relation_type", F.col("strength").cast("double").alias("strength"))
    out = tb.upsert(base, base.withColumn("strength", F.lit(0.5)), ["source_id", "target_id", "relation_type"], "greatest", "strength")
    return out.select("source_id", "target_id", "relation_type", r6("strength", "strength"))


@query("upsert_union", "ent", "SELECT entity_id, array_to_string(list_sort([alias, name]), '|') AS aliases FROM ent")
def upsert_union(t):
    base = t.ent.select("entity_id", F.array("alias").alias("aliases"))
    out = tb.upsert(base, t.ent.select("entity_id", F.array("alias", "name").alias("aliases")), ["entity_id"], "union", "aliases")
    return out.select("entity_id", F.array_join("aliases", "|").alias("aliases"))


@query("upsert_add", "usage_events", "SELECT tenant_id, kind, count(*) + 7 AS n FROM usage_events GROUP BY 1, 2")
def upsert_add(t):
    base = t.usage_events.groupBy("tenant_id", "kind").agg(F.lit(7).cast("long").alias("n"))
    more = t.usage_events.select("tenant_id", "kind", F.lit(1).cast("long").alias("n"))
    return tb.upsert(base, more, ["tenant_id", "kind"], "add", "n")
