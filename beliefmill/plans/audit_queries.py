"""Change-log queries."""

from pyspark.sql import functions as F

from beliefmill.operators import audit as au
from beliefmill.plans.belief_queries import TIER, pos
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW


def _enc(x):
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE length({x}) || ':' || {x} END"


MICRO = "round({0}::DOUBLE * 1000000)::BIGINT::VARCHAR"
FIELDS = ["memory_id::VARCHAR", "agent_id::VARCHAR", "tenant_id::VARCHAR", "mutation_type", "source_type", "NULL::VARCHAR", MICRO.format("old_confidence"), MICRO.format("new_confidence"),
          "NULL::VARCHAR", "NULL::VARCHAR", "reason", "NULL::VARCHAR", "content_hash", "content_snapshot", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR", "epoch_us(created_at)::VARCHAR"]
DIGEST = "sha256(" + " || ".join("(" + _enc(f) + ")" for f in FIELDS) + ")"
NUMBERED = f"nb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS seq, {DIGEST} AS digest FROM mlog)"
CHAIN = f"""{NUMBERED},
ch AS (SELECT tenant_id, seq, '' AS prev_hash, sha256('2|' || seq || '||' || digest) AS row_hash FROM nb WHERE seq = 1
  UNION ALL SELECT n.tenant_id, n.seq, c.row_hash, sha256('2|' || n.seq || '|' || c.row_hash || '|' || n.digest) FROM ch c JOIN nb n ON n.tenant_id = c.tenant_id AND n.seq = c.seq + 1)"""


@query("body_digests", "mlog", f"SELECT id, {DIGEST} AS digest FROM mlog")
def body_digests(t):
    return t.mlog.select("id", au.body_digest(t.mlog).alias("digest"))


@query("first_version_hash", "mlog", f"""
SELECT id, sha256(concat_ws('|', seq::VARCHAR, 'p', memory_id::VARCHAR, agent_id::VARCHAR, tenant_id::VARCHAR, mutation_type, source_type, '', coalesce({MICRO.format('old_confidence')}, ''), coalesce({MICRO.format('new_confidence')}, ''),
  reason, coalesce(content_hash, ''), '', epoch_us(created_at)::VARCHAR)) AS h FROM (SELECT *, id * 2 AS seq FROM mlog) x""")
def first_version_hash(t):
    m = t.mlog.withColumn("seq", F.col("id") * 2)
    return m.select("id", F.sha2(au.first_version_text(m, F.lit("p")), 256).alias("h"))


@query("seal_chain", "mlog", f"WITH RECURSIVE {CHAIN} SELECT n.id, n.seq, c.prev_hash, c.row_hash FROM ch c JOIN nb n ON n.tenant_id = c.tenant_id AND n.seq = c.seq")
def seal_chain(t):
    return au.seal_chain(t.mlog).select("id", "seq", "prev_hash", "row_hash")


@query("chain_heads", "mlog", f"WITH RECURSIVE {CHAIN} SELECT tenant_id::VARCHAR AS tenant_id, max(seq) AS last_seq, arg_max(row_hash, seq) AS last_hash FROM ch GROUP BY 1")
def chain_heads(t):
    return au.chain_heads(au.seal_chain(t.mlog))


@query("verify_chain", "mlog", "SELECT tenant_id::VARCHAR AS tenant_id, true AS valid, count(*) AS checked, NULL::BIGINT AS break_seq, NULL::VARCHAR AS reason FROM mlog GROUP BY 1")
def verify_chain(t):
    s = au.seal_chain(t.mlog)
    return au.verify_chain(s, au.chain_heads(s))


@query("verify_tampered", "mlog", f"""
SELECT tenant_id::VARCHAR AS tenant_id, false AS valid, CASE tenant_id WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE count(*) - 1 END::BIGINT AS checked, CASE tenant_id WHEN 0 THEN 5 WHEN 1 THEN 8 END::BIGINT AS break_seq,
 CASE tenant_id WHEN 0 THEN '{au.EDIT}' WHEN 1 THEN '{au.LINK}' ELSE 'head mismatch: head_seq=' || count(*) || ' checked=' || (count(*) - 1) || ' (tail truncated or head edited)' END AS reason FROM mlog GROUP BY mlog.tenant_id""")
def verify_tampered(t):
    s = au.seal_chain(t.mlog)
    heads = au.chain_heads(s)
    cut = heads.select(F.col("tenant_id").cast("long").alias("ht"), "last_seq")
    bad = s.join(cut, s.tenant_id == F.col("ht")).where(
        ~((F.col("tenant_id") == 1) & (F.col("seq") == 7)) & ~((F.col("tenant_id") == 2) & (F.col("seq") == F.col("last_seq")))
    ).withColumn("reason", F.when((F.col("tenant_id") == 0) & (F.col("seq") == 5), "edited").otherwise(F.col("reason"))).drop("ht", "last_seq")
    return au.verify_chain(bad, heads)


def _js(x):
    return f"coalesce(to_json({x})::VARCHAR, 'null')"


# every sealed field as an element of a JSON array; confidences are short decimals here
JS = " || ', ' || ".join([_js("memory_id::VARCHAR"), _js("agent_id::VARCHAR"), _js("tenant_id::VARCHAR"), _js("mutation_type"), _js("source_type"), "'null'",
                          "coalesce(regexp_replace(old_confidence::VARCHAR, '\\.0$', ''), 'null')", "coalesce(regexp_replace(new_confidence::VARCHAR, '\\.0$', ''), 'null')", "'null'", "'null'", _js("reason"), "'null'",
                          _js("content_hash"), _js("content_snapshot"), "'null'", "'null'", "'null'", "'null'",
                          "'\"' || (epoch_us(created_at)::DECIMAL(26, 0) / 1000000)::DECIMAL(26, 6)::VARCHAR || '\"'"])
CANON = f"""cb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS seq, {JS} AS body FROM mlog),
cc AS (SELECT tenant_id, seq, '' AS prev_hash, sha256('[2, ' || seq || ', "", ' || body || ']') AS row_hash FROM cb WHERE seq = 1
  UNION ALL SELECT n.tenant_id, n.seq, c.row_hash, sha256('[2, ' || n.seq || ', "' || c.row_hash || '", ' || n.body || ']') FROM cc c JOIN cb n ON n.tenant_id = c.tenant_id AND n.seq = c.seq + 1)"""


@query("seal_canonical", "mlog", f"WITH RECURSIVE {CANON} SELECT n.id, n.seq, c.prev_hash, c.row_hash FROM cc c JOIN cb n ON n.tenant_id = c.tenant_id AND n.seq = c.seq")
def seal_canonical(t):
    return au.seal_canonical(t.mlog).select("id", "seq", "prev_hash", "row_hash")


@query("verify_canonical", "mlog", f"""
SELECT tenant_id::VARCHAR AS tenant_id, tenant_id > 1 AS valid, CASE tenant_id WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE count(*) END::BIGINT AS checked, CASE tenant_id WHEN 0 THEN 5 WHEN 1 THEN 7 END::BIGINT AS break_seq,
 CASE tenant_id WHEN 0 THEN '{au.EDIT}' WHEN 1 THEN '{au.LINK}' END AS reason FROM mlog GROUP BY mlog.tenant_id""")
def verify_canonical(t):
    """Tenant 0: an edited row; tenant 1: a seq that stands twice; the others are whole."""
    s = au.seal_canonical(t.mlog)
    bad = s.withColumn("reason", F.when((F.col("tenant_id") == 0) & (F.col("seq") == 5), "edited").otherwise(F.col("reason")))
    return au.verify_chain(bad.unionByName(bad.where("tenant_id = 1 AND seq = 7")), au.chain_heads(s), canonical=True)


@query("chain_tail", "mlog", f"WITH {NUMBERED} SELECT tenant_id, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq DESC) AS rk FROM nb) x WHERE rk <= 100")
def chain_tail(t):
    return au.chain_tail(au.seal_chain(t.mlog), 100).select("tenant_id", "id", "seq")


@query("export_audit", "mlog", f"""
WITH RECURSIVE {CHAIN}
SELECT tenant_id::VARCHAR AS tenant_id, seq AS pos, '{{"seq":' || seq || ',"memory_id":' || memory_id || ',"mutation_type":"' || mutation_type || '","reason":"' || reason || '"}}' AS line FROM nb
UNION ALL SELECT tenant_id::VARCHAR, max(seq) + 1, '{{"_trailer":true,"tenant_id":"' || tenant_id || '","count":' || count(*) || ',"head_seq":' || max(seq) || ',"head_hash":"' || arg_max(row_hash, seq) || '","exported_at":"2024-02-01T00:00:00Z"}}' FROM ch GROUP BY tenant_id""")
def export_audit(t):
    return au.export_lines(au.seal_chain(t.mlog), ["seq", "memory_id", "mutation_type", "reason"], NOW)


@query("beliefs_as_of", "mem mlog", f"""
WITH r AS (SELECT * FROM mem WHERE created_at <= TIMESTAMP '2024-01-18 12:00:00' AND NOT is_archived),
s AS (SELECT memory_id, arg_max(new_confidence, (created_at, id)) FILTER (created_at <= TIMESTAMP '2024-01-18 12:00:00' AND new_confidence IS NOT NULL) AS p, arg_min(old_confidence, (created_at, id)) FILTER (old_confidence IS NOT NULL) AS f FROM mlog GROUP BY 1),
h AS (SELECT r.agent_id, r.id, coalesce(p, f, r.confidence) AS confidence, count(*) OVER (PARTITION BY r.agent_id) AS total FROM r LEFT JOIN s ON s.memory_id = r.id),
k AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY confidence DESC, id) AS rank FROM h)
SELECT agent_id, id, rank, total, round(confidence::DOUBLE, 6) AS conf_at, {TIER} AS tier FROM k WHERE rank <= 100""")
def beliefs_as_of(t):
    return au.beliefs_as_of(t.mem, t.mlog, "2024-01-18 12:00:00").select("agent_id", "id", pos("rank"), "total", r6("conf_at", "conf_at"), "tier")


@query("confidence_history", "mlog", """
SELECT memory_id, id, row_number() OVER w AS step, round(lag(new_confidence) OVER w::DOUBLE, 6) AS previous, round(old_confidence::DOUBLE - lag(new_confidence) OVER w::DOUBLE, 6) AS jump
FROM mlog WINDOW w AS (PARTITION BY memory_id ORDER BY created_at, id)""")
def confidence_history(t):
    return au.confidence_history(t.mlog).select("memory_id", "id", "step", r6("previous", "previous"), r6("jump", "jump"))
