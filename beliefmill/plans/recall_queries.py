"""Recall queries and their checks."""

from pyspark.sql import functions as F

from beliefmill.functions import scalar as sc
from beliefmill.functions.stems import stems_sql
from beliefmill.operators import recall as rc
from beliefmill.operators.similarity import top_by
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW

SIM = "list_cosine_similarity(v.emb, q.vec::DOUBLE[])"
OPEN = "NOT m.is_archived AND m.binding <> 'quarantine' AND m.anchor_id IS NULL AND m.session_id IS NULL"
SCOPE = "m.tenant_id = q.tenant_id AND m.agent_id = q.agent_id"
FROM = "FROM mem m JOIN vecs v ON v.vec_id = m.id JOIN queries q ON " + SCOPE


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double"), 6)
    return out.alias(name) if name else out


@query("recall_similarity", "mem vecs queries", f"""
WITH s AS (SELECT q.query_id, m.id, m.confidence, {SIM} AS score,
  row_number() OVER (PARTITION BY q.query_id ORDER BY {SIM} DESC, m.id) AS rank {FROM} WHERE {OPEN})
SELECT query_id, id, rank, round(score, 6) AS score,
  CASE WHEN confidence::DOUBLE > 0.85 THEN 'hot' WHEN confidence::DOUBLE > 0.7 THEN 'warm' WHEN confidence::DOUBLE > 0.4 THEN 'cold' ELSE 'archive' END AS tier,
  CASE WHEN confidence >= 0.7::FLOAT THEN 'healthy' WHEN confidence >= 0.4::FLOAT THEN 'decaying' ELSE 'at_risk' END AS decay_status
FROM s WHERE rank <= 10""")
def recall_similarity(t):
    return rc.recall_similarity(t.memv, t.queries).select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), r6("score", "score"),
        sc.tier(F.col("confidence")).alias("tier"), sc.decay_status(F.col("confidence")).alias("decay_status"))


@query("recall_filtered", "mem vecs queries", f"""
WITH s AS (SELECT q.query_id, m.id, {SIM} AS score,
  row_number() OVER (PARTITION BY q.query_id ORDER BY {SIM} DESC, m.id) AS rank {FROM} WHERE {OPEN}
  AND m.type = 'fact' AND m.confidence >= 0.3::FLOAT AND coalesce(m.event_date, m.created_at) BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00')
SELECT query_id, id, rank, round(score, 6) AS score FROM s WHERE rank <= 10""")
def recall_filtered(t):
    return rc.recall_similarity(t.memv, t.queries, mem_type="fact", min_confidence=0.3,
                                date_from="2024-01-01 00:00:00", date_to="2024-01-25 00:00:00").select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), r6("score", "score"))


@query("recall_recency", "mem vecs queries", f"""
WITH a AS (SELECT m.*, epoch_us(coalesce(event_date, created_at)) AS tt FROM mem m WHERE {OPEN}),
b AS (SELECT a.*, CASE WHEN max(tt) OVER w > min(tt) OVER w THEN (tt - min(tt) OVER w)::DOUBLE / (max(tt) OVER w - min(tt) OVER w) ELSE 0.5 END AS rr FROM a WINDOW w AS (PARTITION BY agent_id)),
s AS (SELECT q.query_id, m.id, {SIM} + 0.2 * rr AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY {SIM} + 0.2 * rr DESC, m.id) AS rank
  FROM b m JOIN vecs v ON v.vec_id = m.id JOIN queries q ON {SCOPE})
SELECT query_id, id, rank, round(score, 6) AS score FROM s WHERE rank <= 10""")
def recall_recency(t):
    return rc.recall_similarity(t.memv, t.queries, recency_boost=0.2).select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), r6("score", "score"))


@query("relative_recency", "mem", f"""
WITH a AS (SELECT m.*, epoch_us(coalesce(event_date, created_at)) AS tt FROM mem m WHERE {OPEN})
SELECT id, round(CASE WHEN max(tt) OVER w > min(tt) OVER w THEN (tt - min(tt) OVER w)::DOUBLE / (max(tt) OVER w - min(tt) OVER w) ELSE 0.5 END, 6) AS rr
FROM a WINDOW w AS (PARTITION BY agent_id)""")
def relative_recency(t):
    return rc.relative_recency(rc.recall_scope(t.mem)).select("id", r6("rr", "rr"))


EVERY = f"""
WITH s AS (SELECT q.query_id, m.id, list_inner_product(v.emb, q.vec::DOUBLE[]) AS score {FROM} WHERE {OPEN}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.25)
SELECT query_id, id, rank, round(score, 6) AS score FROM r"""


@query("recall_exhaustive", "mem vecs queries", f"{EVERY} WHERE rank <= 500")
def recall_exhaustive(t):
    return rc.recall_exhaustive(t.memv, t.queries, max_results=500).select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), r6("score", "score"))


@query("recall_exhaustive_all", "mem vecs queries", EVERY.replace("id, rank, round", "id, round"))
def recall_exhaustive_all(t):
    """All rows above the least similarity."""
    return rc.recall_exhaustive(t.memv, t.queries).select("query_id", "id", r6("score", "score"))


STOP = "['a','an','and','are','as','at','be','by','for','in','is','it','not','of','on','or','that','the','to','with']"
TOK = f"list_filter(regexp_split_to_array(lower(%s), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({STOP}, w))"
WORDS = stems_sql(TOK.replace("%s", "text"))
PLURAL = "regexp_replace(%s, '([a-z]{4,})\\b', '\\1s', 'g')"
LEX = f"""seen AS (SELECT * FROM mem m WHERE NOT is_archived AND anchor_id IS NULL AND session_id IS NULL),
words AS (SELECT id, tenant_id, agent_id, {WORDS} AS w FROM (SELECT *, content AS text FROM seen) y),
corpus AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM words),
occ AS (SELECT id, tenant_id, agent_id, len, token, count(*) AS tf FROM (SELECT id, tenant_id, agent_id, len(w) AS len, unnest(w) AS token FROM words) x GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM occ GROUP BY token),
terms AS (SELECT query_id, tenant_id, agent_id, len(tw) AS n_terms, unnest(tw) AS token FROM (SELECT *, list_distinct({WORDS}) AS tw FROM queries) x),
lex AS (SELECT t.query_id, o.id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf::DOUBLE * 2.2 / (tf::DOUBLE + 1.2 * (1 - 0.75 + 0.75 * o.len / avg_len))) AS score
  FROM terms t JOIN occ o ON o.token = t.token AND o.tenant_id = t.tenant_id AND o.agent_id = t.agent_id JOIN dfs ON dfs.token = t.token CROSS JOIN corpus
  GROUP BY t.query_id, o.id, t.n_terms HAVING count(*) = t.n_terms)"""


@query("lexical_scores", "mem queries", f"WITH {LEX} SELECT query_id, id, round(score, 6) AS score FROM lex")
def lexical_scores(t):
    return rc.lexical_scores(rc.recall_scope(t.mem, quarantined=True), t.queries).select("query_id", "id", r6("score", "score"))


@query("lexical_plurals", "mem queries", f"WITH {LEX.replace('FROM queries)', 'FROM (SELECT * REPLACE (' + PLURAL.replace('%s', 'text') + ' AS text) FROM queries) p)')} SELECT query_id, id, round(score, 6) AS score FROM lex")
def lexical_plurals(t):
    """Queries in other forms of the words find the same rows."""
    other = t.queries.withColumn("text", F.regexp_replace("text", "([a-z]{4,})\\b", "$1s"))
    return rc.lexical_scores(rc.recall_scope(t.mem, quarantined=True), other).select("query_id", "id", r6("score", "score"))


@query("recall_rrf", "mem vecs queries", f"""
WITH {LEX},
lr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS lr FROM lex),
vr AS (SELECT * FROM (SELECT q.query_id, m.id, row_number() OVER (PARTITION BY q.query_id ORDER BY {SIM} DESC, m.id) AS vr
  FROM seen m JOIN vecs v ON v.vec_id = m.id JOIN queries q ON {SCOPE}) x WHERE vr <= 100),
f AS (SELECT coalesce(lr.query_id, vr.query_id) AS query_id, coalesce(lr.id, vr.id) AS id, 1.0::DOUBLE / (60 + coalesce(lr, 1000)) + 1.0::DOUBLE / (60 + coalesce(vr, 1000)) AS score
  FROM lr FULL OUTER JOIN vr ON vr.query_id = lr.query_id AND vr.id = lr.id),
g AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.id) AS rank FROM f JOIN mem m ON m.id = f.id WHERE NOT m.is_archived AND m.binding <> 'quarantine')
SELECT query_id, id, rank, round(score, 9) AS score FROM g WHERE rank <= 10""")
def recall_rrf(t):
    return rc.recall_rrf(t.memv, t.queries).select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query("recall_composed", "mem vecs queries", f"""
WITH s AS (SELECT q.query_id, m.id, m.binding AS scope, {SIM} AS sim FROM mem m JOIN vecs v ON v.vec_id = m.id JOIN queries q ON m.tenant_id = q.tenant_id
  WHERE NOT m.is_archived AND ((m.binding = 'private' AND m.agent_id = q.agent_id) OR m.binding = 'canon'
   OR (m.binding = 'anchored' AND m.agent_id = q.agent_id AND m.anchor_id = q.anchor_id) OR (m.binding = 'session' AND m.agent_id = q.agent_id AND m.session_id = q.session_id))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY sim DESC, id) AS scope_rank FROM s)
SELECT query_id, id, scope, scope_rank, round(sim * CASE scope WHEN 'anchored' THEN 1.05 WHEN 'session' THEN 1.1 ELSE 1.0 END, 6) AS score
FROM r WHERE scope_rank <= CASE scope WHEN 'canon' THEN 2 ELSE 10 END""")
def recall_composed(t):
    return rc.recall_composed(t.memv, t.queries).select(
        "query_id", "id", "scope", F.col("scope_rank").cast("long").alias("scope_rank"), r6("score", "score"))


@query("rerank_weighted", "mem vecs queries policies", f"""
WITH s AS (SELECT q.query_id, m.id, m.agent_id, m.type, m.confidence::DOUBLE AS c, m.updated_at, {SIM} AS sim,
  row_number() OVER (PARTITION BY q.query_id ORDER BY {SIM} DESC, m.id) AS rk {FROM} WHERE {OPEN} AND m.confidence >= 0.7::FLOAT),
g AS (SELECT s.*, exp(-0.0001 * greatest(0.0, (epoch_us(:now) - epoch_us(updated_at)) / 3600000000.0::DOUBLE)) AS freshness, coalesce(p.priority_weight::DOUBLE, 1.0) AS weight
  FROM s LEFT JOIN policies p ON p.agent_id = s.agent_id AND p.memory_type = s.type
  WHERE rk <= 30 AND ((c > 0.85 AND sim >= 0) OR (c > 0.7 AND sim >= 0.5))),
z AS (SELECT *, sim * c * freshness * weight AS score FROM g),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z)
SELECT query_id, id, rank, round(sim, 6) AS similarity, round(c, 6) AS confidence, round(freshness, 6) AS freshness, round(weight, 6) AS weight, round(score, 6) AS score FROM y WHERE rank <= 10""")
def rerank_weighted(t):
    return rc.rerank_weighted(t.memv, t.queries, t.policies, NOW).select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), r6("similarity", "similarity"), r6("confidence", "confidence"),
        r6("freshness", "freshness"), r6("weight", "weight"), r6("score", "score"))


@query("tier_gate", "mem vecs queries", f"""
WITH s AS (SELECT q.query_id, m.id, m.confidence::DOUBLE AS c, {SIM} AS sim, row_number() OVER (PARTITION BY q.query_id ORDER BY {SIM} DESC, m.id) AS rk {FROM} WHERE {OPEN})
SELECT query_id, id, round(sim, 6) AS score FROM s WHERE rk <= 50 AND ((c > 0.85 AND sim >= 0) OR (c > 0.7 AND sim >= 0.5) OR (c > 0.4 AND c <= 0.7 AND sim >= 0.75))""")
def tier_gate(t):
    hits = rc.recall_similarity(t.memv, t.queries, k=50)
    return rc.filter_by_tier(hits, ["hot", "warm", "cold"]).select("query_id", "id", r6("score", "score"))


def similar_sql(table, key, theta, k, extra=""):
    return f"""
WITH s AS (SELECT q.query_id, m.id, {SIM} AS sim FROM {table} m JOIN vecs v ON v.vec_id = m.{key} JOIN queries q ON {SCOPE} {extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= {theta})
SELECT query_id, id, rank, round(sim, 6) AS score FROM r WHERE rank <= {k}"""


def _ranked(df):
    return df.select("query_id", "id", F.col("rank").cast("long").alias("rank"), r6("score", "score"))


@query("similar_episodes", "ep vecs queries", similar_sql("ep", "vec_id", 0.5, 20))
def similar_episodes(t):
    return _ranked(rc.similar_rows(t.with_vec(t.ep), t.queries, 0.5, 20))


@query("similar_procedures", "proc vecs queries", similar_sql("proc", "vec_id", 0.6, 20))
def similar_procedures(t):
    return _ranked(rc.similar_rows(t.with_vec(t.proc), t.queries, 0.6, 20))


@query("similar_schemas", "sch vecs queries", similar_sql("sch", "vec_id", 0.5, 10))
def similar_schemas(t):
    return _ranked(rc.similar_rows(t.with_vec(t.sch), t.queries, 0.5, 10))


@query("similar_entities", "ent vecs", """
WITH e AS (SELECT n.*, v.emb FROM ent n JOIN vecs v ON v.vec_id = n.entity_id)
SELECT a.entity_id AS query_id, b.entity_id AS id, round(list_cosine_similarity(a.emb, b.emb), 6) AS score
FROM e a JOIN e b ON a.agent_id = b.agent_id AND a.entity_type = b.entity_type WHERE list_cosine_similarity(a.emb, b.emb) >= -0.2""")
def similar_entities(t):
    e = t.with_vec(t.ent.withColumn("vec_id", F.col("entity_id"))).withColumn("id", F.col("entity_id"))
    q = e.select(F.col("entity_id").alias("query_id"), F.col("emb").alias("vec"), "agent_id", "entity_type")
    return rc.similar_rows(e, q, -0.2, None, scope=("agent_id", "entity_type")).select("query_id", "id", r6("score", "score"))


@query("find_similar", "mem vecs", """
WITH e AS (SELECT m.*, v.emb FROM mem m JOIN vecs v ON v.vec_id = m.id)
SELECT a.id AS lid, b.id AS rid, round(list_cosine_similarity(a.emb, b.emb), 6) AS sim FROM e a JOIN e b ON a.agent_id = b.agent_id AND a.tenant_id = b.tenant_id
WHERE NOT b.is_archived AND b.binding <> 'quarantine' AND list_cosine_similarity(a.emb, b.emb) >= 0.7""")
def find_similar(t):
    return rc.find_similar(t.memv, t.memv, 0.7).select("lid", "rid", r6("sim", "sim"))


@query("applicable_procedures", "proc vecs queries", f"""
WITH s AS (SELECT q.query_id, m.id, m.confidence, m.last_used_at, CASE WHEN use_count > 0 THEN success_count::DOUBLE / use_count ELSE 0 END AS sr, {SIM} AS sim
  FROM proc m JOIN vecs v ON v.vec_id = m.vec_id JOIN queries q ON {SCOPE}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rk FROM s WHERE sim >= 0.75),
f AS (SELECT *, sr * confidence::DOUBLE * sim * CASE WHEN last_used_at IS NULL THEN 0.5 ELSE exp(-((epoch_us(:now) - epoch_us(last_used_at)) / 86400000000.0::DOUBLE) / 30.0) END AS fit
  FROM r WHERE rk <= 10 AND sr >= 0.5 AND confidence >= 0.4::FLOAT),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fit DESC, id) AS rank FROM f)
SELECT query_id, id, rank, round(fit, 6) AS fit FROM g WHERE rank <= 5""")
def applicable_procedures(t):
    return rc.applicable_procedures(t.with_vec(t.proc), t.queries, NOW).select(
        "query_id", "id", F.col("rank").cast("long").alias("rank"), r6("fit", "fit"))


@query("parse_tiers", "", """
SELECT value AS word, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(replace(lower(event_type), 'view', 'hot, cold,bogus'), ','), lambda x: trim(x)), lambda x: x IN ('hot', 'warm', 'cold', 'archive'))) AS value FROM events) x GROUP BY value""")
def parse_tiers(t):
    raw = F.replace(F.lower("event_type"), F.lit("view"), F.lit("hot, cold,bogus"))
    return t.events.select(F.explode(rc.parse_tiers(raw)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
