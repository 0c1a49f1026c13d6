"""Belief tables derived from the raw parquet tables.

Every view is one SQL text that both Spark and the checking engine run; names
in braces are other views or raw tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["mem"] = """
SELECT vec_id AS id, label,
  CAST(floor(vec_id / 4) AS BIGINT) % 6 AS agent_id,
  (CAST(floor(vec_id / 4) AS BIGINT) % 6) % 3 AS tenant_id,
  CASE label % 4 WHEN 0 THEN 'preference' WHEN 1 THEN 'fact' WHEN 2 THEN 'decision' ELSE 'constraint' END AS type,
  CASE vec_id % 8 WHEN 0 THEN 'User prefers topic ' WHEN 1 THEN 'Team decided to use topic ' WHEN 2 THEN 'Users must not share topic '
    WHEN 3 THEN 'Known item in topic ' WHEN 4 THEN 'User switched to topic ' WHEN 5 THEN 'User does not use topic '
    WHEN 6 THEN 'Client no longer needs topic ' ELSE '[DATE: 2024/01/15] Visited topic ' END || CAST(label AS STRING) AS content,
  CASE vec_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'agent' WHEN 2 THEN 'tool' WHEN 3 THEN 'derived' ELSE 'inferred' END AS provenance,
  CASE vec_id % 5 WHEN 0 THEN 'user_statement' WHEN 1 THEN 'extraction' WHEN 2 THEN 'agent_inference' WHEN 3 THEN 'tool_output' ELSE 'other' END AS source,
  CAST(((vec_id * 37) % 100) / 100.0 AS FLOAT) AS confidence,
  CAST(vec_id % 7 AS INT) AS reinforcement_count,
  CAST(vec_id % 4 AS INT) AS access_count,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * (vec_id % 30) + INTERVAL '1' MINUTE * vec_id AS created_at,
  TIMESTAMP '2024-01-01 01:00:00' + INTERVAL '1' DAY * (vec_id % 30) + INTERVAL '1' MINUTE * vec_id AS updated_at,
  CASE WHEN vec_id % 5 <> 0 THEN TIMESTAMP '2023-12-20 00:00:00' + INTERVAL '1' DAY * (vec_id % 41) END AS event_date,
  CASE WHEN vec_id % 13 <> 0 THEN TIMESTAMP '2024-01-01 06:00:00' + INTERVAL '1' DAY * (vec_id % 30) + INTERVAL '1' HOUR * (vec_id % 20) END AS last_accessed_at,
  CASE WHEN vec_id % 9 <> 0 THEN TIMESTAMP '2024-01-01 00:30:00' + INTERVAL '1' DAY * (vec_id % 30) END AS last_verified_at,
  CASE WHEN vec_id % 11 = 0 THEN TIMESTAMP '2024-01-25 00:00:00' + INTERVAL '1' DAY * (vec_id % 14) END AS expires_at,
  CASE WHEN vec_id % 10 <= 5 THEN 'private' WHEN vec_id % 10 <= 7 THEN 'anchored' WHEN vec_id % 10 = 8 THEN 'session'
    WHEN vec_id % 20 = 9 THEN 'quarantine' ELSE 'canon' END AS binding,
  CASE WHEN vec_id % 10 IN (6, 7) OR vec_id % 20 = 8 THEN vec_id % 4 END AS anchor_id,
  CASE WHEN vec_id % 10 = 8 THEN vec_id % 7 END AS session_id,
  vec_id % 17 = 0 AS is_archived, vec_id % 19 = 0 AS needs_review
FROM {embeddings}"""

# Vector rule: embedding pulled towards the first vector of its label.
VIEWS["base"] = "SELECT label, min_by(embedding, vec_id) AS base FROM {embeddings} GROUP BY label"

SPARK_VECS = """
SELECT vec_id, label, zip_with(v, array_repeat(sqrt(aggregate(v, CAST(0 AS DOUBLE), (a, y) -> a + y * y)), size(v)), (x, n) -> x / n) AS emb FROM (
  SELECT e.vec_id, e.label, zip_with(b.base, e.embedding, (p, q) -> CAST(CASE e.vec_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS DOUBLE) * CAST(p AS DOUBLE) + CAST(q AS DOUBLE)) AS v
  FROM {embeddings} e JOIN {base} b ON b.label = e.label)"""

CHECK_VECS = """
SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS emb FROM (
  SELECT e.vec_id, e.label, list_transform(list_zip(b.base, e.embedding), lambda p: CASE e.vec_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END::DOUBLE * p[1]::DOUBLE + p[2]::DOUBLE) AS v
  FROM embeddings e JOIN base b ON b.label = e.label)"""

VIEWS["queries"] = """
SELECT CAST(b.label AS BIGINT) AS query_id, CAST(b.label % 6 AS BIGINT) AS agent_id, CAST((b.label % 6) % 3 AS BIGINT) AS tenant_id,
  CAST(b.label % 4 AS BIGINT) AS anchor_id, CAST(b.label % 7 AS BIGINT) AS session_id, b.base AS vec,
  'topic ' || CAST(b.label AS STRING) AS text
FROM {base} b"""

VIEWS["signals"] = """
SELECT e.event_id AS id, e.event_id % (SELECT count(*) FROM {embeddings}) AS memory_id, CAST(e.ts AS TIMESTAMP) AS created_at,
  CASE e.event_type WHEN 'view' THEN 'used' WHEN 'click' THEN 'ignored' WHEN 'purchase' THEN 'helpful' WHEN 'signup' THEN 'unhelpful'
    ELSE CASE WHEN e.event_id % 2 = 0 THEN 'contradicted' ELSE 'outdated' END END AS signal_type
FROM {events} e"""

# Change log in arrival order (created_at, id) per tenant; the sealing operator numbers it.
VIEWS["mlog"] = """
SELECT s.id, s.memory_id, m.agent_id, m.tenant_id, s.created_at,
  CASE s.id % 5 WHEN 0 THEN 'outcome' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'decay' ELSE 'feedback' END AS mutation_type,
  'system' AS source_type,
  CASE s.id % 5 WHEN 0 THEN CASE WHEN s.signal_type IN ('helpful', 'used') THEN 'outcome: helpful' ELSE 'outcome: unhelpful' END
    WHEN 1 THEN 'contradiction: hard' WHEN 2 THEN 'decay: pass' ELSE 'feedback: ' || s.signal_type END AS reason,
  CASE WHEN s.id % 29 <> 0 THEN CAST(((s.id * 53) % 99 + 1) / 100.0 AS FLOAT) END AS old_confidence,
  CASE WHEN s.id % 31 <> 0 THEN CAST(((s.id * 53) % 99 + 1) / 100.0 * CASE WHEN s.signal_type IN ('helpful', 'used') THEN 1.0 ELSE 0.9 END AS FLOAT) END AS new_confidence,
  CASE WHEN s.id % 7 = 0 THEN sha256_hex(m.content) END AS content_hash,
  CASE WHEN s.id % 7 = 0 THEN m.content END AS content_snapshot
FROM {signals} s JOIN {mem} m ON m.id = s.memory_id"""

VIEWS["edges"] = """
SELECT source_id, target_id, relation_type, max(strength) AS strength, min(created_at) AS created_at, CAST(count(*) AS BIGINT) AS traversal_count
FROM (SELECT l_orderkey % (SELECT count(*) FROM {embeddings}) AS source_id, l_partkey % (SELECT count(*) FROM {embeddings}) AS target_id,
  CASE l_orderkey % 8 WHEN 0 THEN 'entity_link' WHEN 1 THEN 'causal' WHEN 2 THEN 'temporal' WHEN 3 THEN 'thematic' WHEN 4 THEN 'contradicts'
    WHEN 5 THEN 'supports' WHEN 6 THEN 'derived_from' ELSE 'supersedes' END AS relation_type,
  CAST(l_quantity / 50.0 AS FLOAT) AS strength, TIMESTAMP '2023-10-01 00:00:00' + INTERVAL '1' DAY * (l_orderkey % 120) AS created_at FROM {lineitem}) x
WHERE source_id <> target_id GROUP BY source_id, target_id, relation_type"""

VIEWS["ep"] = """
SELECT d.doc_id AS id, d.doc_id % 6 AS agent_id, (d.doc_id % 6) % 3 AS tenant_id, d.text AS raw_content, d.lang, d.source,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (d.doc_id * 41 % 44640) AS occurred_at,
  TIMESTAMP '2024-01-01 03:00:00' + INTERVAL '1' MINUTE * (d.doc_id * 41 % 43200) AS last_accessed_at,
  CASE WHEN l.toxic = 1 THEN 'failure' WHEN l.quality = 1 THEN 'success' ELSE 'neutral' END AS outcome,
  CAST((d.doc_id * 29 % 100) / 100.0 AS FLOAT) AS importance_score,
  CASE d.doc_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' WHEN 2 THEN 'abstracted' ELSE 'archived' END AS consolidation_status,
  CAST(1.0 - (d.doc_id % 10) / 10.0 AS FLOAT) AS memory_strength, CAST(0.1 AS FLOAT) AS decay_rate,
  d.doc_id % 20 AS conversation_id, d.doc_id % 9 AS message_sequence,
  d.doc_id % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""

VIEWS["proc"] = """
SELECT p_partkey AS id, p_partkey % 6 AS agent_id, (p_partkey % 6) % 3 AS tenant_id, p_name AS trigger_pattern, p_type AS action_template,
  CAST(p_size AS INT) AS use_count, CAST(floor(p_size * (p_partkey % 11) / 10.0) AS INT) AS success_count,
  CAST(((p_partkey * 17) % 100) / 100.0 AS FLOAT) AS confidence,
  CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (p_partkey % 700) END AS last_used_at,
  p_partkey % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {part}"""

VIEWS["mentions"] = """
SELECT CAST(label AS BIGINT) AS entity_id, vec_id AS memory_id, CASE vec_id % 3 WHEN 0 THEN 'subject' WHEN 1 THEN 'object' ELSE 'context' END AS mention_type FROM {embeddings}
UNION ALL SELECT 100 + vec_id % 7 AS entity_id, vec_id AS memory_id, 'context' AS mention_type FROM {embeddings}"""

VIEWS["ent"] = """
SELECT DISTINCT entity_id, entity_id % 6 AS agent_id, (entity_id % 6) % 3 AS tenant_id,
  CASE WHEN entity_id < 100 THEN 'Topic ' ELSE 'Hub ' END || CAST(entity_id AS STRING) AS name,
  CASE WHEN entity_id < 100 THEN 'concept' ELSE 'person' END AS entity_type,
  entity_id >= 100 AS is_anchor, 'ext-' || CAST(entity_id AS STRING) AS external_id,
  'alias ' || CAST(entity_id AS STRING) AS alias
FROM {mentions}"""

VIEWS["contra"] = """
SELECT belief_id, contradicted_by_id, min(ts) AS detected_at FROM (
  SELECT event_id % (SELECT count(*) FROM {embeddings}) AS belief_id, user_id % (SELECT count(*) FROM {embeddings}) AS contradicted_by_id, CAST(ts AS TIMESTAMP) AS ts
  FROM {events} WHERE event_type = 'error') x
WHERE belief_id <> contradicted_by_id GROUP BY belief_id, contradicted_by_id"""

VIEWS["policies"] = """
SELECT DISTINCT agent_id, type AS memory_type, CAST(5 + agent_id AS INT) AS max_memories, CAST(10 + agent_id AS INT) AS retention_days, CAST(1.0 AS FLOAT) AS priority_weight
FROM {mem} WHERE type <> 'fact'"""

VIEWS["turns"] = "SELECT conv_id, turn, role, text, conv_id % 6 AS agent_id FROM {conversations}"

VIEWS["sessions"] = """
SELECT conv_id AS id, conv_id % 7 AS session_id, 'chat-' || CAST(conv_id % 50 AS STRING) AS external_id,
  CASE WHEN conv_id % 3 = 0 THEN 'active' ELSE 'ended' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * conv_id AS created_at,
  TIMESTAMP '2024-01-20 00:00:00' + INTERVAL '1' HOUR * conv_id AS expires_at
FROM (SELECT DISTINCT conv_id FROM {conversations}) c"""

VIEWS["hits"] = """
SELECT event_id AS id, event_id % (SELECT count(*) FROM {embeddings}) AS memory_id, CAST(ts AS TIMESTAMP) AS ts FROM {events} WHERE event_type = 'view'"""

VIEWS["usage_events"] = """
SELECT event_id AS id, user_id % 3 AS tenant_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'click' THEN 'written' ELSE 'recall' END AS kind
FROM {events} WHERE event_type IN ('click', 'view')"""

VIEWS["ep_usage"] = """
SELECT id AS episode_id, id % (SELECT count(*) FROM {embeddings}) AS memory_id, 'retrieved' AS usage_type, CAST(0.5 AS FLOAT) AS relevance FROM {ep}
UNION ALL SELECT id AS episode_id, (id + 7) % (SELECT count(*) FROM {embeddings}) AS memory_id, 'influenced' AS usage_type, CAST(0.8 AS FLOAT) AS relevance FROM {ep}"""

VIEWS["incoming"] = """
SELECT m.id + 1000000 AS id, m.agent_id, m.tenant_id, m.type, m.content, m.provenance, m.binding, m.anchor_id, m.session_id, m.created_at,
  (m.id + 4) % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {mem} m"""

VIEWS["sch"] = """
SELECT s_suppkey AS id, s_suppkey % 6 AS agent_id, (s_suppkey % 6) % 3 AS tenant_id, s_name AS name, 'About ' || s_name AS description,
  CASE s_suppkey % 3 WHEN 0 THEN 'user_archetype' WHEN 1 THEN 'situation_template' ELSE 'causal_model' END AS schema_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' WHEN 2 THEN 'evening' ELSE 'night' END AS time_preference,
  CASE s_suppkey % 2 WHEN 0 THEN 'Morning to noon' ELSE 'late night' END AS work_hours,
  CASE s_suppkey % 3 WHEN 0 THEN 'coding' WHEN 1 THEN 'Support' ELSE 'billing' END AS ctx1,
  CASE s_suppkey % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'travel' ELSE 'Planning' END AS ctx2,
  CAST(((s_suppkey * 7) % 10) / 10.0 AS FLOAT) AS confidence, CAST(s_suppkey % 10 AS INT) AS label,
  s_suppkey % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {supplier}"""

VIEWS["assoc"] = """
SELECT 'semantic' AS source_type, id AS source_id, 'semantic' AS target_type, (id * 7 + 3) % (SELECT count(*) FROM {embeddings}) AS target_id, CAST(0.8 AS FLOAT) AS strength FROM {mem}
UNION ALL SELECT 'episodic' AS source_type, id AS source_id, 'semantic' AS target_type, vec_id AS target_id, CAST(0.9 AS FLOAT) AS strength FROM {ep}"""

# One start node per label.
VIEWS["starts"] = "SELECT CAST(label AS BIGINT) AS query_id, min(vec_id) AS id FROM {embeddings} GROUP BY label"

# Detector output: names found in beliefs (known names, aliases, near names, new names).
VIEWS["extracted"] = """
SELECT m.id AS memory_id, m.agent_id, m.tenant_id,
  CASE m.id % 4 WHEN 0 THEN 'TOPIC ' || CAST(m.label AS STRING) WHEN 1 THEN 'Alias ' || CAST(100 + m.id % 7 AS STRING) WHEN 2 THEN 'Almost ' || CAST(m.label AS STRING) ELSE 'New ' || CAST(m.id % 25 AS STRING) END AS name,
  CASE m.id % 4 WHEN 1 THEN 'person' ELSE 'concept' END AS entity_type, 'subject' AS role, m.id AS vec_id
FROM {mem} m"""

VIEWS["tenants"] = """
SELECT DISTINCT tenant_id, CASE tenant_id WHEN 0 THEN 'free' WHEN 1 THEN 'developer' ELSE 'unknown-plan' END AS plan FROM {mem}"""

VIEWS["settings_raw"] = """
SELECT DISTINCT tenant_id, CASE tenant_id WHEN 0 THEN '{{"decay_base_rate": 0.002, "firewall_enabled": true, "quarantine_provenances": ["inferred", "bogus", "agent"]}}'
  WHEN 1 THEN '{{"decay_floor": 1.7, "competition_weight": -2}}' END AS raw FROM {mem}"""

DEP = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def deps(name: str) -> list[str]:
    if name == "vecs":
        return ["embeddings", "base"]
    return list(dict.fromkeys(DEP.findall(VIEWS[name])))


def check_sql(views: str, body: str) -> str:
    """Self-contained SQL: the named views (and what they need) as CTEs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in RAW or n in order:
            return
        for d in deps(n):
            visit(d)
        order.append(n)

    for v in views.split():
        visit(v)
    ctes = []
    for n in order:
        if n == "vecs":
            text = CHECK_VECS
        else:
            text = VIEWS[n].format(**{d: d for d in deps(n)}).replace("sha256_hex(", "sha256(")
        ctes.append(f"{n} AS ({text})")
    body = body.strip()
    if not ctes:
        return body
    recursive = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else "WITH "
    head = recursive + ",\n".join(ctes)
    if body.upper().startswith("WITH"):
        return head + ",\n" + body[len(recursive):] if recursive == "WITH RECURSIVE " else head + ",\n" + body[5:]
    return head + "\n" + body


class Tables:
    """Raw and derived tables of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in RAW and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            if name in RAW:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                self._made[name] = self._view(VIEWS[name], deps(name))
        return self._made[name]

    def _view(self, text: str, needs: list[str]) -> DataFrame:
        text = re.sub(r"sha256_hex\(([^)]*)\)", r"sha2(\1, 256)", text)
        return self.spark.sql(text, **{d: getattr(self, d) for d in needs})

    @cached_property
    def vecs(self) -> DataFrame:
        return self._view(SPARK_VECS, ["embeddings", "base"])

    @cached_property
    def memv(self) -> DataFrame:
        """Beliefs with their vector ``emb``."""
        return self.mem.join(self.vecs.select(F.col("vec_id").alias("id"), "emb"), "id", "left")

    def with_vec(self, df: DataFrame, col: str = "vec_id", out: str = "emb") -> DataFrame:
        return df.join(self.vecs.select(F.col("vec_id").alias(col), F.col("emb").alias(out)), col, "left")
