"""Expiry, retention, policies, sessions, quarantine decisions, overrides, erasure.

Every operator takes tables and gives back the changed rows, the kept rows or
the log rows; ``ids`` tables name the rows to act on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmill.functions import scalar as sc
from beliefmill.operators.beliefs import active
from beliefmill.operators.graph import derived_closure, purge_links
from beliefmill.operators.similarity import top_by
from beliefmill.session import instant, pin

TOMBSTONE = "[REDACTED]"
SHRED_MARK = "enc:v1:"


def log_rows(mem: DataFrame, mutation_type: str, reason: str | Column, now, *, source: str = "system", keep_text: bool = False,
             actor: str | None = None, new_confidence: Column | None = None) -> DataFrame:
    """Change-log rows for beliefs; the content hash is always kept, the text only on demand."""
    why = reason if isinstance(reason, Column) else F.lit(reason)
    return mem.select(
        F.col("id").alias("memory_id"), "agent_id", "tenant_id", F.lit(mutation_type).alias("mutation_type"), F.lit(source).alias("source_type"),
        F.col("confidence").cast("double").alias("old_confidence"), (new_confidence if new_confidence is not None else F.lit(None).cast("double")).alias("new_confidence"),
        why.alias("reason"), sc.content_hash(F.col("content")).alias("content_hash"),
        (F.col("content") if keep_text else F.lit(None).cast("string")).alias("content_snapshot"),
        F.lit(actor).cast("string").alias("actor_type"), "anchor_id", "binding", instant(now).alias("created_at"))


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def _without(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def expired(mem: DataFrame, policies: DataFrame, now) -> DataFrame:
    """Rows past their own expiry or the retention of their type, with the reason."""
    at = instant(now)
    keep = policies.where(F.col("retention_days") > 0).select("agent_id", F.col("memory_type").alias("type"), "retention_days")
    rows = mem.join(keep, ["agent_id", "type"], "left")
    ttl = F.col("expires_at") < at
    old = F.unix_micros("created_at") < F.unix_micros(at) - F.col("retention_days").cast("long") * 86_400_000_000
    why = F.when(F.coalesce(ttl, F.lit(False)), "deletion: ttl expired").when(F.coalesce(old, F.lit(False)), "deletion: retention policy")
    return rows.withColumn("removal_reason", why).where(F.col("removal_reason").isNotNull()).drop("retention_days")


def expire(mem: DataFrame, policies: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(kept rows, log rows with the removed text)."""
    gone = expired(mem, policies, now)
    return _without(mem, gone), log_rows(gone, "deletion", F.col("removal_reason"), now, keep_text=True)


def policy_excess(mem: DataFrame, policies: DataFrame) -> DataFrame:
    """Active rows beyond the newest max_memories per (agent, type).

    The rows to keep are found first: with the largest cap as a bound, Spark
    prunes to that many rows per key before the shuffle.
    """
    rows = mem.where(active())
    caps = policies.select("agent_id", F.col("memory_type").alias("type"), "max_memories")
    bound = caps.agg(F.max("max_memories")).first()[0] or 0
    newest = top_by(rows.select("id", "agent_id", "type", "created_at"), ["agent_id", "type"], [F.desc("created_at"), F.desc("id")], max(int(bound), 1), "_r")
    keep = newest.join(caps, ["agent_id", "type"]).where(F.col("_r") <= F.col("max_memories"))
    return _without(rows.join(caps.select("agent_id", "type"), ["agent_id", "type"], "left_semi"), keep)


def enforce_policies(mem: DataFrame, policies: DataFrame, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, summary rows). A summary row stands in for the removed rows of an
    (agent, type) whose policy asks for it."""
    gone = policy_excess(mem, policies)
    kept = _without(mem, gone)
    if summaries is None:
        return kept, gone.sparkSession.createDataFrame([], "agent_id long, tenant_id long, type string, content string, source string, confidence double")
    groups = gone.groupBy("agent_id", "type").agg(F.min("tenant_id").alias("tenant_id"))
    asked = policies.where(F.coalesce("auto_summarize", F.lit(False))).select("agent_id", F.col("memory_type").alias("type")) if "auto_summarize" in policies.columns else policies.select("agent_id", F.col("memory_type").alias("type"))
    rows = groups.join(asked, ["agent_id", "type"], "left_semi").join(summaries.select("agent_id", F.col("memory_type").alias("type"), "content"), ["agent_id", "type"])
    return kept, rows.select("agent_id", "tenant_id", "type", "content", F.lit("auto-summarize").alias("source"), F.lit(0.8).alias("confidence"))


def end_sessions(sessions: DataFrame, ids: DataFrame, now, ttl_hours: int = 24) -> DataFrame:
    hit = ids.select(F.col("id"), F.lit(True).alias("_h")).distinct()
    ends = F.coalesce("_h", F.lit(False)) & (F.col("status") == "active")
    at = instant(now)
    return sessions.join(hit, "id", "left").withColumns({
        "expires_at": F.when(ends, at + F.expr(f"INTERVAL {ttl_hours} HOURS")).otherwise(F.col("expires_at")),
        "status": F.when(ends, "ended").otherwise(F.col("status"))}).drop("_h")


def expire_sessions(sessions: DataFrame, now) -> DataFrame:
    over = (F.col("status") != "expired") & F.col("expires_at").isNotNull() & (F.col("expires_at") < instant(now))
    return sessions.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def expired_session_memories(mem: DataFrame, sessions: DataFrame, now) -> DataFrame:
    over = sessions.where(F.col("expires_at") < instant(now)).select("session_id").distinct()
    return mem.where(active() & (F.col("binding") == "session")).join(over, "session_id", "left_semi")


def release(mem: DataFrame, ids: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    rows = _only(mem.where(F.col("binding") == "quarantine"), ids).withColumn("binding", sc.binding_of(F.col("anchor_id"), F.col("session_id")))
    if "quarantine_reason" in rows.columns:
        rows = rows.withColumn("quarantine_reason", F.lit(None).cast("string"))
    return rows, log_rows(rows, "quarantine_release", "release: admitted to active memory", now)


def reject(mem: DataFrame, ids: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    rows = _only(mem.where(F.col("binding") == "quarantine"), ids)
    return _without(mem, rows), log_rows(rows, "quarantine_reject", "reject: discarded untrusted write", now, keep_text=True)


def set_archived(mem: DataFrame, ids: DataFrame, value: bool) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_h", F.lit(True))
    return mem.join(hit, "id", "left").withColumn("is_archived", F.when(F.col("_h"), F.lit(value)).otherwise(F.col("is_archived"))).drop("_h")


def archive(mem: DataFrame, ids: DataFrame) -> DataFrame:
    return set_archived(mem, ids, True)


def restore(mem: DataFrame, ids: DataFrame) -> DataFrame:
    return set_archived(mem, ids, False)


def flag_review(mem: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_h", F.lit(True))
    return mem.join(hit, "id", "left").withColumn("needs_review", F.when(F.col("_h"), F.lit(value)).otherwise(F.col("needs_review"))).drop("_h")


def override(mem: DataFrame, changes: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Operator corrections: changes(id, confidence?, content?, reason, actor)."""
    c = changes.select("id", F.col("confidence").alias("_c"), F.col("content").alias("_t"), F.col("reason").alias("_why"), F.col("actor").alias("_who"))
    rows = mem.join(c, "id")
    new = rows.withColumns({"confidence": F.coalesce(F.col("_c").cast("float"), F.col("confidence")), "content": F.coalesce("_t", "content")}).drop("_c", "_t", "_why", "_who")
    log = log_rows(rows, "admin_override", F.col("_why"), now, source="admin", new_confidence=F.col("_c").cast("double"))
    extra = rows.select(F.col("id").alias("memory_id"), F.when(F.col("_t").isNotNull(), F.to_json(F.create_map(F.lit("new_content_hash"), sc.content_hash(F.col("_t"))))).alias("metadata"), F.col("_who").alias("who"))
    return new, log.join(extra, "memory_id").withColumn("actor_type", F.col("who")).drop("who")


def resolve_contradictions(mem: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(keeper, loser): losers are archived, keepers lose their review flag."""
    lose = pairs.select(F.col("loser").alias("id")).distinct().withColumn("_l", F.lit(True))
    keep = pairs.select(F.col("keeper").alias("id")).distinct().withColumn("_k", F.lit(True))
    return mem.join(lose, "id", "left").join(keep, "id", "left").withColumns({
        "is_archived": F.col("is_archived") | F.coalesce("_l", F.lit(False)), "needs_review": F.col("needs_review") & F.col("_k").isNull()}).drop("_l", "_k")


def redact(mem: DataFrame, ids: DataFrame, reason: str, now, actor: str = "admin") -> tuple[DataFrame, DataFrame]:
    rows = _only(mem, ids)
    log = log_rows(rows, "redaction", reason, now, source="admin", actor=actor)
    blank = rows.withColumn("content", F.lit(TOMBSTONE))
    if "emb" in rows.columns:
        blank = blank.withColumn("emb", F.lit(None).cast(rows.schema["emb"].dataType))
    return blank, log


def subject_rows(anchors: DataFrame, mem: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, id, direct) of active rows about the subjects and all derived from them."""
    own = mem.where(active()).join(anchors.select("tenant_id", "anchor_id").distinct(), ["tenant_id", "anchor_id"], "left_semi").select("tenant_id", "id")
    return own.withColumn("direct", F.lit(True)).unionByName(derived_closure(own, edges, mem).withColumn("direct", F.lit(False)))


def purge_subject(anchors: DataFrame, mem: DataFrame, mentions: DataFrame, edges: DataFrame, assoc: DataFrame, now):
    """(kept beliefs, log rows without text, mentions, edges, associations)."""
    own = subject_rows(anchors, mem, edges)
    # archived rows of the subject go as well, though nothing is derived through them
    all_own = mem.join(anchors.select("tenant_id", "anchor_id").distinct(), ["tenant_id", "anchor_id"], "left_semi").select("id", F.lit(True).alias("direct"))
    ids = pin(all_own.unionByName(own.where(~F.col("direct")).select("id", "direct")).groupBy("id").agg(F.max("direct").alias("direct")))
    why = F.when(F.col("direct"), "deletion: anchor purge (erasure)").otherwise("deletion: derived from purged subject (erasure)")
    return (_without(mem, ids), log_rows(mem.join(ids, "id"), "deletion", why, now), *purge_links(ids, mentions, edges, assoc))


def shred(text: Column) -> Column:
    """Encrypt under a random key that exists only inside the expression."""
    key = F.expr("unhex(substr(sha2(concat(uuid(), uuid(), uuid()), 256), 1, 64))")
    return F.concat(F.lit(SHRED_MARK), F.base64(F.aes_encrypt(text, key, F.lit("GCM"))))


def is_shredded(text: Column) -> Column:
    return text.startswith(SHRED_MARK)


def shred_subject(anchors: DataFrame, mem: DataFrame, ent: DataFrame, mentions: DataFrame, edges: DataFrame, assoc: DataFrame, now, reason: str = "erasure"):
    """(shredded beliefs written once, log rows, scrubbed entities, mentions, edges,
    associations). The random keys differ on every evaluation, so the result is
    pinned and must not be recomputed."""
    ids = pin(subject_rows(anchors, mem, edges))
    rows = _only(mem, ids)
    gone = rows.withColumn("content", shred(F.col("content")))
    if "emb" in rows.columns:
        gone = gone.withColumn("emb", F.lit(None).cast(rows.schema["emb"].dataType))
    log = log_rows(rows, "redaction", reason, now, source="admin", actor="admin").select("memory_id", "tenant_id", "mutation_type", "reason", "content_hash")
    whole = anchors.select(F.col("anchor_id").alias("memory_id"), "tenant_id").distinct().select(
        "memory_id", "tenant_id", F.lit("redaction").alias("mutation_type"), F.lit("subject erasure (GDPR): " + reason).alias("reason"), F.lit(None).cast("string").alias("content_hash"))
    return (pin(gone), log.unionByName(whole), scrub_entities(ent, anchors), *purge_links(ids, mentions, edges, assoc))


def scrub_entities(ent: DataFrame, anchors: DataFrame) -> DataFrame:
    hit = anchors.select("tenant_id", F.col("anchor_id").alias("entity_id")).distinct()
    out = ent.join(hit, ["tenant_id", "entity_id"], "left_semi").withColumn("name", F.concat(F.lit("erased-"), F.col("entity_id").cast("string")))
    for c in ("aliases", "alias", "metadata", "external_id", "emb"):
        if c in out.columns:
            out = out.withColumn(c, F.lit(None).cast(ent.schema[c].dataType))
    return out


def upsert_anchors(ent: DataFrame, incoming: DataFrame) -> DataFrame:
    """Subjects keyed (tenant, external_id): last name wins, aliases are united."""
    cols = ["tenant_id", "external_id"]
    a = ent.select(*cols, "name", "entity_type", "aliases", F.lit(0).alias("_s"))
    b = incoming.select(*cols, "name", F.coalesce("entity_type", F.lit("person")).alias("entity_type"), "aliases", F.lit(1).alias("_s"))
    return a.unionByName(b).groupBy(*cols).agg(
        F.max_by("name", F.struct("_s", "name")).alias("name"), F.min_by("entity_type", "_s").alias("entity_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"))


def record_usage(base: DataFrame, incoming: DataFrame) -> DataFrame:
    both = base.withColumn("_s", F.lit(0)).unionByName(incoming.withColumn("_s", F.lit(1)))
    return both.groupBy("episode_id", "memory_id", "usage_type").agg(F.max_by("relevance", F.struct("_s", "relevance")).alias("relevance"))


def touch_episodes(ep: DataFrame, accesses: DataFrame) -> DataFrame:
    n = accesses.groupBy(F.col("episode_id").alias("id")).agg(F.count("*").alias("accesses"), F.max("ts").alias("seen"))
    return ep.join(n, "id").withColumn("last_accessed_at", F.greatest("last_accessed_at", "seen"))


def normalise_confidence(mem: DataFrame) -> DataFrame:
    cap = F.lit(0.99).cast("float")
    return mem.withColumn("confidence", F.when(F.col("confidence") > cap, cap).otherwise(F.col("confidence")))


def backfill_association_tenants(assoc: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """owners(type, id, tenant_id) over all belief tables: (filled, dangling)."""
    o = owners.select(F.col("type").alias("source_type"), F.col("id").alias("source_id"), "tenant_id")
    rows = assoc.drop("tenant_id") if "tenant_id" in assoc.columns else assoc
    return rows.join(o, ["source_type", "source_id"]), rows.join(o, ["source_type", "source_id"], "left_anti")


def backfill_entity_tenants(ent: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing tenants from the owning agent: (filled, ownerless rows to drop)."""
    a = agents.select("agent_id", F.col("tenant_id").alias("_t")).distinct()
    rows = ent.join(a, "agent_id", "left").withColumn("tenant_id", F.coalesce("tenant_id", "_t")).drop("_t")
    return rows.where(F.col("tenant_id").isNotNull()), rows.where(F.col("tenant_id").isNull())


def backfill_log_identity(mlog: DataFrame, mem: DataFrame) -> DataFrame:
    m = mem.select(F.col("id").alias("memory_id"), F.col("tenant_id").alias("_t"), F.col("anchor_id").alias("_a"), F.col("binding").alias("_b"))
    return mlog.join(m, "memory_id", "left").withColumns({"tenant_id": F.coalesce("tenant_id", "_t"), "anchor_id": F.col("_a"), "binding": F.col("_b")}).drop("_t", "_a", "_b")
