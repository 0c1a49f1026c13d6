"""Listing, validation and gating of belief rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmill.functions import lexicon as lx
from beliefmill.functions import scalar as sc
from beliefmill.operators.similarity import top_by
from beliefmill.session import instant



def active() -> Column:
    return ~F.col("is_archived")


def live() -> Column:
    return active() & (F.col("binding") != "quarantine")


def with_write_defaults(incoming: DataFrame, now) -> DataFrame:
    prov = F.when(F.coalesce("provenance", F.lit("")) == "", "agent").otherwise(F.col("provenance"))
    binding = F.when(F.coalesce("binding", F.lit("")) == "", sc.binding_of(F.col("anchor_id"), F.col("session_id"))).otherwise(F.col("binding"))
    out = incoming.withColumn("provenance", prov).withColumn("binding", binding)
    conf = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, sc.provenance_prior(F.col("provenance"))).otherwise(F.col("confidence").cast("double"))
    rate = F.when(F.coalesce(F.col("decay_rate"), F.lit(0.0)) == 0, sc.binding_decay_rate(F.col("binding"))).otherwise(F.col("decay_rate").cast("double"))
    count = F.coalesce(F.col("reinforcement_count"), F.lit(0))
    return out.withColumns({
        "confidence": F.least(conf, F.lit(lx.PROB_HI)).cast("float"),
        "decay_rate": rate.cast("float"),
        "reinforcement_count": F.when(count == 0, F.lit(1)).otherwise(count),
        "access_count": F.lit(0),
        "last_verified_at": instant(now),
        "last_accessed_at": instant(now),
    })


def page(df: DataFrame, key: str, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Page per key with the filtered total. Only limit+offset rows per key move."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    totals = df.groupBy(key).agg(F.count("*").alias("total"))
    return top_by(df, [key], order, limit + offset, "pos").where(F.col("pos") > offset).join(totals, key)


def browse(mem: DataFrame, tier: str | None = None, mem_type: str | None = None, provenance: str | None = None,
           binding: str | None = None) -> DataFrame:
    c = F.col("confidence").cast("double")
    if tier == "archive":
        out = mem.where((c <= 0.40) | F.col("is_archived"))
    else:
        out = mem.where(active())
        if tier:
            out = out.where(sc.tier(F.col("confidence")) == tier)
    for name, want in (("type", mem_type), ("provenance", provenance), ("binding", binding)):
        if want:
            out = out.where(F.col(name) == want)
    return out



def list_page(mem: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    return page(browse(mem, **filters), "agent_id", [F.desc("confidence"), F.desc("created_at"), F.asc("id")], limit, offset)


def memories_in_tier(mem: DataFrame, tier: str, n: int = 100) -> DataFrame:
    lo, hi = lx.TIER_BOUNDS[tier]
    c = F.col("confidence").cast("double")
    return top_by(mem.where(active() & (c > lo) & (c <= hi)), ["agent_id"], [F.desc("confidence"), F.asc("id")], n)


def hot_memories(mem: DataFrame, n: int = 20) -> DataFrame:
    return memories_in_tier(mem, "hot", n)


def validate(mem: DataFrame) -> DataFrame:
    """Add ``violations``: an array of broken rules (empty when clean)."""
    a, s, b = F.col("anchor_id"), F.col("session_id"), F.col("binding")
    c = F.col("confidence").cast("double")
    rules = {
        "binding_ids": (b.isin("canon", "private") & (a.isNotNull() | s.isNotNull()))
        | ((b == "anchored") & (a.isNull() | s.isNotNull())) | ((b == "session") & s.isNull()),
        "confidence_range": c.isNull() | (c < 0) | (c > 1),
        "type_domain": ~F.coalesce(F.col("type").isin(*lx.MEMORY_TYPES), F.lit(False)),
        "provenance_domain": ~F.coalesce(F.col("provenance").isin(*lx.PROVENANCES), F.lit(False)),
        "binding_domain": ~F.coalesce(b.isin(*lx.BINDINGS), F.lit(False)),
    }
    marks = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return mem.withColumn("violations", F.filter(marks, lambda x: x.isNotNull()))


def resolve_settings(tenants: DataFrame, raw: DataFrame) -> DataFrame:
    """Defaults overlaid by each tenant's JSON, every value forced into its range."""
    json = "struct<" + ",".join(f"{k}:double" for k in lx.SETTING_DEFAULTS) + ",firewall_enabled:boolean,quarantine_provenances:array<string>>"
    got = tenants.select("tenant_id").distinct().join(raw, "tenant_id", "left").withColumn("s", F.from_json("raw", json))
    cols = [F.col("tenant_id")]
    for name, (default, hi) in lx.SETTING_DEFAULTS.items():
        v = F.coalesce(F.col(f"s.{name}"), F.lit(default))
        cols.append(F.when(v < 0, F.lit(default)).when(v > hi, F.lit(hi)).otherwise(v).alias(name))
    cols.append(F.coalesce("s.firewall_enabled", F.lit(False)).alias("firewall_enabled"))
    listed = F.coalesce("s.quarantine_provenances", F.array().cast("array<string>"))
    cols.append(F.filter(listed, lambda p: p.isin(*lx.PROVENANCES)).alias("quarantine_provenances"))
    return got.select(*cols)


def firewall(incoming: DataFrame, settings: DataFrame, flag: str | None = None) -> DataFrame:
    """Add ``quarantine_reason`` (null = let through); canon is exempt."""
    explicit = F.col(flag) if flag else F.lit(False)
    by_rule = F.col("firewall_enabled") & F.array_contains("quarantine_provenances", F.col("provenance"))
    reason = (
        F.when(F.col("binding") == "canon", F.lit(None))
        .when(explicit, F.lit("caller marked write untrusted"))
        .when(by_rule, F.concat(F.lit("firewall policy: provenance '"), "provenance", F.lit("' quarantined")))
    )
    rules = settings.select("tenant_id", "firewall_enabled", "quarantine_provenances")
    return incoming.join(rules, "tenant_id", "left").withColumn("quarantine_reason", reason).drop(
        "firewall_enabled", "quarantine_provenances")


def quarantine_queue(mem: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    held = mem.where((F.col("binding") == "quarantine") & active())
    return page(held, "tenant_id", [F.desc("created_at"), F.asc("id")], limit, offset)


def needs_review(mem: DataFrame, n: int = 100) -> DataFrame:
    return top_by(mem.where(F.col("needs_review") & active()), ["agent_id"], [F.desc("updated_at"), F.asc("id")], n)


def by_anchor(mem: DataFrame, n: int = 100) -> DataFrame:
    return top_by(mem.where(F.col("anchor_id").isNotNull() & active()), ["tenant_id", "anchor_id"],
                  [F.desc("confidence"), F.desc("created_at"), F.asc("id")], n)


def canon(mem: DataFrame, n: int = 100) -> DataFrame:
    return top_by(mem.where((F.col("binding") == "canon") & active()), ["tenant_id"],
                  [F.desc("confidence"), F.desc("created_at"), F.asc("id")], n)


def canon_dedupe(incoming: DataFrame, mem: DataFrame) -> DataFrame:
    """Oldest canon row with exactly the incoming content, per tenant."""
    known = mem.where((F.col("binding") == "canon") & active()).groupBy("tenant_id", "content").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("canon_id"))
    return incoming.join(known, ["tenant_id", "content"])


def episodes_in_range(ep: DataFrame, start, end) -> DataFrame:
    return ep.where((F.col("occurred_at") >= instant(start)) & (F.col("occurred_at") <= instant(end)))


def episodes_by_importance(ep: DataFrame, floor: float, n: int = 50) -> DataFrame:
    return top_by(ep.where(F.col("importance_score") >= F.lit(floor).cast("float")), ["agent_id"],
                  [F.desc("importance_score"), F.desc("occurred_at"), F.asc("id")], n)


def episodes_by_status(ep: DataFrame, status: str, n: int = 50) -> DataFrame:
    return top_by(ep.where(F.col("consolidation_status") == status), ["agent_id"], [F.asc("occurred_at"), F.asc("id")], n)


def weak_episodes(ep: DataFrame, below: float) -> DataFrame:
    return ep.where((F.col("memory_strength") < F.lit(below).cast("float")) & (F.col("consolidation_status") != "archived"))


def recall_episodes(ep: DataFrame, *, queries: DataFrame | None = None, start=None, end=None, importance: float | None = None,
                    n: int = 50) -> DataFrame:
    """Similarity when queries are given, else the time range, else importance."""
    from beliefmill.operators.recall import similar_rows

    if queries is not None:
        return similar_rows(ep, queries, 0.5, n)
    if start is not None:
        hits = episodes_in_range(ep, start, end)
        return top_by(hits, ["agent_id"], [F.desc("occurred_at"), F.asc("id")], n).withColumn("score", F.lit(1.0))
    if importance is not None:
        return episodes_by_importance(ep, importance, n).withColumn("score", F.col("importance_score").cast("double"))
    raise ValueError("give queries, a time range or an importance floor")


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("external_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("session"))


def mutation_trail(mlog: DataFrame, n: int = 100) -> DataFrame:
    return top_by(mlog, ["memory_id"], [F.desc("created_at"), F.desc("id")], n)


def mutation_feed(mlog: DataFrame, since) -> DataFrame:
    return mlog.where(F.col("created_at") >= instant(since))


def anchors(ent: DataFrame, entity_type: str | None = None) -> DataFrame:
    out = ent.where("is_anchor")
    return out.where(F.col("entity_type") == entity_type) if entity_type else out
