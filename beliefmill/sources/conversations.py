"""Conversations and extracted facts as belief rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.functions import scalar as sc
from beliefmill.functions.lexicon import EVIDENCE_TYPES, MEMORY_TYPES

TURNS_PER_PIECE = 512
NUMBERED = r"(?m)^\s*\d+[.)]\s"


def conversation_user_memories(turns: DataFrame) -> DataFrame:
    """All user turns of a conversation as one fact. Long conversations are first
    joined in pieces, so no task collects single turns of a whole conversation."""
    lines = turns.where(F.col("role") == "user").select(
        "conv_id", "agent_id", F.floor(F.col("turn") / TURNS_PER_PIECE).alias("piece"),
        F.struct("turn", F.concat(F.lit("User: "), "text").alias("line")).alias("t"))

    def joined(col):
        return F.array_join(F.transform(F.array_sort(F.collect_list(col)), lambda x: x["line"]), "\n")

    pieces = lines.groupBy("conv_id", "agent_id", "piece").agg(joined("t").alias("line"))
    return pieces.groupBy("conv_id", "agent_id").agg(joined(F.struct("piece", "line")).alias("content")).withColumns({
        "type": F.lit("fact"), "provenance": F.lit("user"), "confidence": F.lit(0.90).cast("float")})


def enumeration_memories(turns: DataFrame) -> DataFrame:
    """Turns with at least four numbered lines become beliefs of their own."""
    hits = F.size(F.regexp_extract_all("text", F.lit(NUMBERED), F.lit(0)))
    return turns.where(hits >= 4).select(
        "conv_id", "turn", "agent_id", F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", "agent").otherwise("user").alias("provenance"))


def ingest_facts(facts: DataFrame, user_mem: DataFrame, request_metadata: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Extracted facts as beliefs, and the user-turn rows that remain (those of
    conversations without any stored fact)."""
    ev = F.when(F.col("evidence").isin(*EVIDENCE_TYPES), F.col("evidence")).otherwise("explicit_statement")
    stored = facts.where(F.trim("content") != "").select(
        "conv_id",
        "content",
        F.when(F.col("type").isin(*MEMORY_TYPES), F.col("type")).otherwise("fact").alias("type"),
        F.when(F.col("source") == "assistant", "agent").otherwise("user").alias("provenance"),
        ev.alias("evidence"),
        F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) == 0, sc.evidence_prior(ev)).otherwise(F.col("confidence").cast("double")).cast("float").alias("confidence"),
        *([overlay_metadata(F.col("metadata"), request_metadata).alias("metadata")] if "metadata" in facts.columns else []),
    )
    return stored, user_mem.join(stored.select("conv_id").distinct(), "conv_id", "left_anti")


def overlay_metadata(base, request: dict[str, str] | None):
    """base ∪ request, the request wins."""
    req = F.create_map(*[F.lit(x) for kv in (request or {}).items() for x in kv]) if request else F.create_map().cast("map<string,string>")
    own = F.coalesce(base, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(req), k)), req)


def store_extracted(rows: DataFrame) -> DataFrame:
    """Rows of an extractor: prior from the evidence when given."""
    conf = F.when(F.coalesce("evidence", F.lit("")) != "", sc.evidence_prior(F.col("evidence"))).otherwise(F.col("confidence").cast("double"))
    return rows.withColumn("confidence", conf.cast("float")).withColumn("source", F.lit("extraction"))
