"""Column types of the belief tables; the single source for typed scans."""

from pyspark.sql import types as T

L, S, FL, D, B, TS, I = (T.LongType(), T.StringType(), T.FloatType(), T.DoubleType(), T.BooleanType(),
                         T.TimestampType(), T.IntegerType())
VEC = T.ArrayType(T.FloatType())
IDS = T.ArrayType(T.StringType())


def _of(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


SCHEMAS: dict[str, T.StructType] = {
    "memories": _of(
        id=S, agent_id=S, tenant_id=S, type=S, content=S, embedding=VEC, source=S, provenance=S, confidence=FL,
        metadata=T.MapType(S, S), event_date=TS, expires_at=TS, last_verified_at=TS, reinforcement_count=I,
        decay_rate=FL, last_accessed_at=TS, access_count=I, needs_review=B, is_archived=B, archived_at=TS, binding=S,
        anchor_id=S, session_id=S, quarantine_reason=S, quarantined_at=TS, created_at=TS, updated_at=TS),
    "episodes": _of(
        id=S, agent_id=S, tenant_id=S, raw_content=S, conversation_id=S, message_sequence=I, occurred_at=TS,
        emotional_valence=FL, emotional_intensity=FL, importance_score=FL, entities=IDS, topics=IDS,
        causal_links=T.ArrayType(_of(cause=S, effect=S, confidence=FL)), outcome=S, consolidation_status=S,
        derived_semantic_ids=IDS, derived_procedural_ids=IDS, memory_strength=FL, decay_rate=FL,
        last_accessed_at=TS, access_count=I, embedding=VEC),
    "procedures": _of(
        id=S, agent_id=S, tenant_id=S, trigger_pattern=S, trigger_keywords=IDS, trigger_embedding=VEC,
        action_template=S, action_type=S, use_count=I, success_count=I, failure_count=I, last_used_at=TS,
        derived_from_episodes=IDS, version=I, previous_version_id=S, confidence=FL, memory_strength=FL),
    "schemas": _of(
        id=S, agent_id=S, tenant_id=S, schema_type=S, name=S, description=S, attributes=T.MapType(S, S),
        evidence_memories=IDS, evidence_episodes=IDS, evidence_count=I, confidence=FL, applicable_contexts=IDS,
        contradiction_count=I, last_validated_at=TS, embedding=VEC),
    "memory_graph": _of(source_id=S, target_id=S, relation_type=S, strength=FL, created_at=TS, last_traversed_at=TS,
                        traversal_count=L),
    "entities": _of(id=S, agent_id=S, tenant_id=S, name=S, entity_type=S, aliases=IDS, embedding=VEC, is_anchor=B,
                    external_id=S, metadata=T.MapType(S, S)),
    "entity_mentions": _of(entity_id=S, memory_id=S, mention_type=S, created_at=TS),
    "belief_contradictions": _of(belief_id=S, contradicted_by_id=S, detected_at=TS),
    "feedback_signals": _of(id=S, memory_id=S, agent_id=S, signal_type=S, context=T.MapType(S, S), created_at=TS),
    "mutation_log": _of(
        id=S, memory_id=S, agent_id=S, tenant_id=S, mutation_type=S, source_type=S, source_id=S, old_confidence=FL,
        new_confidence=FL, old_reinforcement_count=I, new_reinforcement_count=I, reason=S, metadata=S,
        content_hash=S, content_snapshot=S, actor_type=S, actor_id=S, anchor_id=S, binding=S, created_at=TS, seq=L,
        prev_hash=S, row_hash=S, hash_version=I),
    "audit_chain_heads": _of(tenant_id=S, last_seq=L, last_hash=S),
    "sessions": _of(id=S, tenant_id=S, agent_id=S, anchor_id=S, external_id=S, status=S, created_at=TS, ended_at=TS,
                    expires_at=TS),
    "memory_policies": _of(agent_id=S, memory_type=S, max_memories=I, retention_days=I, priority_weight=FL, auto_summarize=B),
    "tenant_settings": _of(tenant_id=S, raw=S),
    "usage_counters": _of(tenant_id=S, month=T.DateType(), written=L, recalls=L),
    "episode_memory_usage": _of(episode_id=S, memory_id=S, usage_type=S, relevance=FL),
    "memory_associations": _of(tenant_id=S, source_type=S, source_id=S, target_type=S, target_id=S,
                               association_type=S, strength=FL),
}

# Contract schemas of tables produced outside this library (model or detector output).
CONTRACTS: dict[str, T.StructType] = {
    "facts": _of(conv_id=L, source=S, content=S, type=S, evidence=S, confidence=FL, metadata=T.MapType(S, S)),
    "episode_structure": _of(episode_id=S, entities=IDS, topics=IDS, emotional_valence=FL, emotional_intensity=FL, importance_score=FL),
    "procedure_pattern": _of(episode_id=S, trigger_pattern=S, trigger_keywords=IDS, action_template=S, action_type=S, embedding=VEC),
    "schema_pattern": _of(agent_id=S, cluster_id=S, schema_type=S, name=S, description=S, attributes=T.MapType(S, S), applicable_contexts=IDS),
    "implicit_feedback": _of(memory_id=S, signal_type=S, confidence=FL, evidence=S, created_at=TS),
    "entities": _of(memory_id=S, agent_id=S, name=S, entity_type=S, role=S, embedding=VEC),
    "relationships": _of(source_id=S, target_id=S, relation_type=S, strength=FL),
    "summaries": _of(agent_id=S, memory_type=S, content=S),
    "tension_verdicts": _of(existing_id=S, incoming_id=S, kind=S, score=FL),
}
