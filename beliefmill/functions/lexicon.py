"""Word lists, lookup tables and constants the results depend on."""

# Tier bands and behaviour.
TIERS = ["hot", "warm", "cold", "archive"]
TIER_BOUNDS = {"hot": (0.85, 1.0), "warm": (0.70, 0.85), "cold": (0.40, 0.70), "archive": (0.0, 0.40)}
# tier: (auto_inject, retrieval_threshold, summarize_on_access, decay_multiplier)
TIER_BEHAVIOUR = {
    "hot": (True, 0.0, False, 0.5),
    "warm": (False, 0.5, False, 1.0),
    "cold": (False, 0.75, True, 1.5),
    "archive": (False, 1.0, True, 2.0),
}
TIER_REASON = {
    "hot": "confidence > 0.85",
    "warm": "0.70 < confidence <= 0.85",
    "cold": "0.40 < confidence <= 0.70",
    "archive": "confidence <= 0.40",
}

# Enumerations.
MEMORY_TYPES = ["preference", "fact", "decision", "constraint", "belief"]
PROVENANCES = ["user", "agent", "tool", "derived", "inferred"]
BINDINGS = ["canon", "private", "anchored", "session", "quarantine"]
EVIDENCE_TYPES = ["explicit_statement", "implicit_inference", "behavioral_signal"]
RELATIONS = ["entity_link", "causal", "temporal", "thematic", "contradicts", "supports", "derived_from", "supersedes"]
SYMMETRIC_RELATIONS = ["entity_link", "thematic", "supports"]
OUTCOMES = ["success", "failure", "neutral", "unknown"]

# Priors.
PROVENANCE_PRIOR = {"user": 0.9, "tool": 0.8, "agent": 0.72, "derived": 0.5, "inferred": 0.4}
PROVENANCE_PRIOR_DEFAULT = 0.5
EVIDENCE_PRIOR = {"explicit_statement": 0.90, "implicit_inference": 0.625, "behavioral_signal": 0.425}
EVIDENCE_PRIOR_DEFAULT = 0.5
BINDING_DECAY_RATE = {"session": 0.20, "canon": 0.01}
BINDING_DECAY_RATE_DEFAULT = 0.05
SOURCE_RELIABILITY = {"user_statement": 1.0, "tool_output": 0.9, "extraction": 0.8, "agent_inference": 0.7}
SOURCE_RELIABILITY_DEFAULT = 0.75

# Feedback effects, signal: (log-odds delta, count delta, review, summarise).
FEEDBACK_EFFECTS = {
    "helpful": (0.3, 1, False, False),
    "unhelpful": (-0.5, -1, False, False),
    "used": (0.1, 0, False, False),
    "ignored": (-0.1, 0, False, False),
    "contradicted": (-1.0, -2, True, False),
    "outdated": (-0.8, -1, False, True),
}

# Keyword lists for type classification, tried in this order.
PREFERENCE_WORDS = [
    "prefer", "i like", "love", "hate", "enjoy", "dislike",
    "i want", "my preference", "tend to", "usually", "typically",
]
DECISION_WORDS = [
    "decided ", "agreed ", "will do ", "going to ", "plan to ",
    "chose ", "committed ", "resolved to ", "decided to ", "agreed to ",
    "won't ", "will not ", "we will ", "i will ",
]
CONSTRAINT_WORDS = [
    "must ", "cannot ", " can't ",
    "required ", "prohibited ", "not allowed ", "mandatory ",
    "forbidden ", "must not ", "shall not ", "no exceptions",
]

# Markers of change over time and of negation.
TEMPORAL_MARKERS = [
    "as of ", "starting from ", "starting to ",
    "moved to ", "moved from ", "switched to ", "changed to ",
    "no longer ", "used to ", "formerly ",
    "update:", "updated my ", "updating my ",
    "rather than ", "instead of ",
    "prefer ", "prefers ", "preferred ",
]
NEGATION_MARKERS = [
    " not ", " no longer ", "never ", "isn't ", "aren't ", "wasn't ",
    "weren't ", "don't ", "doesn't ", "didn't ", "won't ", "wouldn't ",
    "stopped ", "quit ", "left ", "rejected ", "avoided ", "opposed ",
    "disagrees ", "denies ",
]

# Graph weights.
RELATION_MULTIPLIER = {
    "entity_link": 0.7, "causal": 0.9, "temporal": 0.6, "thematic": 0.7,
    "supports": 0.85, "contradicts": 0.95, "derived_from": 0.8, "supersedes": 0.9,
}
RELATION_MULTIPLIER_DEFAULT = 0.7
MENTION_WEIGHT = {"subject": 0.9, "object": 0.7, "context": 0.4}

# Plan limits, plan: (agents, memories); None means unlimited.
PLAN_LIMITS = {
    "free": (1, 1_000),
    "developer": (5, 50_000),
    "team": (25, 500_000),
    "growth": (100, 5_000_000),
    "enterprise": (None, None),
}

# Engine settings, name: (default, upper bound).
SETTING_DEFAULTS = {
    "decay_base_rate": (0.001, 1.0),
    "decay_floor": (0.1, 0.9),
    "archive_threshold": (0.15, 0.9),
    "competition_weight": (0.5, 5.0),
    "reinforcement_log_odds": (0.3, 5.0),
    "contradiction_log_odds": (0.5, 5.0),
}

# Date layouts tried in order (weekday in brackets removed first).
EVENT_DATE_LAYOUTS = [
    "yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy",
]

# Our own short English stop list for keyword matching.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "not", "of", "on", "or", "that", "the", "to", "with"]

PROB_LO, PROB_HI = 0.01, 0.99
