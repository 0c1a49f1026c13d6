"""Scalar belief functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from beliefmill.functions import lexicon as lx
from beliefmill.session import days_between, hours_between

LOGIT_LO = math.log(lx.PROB_LO / (1 - lx.PROB_LO))
LOGIT_HI = math.log(lx.PROB_HI / (1 - lx.PROB_HI))


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def clip(x: Column, lo, hi) -> Column:
    """Clamp that keeps nulls (``greatest`` would replace them)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def lookup(key: Column, table: dict, default) -> Column:
    """CASE over a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


# -- log odds ---------------------------------------------------------------

def logit(p: Column) -> Column:
    q = clip(p.cast("double"), lx.PROB_LO, lx.PROB_HI)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log_odds_shift(conf: Column, delta: Column) -> Column:
    return clip(sigmoid(logit(conf) + delta), lx.PROB_LO, lx.PROB_HI)


# -- tiers and priors -------------------------------------------------------

def tier(conf: Column) -> Column:
    c = conf.cast("double")
    return (
        F.when(c > 0.85, "hot").when(c > 0.70, "warm").when(c > 0.40, "cold").otherwise("archive")
    )


def tier_reason(conf: Column) -> Column:
    return lookup(tier(conf), {k: v for k, v in lx.TIER_REASON.items() if k != "archive"}, lx.TIER_REASON["archive"])


def tier_behaviour(t: Column) -> Column:
    """Struct of behaviour; unknown tiers behave like archive."""
    names = ["auto_inject", "retrieval_threshold", "summarize_on_access", "decay_multiplier"]
    fields = []
    for i, n in enumerate(names):
        known = {k: v[i] for k, v in lx.TIER_BEHAVIOUR.items()}
        fields.append(lookup(t, known, lx.TIER_BEHAVIOUR["archive"][i]).alias(n))
    return F.struct(*fields)


def decay_status(conf: Column) -> Column:
    c = conf.cast("float")
    return (
        F.when(c >= F.lit(0.7).cast("float"), "healthy")
        .when(c >= F.lit(0.4).cast("float"), "decaying")
        .otherwise("at_risk")
    )


def binding_of(anchor: Column, session: Column) -> Column:
    return F.when(session.isNotNull(), "session").when(anchor.isNotNull(), "anchored").otherwise("private")


def provenance_prior(p: Column) -> Column:
    return lookup(p, lx.PROVENANCE_PRIOR, lx.PROVENANCE_PRIOR_DEFAULT)


def evidence_prior(e: Column) -> Column:
    return lookup(e, lx.EVIDENCE_PRIOR, lx.EVIDENCE_PRIOR_DEFAULT)


def binding_decay_rate(b: Column) -> Column:
    return lookup(b, lx.BINDING_DECAY_RATE, lx.BINDING_DECAY_RATE_DEFAULT)


def source_reliability(s: Column) -> Column:
    return lookup(s, lx.SOURCE_RELIABILITY, lx.SOURCE_RELIABILITY_DEFAULT)


def feedback_delta(signal: Column) -> Column:
    return lookup(signal, {k: v[0] for k, v in lx.FEEDBACK_EFFECTS.items()}, 0.0)


def feedback_count_delta(signal: Column) -> Column:
    return lookup(signal, {k: v[1] for k, v in lx.FEEDBACK_EFFECTS.items()}, 0)


def relation_multiplier(rel: Column) -> Column:
    return lookup(rel, lx.RELATION_MULTIPLIER, lx.RELATION_MULTIPLIER_DEFAULT)


def mention_weight(m: Column) -> Column:
    return lookup(m, lx.MENTION_WEIGHT, 0.0)


# -- decay ------------------------------------------------------------------

def decayed_confidence(conf: Column, hours: Column, reinforcement: Column, competition: Column,
                       rate, floor) -> Column:
    """Distance-to-floor decay sped up by competition, slowed by reinforcement."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    c = conf.cast("double")
    faded = floor + (c - floor) * F.exp(-(rate * (1 + competition)) * hours)
    hold = 1 - 1 / (1 + 0.15 * F.log((reinforcement + 1).cast("double")))
    held = F.when(reinforcement > 0, faded + (c - faded) * hold).otherwise(faded)
    raised = F.when(held < floor, floor).otherwise(held)
    return F.when(hours < 1.0, c).otherwise(F.when(raised > c, c).otherwise(raised))


def simple_decay(conf: Column, last_access: Column, now: Column, rate: float = 0.001, floor: float = 0.01) -> Column:
    c = conf.cast("double")
    faded = c * F.exp(-rate * hours_between(now, last_access))
    return F.when(last_access.isNull(), c).when(faded < floor, F.lit(floor)).otherwise(faded)


def episode_strength(strength: Column, rate: Column, last_access: Column, now: Column) -> Column:
    s = strength.cast("double") * F.exp(-rate.cast("double") * days_between(now, last_access))
    return F.when(s < 0, F.lit(0.0)).otherwise(s)


def edge_strength(strength: Column, last_seen: Column, now: Column, rate: float = 0.0005) -> Column:
    h = hours_between(now, last_seen)
    s = strength.cast("double")
    faded = s * F.exp(-rate * h)
    return F.when(h > 1.0, F.when(faded < 0.05, F.lit(0.05)).otherwise(faded)).otherwise(s)


def procedure_decay(conf: Column, last_used: Column, now: Column) -> Column:
    c = conf.cast("double")
    faded = c * F.exp(-0.01 * days_between(now, last_used))
    floored = F.when(faded < 0.1, F.lit(0.1)).otherwise(faded)
    return F.when(last_used.isNotNull() & (F.abs(floored - c) > 0.001), floored).otherwise(c)


# -- metacognition ----------------------------------------------------------

def last_confirmed() -> Column:
    return F.coalesce("last_verified_at", "last_accessed_at", "updated_at")


def recency_factor(confirmed: Column, now: Column) -> Column:
    return F.exp(-days_between(now, confirmed) / 30.0)


def reinforcement_factor(count: Column) -> Column:
    return F.when(count <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(0.5), 0.1 * F.log((count + 1).cast("double")))
    )


# -- text -------------------------------------------------------------------

def words(items: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in items])


def contains_any(text: Column, items: list[str]) -> Column:
    """One lambda over a literal array keeps the expression small where it is
    used several times; long OR chains dominate planning otherwise."""
    return F.exists(words(items), lambda w: text.contains(w))


def classify_type(content: Column) -> Column:
    t = F.lower(content)
    return (
        F.when(contains_any(t, lx.PREFERENCE_WORDS), "preference")
        .when(contains_any(t, lx.DECISION_WORDS), "decision")
        .when(contains_any(t, lx.CONSTRAINT_WORDS), "constraint")
        .otherwise("fact")
    )


def marker_score(text: Column, markers: list[str]) -> Column:
    hits = F.size(F.filter(words(markers), lambda m: text.contains(m)))
    return F.least(F.lit(1.0), hits * 0.35)


def tension(sim: Column, incoming: Column) -> Column:
    """Struct (kind, score, ambiguous) for one existing/incoming pair."""
    return tension_of(sim, *markers(incoming))


def markers(incoming: Column) -> tuple[Column, Column]:
    """Temporal and negation score of a text, all that a tension depends on but the similarity."""
    text = F.lower(F.trim(incoming))
    return marker_score(text, lx.TEMPORAL_MARKERS), marker_score(text, lx.NEGATION_MARKERS)


def tension_of(sim: Column, temporal: Column, negation: Column) -> Column:
    """``tension`` from the scores of ``markers``."""
    in_zone = sim.isNotNull() & (sim >= 0.5) & (sim < 0.85)
    kind = (
        F.when(~in_zone, "none")
        .when(temporal >= 0.30, "temporal")
        .when(negation >= 0.35, "hard")
        .when(sim >= 0.70, "soft")
        .otherwise("none")
    )
    score = (
        F.when(~in_zone, F.lit(0.0))
        .when(temporal >= 0.30, temporal)
        .when(negation >= 0.35, negation * (1 - 0.3 * (sim - 0.5) / (0.85 - 0.5)))
        .when(sim >= 0.70, (sim - 0.70) / (0.85 - 0.70))
        .otherwise(F.lit(0.0))
    )
    return F.struct(
        kind.alias("kind"),
        score.alias("score"),
        ((kind != "none") & (score < 0.65)).alias("ambiguous"),
    )


def event_date(content: Column, metadata: Column | None = None) -> Column:
    """Metadata session_date, then event_date, then a [DATE: ..] tag in the text."""

    def parse(raw: Column) -> Column:
        plain = F.trim(F.regexp_replace(raw, r"\s*\([A-Za-z]{3}\)", ""))
        return F.coalesce(*[F.try_to_timestamp(plain, F.lit(p)) for p in lx.EVENT_DATE_LAYOUTS])

    tag = F.nullif(F.regexp_extract(content, r"\[DATE:\s*([^\]]+)\]", 1), F.lit(""))
    sources = [parse(tag)]
    if metadata is not None:
        sources = [parse(metadata["session_date"]), parse(metadata["event_date"])] + sources
    return F.coalesce(*sources)


def truncate_text(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return (
        F.when((h >= 5) & (h < 12), "morning")
        .when((h >= 12) & (h < 17), "afternoon")
        .when((h >= 17) & (h < 21), "evening")
        .otherwise("night")
    )


def weekday(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def initial_schema_confidence(n: Column) -> Column:
    return F.least(F.lit(0.8), 0.5 + 0.05 * n)


def context_match(schema_contexts: Column, inputs: Column) -> Column:
    hit = F.filter(
        schema_contexts,
        lambda sc: F.exists(inputs, lambda ic: F.lower(ic).contains(F.lower(sc))),
    )
    return F.when(
        (F.size(schema_contexts) > 0) & (F.size(inputs) > 0),
        F.size(hit) / F.size(schema_contexts),
    ).otherwise(F.lit(0.0))


def time_match(attributes: Column, time: Column) -> Column:
    return (
        F.when(F.lower(attributes["time_preference"]) == F.lower(time), F.lit(1.0))
        .when(F.lower(attributes["work_hours"]).contains(F.lower(time)), F.lit(0.8))
        .otherwise(F.lit(0.0))
    )


def tokens(text: Column) -> Column:
    """Lower-case word list without stop words; ``stems.stems`` reduces them to stems."""
    words = F.split(F.lower(text), r"[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in lx.STOP_WORDS])
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))
