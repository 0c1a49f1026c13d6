"""Known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from beliefmill.functions import scalar as sc
from beliefmill.functions import vectors as vc
from beliefmill.operators import beliefs as bl
from beliefmill.operators import learning as ln
from beliefmill.operators import working as wk
from beliefmill.sources.embedder import FNV_OFFSET, FNV_PRIME, _seeds, hash_vectors


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lit32(v):
    return F.lit(v).cast("float")


@pytest.mark.parametrize("conf,tier", [(0.9, "hot"), (0.85, "hot"), (0.8, "warm"), (0.7, "cold"), (0.41, "cold"), (0.4, "cold"), (0.1, "archive")])
def test_tier_compares_stored_float(spark, conf, tier):
    # 0.85 and 0.4 widen to a little more than their bound, 0.7 to a little less
    assert one(spark, sc.tier(lit32(conf))) == tier


@pytest.mark.parametrize("conf,hours,lo,hi", [(0.9, 168, 0.5, 0.85), (0.5, 168, 0.3, 0.48), (0.2, 168, 0.1, 0.19), (0.8, 0.5, 0.8, 0.8)])
def test_decay_bounds(spark, conf, hours, lo, hi):
    v = one(spark, sc.decayed_confidence(F.lit(conf), F.lit(float(hours)), F.lit(0), F.lit(0.0), 0.001, 0.1))
    assert lo <= v <= hi


def test_competition_speeds_and_reinforcement_slows_decay(spark):
    def d(r, k):
        return one(spark, sc.decayed_confidence(F.lit(0.8), F.lit(200.0), F.lit(r), F.lit(k), 0.001, 0.1))

    assert d(0, 0.5) < d(0, 0.0) < d(5, 0.0) <= 0.8


def test_log_odds_moves_extremes_less(spark):
    drop = [c - one(spark, sc.log_odds_shift(F.lit(c), F.lit(-0.5))) for c in (0.95, 0.6)]
    assert 0 < drop[0] < drop[1]
    assert one(spark, sc.log_odds_shift(F.lit(0.99), F.lit(3.0))) == 0.99


def test_null_confidence_stays_null(spark):
    assert one(spark, sc.logit(F.lit(None).cast("float"))) is None


def test_calibration_known_values(spark):
    perfect = [(0, (i + 0.5) / 10, j < 100 * (i + 0.5) / 10) for i in range(10) for j in range(100)]
    halves = [(1, 0.9, j % 2 == 0) for j in range(200)]
    few = [(2, 0.5, True)] * 5
    df = spark.createDataFrame(perfect + halves + few, "tenant_id int, predicted double, correct boolean")
    r = {x["tenant_id"]: x for x in ln.calibration(df, ["tenant_id"]).collect()}
    assert r[0]["ece"] <= 0.01
    assert (round(r[1]["ece"], 6), round(r[1]["mce"], 6), round(r[1]["brier"], 6)) == (0.4, 0.4, 0.41)
    assert r[2]["insufficient"] and not r[1]["insufficient"]


def test_learning_stats_ignore_decay(spark):
    t = dt.datetime(2024, 1, 5)
    rows = [(1, 7, t, "feedback", "feedback: helpful", 0.5, 0.6), (2, 7, t, "feedback", "feedback: unhelpful", 0.6, 0.5),
            (3, 7, t, "outcome", "outcome: helpful", 0.5, 0.7), (4, 7, t, "decay", "decay: pass", 0.9, 0.1), (5, 8, t, "decay", "decay: pass", 0.9, 0.1)]
    df = spark.createDataFrame(rows, "id long, agent_id long, created_at timestamp, mutation_type string, reason string, old_confidence float, new_confidence float")
    r = {x["agent_id"]: x for x in ln.learning_stats(df, "2024-01-01 00:00:00", "2024-02-01 00:00:00").collect()}
    assert (r[7]["increases"], r[7]["decreases"]) == (2, 1) and abs(r[7]["velocity"] - 1 / 3) < 1e-9 and abs(r[7]["stability"] - 2 / 3) < 1e-9
    assert r[8]["velocity"] is None and r[8]["stability"] is None


@pytest.mark.parametrize("sim,text,kind", [(0.3, "we switched to tea", "none"), (0.9, "does not matter", "none"), (0.6, "we switched to tea", "temporal"),
                                           (0.6, "they do not like tea", "hard"), (0.8, "tea again", "soft"), (0.6, "tea again", "none")])
def test_tension(spark, sim, text, kind):
    assert one(spark, sc.tension(F.lit(sim), F.lit(text)))["kind"] == kind


@pytest.mark.parametrize("text,kind", [("I LOVE tea", "preference"), ("We agreed to ship", "decision"), ("You must not run", "constraint"), ("Water is wet", "fact")])
def test_classify(spark, text, kind):
    assert one(spark, sc.classify_type(F.lit(text))) == kind


@pytest.mark.parametrize("text,want", [("[DATE: 2024/01/15 (Mon) 10:30] x", "2024-01-15 10:30:00"), ("[DATE: 2024/01/15] x", "2024-01-15 00:00:00"),
                                       ("[DATE: 2024-01-15T08:00:00Z]", "2024-01-15 08:00:00"), ("[DATE: January 2, 2006]", "2006-01-02 00:00:00"), ("no date", None), ("[DATE: soon]", None)])
def test_event_date(spark, text, want):
    got = one(spark, F.date_format(sc.event_date(F.lit(text)), "yyyy-MM-dd HH:mm:ss"))
    assert got == want


def test_cosine_edge_cases(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vc.cosine(a(1, 0), a(1, 0))) == 1.0
    assert one(spark, vc.cosine(a(1, 0), a(0, 0))) == 0.0
    assert one(spark, vc.cosine(a(1, 0), a(1, 0, 0))) == 0.0


def test_hash_vectors_are_stable_units():
    v = hash_vectors(["a", "b", "a"], 32)
    assert (v[0] == v[2]).all() and not (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-9


def test_validate_flags_broken_bindings(spark):
    rows = [(1, "fact", "user", "private", None, None, 0.5), (2, "fact", "user", "anchored", None, None, 0.5), (3, "odd", "user", "session", None, 4, 1.5)]
    df = spark.createDataFrame(rows, "id long, type string, provenance string, binding string, anchor_id long, session_id long, confidence float")
    r = {x["id"]: x["violations"] for x in bl.validate(df).collect()}
    assert r[1] == [] and r[2] == ["binding_ids"] and r[3] == ["confidence_range", "type_domain"]


def test_merge_keeps_first_side_on_ties(spark):
    cols = "session_id long, type string, id long, level double, confidence double, content string, source string, cue string"
    a = spark.createDataFrame([(1, "semantic", 1, 0.6, 0.5, "x", "direct", "a"), (1, "semantic", 2, 0.3, 0.5, "y", "direct", "a")], cols)
    b = spark.createDataFrame([(1, "semantic", 1, 0.5, 0.9, "z", "goal", "b"), (1, "semantic", 2, 0.4, 0.9, "z", "goal", "b")], cols)
    r = {x["id"]: x for x in wk.merge_activations(a, b, 1.2).collect()}
    assert r[1]["source"] == "direct" and r[2]["source"] == "goal" and abs(r[2]["level"] - 0.48) < 1e-9 and r[2]["content"] == "y"


def test_hash_of_texts_follows_their_bytes():
    texts = ["", "a", "né", "longer text", "a", "x" * 300]
    want = []
    for t in texts:
        h = FNV_OFFSET
        for byte in t.encode():
            h = (h ^ byte) * FNV_PRIME % (1 << 64)
        want.append(h)
    assert _seeds(texts).tolist() == want and _seeds([]).tolist() == []
