"""Words inside texts and schema matching against brute force."""

import random

from pyspark.sql import functions as F

from beliefmill.operators import working as wk
from beliefmill.operators.phrases import words_inside


def test_words_inside_texts(spark):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, n)))
    words = [(rng.randint(0, 2), piece(6)) for _ in range(60)] + [(0, ""), (1, None), (None, "a"), (0, "not there")]
    texts = [(rng.randint(0, 2), piece(25)) for _ in range(60)] + [(0, ""), (1, None), (None, "a")]
    texts += texts[:10]
    got = words_inside(spark.createDataFrame(words, "k int, w string"), spark.createDataFrame(texts, "k int, x string"), ["k"])
    back = spark.createDataFrame(texts, "k int, x string").distinct().withColumn("tid", F.md5("x"))
    rows = [(r["k"], r["w"], r["x"]) for r in got.join(back, ["k", "tid"]).collect()]
    want = {(k, w, x) for k, w in words for j, x in texts if k == j and None not in (k, w, x) and w in x}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_schema_matching_equals_all_pairs(spark):
    rng = random.Random(7)
    topics, day = ["code", "review", "plan", "ops", "Coding"], ["morning", "evening", "night", None]
    sch = [(i, rng.randint(0, 1), [rng.choice(topics) for _ in range(rng.randint(0, 3))], {"time_preference": rng.choice(day[:3]), "work_hours": rng.choice(["evening and night", "none"])},
            rng.randint(20, 100) / 100, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    asks = [(q, rng.randint(0, 1), [rng.choice(["deep Coding", "a Review", "planning", "misc"]) for _ in range(rng.randint(0, 2))], rng.choice(day), [rng.gauss(0, 1) for _ in range(4)]) for q in range(25)]
    got = wk.match_schemas(spark.createDataFrame(sch, "id long, agent_id long, contexts array<string>, attributes map<string,string>, confidence double, emb array<double>"),
                           spark.createDataFrame(asks, "query_id long, agent_id long, contexts array<string>, time_of_day string, vec array<double>"), k=4, floor=0.1)
    have = {}
    for r in got.collect():
        have.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 8)))
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q, agent, said, t, v in asks:
        rows = []
        for i, own, ctx, at, c, e in sch:
            if own != agent:
                continue
            share = sum(any(w.lower() in x.lower() for x in said) for w in ctx) / len(ctx) if ctx and said else 0
            tm = 0 if t is None else 1.0 if at["time_preference"] == t else 0.8 if t in at["work_hours"] else 0
            sim = sum(a * b for a, b in zip(v, e)) / norm(v) / norm(e)
            s = (0.3 * share + 0.2 * tm + (0.5 * sim if sim > 0.5 else 0)) * c
            if s >= 0.1:
                rows.append((-round(s, 9), i, round(s, 8)))
        assert [(i, s) for _, i, s in sorted(have.get(q, []))] == [(i, s) for _, i, s in sorted(rows)[:4]]
