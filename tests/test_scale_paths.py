"""The paths that only large or skewed groups take, against brute force."""

import datetime as dt
import hashlib
import math
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from beliefmill.operators import audit as au
from beliefmill.operators import consolidate as co
from beliefmill.operators import dynamics as dy
from beliefmill.operators import graph as gr
from beliefmill.operators import ordering as od
from beliefmill.operators import recall as rc
from beliefmill.operators import similarity as sm


def vectors(n, dim=8, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    v = centres[rng.integers(0, 5, n)] + rng.normal(scale=0.5, size=(n, dim))
    if copies:
        v[:copies] = v[0]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, id_name, vec_name, key=0):
    return spark.createDataFrame([(i, [float(x) for x in r], key) for i, r in enumerate(v)], f"{id_name} long, {vec_name} array<double>, k int")


@pytest.mark.parametrize("theta", [0.3, 0.7, 0.9])
def test_blocked_threshold_join_is_exact(spark, theta):
    v = vectors(150, copies=50)
    got = sm.match_blocks(frame(spark, v, "lid", "lvec"), frame(spark, v, "rid", "rvec"), ["k"], theta, block_rows=16, n_pivots=7)
    pairs = [(r["lid"], r["rid"]) for r in got.collect()]
    want = {(i, j) for i in range(150) for j in range(150) if round(float(v[i] @ v[j]), 12) >= theta}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_all_pairs_leave_a_task_in_pieces(spark, monkeypatch):
    """A group of copies has as many pairs as the square of its rows; the task holds a tile of them."""
    taken, v = [], vectors(2)
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, func, schema: taken.append(func))
    sm.match_blocks(frame(spark, v, "lid", "lvec"), frame(spark, v, "rid", "rvec"), ["k"], 0.5)
    n, row, none = 4000, [[0.6, 0.8]], [None]
    sides = [{"lid": range(n), "lvec": row * n, "k": [0] * n, "rid": none * n, "rvec": none * n}, {"lid": none * n, "lvec": none * n, "k": [0] * n, "rid": range(n), "rvec": row * n}]
    kinds = pa.schema([("lid", pa.int64()), ("lvec", pa.list_(pa.float64())), ("k", pa.int32()), ("rid", pa.int64()), ("rvec", pa.list_(pa.float64()))])
    group = [pa.RecordBatch.from_pydict({c: list(x) for c, x in side.items()}, schema=kinds) for side in sides]
    tracemalloc.start()
    sizes = [b.num_rows for b in taken[0](iter(group))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n * n and max(sizes) <= sm.PAIR_ROWS and peak < 24 * n * n / 2


def test_carried_columns_leave_in_the_same_pieces(spark, monkeypatch):
    """What the left rows bring along to their pairs is copied for one piece at a time."""
    taken, v = [], vectors(2)
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, func, schema: taken.append(func))
    sm.match_blocks(frame(spark, v, "lid", "lvec").withColumn("mark", F.lit("x")), frame(spark, v, "rid", "rvec"), ["k"], 0.25, carry=("mark",))
    n, row, none = 600, [[0.6, 0.8]], [None]
    sides = [{"lid": range(n), "lvec": row * n, "mark": [f"m{i}" for i in range(n)], "rid": none * n, "rvec": none * n}, {"lid": none * n, "lvec": none * n, "mark": none * n, "rid": range(n), "rvec": row * n}]
    kinds = pa.schema([("lid", pa.int64()), ("lvec", pa.list_(pa.float64())), ("mark", pa.string()), ("rid", pa.int64()), ("rvec", pa.list_(pa.float64()))])
    out = list(taken[0](pa.RecordBatch.from_pydict({c: list(x) for c, x in side.items()}, schema=kinds) for side in sides))
    assert max(b.num_rows for b in out) <= sm.PAIR_ROWS
    rows = [r for b in out for r in b.to_pylist()]
    assert len({(r["lid"], r["rid"]) for r in rows}) == len(rows) == n * n and all(r["mark"] == f"m{r['lid']}" for r in rows)


def test_scattered_rows_are_not_sent_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)

    def routed(*_):
        raise AssertionError("a row would go to nearly all cells")

    monkeypatch.setattr(sm, "_route", routed)
    got = sm.match_blocks(frame(spark, v, "lid", "lvec"), frame(spark, v, "rid", "rvec"), ["k"], 0.5, k=3, block_rows=64, n_pivots=16)
    have = {}
    for r in got.collect():
        have.setdefault(r["lid"], []).append((r["rank"], r["rid"]))
    s = np.round(v @ v.T, 12)
    assert {i: [j for _, j in sorted(x)] for i, x in have.items()} == {i: sorted((j for j in range(900) if s[i, j] >= 0.5), key=lambda j: (-s[i, j], j))[:3] for i in range(900)}


def test_clustered_rows_are_routed_and_matched_exactly(spark):
    rng = np.random.default_rng(6)
    v = np.repeat(np.eye(12), 75, axis=0) + rng.normal(scale=0.01, size=(900, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = sm.match_blocks(frame(spark, v, "lid", "lvec"), frame(spark, v, "rid", "rvec"), ["k"], 0.9, block_rows=64, n_pivots=16)
    s = np.round(v @ v.T, 12)
    assert sorted((r["lid"], r["rid"]) for r in got.collect()) == [(i, j) for i in range(900) for j in range(900) if s[i, j] >= 0.9]


@pytest.mark.parametrize("block", [16, 4096])
def test_blocked_top_k_with_copies_is_exact(spark, block):
    v = vectors(120, copies=40)
    got = sm.match_blocks(frame(spark, v, "lid", "lvec"), frame(spark, v, "rid", "rvec"), ["k"], 0.5, k=4, drop_self=True, block_rows=block, n_pivots=6)
    have = {}
    for r in got.collect():
        have.setdefault(r["lid"], []).append((r["rank"], r["rid"]))
    s = np.round(v @ v.T, 12)
    for i in range(120):
        order = sorted((j for j in range(120) if j != i and s[i, j] >= 0.5), key=lambda j: (-s[i, j], j))[:4]
        assert [j for _, j in sorted(have.get(i, []))] == order


@pytest.mark.parametrize("block", [60, 4096])
def test_equal_places_in_order_leave_no_task_in_full(spark, monkeypatch, block):
    v = vectors(200)
    right = frame(spark, v, "rid", "rvec").withColumn("rord", F.when(F.col("rid") % 4 == 0, F.lit(5)).otherwise(F.lit(-1)).cast("long"))
    top, met = sm.top_by, []

    def counted(df, keys, order, k, out="rank"):
        if keys == ["lid"]:
            met.append(df.count())
        return top(df, keys, order, k, out)

    monkeypatch.setattr(sm, "top_by", counted)
    got = sm.match_blocks(frame(spark, v, "lid", "lvec"), right, ["k"], 0.2, k=3, order="rord", drop_self=True, block_rows=block, n_pivots=5)
    have = {}
    for r in got.collect():
        have.setdefault(r["lid"], []).append((r["rank"], r["rid"]))
    s = np.round(v @ v.T, 12)
    for i in range(200):
        assert [j for _, j in sorted(have.get(i, []))] == sorted((j for j in range(200) if j != i and s[i, j] >= 0.2), key=lambda j: (j % 4 == 0, j))[:3]
    # at most k and the row itself from each of the two cells or blocks a row meets
    assert met and met[0] <= 2 * 4 * 200


def test_blocked_first_by_order_is_exact(spark):
    v = vectors(90, copies=30)
    right = frame(spark, v, "rid", "rvec").withColumn("rord", (F.col("rid") * 37 % 90).cast("long"))
    got = sm.match_blocks(frame(spark, v, "lid", "lvec"), right, ["k"], 0.6, k=3, order="rord", drop_self=True, block_rows=16, n_pivots=5)
    have = {}
    for r in got.collect():
        have.setdefault(r["lid"], []).append((r["rank"], r["rid"]))
    s = np.round(v @ v.T, 12)
    for i in range(90):
        want = sorted((j for j in range(90) if j != i and s[i, j] >= 0.6), key=lambda j: (j * 37 % 90, j))[:3]
        assert [j for _, j in sorted(have.get(i, []))] == want


def test_many_queries_take_the_block_path(spark):
    v = vectors(60)
    rows = frame(spark, v, "id", "emb").select("id", "emb", F.lit(1).alias("tenant_id"), F.lit(2).alias("agent_id"))
    q = frame(spark, v[:9], "query_id", "vec").select("query_id", "vec", F.lit(1).alias("tenant_id"), F.when(F.col("query_id") % 2 == 0, 2).alias("agent_id"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(sm.score_queries(rows, q, k=5)) == key(sm.score_queries(rows, q, k=5, max_shipped=2))


def signals(spark, n, hot):
    kinds = ["helpful", "unhelpful", "used", "ignored", "contradicted", "outdated"]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 == 0 or hot else i % 7, t0 + dt.timedelta(minutes=(i * 7919) % 5000), kinds[(i * 31) % 6]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, memory_id long, created_at timestamp, signal_type string")


def replay(rows, conf, count):
    from beliefmill.functions.lexicon import FEEDBACK_EFFECTS

    state, log = {}, {}
    for i, m, at, s in sorted(rows, key=lambda r: (r[2], r[0])):
        c, n = state.get(m, (conf, count))
        p = min(max(c, 0.01), 0.99)
        x = math.log(p / (1 - p)) + FEEDBACK_EFFECTS[s][0]
        new = min(max(1 / (1 + math.exp(-x)), 0.01), 0.99)
        state[m] = (new, max(0, n + FEEDBACK_EFFECTS[s][1]))
        log[i] = (c, new)
    return state, log


def beliefs(spark, conf=0.6, count=2):
    return spark.createDataFrame([(i, conf, count) for i in range(8)], "id long, confidence double, reinforcement_count int")


@pytest.mark.parametrize("hot", [False, True])
def test_hot_belief_is_folded_over_many_slices(spark, hot):
    rows, df = signals(spark, 900, hot)
    state, log = replay(rows, 0.6, 2)
    steps = od.sliced(dy.feedback_events(df), ["memory_id"], [F.asc("at"), F.asc("event_id")])
    assert steps.where("memory_id = 1").select("_slice").distinct().count() > 1
    for r in dy.apply_feedback(beliefs(spark), df).collect():
        assert abs(r["new_confidence"] - state[r["memory_id"]][0]) < 1e-9 and r["new_count"] == state[r["memory_id"]][1]
    got = {r["event_id"]: (r["old_confidence"], r["new_confidence"]) for r in dy.feedback_log(beliefs(spark), dy.feedback_events(df)).collect()}
    assert set(got) == set(log) and all(abs(got[i][0] - log[i][0]) < 1e-9 and abs(got[i][1] - log[i][1]) < 1e-9 for i in log)


def test_a_long_run_on_one_belief_is_replayed_in_linear_time(spark):
    """200 000 events on one belief; the fold and the log agree with a plain loop."""
    from beliefmill.functions.lexicon import FEEDBACK_EFFECTS

    kinds = sorted(FEEDBACK_EFFECTS)
    df = spark.range(200_000).select("id", F.lit(1).cast("long").alias("memory_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 977)).alias("created_at"),
                                     F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.hash("id") % len(kinds) + len(kinds)).cast("int") % len(kinds) + 1).alias("signal_type"))
    rows = [tuple(r) for r in df.collect()]
    t0 = time.perf_counter()
    final = dy.apply_feedback(beliefs(spark), df).first()
    got = {r["event_id"]: r["new_confidence"] for r in dy.feedback_log(beliefs(spark), dy.feedback_events(df)).collect()}
    took = time.perf_counter() - t0
    state, log = replay(rows, 0.6, 2)
    assert abs(final["new_confidence"] - state[1][0]) < 1e-9 and final["n"] == len(rows)
    assert len(got) == len(log) and all(abs(got[i] - log[i][1]) < 1e-9 for i in log)
    assert took < 120


def test_row_numbers_and_previous_values_cross_slices(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("k"), ((F.col("id") * 7919) % 1009).alias("o"))
    got = {r["id"]: (r["seq"]) for r in od.number_rows(df, ["k"], [F.asc("o")]).collect()}
    prev = {r["id"]: (r["p"], r["n"]) for r in od.with_previous(df, ["k"], [F.asc("o")], {"id": "p"}, "n").collect()}
    for k in (0, 1):
        ids = sorted((i for i in range(1000) if (i % 3 == 0) == bool(k)), key=lambda i: i * 7919 % 1009)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
        assert [prev[i] for i in ids] == [(ids[n - 1] if n else None, n + 1) for n in range(len(ids))]


def log(spark, n=60):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 5, 1, i % 2, t0 + dt.timedelta(minutes=i), "feedback", "system", f"r{i}", 0.5, 0.6, hashlib.sha256(b"x").hexdigest(), "x") for i in range(n)]
    return spark.createDataFrame(rows, "id long, memory_id long, agent_id long, tenant_id long, created_at timestamp, mutation_type string, source_type string, reason string, "
                                       "old_confidence float, new_confidence float, content_hash string, content_snapshot string")


def test_segments_give_the_same_chain(spark):
    key = lambda df: {r["id"]: (r["seq"], r["prev_hash"], r["row_hash"]) for r in df.collect()}
    assert key(au.seal_chain(log(spark))) == key(au.seal_chain(log(spark), segment_rows=7))


def test_sealing_continues_from_heads(spark):
    first = au.seal_chain(log(spark).where("id < 30"))
    more = au.seal_chain(log(spark).where("id >= 30"), au.chain_heads(first))
    both = first.unionByName(more)
    assert all(r["valid"] for r in au.verify_chain(both, au.chain_heads(both)).collect())


@pytest.mark.parametrize("what,reason,seq", [
    ("edit", au.EDIT, 4), ("delete", au.LINK, 5), ("swap", au.LINK, 4), ("snapshot", au.SNAPSHOT, 4), ("truncate", "head mismatch", None), ("duplicate", au.LINK, 4)])
def test_tampering_is_found(spark, what, reason, seq):
    sealed = au.seal_chain(log(spark))
    heads = au.chain_heads(sealed)
    hit = (F.col("tenant_id") == 0) & (F.col("seq") == 4)
    if what == "edit":
        bad = sealed.withColumn("reason", F.when(hit, "forged").otherwise(F.col("reason")))
    elif what == "delete":
        bad = sealed.where(~hit)
    elif what == "swap":
        s = F.col("seq")
        bad = sealed.withColumn("seq", F.when((F.col("tenant_id") == 0) & s.isin(4, 5), 9 - s).otherwise(s))
    elif what == "snapshot":
        wrong = sealed.withColumn("content_snapshot", F.when(hit, "y").otherwise(F.col("content_snapshot")))
        # an attacker who reseals the row still fails on the sealed content hash
        wrong = wrong.drop("seq", "prev_hash", "row_hash", "hash_version")
        bad = au.seal_chain(wrong)
        heads = au.chain_heads(bad)
    elif what == "truncate":
        bad = sealed.where(~((F.col("tenant_id") == 0) & (F.col("seq") == 30)))
    else:
        bad = sealed.unionByName(sealed.where(hit))
    r = {x["tenant_id"]: x for x in au.verify_chain(bad, heads).collect()}
    assert r["1"]["valid"] and not r["0"]["valid"] and r["0"]["reason"].startswith(reason) and r["0"]["break_seq"] == seq


def cluster_input(spark, n=120):
    v = vectors(n, seed=9, copies=10)
    rows = [(i, i % 2, "fact", float((i * 37) % 100) / 100, i % 5, [float(x) for x in v[i]], False, "private", dt.datetime(2024, 1, 1 + i % 20)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, agent_id long, type string, confidence float, reinforcement_count int, emb array<double>, is_archived boolean, binding string, last_accessed_at timestamp")


def scan(rows, agent):
    return sorted((r for r in rows if r[1] == agent), key=lambda r: (r[8], r[0]))


@pytest.mark.parametrize("rows_per_pass", [10_000, 7])
def test_merging_follows_scan_order(spark, rows_per_pass):
    rows, df = cluster_input(spark)
    got = {r["id"]: (r["archived"], round(r["new_confidence"], 5), r["new_count"]) for r in co.merge_redundant(df, rows_per_pass).collect()}
    want = {}
    for agent in (0, 1):
        m = scan(rows, agent)
        c, n, gone = [np.float64(np.float32(r[3])) for r in m], [r[4] for r in m], set()
        for i in range(len(m)):
            if i in gone:
                continue
            for j in range(i + 1, len(m)):
                if j in gone or float(np.dot(m[i][5], m[j][5])) < 0.92:
                    continue
                k, d = (j, i) if c[j] > c[i] or n[j] > n[i] else (i, j)
                c[k], n[k] = min(c[k] + 0.02, 0.99), n[k] + 1
                gone.add(d)
                want[m[k][0]] = want[m[d][0]] = None
        for i, r in enumerate(m):
            if r[0] in want:
                want[r[0]] = (i in gone, round(float(c[i]), 5), n[i])
    assert got == want


@pytest.mark.parametrize("mode,rows_per_pass", [("running", 10_000), ("pair", 10_000), ("running", 11), ("pair", 11)])
def test_clusters_follow_scan_order(spark, mode, rows_per_pass):
    rows, df = cluster_input(spark)
    got = {r["id"]: r["cluster_id"] for r in co.cluster(df, mode, rows_per_pass).collect()}
    for agent in (0, 1):
        m, done = scan(rows, agent), {}
        for i, r in enumerate(m):
            if i in done:
                continue
            centre, size, done[i] = np.array(r[5]), 1, i
            for j in range(i + 1, len(m)):
                w = np.array(m[j][5])
                if j not in done and float(centre @ w) / (np.linalg.norm(centre) * np.linalg.norm(w)) >= 0.65:
                    size, done[j] = size + 1, i
                    centre = centre + (w - centre) / size if mode == "running" else (centre + w) / 2
        for i, s in done.items():
            assert got[m[i][0]] == f"{agent}:{m[s][0]}"


def test_entity_links_match_all_pairs_when_uncapped(spark):
    rows = [(e, m, ["subject", "object", "context"][(e + m) % 3]) for e in range(4) for m in range(12) if (e * m) % 5 != 1]
    df = spark.createDataFrame(rows, "entity_id long, memory_id long, mention_type string")
    w = {(e, m): {"subject": 0.9, "object": 0.7, "context": 0.4}[k] for e, m, k in rows}
    want = {}
    for (e, a), x in w.items():
        for (f, b), y in w.items():
            if e == f and a != b:
                want[a, b] = max(want.get((a, b), 0), math.sqrt(x * y))
    got = {(r["source_id"], r["target_id"]): r["strength"] for r in gr.entity_link_edges(df, per_source=50).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = {}
    for (a, b), s in want.items():
        top.setdefault(a, []).append((-round(s, 9), b))
    capped = {}
    for r in gr.entity_link_edges(df, per_source=3).collect():
        capped.setdefault(r["source_id"], set()).add(r["target_id"])
    assert all(capped[a] == {b for _, b in sorted(v)[:3]} for a, v in top.items())


def test_build_graph_keeps_all_links_of_a_hub(spark, tables):
    n, kinds = 130, ["subject", "object", "context"]
    rows = [(i % 3 and 900 or 901, i, kinds[i % 2]) for i in range(n)] + [(900, i, kinds[i % 3]) for i in range(0, n, 5)] + [(902, i, "subject") for i in (1, 3, 7)]
    mentions = spark.createDataFrame(rows, "entity_id long, memory_id long, mention_type string")
    first = tables.memv.where("NOT is_archived AND binding <> 'quarantine'").limit(1)
    copies = first.drop("id").crossJoin(spark.range(70)).select(*tables.memv.columns)
    none = spark.createDataFrame([], "source_id long, target_id long, relation_type string, strength double")
    edges, factors = gr.build_graph(copies, mentions, none)
    assert edges.where("relation_type = 'thematic'").count() == 70 * 69
    pairs = factors.alias("a").join(factors.alias("b"), "entity_id").where("a.memory_id <> b.memory_id")
    pairs = pairs.groupBy(F.col("a.memory_id").alias("source_id"), F.col("b.memory_id").alias("target_id")).agg(F.max(F.col("a.half") * F.col("b.half")).alias("strength"))
    all_pairs = pairs.withColumn("relation_type", F.lit("entity_link")).localCheckpoint()
    assert all_pairs.count() > 50 * n
    chain = spark.createDataFrame([(2, 200, "causal", 0.9), (5, 201, "causal", 0.8), (200, 4, "supports", 0.9)], none.schema)
    seeds = spark.createDataFrame([(1, 3, 0.9), (1, 5, 0.9), (1, 8, 0.7), (2, 6, 0.95), (2, 201, 0.6)], "query_id long, id long, score double")
    for more in ({}, {"min_strength": 0.75}, {"relations": ["entity_link"]}, {"relations": ["causal"]}):
        got, want = ({(r.query_id, r.id): (round(r.activation, 8), r.hops, tuple(r.path)) for r in x.collect()} for x in (
            gr.activate_graph(seeds, chain, factors=factors, **more), gr.activate_graph(seeds, chain.unionByName(all_pairs), **more)))
        assert got == want and got
    starts = seeds.where("id = 5")
    got, want = (sorted((r.path, round(r.strength, 8)) for r in x.collect()) for x in (
        gr.traverse_paths(starts, chain, 1, factors=factors), gr.traverse_paths(starts, chain.unionByName(all_pairs).where("source_id < target_id OR relation_type <> 'entity_link'"), 1)))
    assert got == want and len(got) > 50


def test_no_recall_shows_hidden_rows(spark, tables):
    q, m = tables.queries, tables.memv
    for df in (rc.recall_similarity(m, q, keep=("binding", "is_archived", "tenant_id")),
               rc.recall_composed(m, q).join(m.select("id", "binding", "is_archived", "tenant_id"), "id")):
        assert df.where("is_archived OR binding = 'quarantine'").count() == 0
        assert df.join(q.select("query_id", F.col("tenant_id").alias("qt")), "query_id").where("tenant_id <> qt").count() == 0


def feed(spark, folder, run, *parts):
    """Write the parts one after another and call ``run`` on the stream after each."""
    out = []
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/{i}")
        out.append(run(spark.readStream.schema(part.schema).parquet(f"{folder}/in/*")))
    return out


def test_late_events_are_dropped_and_counted(spark):
    from beliefmill.streaming.jobs import FeedbackStream, dropped, scratch, taken

    folder = scratch(spark, "late")
    job = FeedbackStream(spark, beliefs(spark), folder, delay="1 hour")
    assert {(r["confidence"], r["reinforcement_count"]) for r in job.result().collect()} == {(0.6, 2)}
    t = lambda h: dt.datetime(2024, 1, 1, h)
    cols = "id long, memory_id long, created_at timestamp, signal_type string"
    first = [(1, 1, t(1), "helpful"), (2, 1, t(9), "helpful")]
    second = [(3, 1, t(2), "outdated"), (2, 1, t(9), "helpful"), (4, 1, t(10), "used"), (5, 1, t(13), "used")]
    runs = feed(spark, folder, lambda s: job.run(s, f"{folder}/ckpt"), spark.createDataFrame(first, cols), spark.createDataFrame(second, cols))
    state, _ = replay([(1, 1, t(1), "helpful"), (2, 1, t(9), "helpful"), (4, 1, t(10), "used")], 0.6, 2)  # 5 waits
    r = job.result().where("id = 1").first()
    assert [dropped(q) for q in runs] == [0, 1] and abs(r["confidence"] - state[1][0]) < 1e-9 and r["reinforcement_count"] == state[1][1]
    # a batch that comes again after a failure overwrites its own rows
    steps = taken(spark, job.steps)
    last = steps.agg(F.max("batch")).first()[0]
    rest = steps.where(F.col("batch") < last).count()
    job.batch(spark.createDataFrame([], cols), last)
    assert taken(spark, job.steps).count() == rest


def test_access_totals_over_batches(spark):
    from beliefmill.streaming.jobs import AccessStream, scratch

    folder = scratch(spark, "hits")
    mem = beliefs(spark).withColumn("access_count", F.lit(3))
    job = AccessStream(spark, mem, folder)
    hits = spark.range(90).select((F.col("id") % 4).alias("memory_id"), F.timestamp_seconds("id").alias("ts"))
    feed(spark, folder, lambda s: job.run(s, f"{folder}/ckpt"), hits.where("memory_id < 2"), hits.where("memory_id > 0"))
    got = {r["id"]: (round(r["confidence"], 9), r["access_count"]) for r in job.result().collect()}
    n = {0: 23, 1: 46, 2: 22, 3: 22}
    assert got == {i: (round(min(0.6 + 0.02 * n.get(i, 0), 0.99), 9), 3 + n.get(i, 0)) for i in range(8)}


def test_replayed_rows_do_not_fork_a_chain(spark):
    from beliefmill.streaming.jobs import SealStream, scratch

    folder = scratch(spark, "seal")
    job, rows = SealStream(spark, folder), log(spark)
    feed(spark, folder, lambda s: job.run(s, f"{folder}/ckpt"), rows.where("id < 30"), rows.where("id >= 20"))
    out = au.verify_chain(job.log(), job.heads()).collect()
    assert all(r["valid"] for r in out) and sum(r["checked"] for r in out) == 60
    # a batch sealed again starts from the heads before it
    job.batch(rows.where("id >= 30"), spark.read.parquet(job.sealed).where("id >= 30").agg(F.max("batch")).first()[0])
    out = au.verify_chain(job.log(), job.heads()).collect()
    assert all(r["valid"] for r in out) and sum(r["checked"] for r in out) == 60


def test_entities_of_one_belief_stay_apart(spark):
    """A belief that names a person and a place resolves each by its own vector."""
    from beliefmill.operators.graph import resolve_entities

    ent = spark.createDataFrame([(1, 7, "Anna", "person", [1.0, 0.0], []), (2, 7, "Rome", "place", [0.0, 1.0], [])], "entity_id long, agent_id long, name string, entity_type string, emb array<double>, aliases array<string>")
    named = spark.createDataFrame([(5, 7, 0, "Annie", "person", [0.99, 0.1]), (5, 7, 0, "Roma", "place", [0.1, 0.99])], "memory_id long, agent_id long, tenant_id long, name string, entity_type string, emb array<double>")
    assert {(r["name"], r["entity_id"], r["how"]) for r in resolve_entities(named, ent).collect()} == {("Annie", 1, "vector"), ("Roma", 2, "vector")}


def test_large_query_set_keeps_negative_scores(spark):
    from beliefmill.operators.similarity import score_queries

    rows = spark.createDataFrame([(1, 0, 0, [-3.0, 0.0])], "id long, tenant_id long, agent_id long, emb array<double>")
    asked = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (2, 0, 0, [1.0, 0.0])], "query_id long, tenant_id long, agent_id long, vec array<double>")
    for most in (1, 10):
        assert sorted(r["score"] for r in score_queries(rows, asked, k=1, cosine=False, max_shipped=most).collect()) == [-3.0, -3.0]


def test_build_graph_gives_every_shared_entity_link(spark, tables):
    from beliefmill.plans import registry

    registry.load_all()
    got = registry.QUERIES["build_graph"](spark, tables.dir).where("entity_id IS NOT NULL")
    assert {(r.source_id, r.entity_id) for r in got.collect()} == {(r.memory_id, r.entity_id) for r in tables.mentions.collect()}


def test_schema_evidence_moves_no_pairs(spark, tables):
    from beliefmill.plans import registry

    registry.load_all()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES["schema_evidence"](spark, tables.dir)
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # from the top down, the contents are the only side that is dealt out above the pairs
    lines = [line.strip(" :+-*") for line in plan.splitlines()]
    top = next(i for i, line in enumerate(lines) if "ShuffledHashJoin" in line and "type" in line)
    pairs = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line and "label" in line)
    assert not any("Exchange hashpartitioning" in line for line in lines[top:pairs])


def test_graph_edges_are_those_of_the_whole_union_and_move_no_pairs(spark):
    """Ids that stand for several rows and pairs that are detected as well included."""
    v, theta = vectors(80, copies=12), 0.8
    rows = [(i % 70, 1, i % 2, i % 17 == 0, "quarantine" if i % 13 == 0 else "private", [float(x) for x in r]) for i, r in enumerate(v)]
    mem = spark.createDataFrame(rows, "id long, tenant_id long, agent_id long, is_archived boolean, binding string, emb array<double>")
    kinds = ["thematic", "causal", "supports", "no such"]
    detected = spark.createDataFrame([(i, j, kinds[(i + j // 2) % 4], ((i * 7 + j) % 11) / 10) for i in range(70) for j in range(70) if (i + j) % 2 == 0], "source_id long, target_id long, relation_type string, strength double")
    named = gr.relationship_edges(gr.relationship_candidates(mem), detected).select(*gr.EDGE, "strength")
    want = sorted((*r[:3], round(r[3], 9)) for r in gr.symmetrise(gr.thematic_edges(mem).unionByName(named)).collect())
    made = gr.graph_edges(mem, detected)
    assert sorted((*r[:3], round(r[3], 9)) for r in made.collect()) == want
    assert {r[2] for r in want} == {"thematic", "causal", "supports"} and any(r[2] == "thematic" and r[3] < theta for r in want)
    # ids of one row: nothing is grouped after the pairs are found
    lines = gr.thematic_both_ways(mem.where("id > 9"), theta)._jdf.queryExecution().executedPlan().toString().splitlines()
    found = next(i for i, line in enumerate(lines) if "InArrow" in line)
    assert not any("Exchange" in line for line in lines[:found])


def test_schema_evidence_of_factors_takes_little_space(spark, monkeypatch, tmp_path):
    """Pairs made from factors are those of the pair form, and lie so that they compress."""
    from beliefmill.operators import working as wk

    monkeypatch.setattr(wk, "HOLDER_BLOCK", 64)
    monkeypatch.setattr(wk, "ROW_BLOCK", 100)
    by = ["label", "agent_id"]
    sch = spark.range(2001).select(F.when(F.col("id") == 2000, 3).otherwise(F.col("id")).alias("id"), F.concat(F.lit("Supplier "), F.md5(F.col("id").cast("string"))).alias("name"),
                                   F.when(F.col("id") == 9, F.lit(None)).otherwise(F.lit(1)).alias("label"), (F.col("id") % 40 == 1).cast("int").alias("agent_id"))
    holders = sch.select(F.col("id").alias("schema_id"), *by)
    kinds = F.when(F.col("id") % 7 == 0, "procedural").when(F.col("id") % 2 == 0, "semantic").otherwise("episodic")
    rows = spark.range(460).select(kinds.alias("type"), "id", F.when(F.col("id") == 8, F.lit(None)).otherwise(F.lit(1)).alias("label"), (F.col("id") % 5 == 0).cast("int").alias("agent_id"))
    rows = rows.unionByName(rows.where("id = 10"))
    contents = rows.where("id % 11 <> 0").select("type", "id", F.lit("text").alias("content"), F.lit(0.5).alias("confidence")).distinct()
    cols = ["schema_id", "type", "id", "level", "cue", "content"]
    made = wk.schema_evidence(sch, rows, contents, by=by, holders=holders).select(*cols)
    pairs = wk.schema_evidence(sch, rows.join(holders, by).select("schema_id", "type", "id"), contents).select(*cols)
    made.select(*cols[:5]).write.parquet(f"{tmp_path}/made")
    assert pairs.count() > 500_000 and made.exceptAll(pairs).isEmpty() and pairs.exceptAll(made).isEmpty()
    assert sum(p.stat().st_size for p in (tmp_path / "made").glob("*.parquet")) < pairs.count()
