"""Consolidation: episode links, belief and procedure learning, clusters, merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beliefmill.functions import scalar as sc
from beliefmill.functions.vectors import unit_rows
from beliefmill.operators import dynamics as dy
from beliefmill.operators import graph as gr
from beliefmill.operators.beliefs import live
from beliefmill.operators.lifecycle import archive
from beliefmill.operators.ordering import number_rows
from beliefmill.operators.recall import find_similar
from beliefmill.operators.similarity import match_blocks, top_by
from beliefmill.session import instant, pin

# One pass of the order-dependent steps looks at this many rows of an agent in
# scan order; what stays open is carried to the next pass.
PASS_ROWS = 10_000
REDUNDANT_SIM, CLUSTER_SIM = 0.92, 0.65
MIN_EVIDENCE = 5


def episode_associations(ep: DataFrame) -> DataFrame:
    """Five nearest episodes (the episode itself counts among the five)."""
    keys = ["tenant_id", "agent_id"]
    e = ep.select("id", "emb", *keys)
    pairs = match_blocks(e.select(F.col("id").alias("lid"), F.col("emb").alias("lvec"), *keys),
                         e.select(F.col("id").alias("rid"), F.col("emb").alias("rvec"), *keys), keys, 0.7, k=5)
    return pairs.where(F.col("lid") != F.col("rid")).select(
        F.col("lid").alias("episode_id"), F.col("rid").alias("other_id"), F.lit("thematic").alias("association_type"), F.col("sim").alias("strength"))


def episode_memory_links(ep: DataFrame, mem: DataFrame) -> DataFrame:
    pairs = find_similar(ep, mem, 0.7)
    return pairs.select(F.lit("episodic").alias("source_type"), F.col("lid").alias("source_id"), F.lit("semantic").alias("target_type"),
                        F.col("rid").alias("target_id"), F.lit("thematic").alias("association_type"), F.col("sim").alias("strength"))


def encode_episodes(raw: DataFrame) -> DataFrame:
    """Defaults and calendar fields of new episodes."""
    return raw.withColumns({
        "memory_strength": F.lit(1.0).cast("float"), "decay_rate": F.lit(0.1).cast("float"),
        "importance_score": F.when(F.coalesce(F.col("importance_score"), F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("importance_score").cast("double")).cast("float"),
        "consolidation_status": F.lit("raw"), "time_of_day": sc.time_of_day(F.col("occurred_at")), "day_of_week": sc.weekday(F.col("occurred_at"))})


def _batch(ep: DataFrame, batch: int | None) -> DataFrame:
    if not batch:
        return ep
    return top_by(ep, ["agent_id"], [F.asc("occurred_at"), F.asc("id")], batch, "_b").drop("_b")


def process_raw(ep: DataFrame, batch: int | None = None) -> DataFrame:
    """Raw episodes turned processed (a batch per agent when asked)."""
    return _batch(ep.where(F.col("consolidation_status") == "raw"), batch).withColumn("consolidation_status", F.lit("processed"))


def extractable(ep: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """Processed episodes without derived beliefs; ``skip`` marks the ones that are
    abstracted without extraction."""
    rows = ep.where(F.col("consolidation_status") == "processed").dropDuplicates(["id"])
    if derived is not None:
        rows = rows.join(derived.select(F.col("episode_id").alias("id")).distinct(), "id", "left_anti")
    skip = (F.col("importance_score") < F.lit(0.6).cast("float")) & ~F.coalesce(F.col("outcome").isin("success", "failure"), F.lit(False))
    return rows.withColumn("skip", skip)


def consolidate_beliefs(ep: DataFrame, mem: DataFrame, extracted: DataFrame) -> DataFrame:
    """extracted(belief_key, episode_id, content, type, evidence, confidence, emb) of
    worthwhile episodes -> + (target_id, action, new_confidence for inserts)."""
    worth = extractable(ep).where(~F.col("skip")).select(F.col("id").alias("episode_id"), "tenant_id", "agent_id")
    rows = extracted.join(worth, "episode_id")
    keys = ["tenant_id", "agent_id"]
    near = match_blocks(rows.select(F.col("belief_key").alias("lid"), F.col("emb").alias("lvec"), *keys),
                        mem.where(live()).select(F.col("id").alias("rid"), F.col("emb").alias("rvec"), *keys), keys, 0.85, k=1)
    hit = near.select(F.col("lid").alias("belief_key"), F.col("rid").alias("target_id"))
    prior = F.when(F.coalesce("evidence", F.lit("")) != "", sc.evidence_prior(F.col("evidence"))).otherwise(F.col("confidence").cast("double"))
    return rows.join(hit, "belief_key", "left").withColumns({
        "action": F.when(F.col("target_id").isNotNull(), "reinforce").otherwise("insert"),
        "new_confidence": F.when(F.col("target_id").isNull(), 0.8 * prior)})


def belief_reinforcements(decided: DataFrame, mem: DataFrame) -> DataFrame:
    n = decided.where(F.col("action") == "reinforce").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    c = F.col("confidence").cast("double")
    up = F.least(c + 0.05 * F.col("n"), F.lit(0.99))
    return mem.join(n, "id").select("id", "n", up.alias("new_confidence"), (F.col("reinforcement_count") + F.col("n")).alias("new_count"))


def derived_associations(decided: DataFrame) -> DataFrame:
    """episode -> belief links of inserted beliefs."""
    return decided.where(F.col("action") == "insert").select(
        F.lit("episodic").alias("source_type"), F.col("episode_id").alias("source_id"), F.lit("semantic").alias("target_type"),
        F.col("belief_key").alias("target_id"), F.lit("derived").alias("association_type"), F.lit(0.9).alias("strength"))


def abstracted(ep: DataFrame) -> DataFrame:
    """Processed episodes after extraction."""
    return extractable(ep).withColumn("consolidation_status", F.lit("abstracted")).drop("skip")


def _nearest_procedure(rows: DataFrame, proc: DataFrame, theta: float) -> DataFrame:
    keys = ["tenant_id", "agent_id"]
    near = match_blocks(rows.select(F.col("episode_id").alias("lid"), F.col("emb").alias("lvec"), *keys),
                        proc.select(F.col("id").alias("rid"), F.col("emb").alias("rvec"), *keys), keys, theta, k=1)
    return near.select(F.col("lid").alias("episode_id"), F.col("rid").alias("procedure_id"), "sim")


def learn_procedures(ep: DataFrame, patterns: DataFrame, proc: DataFrame, now, theta: float = 0.9, days: int = 7,
                     derived: DataFrame | None = None) -> DataFrame:
    """patterns(episode_id, trigger_pattern, action_template, emb) of recent useful
    successes -> + (procedure_id, action): reinforce a near procedure or learn anew."""
    at = instant(now)
    good = ep.where((F.col("outcome") == "success") & (F.col("importance_score") >= F.lit(0.6).cast("float"))
                    & (F.col("occurred_at") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("occurred_at") <= at))
    if derived is not None:
        good = good.join(derived.select(F.col("episode_id").alias("id")).distinct(), "id", "left_anti")
    rows = patterns.where(F.coalesce("trigger_pattern", F.lit("")) != "").join(
        good.select(F.col("id").alias("episode_id"), "tenant_id", "agent_id"), "episode_id")
    return rows.join(_nearest_procedure(rows, proc, theta).drop("sim"), "episode_id", "left").withColumn(
        "action", F.when(F.col("procedure_id").isNotNull(), "reinforce").otherwise("learn"))


def procedure_reinforcements(learned: DataFrame, proc: DataFrame) -> DataFrame:
    n = learned.where(F.col("action") == "reinforce").groupBy(F.col("procedure_id").alias("id")).agg(F.count("*").alias("n"))
    return proc.join(n, "id").select("id", "n", F.least(F.col("confidence").cast("double") + 0.05 * F.col("n"), F.lit(0.99)).alias("new_confidence"))


def failed_procedures(ep: DataFrame, proc: DataFrame) -> DataFrame:
    """(procedure_id, failures): nearest procedure of every failed episode."""
    rows = ep.where(F.col("outcome") == "failure").select(F.col("id").alias("episode_id"), "emb", "tenant_id", "agent_id")
    return _nearest_procedure(rows, proc, 0.75).groupBy("procedure_id").agg(F.count("*").alias("failures"))


def record_uses(proc: DataFrame, uses: DataFrame) -> DataFrame:
    """uses(procedure_id, success, ts): counters and last use."""
    n = uses.groupBy(F.col("procedure_id").alias("id")).agg(F.count("*").alias("_n"), F.count_if("success").alias("_ok"), F.max("ts").alias("_at"))
    return proc.join(n, "id", "left").withColumns({
        "use_count": (F.col("use_count") + F.coalesce("_n", F.lit(0))).cast("int"), "success_count": (F.col("success_count") + F.coalesce("_ok", F.lit(0))).cast("int"),
        "last_used_at": F.greatest("last_used_at", "_at")}).drop("_n", "_ok", "_at")


def new_versions(proc: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(id, new_id, action_template): the new rows, linked to their predecessors."""
    c = changes.select("id", "new_id", F.col("action_template").alias("_a"))
    version = F.coalesce(F.col("version"), F.lit(1)) if "version" in proc.columns else F.lit(1)
    rows = proc.join(c, "id").withColumns({"previous_version_id": F.col("id"), "version": version + 1, "action_template": F.col("_a")})
    return rows.withColumn("id", F.col("new_id")).drop("new_id", "_a")


# -- order-dependent steps --------------------------------------------------

def _passes(mem: DataFrame, rows_per_pass: int) -> DataFrame:
    """Rows numbered in scan order and cut into passes of bounded size; ``final`` marks the
    last pass of an agent."""
    rows = mem.where(live() & F.col("emb").isNotNull()).select(
        "id", "agent_id", "type", F.col("confidence").cast("double").alias("confidence"), "reinforcement_count", "emb",
        F.coalesce(F.unix_micros("last_accessed_at"), F.lit(-1)).alias("_at"))
    out = number_rows(rows, ["agent_id"], [F.asc("_at"), F.asc("id")], "_n").drop("_at")
    out = out.withColumn("pass", F.floor((F.col("_n") - 1) / rows_per_pass).cast("long"))
    last = out.groupBy("agent_id").agg(F.max("pass").alias("_last"))
    return out.join(last, "agent_id").withColumn("final", F.col("pass") == F.col("_last")).drop("_last")


def _in_turn(mem: DataFrame, rows_per_pass: int, step, schema: T.StructType) -> DataFrame:
    """Run ``step(rows, state)`` over the passes of every agent in scan order, all agents side
    by side. Rows it returns with ``open`` are the state of the agent's next pass, the others
    are results. A task holds one pass and the state of one agent, and the outcome is the same
    for every pass size."""
    rows = pin(_passes(mem, rows_per_pass), "pass")
    passes = rows.select("pass").distinct().count()
    state, out = rows.sparkSession.createDataFrame([], schema), None
    for p in range(max(passes, 1)):
        both = rows.where(F.col("pass") == p).groupBy("agent_id").cogroup(state.groupBy("agent_id"))
        made = pin(both.applyInPandas(step, schema))
        state, done = made.where("open"), made.where("NOT open")
        out = done if out is None else out.unionByName(done)
    return out


def merge_redundant(mem: DataFrame, rows_per_pass: int = PASS_ROWS) -> DataFrame:
    """(id, agent_id, archived, new_confidence, new_count) of rows a merge touched.

    Only rows with a partner take part, found by an exact search that combines copies. A row
    that no earlier row absorbs stays open and meets all later ones, in later passes too; a row
    absorbed on arrival meets none, so copies don't add to what is carried.
    """
    schema = T.StructType([mem.schema["id"], mem.schema["agent_id"], T.StructField("archived", T.BooleanType()), T.StructField("new_confidence", T.DoubleType()),
                           T.StructField("new_count", T.LongType()), T.StructField("touched", T.BooleanType()), T.StructField("open", T.BooleanType()),
                           T.StructField("_n", T.LongType()), T.StructField("unit", T.ArrayType(T.DoubleType()))])

    def step(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new, old = new.sort_values("_n"), old.sort_values("_n")
        if not len(new):
            return old.iloc[:0]
        m, n = len(old), len(old) + len(new)
        fresh = unit_rows(np.stack(new["emb"].to_numpy()).astype(np.float64))
        unit = np.concatenate([np.stack(old["unit"].to_numpy()), fresh]) if m else fresh
        conf = np.concatenate([old["new_confidence"].to_numpy(np.float64), new["confidence"].to_numpy(np.float64)])
        count = np.concatenate([old["new_count"].to_numpy(np.int64), new["reinforcement_count"].to_numpy(np.int64)])
        gone = np.concatenate([old["archived"].to_numpy(bool), np.zeros(len(new), bool)])
        touched = np.concatenate([old["touched"].to_numpy(bool), np.zeros(len(new), bool)])
        opened = np.arange(n) < m
        vectors, at = np.empty_like(unit), np.empty(n, np.int64)  # of the open rows, in scan order
        vectors[:m], at[:m] = unit[:m], np.arange(m)
        for j in range(len(old), n):
            for i in at[:m][vectors[:m] @ unit[j] >= REDUNDANT_SIM]:
                keep, drop = (j, i) if conf[j] > conf[i] or count[j] > count[i] else (i, j)
                conf[keep], count[keep] = min(conf[keep] + 0.02, 0.99), count[keep] + 1
                gone[drop] = touched[drop] = touched[keep] = True
                if gone[j]:
                    break
            if not gone[j]:
                vectors[m], at[m], opened[j] = unit[j], j, True
                m += 1
        if bool(new["final"].iloc[0]):
            opened[:] = False
        out = pd.DataFrame({"id": pd.concat([old["id"], new["id"]], ignore_index=True), "agent_id": new["agent_id"].iloc[0], "archived": gone, "new_confidence": conf, "new_count": count,
                            "touched": touched, "open": opened, "_n": np.concatenate([old["_n"].to_numpy(np.int64), new["_n"].to_numpy(np.int64)]), "unit": list(unit)})
        return out[touched | opened]

    v = mem.where(live() & F.col("emb").isNotNull()).select("id", "emb", "agent_id")
    near = match_blocks(v.select(F.col("id").alias("lid"), F.col("emb").alias("lvec"), "agent_id"), v.select(F.col("id").alias("rid"), F.col("emb").alias("rvec"), "agent_id"),
                        ["agent_id"], REDUNDANT_SIM - 1e-9, k=1, drop_self=True)
    alike = mem.join(near.select(F.col("lid").alias("id")).distinct(), "id", "left_semi")
    return _in_turn(alike, rows_per_pass, step, schema).where("touched").select("id", "agent_id", "archived", "new_confidence", "new_count")


def cluster(mem: DataFrame, mode: str = "running", rows_per_pass: int = PASS_ROWS) -> DataFrame:
    """(cluster_id, agent_id, id, type): greedy centroid clusters in scan order. A row joins the
    oldest cluster whose centroid it matches, else it founds one; the centroid is a running
    mean, or the average of itself and each joiner ("pair"). Centroids are carried from pass to
    pass."""
    schema = T.StructType([T.StructField("cluster_id", T.StringType()), mem.schema["agent_id"], mem.schema["id"], T.StructField("type", T.StringType()),
                           T.StructField("open", T.BooleanType()), T.StructField("_n", T.LongType()), T.StructField("size", T.LongType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])

    def step(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new, old = new.sort_values("_n"), old.sort_values("_n")
        if not len(new):
            return old.iloc[:0]
        raw = np.stack(new["emb"].to_numpy()).astype(np.float64)
        unit, m = unit_rows(raw), len(old)
        centre = np.zeros((m + len(new), raw.shape[1]))
        if m:
            centre[:m] = np.stack(old["centre"].to_numpy())
        norm = np.linalg.norm(centre, axis=1)
        norm[norm == 0] = 1.0
        size = np.concatenate([old["size"].to_numpy(np.int64), np.zeros(len(new), np.int64)])
        first = np.concatenate([old["_n"].to_numpy(np.int64), np.zeros(len(new), np.int64)])
        names, agent, members = old["cluster_id"].tolist(), new["agent_id"].iloc[0], []
        for row, (key, number) in enumerate(zip(new["id"], new["_n"], strict=True)):
            near = np.flatnonzero(centre[:m] @ unit[row] / norm[:m] >= CLUSTER_SIM)
            if len(near):
                c = near[0]
                size[c] += 1
                centre[c] = centre[c] + (raw[row] - centre[c]) / size[c] if mode == "running" else (centre[c] + raw[row]) / 2
            else:
                c, m = m, m + 1
                names.append(f"{agent}:{key}")
                centre[c], size[c], first[c] = raw[row], 1, number
            norm[c] = np.linalg.norm(centre[c]) or 1.0
            members.append(names[c])
        made = pd.DataFrame({"cluster_id": members, "agent_id": agent, "id": new["id"].to_numpy(), "type": new["type"].to_numpy(), "open": False, "_n": new["_n"].to_numpy(), "size": 0, "centre": None})
        if bool(new["final"].iloc[0]):
            return made
        carried = pd.DataFrame({"cluster_id": names, "agent_id": agent, "id": new["id"].iloc[0], "type": None, "open": True, "_n": first[:m], "size": size[:m], "centre": list(centre[:m])})
        return pd.concat([made, carried], ignore_index=True)

    return _in_turn(mem, rows_per_pass, step, schema).select("cluster_id", "agent_id", "id", "type")


# -- schemas ----------------------------------------------------------------

def evidence_pool(mem: DataFrame, now) -> DataFrame:
    """Confident rows at least a day old."""
    old = F.unix_micros("created_at") <= F.unix_micros(instant(now)) - 86_400_000_000
    return mem.where(live() & old & (F.col("confidence") >= F.lit(0.6).cast("float")))


def form_schemas(members: DataFrame, patterns: DataFrame, sch: DataFrame, evidence: DataFrame, boost: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members(cluster_id, agent_id, id), patterns(cluster_id, schema_type, name),
    evidence(schema_id, memory_id).

    Gives (updated schemas with new confidence, new schemas, evidence rows to add).
    Evidence stays a table of pairs, so a schema may rest on any number of rows.
    """
    size = members.groupBy("cluster_id", "agent_id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_EVIDENCE)
    named = size.join(patterns.select("cluster_id", "schema_type", "name"), "cluster_id")
    known = named.join(sch.select(F.col("id").alias("schema_id"), "agent_id", "schema_type", "name", F.col("confidence").cast("double").alias("c")),
                       ["agent_id", "schema_type", "name"], "left")
    pairs = known.where(F.col("schema_id").isNotNull()).join(members.select("cluster_id", F.col("id").alias("memory_id")), "cluster_id").select("schema_id", "memory_id", "c")
    fresh = pairs.join(evidence.select("schema_id", "memory_id"), ["schema_id", "memory_id"], "left_anti")
    updated = fresh.groupBy("schema_id").agg(F.count_distinct("memory_id").alias("added"), F.first("c").alias("c")).select(
        "schema_id", "added", F.when(F.col("c") + boost * F.col("added") > 0.95, F.lit(0.95)).otherwise(F.col("c") + boost * F.col("added")).alias("new_confidence"))
    new = known.where(F.col("schema_id").isNull()).select(
        "cluster_id", "agent_id", "schema_type", "name", F.col("n").alias("evidence_count"), sc.initial_schema_confidence(F.col("n")).alias("confidence"))
    return updated, new, fresh.select("schema_id", "memory_id").distinct()


def schema_associations(new: DataFrame, members: DataFrame) -> DataFrame:
    return new.join(members.select("cluster_id", "id"), "cluster_id").select(
        F.lit("semantic").alias("source_type"), F.col("id").alias("source_id"), F.lit("schema").alias("target_type"),
        F.col("name").alias("target_id"), F.lit("derived").alias("association_type"), F.lit(0.8).alias("strength"))


def contradict_schemas(sch: DataFrame, events: DataFrame) -> DataFrame:
    """-0.1 per contradiction down to 0.1."""
    n = events.groupBy(F.col("schema_id").alias("id")).agg(F.count("*").alias("n"))
    c = F.col("confidence").cast("double")
    return sch.join(n, "id").select("id", F.col("n").alias("contradictions"), F.greatest(F.lit(0.1), c - 0.1 * F.col("n")).alias("new_confidence"))


def validate_schemas(sch: DataFrame, ids: DataFrame, now) -> DataFrame:
    return sch.join(ids.select("id").distinct(), "id", "left_semi").withColumn("last_validated_at", instant(now))


# -- compositions -----------------------------------------------------------

def forget(mem: DataFrame, ep: DataFrame, proc: DataFrame, edges: DataFrame, settings: DataFrame, now, full: bool = False) -> dict[str, DataFrame]:
    """Decay of every kind and, on a full run, merging and edge pruning."""
    decayed = dy.decay_pass(mem, settings, now)
    out = {"beliefs": decayed, "episodes": dy.decay_episodes(ep, now), "procedures": dy.decay_procedures(proc, now)}
    faded = dy.decay_edges(edges, now)
    out["edges"] = gr.prune_graph(faded, now) if full else faded
    if full:
        left = archive(mem, decayed.where("archived").select("id"))
        moved = decayed.where("changed").select("id", F.col("new_confidence").alias("_c"))
        out["merged"] = merge_redundant(left.join(moved, "id", "left").withColumn("confidence", F.coalesce(F.col("_c"), F.col("confidence").cast("double")).cast("float")).drop("_c"))
    return out


def consolidate_counts(mem: DataFrame, ep: DataFrame, proc: DataFrame, edges: DataFrame, settings: DataFrame, extracted: DataFrame, patterns: DataFrame, now) -> DataFrame:
    """Counters of one full consolidation per agent: (agent_id, stage, n)."""
    processed = process_raw(ep)
    after = processed.unionByName(ep.where(F.col("consolidation_status") == "processed"))
    beliefs = consolidate_beliefs(after, mem, extracted)
    procs = learn_procedures(ep, patterns, proc, now)
    clusters = cluster(evidence_pool(mem, now))
    big = clusters.groupBy("agent_id", "cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_EVIDENCE)
    parts = forget(mem, ep, proc, edges, settings, now)
    decayed = parts["beliefs"].where("changed")

    def tally(df, stage):
        return df.groupBy("agent_id").agg(F.count("*").alias("n")).select("agent_id", stage.alias("stage") if not isinstance(stage, str) else F.lit(stage).alias("stage"), "n")

    out = tally(processed, "processed")
    for df, stage in ((beliefs.where("action = 'insert'"), "extracted"), (beliefs.where("action = 'reinforce'"), "reinforced"), (procs.where("action = 'learn'"), "learned"),
                      (big, "clusters"), (decayed.where("NOT archived"), "decayed"), (decayed.where("archived"), "archived")):
        out = out.unionByName(tally(df, stage))
    return out
