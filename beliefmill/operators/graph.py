"""Relation graph: building edges, traversal, closures, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.functions import lexicon as lx
from beliefmill.functions import scalar as sc
from beliefmill.functions.vectors import cosine
from beliefmill.operators.beliefs import active, live
from beliefmill.operators.recall import find_similar, recall_similarity
from beliefmill.operators.similarity import SIM_DIGITS, match_blocks, top_by
from beliefmill.session import instant, pin, small_side

EDGE = ["source_id", "target_id", "relation_type"]
MIN_ACTIVATION, SEED_SCORE = 0.1, 0.5
MAX_EDGES = 50
THEMATIC_SIM = 0.8
TRAVERSAL_GAIN = 0.03


# -- building ---------------------------------------------------------------

def symmetrise(edges: DataFrame) -> DataFrame:
    """Add the reverse of symmetric relations; the strongest of equal edges stays."""
    rows = edges.select(*EDGE, "strength")
    back = rows.where(F.col("relation_type").isin(*lx.SYMMETRIC_RELATIONS)).select(
        F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relation_type", "strength")
    return rows.unionByName(back).groupBy(*EDGE).agg(F.max("strength").alias("strength"))


def entity_link_factors(mentions: DataFrame) -> DataFrame:
    """Lossless form of all shared-entity links, one row per mention: two beliefs
    of one entity are linked with strength half_a * half_b. Size is linear in the
    mentions, whatever the size of the entity."""
    w = mentions.groupBy("entity_id", "memory_id").agg(F.max(sc.mention_weight(F.col("mention_type"))).alias("w"))
    return w.select("entity_id", "memory_id", F.sqrt("w").alias("half"))


def entity_link_edges(mentions: DataFrame, per_source: int = MAX_EDGES, new: DataFrame | None = None) -> DataFrame:
    """The strongest shared-entity edges per belief, at most the number a pruned graph
    keeps per source; ``entity_link_factors`` holds all links. A partner that makes a source's list is among the best
    ``per_source`` partners of the entity they share, so each entity offers only
    that many (plus one for the source itself) and no pair list is formed."""
    w = mentions.groupBy("entity_id", "memory_id").agg(F.max(sc.mention_weight(F.col("mention_type"))).alias("w"))
    offers = top_by(w, ["entity_id"], [F.desc("w"), F.asc("memory_id")], per_source + 1).select(
        "entity_id", F.col("memory_id").alias("target_id"), F.col("w").alias("tw"))
    sources = w if new is None else w.join(new.select("memory_id").distinct(), "memory_id", "left_semi")
    pairs = sources.withColumnRenamed("memory_id", "source_id").join(offers, "entity_id").where(F.col("source_id") != F.col("target_id"))
    best = pairs.groupBy("source_id", "target_id").agg(F.max(F.sqrt(F.col("w") * F.col("tw"))).alias("strength"))
    return top_by(best, ["source_id"], [F.desc("strength"), F.asc("target_id")], per_source).select(
        "source_id", "target_id", F.lit("entity_link").alias("relation_type"), "strength")


def thematic_edges(mem: DataFrame, theta: float = THEMATIC_SIM, per_source: int | None = None, one_way: bool = False) -> DataFrame:
    """Similar live rows; ``one_way`` gives each pair once, from the smaller id."""
    rows = mem.where(live())
    pairs = find_similar(rows, rows, theta, k=per_source, drop_self=True, one_way=one_way)
    return _thematic(pairs)


def _thematic(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("lid").alias("source_id"), F.col("rid").alias("target_id"), F.lit("thematic").alias("relation_type"), F.col("sim").alias("strength"))


def thematic_both_ways(mem: DataFrame, theta: float = THEMATIC_SIM) -> DataFrame:
    """``symmetrise(thematic_edges(mem))`` without moving its pairs: each is found once and
    given from either end. Only pairs of an id that stands for several rows are grouped."""
    rows = mem.where(live())
    twice = pin(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    several = small_side(twice)
    once = thematic_edges(rows.join(several, "id", "left_anti"), theta, one_way=True)
    ends = F.array(*[F.struct(F.col(x).alias("source_id"), F.col(y).alias("target_id")) for x, y in (("source_id", "target_id"), ("target_id", "source_id"))])
    out = once.select(F.explode(ends).alias("e"), "relation_type", "strength").select("e.*", "relation_type", "strength")
    if twice.isEmpty():
        return out
    return out.unionByName(symmetrise(_thematic(find_similar(rows.join(several, "id", "left_semi"), rows, theta, drop_self=True))))


def relationship_candidates(mem: DataFrame, theta: float = 0.5, n: int = 5) -> DataFrame:
    """Five nearest live rows per belief (the belief itself may be one of them)."""
    return find_similar(mem.where(active()), mem, theta, k=n)


def relationship_edges(candidates: DataFrame, detected: DataFrame) -> DataFrame:
    """Detector output kept for pairs that were offered and name a known relation."""
    offered = candidates.select(F.col("lid").alias("source_id"), F.col("rid").alias("target_id"))
    return detected.where(F.col("relation_type").isin(*lx.RELATIONS)).join(offered, ["source_id", "target_id"], "left_semi")


def resolve_entities(extracted: DataFrame, ent: DataFrame, theta: float = 0.85) -> DataFrame:
    """extracted + (entity_id, how): known name or alias, else the nearest entity of
    the same type, else new."""
    names = ent.select("agent_id", "entity_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("n"))
    names = names.groupBy("agent_id", F.lower("n").alias("key")).agg(F.min("entity_id").alias("by_name"))
    keyed = extracted.withColumn("key", F.lower("name")).join(names, ["agent_id", "key"], "left")
    rest = keyed.where(F.col("by_name").isNull() & F.col("emb").isNotNull())
    uniq = rest.groupBy("agent_id", "entity_type", "key").agg(F.min_by("emb", "memory_id").alias("emb"))
    # one belief may name several entities, so the name itself is the key of the search
    uniq = uniq.withColumn("lid", F.xxhash64("agent_id", "entity_type", "key"))
    near = match_blocks(
        uniq.select("lid", F.col("emb").alias("lvec"), "agent_id", "entity_type"),
        ent.select(F.col("entity_id").alias("rid"), F.col("emb").alias("rvec"), "agent_id", "entity_type"),
        ["agent_id", "entity_type"], theta, k=1)
    hit = uniq.join(near, "lid").select("agent_id", "entity_type", "key", F.col("rid").alias("by_vec"))
    out = keyed.join(hit, ["agent_id", "entity_type", "key"], "left")
    return out.withColumn("entity_id", F.coalesce("by_name", "by_vec")).withColumn(
        "how", F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_vec").isNotNull(), "vector").otherwise("new"))


def new_aliases(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("how") == "vector").select("entity_id", F.col("name").alias("alias")).distinct()


def new_entities(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("how") == "new").groupBy("agent_id", "entity_type", "key").agg(
        F.min("name").alias("name"), F.min_by("tenant_id", "memory_id").alias("tenant_id"))


def graph_edges(mem: DataFrame, detected: DataFrame, theta: float = THEMATIC_SIM) -> DataFrame:
    """Thematic and detected edges, symmetric ones from either end, the strongest of equal
    ones. The detected edges are few beside the thematic ones, so those that are thematic
    as well are settled on their own and the others are never grouped."""
    named = pin(symmetrise(relationship_edges(relationship_candidates(mem), detected).select(*EDGE, F.col("strength").cast("double").alias("strength"))))
    alike = named.where(F.col("relation_type") == "thematic")
    keys = ["tenant_id", "agent_id"]
    rows = mem.where(live() & F.col("emb").isNotNull()).select("id", "emb", *keys)
    rows = pin(rows.join(small_side(alike.select(F.col("source_id").alias("id")).distinct()), "id", "left_semi"))
    source, target = (rows.select(F.col("id").alias(f"{x}_id"), *[F.col(c).alias(f"_{x}_{c}") for c in ("emb", *keys)]) for x in ("source", "target"))
    met = alike.drop("strength").join(source, "source_id").join(target, "target_id").where(F.col("source_id") != F.col("target_id"))
    for c in keys:
        met = met.where(F.col(f"_source_{c}").eqNullSafe(F.col(f"_target_{c}")))
    sim = F.round(cosine(F.col("_source_emb"), F.col("_target_emb")), SIM_DIGITS)
    both = symmetrise(alike.unionByName(met.select(*EDGE, sim.alias("strength")).where(F.col("strength") >= theta)))
    rest = thematic_both_ways(mem, theta).join(small_side(alike.select("source_id", "target_id")), ["source_id", "target_id"], "left_anti")
    return rest.unionByName(both).unionByName(named.where(F.col("relation_type") != "thematic"))


def build_graph(mem: DataFrame, mentions: DataFrame, detected: DataFrame, links_only: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """(edges, factors): thematic and detected edges with symmetric ones reversed, ready for
    a greatest-upsert, and the shared-entity links as factors, to be joined at traversal.
    Nothing is capped here; ``prune_graph`` and ``cap_edges`` do that. With ``links_only``
    the edges, which take a search of their own, are left out."""
    return None if links_only else graph_edges(mem, detected), entity_link_factors(mentions)


# -- traversal --------------------------------------------------------------

def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, relation_type, strength): each edge seen from either end; two
    equi-joins instead of an OR join."""
    keep = [c for c in edges.columns if c not in ("source_id", "target_id")]
    return edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), *keep).unionByName(
        edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), *keep))


def wanted_links(factors: DataFrame | None, relations: list[str] | None) -> DataFrame | None:
    """Factors (entity_id, node, half), if shared-entity links are to be followed."""
    if factors is None or relations and "entity_link" not in relations:
        return None
    return factors.select("entity_id", F.col("memory_id").alias("node"), "half")


def activate_graph(seeds: DataFrame, edges: DataFrame, hops: int = 2, *, factors: DataFrame | None = None, relations: list[str] | None = None,
                   min_strength: float | None = None, created: DataFrame | None = None, now=None,
                   max_age_days: int | None = None, forward_causal: bool = False) -> DataFrame:
    """Spread seed scores over the graph.

    seeds: query_id, id, score. Result: query_id, id, activation, hops, path; the
    best activation per node at the hop that first reaches it (lowest path on a
    tie). ``created`` (id, created_at) is needed for the time constraints. ``factors``
    adds all shared-entity links: a hop goes from belief to entity to belief, and of the
    nodes that reach an entity with one half weight only the best goes on.
    """
    hop = both_ways(edges.select(*EDGE, "strength"))
    if relations:
        hop = hop.where(F.col("relation_type").isin(*relations))
    if min_strength:
        hop = hop.where(F.col("strength") >= F.lit(min_strength).cast("float"))
    timed = created is not None
    if timed:
        t = created.select(F.col("id").alias("other"), F.col("created_at").alias("other_at"))
        if max_age_days is not None:
            t = t.where(F.col("other_at") >= instant(now) - F.expr(f"INTERVAL {max_age_days} DAYS"))
        hop = hop.join(t, "other", "inner" if max_age_days is not None else "left")
        hop = hop.join(created.select(F.col("id").alias("node"), F.col("created_at").alias("node_at")), "node", "left")
        if forward_causal:
            backward = (F.col("relation_type") == "causal") & (F.col("other_at") < F.col("node_at"))
            hop = hop.where(~F.coalesce(backward, F.lit(False)))
    gain = F.col("strength").cast("double") * sc.relation_multiplier(F.col("relation_type"))
    hop = hop.select("node", "other", gain.alias("gain"))
    links = wanted_links(factors, relations)
    if links is not None:
        ends = links.select("entity_id", F.col("node").alias("other"), F.col("half").alias("other_half"))
        if timed and max_age_days is not None:
            ends = ends.join(t, "other", "left_semi")
    frontier = pin(seeds.where(F.col("score") > SEED_SCORE).select("query_id", F.col("id").alias("node"), F.col("score").cast("double").alias("a"), F.array("id").alias("path")))
    seen = frontier.select("query_id", F.col("node").alias("other"))
    found = None
    for h in range(1, hops + 1):
        # a small frontier goes to the edges, which then need no shuffle
        step = hop.join(small_side(frontier), "node").select("query_id", "other", (F.col("a") * F.col("gain")).alias("a"), "path")
        if links is not None:
            at = links.join(small_side(frontier), "node").groupBy("query_id", "entity_id", "half").agg(F.min(F.struct((-F.round("a", 9)).alias("na"), "path", "a")).alias("b"))
            via = at.join(ends, "entity_id").withColumn("s", F.col("half") * F.col("other_half"))
            if min_strength:
                via = via.where(F.col("s") >= F.lit(min_strength).cast("float"))
            step = step.unionByName(via.select("query_id", "other", (F.col("b.a") * (F.col("s") * sc.relation_multiplier(F.lit("entity_link")))).alias("a"), F.col("b.path").alias("path")))
        step = step.where(F.col("a") > MIN_ACTIVATION).join(small_side(seen), ["query_id", "other"], "left_anti")
        # compared at nine digits, so that equal products in another order tie
        best = step.groupBy("query_id", "other").agg(F.min(F.struct((-F.round("a", 9)).alias("na"), "path", "a")).alias("b")).select(
            "query_id", F.col("other").alias("node"), F.col("b.a").alias("a"), F.array_append("b.path", F.col("other")).alias("path"))
        if h < hops:
            # later hops read this frontier twice; keep it instead of recomputing it
            best = pin(best)
        part = best.select("query_id", F.col("node").alias("id"), F.col("a").alias("activation"), F.lit(h).alias("hops"), "path")
        found = part if found is None else found.unionByName(part)
        frontier = best
        seen = seen.unionByName(best.select("query_id", F.col("node").alias("other")))
    return found


def recall_hybrid(mem: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, hops: int = 2,
                  vector_weight: float = 0.6, graph_weight: float = 0.4, factors: DataFrame | None = None, **scope) -> DataFrame:
    """Vector hits (2k) and their graph neighbourhood fused by weighted sum."""
    seeds = pin(recall_similarity(mem, queries, k=2 * k, keep=(), **scope))
    reached = activate_graph(seeds, edges, hops, factors=factors)
    # graph hits must be readable: active rows of the query's tenant
    owned = reached.join(mem.where(active()).select("id", "tenant_id"), "id")
    graph = owned.join(queries.select("query_id", "tenant_id"), ["query_id", "tenant_id"], "left_semi")
    both = seeds.select("query_id", "id", F.col("score").alias("v")).join(
        graph.select("query_id", "id", F.col("activation").alias("g"), "hops"), ["query_id", "id"], "full_outer")
    scored = both.select("query_id", "id", F.coalesce("v", F.lit(0.0)).alias("vector_score"), F.coalesce("g", F.lit(0.0)).alias("graph_score"),
                         F.coalesce("hops", F.lit(0)).alias("hops"))
    scored = scored.withColumn("score", vector_weight * F.col("vector_score") + graph_weight * F.col("graph_score"))
    return top_by(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def recall_with_entities(results: DataFrame, names: DataFrame, ent: DataFrame, mentions: DataFrame, mem: DataFrame, k: int = 10) -> DataFrame:
    """Results (query_id, id, score) lifted by a tenth of the belief's confidence
    when it is among the k most confident beliefs of a named entity."""
    keys = ent.select("agent_id", "entity_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("n"))
    keys = keys.groupBy("agent_id", F.lower("n").alias("key")).agg(F.min("entity_id").alias("entity_id"))
    named = names.withColumn("key", F.lower("name")).join(keys, ["agent_id", "key"]).select("query_id", "entity_id").distinct()
    rows = memories_for_entity(mentions.join(named.select("entity_id").distinct(), "entity_id", "left_semi"), mem, k)
    lift = named.join(rows, "entity_id").groupBy("query_id", "id").agg(F.max(F.col("confidence").cast("double")).alias("_c"))
    return results.join(lift, ["query_id", "id"], "left").withColumn("score", F.col("score") + 0.1 * F.coalesce("_c", F.lit(0.0))).drop("_c")


def memories_for_entity(mentions: DataFrame, mem: DataFrame, n: int = 50) -> DataFrame:
    rows = mem.where(active()).select(F.col("id"), F.col("id").alias("memory_id"), "confidence", "created_at")
    hits = mentions.select("entity_id", "memory_id").distinct().join(rows, "memory_id")
    return top_by(hits, ["entity_id"], [F.desc("confidence"), F.desc("created_at"), F.asc("id")], n)


def entities_for_memory(mentions: DataFrame, ent: DataFrame) -> DataFrame:
    return mentions.join(ent.select("entity_id", "name", "entity_type"), "entity_id").select("memory_id", "entity_id", "name", "entity_type", "mention_type")


def traverse_paths(starts: DataFrame, edges: DataFrame, depth: int = 2, relations: list[str] | None = None, factors: DataFrame | None = None) -> DataFrame:
    """All paths from expanded nodes to nodes not expanded so far: query_id, path,
    path_length (nodes), strength. A node is expanded once, by its strongest path.
    ``factors`` adds all shared-entity links, formed for the expanded nodes only."""
    if not 1 <= depth <= 5:
        raise ValueError("depth must be between 1 and 5")
    hop = both_ways(edges.select(*EDGE, "strength"))
    if relations:
        hop = hop.where(F.col("relation_type").isin(*relations))
    hop = hop.select("node", "other", F.col("strength").cast("double").alias("s"))
    frontier = pin(starts.select("query_id", F.col("id").alias("node"), F.lit(1.0).alias("strength"), F.array("id").alias("path")))
    seen, out = frontier.select("query_id", F.col("node").alias("other")), None
    links = wanted_links(factors, relations)
    for d in range(1, depth + 1):
        near = hop
        if links is not None:
            own = links.join(small_side(frontier.select("node").distinct()), "node")
            other = links.select("entity_id", F.col("node").alias("other"), F.col("half").alias("other_half"))
            pairs = own.join(other, "entity_id").where(F.col("node") != F.col("other"))
            near = hop.unionByName(pairs.groupBy("node", "other").agg(F.max(F.col("half") * F.col("other_half")).alias("s")))
        step = near.join(small_side(frontier), "node").join(small_side(seen), ["query_id", "other"], "left_anti").select(
            "query_id", F.col("other").alias("node"), (F.col("strength") * F.col("s")).alias("strength"), F.array_append("path", F.col("other")).alias("path"))
        part = step.select("query_id", "path", F.size("path").alias("path_length"), "strength")
        out = part if out is None else out.unionByName(part)
        if d == depth:
            break
        best = step.groupBy("query_id", "node").agg(F.min(F.struct((-F.round("strength", 9)).alias("ns"), "path", "strength")).alias("b"))
        frontier = pin(best.select("query_id", "node", F.col("b.strength").alias("strength"), F.col("b.path").alias("path")))
        seen = seen.unionByName(frontier.select("query_id", F.col("node").alias("other")))
    return out


def relationships(starts: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Edges around each start, by the depth at which they first appear."""
    if not 1 <= depth <= 3:
        raise ValueError("depth must be between 1 and 3")
    keep = ["relation_type", "strength", "traversal_count"]
    ends = edges.select("source_id", "target_id", *keep)
    seen = pin(starts.select("query_id", F.col("id").alias("node")))
    fresh, out = seen, None
    for d in range(1, depth + 1):
        near = small_side(fresh)
        touch = ends.withColumn("node", F.col("source_id")).join(near, "node").unionByName(
            ends.withColumn("node", F.col("target_id")).join(near, "node")).drop("node").distinct()
        nodes = touch.select("query_id", F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
        part = touch.withColumn("depth", F.lit(d))
        out = part if out is None else out.unionByName(part)
        if d == depth:
            break
        fresh = pin(nodes.join(seen, ["query_id", "node"], "left_anti"))
        seen = seen.unionByName(fresh)
    return out.groupBy("query_id", "source_id", "target_id", *keep).agg(F.min("depth").alias("depth"))


def derived_closure(roots: DataFrame, edges: DataFrame, mem: DataFrame) -> DataFrame:
    """Active beliefs derived, directly or not, from the roots of the same tenant.

    roots: tenant_id, id. Semi-naive: every round joins only the newly found rows
    and is written out, so plans stay short and cycles end.
    """
    links = edges.where(F.col("relation_type") == "derived_from").select(F.col("source_id").alias("child"), F.col("target_id").alias("id"))
    rows = mem.where(active() & ~F.col("content").startswith("enc:v1:")).select("tenant_id", F.col("id").alias("child"))
    links = links.join(rows, "child")
    roots = roots.select("tenant_id", "id").distinct()
    found = fresh = pin(roots)
    while True:
        step = fresh.join(links, ["tenant_id", "id"]).select("tenant_id", F.col("child").alias("id")).distinct()
        fresh = pin(step.join(found, ["tenant_id", "id"], "left_anti"))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found.join(roots, ["tenant_id", "id"], "left_anti")


# -- upkeep -----------------------------------------------------------------

def apply_traversals(edges: DataFrame, events: DataFrame) -> DataFrame:
    """+0.03 per traversal up to 1, counted per edge first."""
    n = events.groupBy(*EDGE).agg(F.count("*").alias("_n"), F.max("ts").alias("last_traversed_at"))
    return edges.join(n, EDGE, "left").withColumns({
        "strength": F.least(F.lit(1.0), F.col("strength").cast("double") + TRAVERSAL_GAIN * F.coalesce("_n", F.lit(0))),
        "traversal_count": F.col("traversal_count") + F.coalesce("_n", F.lit(0))}).drop("_n")


def cap_edges(edges: DataFrame, n: int = MAX_EDGES) -> DataFrame:
    return top_by(edges, ["source_id"], [F.desc("strength"), F.asc("target_id"), F.asc("relation_type")], n).drop("rank")


def prune_graph(edges: DataFrame, now, weak: float = 0.05, stale_days: int = 90, n: int = MAX_EDGES) -> DataFrame:
    """Edges left after dropping weak, then stale, then surplus ones."""
    seen = F.coalesce("last_traversed_at", "created_at") if "last_traversed_at" in edges.columns else F.col("created_at")
    stale = (seen < instant(now) - F.expr(f"INTERVAL {stale_days} DAYS")) & (F.col("traversal_count") < 3)
    return cap_edges(edges.where((F.col("strength") >= F.lit(weak).cast("float")) & ~stale), n)


def purge_links(ids: DataFrame, mentions: DataFrame, edges: DataFrame, assoc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, edges and associations that touch none of the ids."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()

    def without(df, col, only=None):
        hit = df[col] == F.col("_gone")
        return df.join(gone, hit if only is None else hit & only, "left_anti")

    kept = without(without(edges, "source_id"), "target_id")
    a = without(assoc, "source_id", assoc["source_type"] == "semantic")
    a = without(a, "target_id", a["target_type"] == "semantic")
    return without(mentions, "memory_id"), kept, a
