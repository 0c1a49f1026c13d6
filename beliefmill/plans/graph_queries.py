"""Graph queries."""

from pyspark.sql import functions as F

from beliefmill.operators import graph as gr
from beliefmill.operators.recall import recall_similarity
from beliefmill.plans.belief_queries import pos
from beliefmill.plans.recall_queries import FROM, OPEN, SIM, r6
from beliefmill.plans.registry import query
from beliefmill.plans.tables import NOW

W = "CASE mention_type WHEN 'subject' THEN 0.9 WHEN 'object' THEN 0.7 ELSE 0.4 END::DOUBLE"
MW = f"mw AS (SELECT entity_id, memory_id, max({W}) AS w FROM mentions GROUP BY ALL)"
ENT_EDGES = f"""{MW}, ep0 AS (SELECT a.memory_id AS source_id, b.memory_id AS target_id, max(sqrt(a.w * b.w)) AS strength FROM mw a JOIN mw b ON a.entity_id = b.entity_id AND a.memory_id <> b.memory_id GROUP BY ALL),
ee AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, target_id) AS rk FROM ep0) x WHERE rk <= 50)"""
LIVEV = "lv AS (SELECT m.*, v.emb FROM mem m JOIN vecs v ON v.vec_id = m.id WHERE NOT is_archived AND binding <> 'quarantine')"
SYM = "('entity_link', 'thematic', 'supports')"


def edges3(df):
    return df.select("source_id", "target_id", "relation_type", r6("strength", "strength"))


@query("entity_link_factors", "mentions", f"WITH {MW} SELECT entity_id, memory_id, round(sqrt(w), 6) AS half FROM mw")
def entity_link_factors(t):
    return gr.entity_link_factors(t.mentions).select("entity_id", "memory_id", r6("half", "half"))


@query("entity_link_edges", "mentions", f"WITH {ENT_EDGES} SELECT source_id, target_id, 'entity_link' AS relation_type, round(strength, 6) AS strength FROM ee")
def entity_link_edges(t):
    return edges3(gr.entity_link_edges(t.mentions))


@query("thematic_edges", "mem vecs", f"""
WITH {LIVEV} SELECT a.id AS source_id, b.id AS target_id, 'thematic' AS relation_type, round(list_cosine_similarity(a.emb, b.emb), 6) AS strength FROM lv a JOIN lv b ON a.agent_id = b.agent_id AND a.tenant_id = b.tenant_id AND a.id <> b.id WHERE list_cosine_similarity(a.emb, b.emb) >= 0.8""")
def thematic_edges(t):
    return edges3(gr.thematic_edges(t.memv))


CAND = f"""cd AS (SELECT lid, rid, sim FROM (SELECT a.id AS lid, b.id AS rid, list_cosine_similarity(a.emb, b.emb) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.emb, b.emb) DESC, b.id) AS rk
 FROM (SELECT m.*, v.emb FROM mem m JOIN vecs v ON v.vec_id = m.id WHERE NOT is_archived) a JOIN lv b ON a.agent_id = b.agent_id AND a.tenant_id = b.tenant_id WHERE list_cosine_similarity(a.emb, b.emb) >= 0.5) x WHERE rk <= 5)"""


@query("relationship_candidates", "mem vecs", f"WITH {LIVEV}, {CAND} SELECT lid, rid, round(sim, 6) AS sim FROM cd")
def relationship_candidates(t):
    return gr.relationship_candidates(t.memv).select("lid", "rid", r6("sim", "sim"))


@query("relationship_edges", "mem vecs edges", f"""
WITH {LIVEV}, {CAND} SELECT e.source_id, e.target_id, e.relation_type, round(e.strength::DOUBLE, 6) AS strength FROM edges e WHERE EXISTS (SELECT 1 FROM cd WHERE lid = e.source_id AND rid = e.target_id)""")
def relationship_edges(t):
    return edges3(gr.relationship_edges(gr.relationship_candidates(t.memv), t.edges))


RESOLVE = """en AS (SELECT e.*, v.emb FROM ent e LEFT JOIN vecs v ON v.vec_id = e.entity_id),
nm AS (SELECT agent_id, lower(n) AS key, min(entity_id) AS by_name FROM (SELECT agent_id, entity_id, unnest([name, alias]) AS n FROM en) x GROUP BY ALL),
k AS (SELECT x.*, lower(x.name) AS key, by_name, v.emb FROM extracted x LEFT JOIN vecs v ON v.vec_id = x.vec_id LEFT JOIN nm ON nm.agent_id = x.agent_id AND nm.key = lower(x.name)),
u AS (SELECT agent_id, entity_type, key, arg_min(emb, memory_id) AS emb, min(memory_id) AS lid FROM k WHERE by_name IS NULL GROUP BY ALL),
h AS (SELECT * FROM (SELECT u.agent_id, u.entity_type, u.key, en.entity_id AS by_vec, row_number() OVER (PARTITION BY u.lid ORDER BY list_cosine_similarity(u.emb, en.emb) DESC, en.entity_id) AS rk
  FROM u JOIN en ON en.agent_id = u.agent_id AND en.entity_type = u.entity_type WHERE list_cosine_similarity(u.emb, en.emb) >= 0.85) y WHERE rk = 1),
res AS (SELECT k.*, coalesce(by_name, by_vec) AS entity_id, CASE WHEN by_name IS NOT NULL THEN 'name' WHEN by_vec IS NOT NULL THEN 'vector' ELSE 'new' END AS how FROM k LEFT JOIN h ON h.agent_id = k.agent_id AND h.entity_type = k.entity_type AND h.key = k.key)"""


def _entities(t):
    return t.with_vec(t.ent.withColumn("vec_id", F.col("entity_id"))).withColumn("aliases", F.array("alias"))


def _resolved(t):
    return gr.resolve_entities(t.with_vec(t.extracted), _entities(t))


@query("resolve_entities", "ent vecs extracted", f"WITH {RESOLVE} SELECT memory_id, name, entity_id, how FROM res")
def resolve_entities(t):
    return _resolved(t).select("memory_id", "name", "entity_id", "how")


@query("new_entities", "ent vecs extracted", f"WITH {RESOLVE} SELECT agent_id, entity_type, key, min(name) AS name, arg_min(tenant_id, memory_id) AS tenant_id FROM res WHERE how = 'new' GROUP BY 1, 2, 3")
def new_entities(t):
    return gr.new_entities(_resolved(t))


@query("new_aliases", "ent vecs extracted", f"WITH {RESOLVE} SELECT DISTINCT entity_id, name AS alias FROM res WHERE how = 'vector'")
def new_aliases(t):
    return gr.new_aliases(_resolved(t))


SYMM = f"(SELECT source_id, target_id, relation_type, max(strength) AS strength FROM (SELECT source_id, target_id, relation_type, strength FROM %s UNION ALL SELECT target_id, source_id, relation_type, strength FROM %s WHERE relation_type IN {SYM}) z GROUP BY 1, 2, 3)"


@query("symmetrise", "edges", f"SELECT source_id, target_id, relation_type, round(strength::DOUBLE, 6) AS strength FROM {SYMM % ('edges', 'edges')} s")
def symmetrise(t):
    return edges3(gr.symmetrise(t.edges))


@query("build_graph", "mem vecs mentions edges", f"""
WITH {MW}, {LIVEV}, {CAND},
th AS (SELECT a.id AS source_id, b.id AS target_id, list_cosine_similarity(a.emb, b.emb) AS strength FROM lv a JOIN lv b ON a.agent_id = b.agent_id AND a.tenant_id = b.tenant_id AND a.id <> b.id WHERE list_cosine_similarity(a.emb, b.emb) >= 0.8),
al AS (SELECT source_id, target_id, 'thematic' AS relation_type, strength FROM th
 UNION ALL SELECT e.source_id, e.target_id, e.relation_type, e.strength::DOUBLE FROM edges e WHERE EXISTS (SELECT 1 FROM cd WHERE lid = e.source_id AND rid = e.target_id))
SELECT source_id, target_id, relation_type, round(strength, 6) AS strength, NULL::BIGINT AS entity_id FROM {SYMM % ('al', 'al')} s
UNION ALL SELECT memory_id, NULL, 'entity_link', round(sqrt(w), 6), entity_id FROM mw""")
def build_graph(t):
    # all shared-entity links come as factors: a belief without target, its half of the strength, and its entity
    edges, factors = gr.build_graph(t.memv, t.mentions, t.edges)
    links = factors.select(F.col("memory_id").alias("source_id"), F.lit(None).cast("long").alias("target_id"), F.lit("entity_link").alias("relation_type"), r6("half", "strength"), "entity_id")
    return edges3(edges).withColumn("entity_id", F.lit(None).cast("long")).unionByName(links)


@query("build_graph_links", "mentions", f"WITH {MW} SELECT memory_id, entity_id, round(sqrt(w), 6) AS half FROM mw")
def build_graph_links(t):
    return gr.build_graph(t.memv, t.mentions, t.edges, links_only=True)[1].select("memory_id", "entity_id", r6("half", "half"))


MULT = "CASE relation_type WHEN 'entity_link' THEN 0.7 WHEN 'causal' THEN 0.9 WHEN 'temporal' THEN 0.6 WHEN 'thematic' THEN 0.7 WHEN 'supports' THEN 0.85 WHEN 'contradicts' THEN 0.95 WHEN 'derived_from' THEN 0.8 ELSE 0.9 END::DOUBLE"
BW = "(SELECT source_id AS node, target_id AS other, relation_type, strength FROM edges UNION ALL SELECT target_id, source_id, relation_type, strength FROM edges)"


# shared-entity links as pairs, uncapped
LINKED = f"(SELECT * FROM {BW} e UNION ALL SELECT a.memory_id, b.memory_id, 'entity_link', sqrt(a.w) * sqrt(b.w) FROM ({MW.removeprefix('mw AS (')} a JOIN ({MW.removeprefix('mw AS (')} b ON a.entity_id = b.entity_id AND a.memory_id <> b.memory_id)"


def activate_sql(where="true", join="", ways=BW):
    return f"""hop AS (SELECT node, other, max(strength::DOUBLE * {MULT}) AS gain FROM {ways} b {join} WHERE {where} GROUP BY ALL),
f0 AS (SELECT query_id, id AS node, score AS a, [id] AS path FROM seeds WHERE score > 0.5),
s1 AS (SELECT f.query_id, h.other, f.a * h.gain AS a, list_append(f.path, h.other) AS path FROM f0 f JOIN hop h ON h.node = f.node WHERE f.a * h.gain > 0.1 AND NOT EXISTS (SELECT 1 FROM f0 z WHERE z.query_id = f.query_id AND z.node = h.other)),
f1 AS (SELECT query_id, other AS node, a, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, other ORDER BY round(a, 9) DESC, path) AS rk FROM s1) x WHERE rk = 1),
s2 AS (SELECT f.query_id, h.other, f.a * h.gain AS a, list_append(f.path, h.other) AS path FROM f1 f JOIN hop h ON h.node = f.node WHERE f.a * h.gain > 0.1
  AND NOT EXISTS (SELECT 1 FROM f0 z WHERE z.query_id = f.query_id AND z.node = h.other) AND NOT EXISTS (SELECT 1 FROM f1 z WHERE z.query_id = f.query_id AND z.node = h.other)),
f2 AS (SELECT query_id, other AS node, a, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, other ORDER BY round(a, 9) DESC, path) AS rk FROM s2) x WHERE rk = 1),
act AS (SELECT *, 1 AS hops FROM f1 UNION ALL SELECT *, 2 AS hops FROM f2)"""


SEEDS = f"""seeds AS (SELECT * FROM (SELECT q.query_id, m.id, {SIM} AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY {SIM} DESC, m.id) AS rk {FROM} WHERE {OPEN}) x WHERE rk <= 20)"""
ACT_OUT = "SELECT query_id, node AS id, round(a, 6) AS activation, hops, array_to_string(list_transform(path, lambda p: p::VARCHAR), '>') AS path FROM act"


def act_cols(df):
    return df.select("query_id", "id", r6("activation", "activation"), "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("activate_graph", "mem vecs queries edges", f"WITH {SEEDS}, {activate_sql()} {ACT_OUT}")
def activate_graph(t):
    return act_cols(gr.activate_graph(recall_similarity(t.memv, t.queries, k=20, keep=()), t.edges))


@query("activate_graph_links", "mem vecs queries edges mentions", f"WITH {SEEDS}, {activate_sql(ways=LINKED)} {ACT_OUT}")
def activate_graph_links(t):
    """With all shared-entity links, as ``build_graph`` gives them."""
    return act_cols(gr.activate_graph(recall_similarity(t.memv, t.queries, k=20, keep=()), t.edges, factors=gr.entity_link_factors(t.mentions)))


@query("activate_constrained", "mem vecs queries edges", f"""
WITH {SEEDS}, {activate_sql("relation_type IN ('causal', 'supports', 'contradicts') AND strength >= 0.3::FLOAT AND o.created_at >= :now - INTERVAL 25 DAY AND NOT (relation_type = 'causal' AND o.created_at < n.created_at)",
  "JOIN mem o ON o.id = b.other JOIN mem n ON n.id = b.node")} {ACT_OUT}""")
def activate_constrained(t):
    seeds = recall_similarity(t.memv, t.queries, k=20, keep=())
    return act_cols(gr.activate_graph(seeds, t.edges, relations=["causal", "supports", "contradicts"], min_strength=0.3,
                                      created=t.mem.select("id", "created_at"), now=NOW, max_age_days=25, forward_causal=True))


def hybrid_sql(ways=BW):
    return f"""{SEEDS}, {activate_sql(ways=ways)},
vis AS (SELECT a.query_id, a.node AS id, a.a AS g, a.hops FROM act a JOIN mem m ON m.id = a.node JOIN queries q ON q.query_id = a.query_id AND q.tenant_id = m.tenant_id WHERE NOT m.is_archived),
j AS (SELECT coalesce(s.query_id, v.query_id) AS query_id, coalesce(s.id, v.id) AS id, coalesce(score, 0) AS v, coalesce(g, 0) AS g, coalesce(hops, 0) AS hops FROM seeds s FULL OUTER JOIN vis v ON v.query_id = s.query_id AND v.id = s.id),
hy AS (SELECT * FROM (SELECT *, 0.6 * v + 0.4 * g AS final, row_number() OVER (PARTITION BY query_id ORDER BY 0.6 * v + 0.4 * g DESC, id) AS rank FROM j) x WHERE rank <= 10)"""


HYBRID, HYBRID_LINKS = hybrid_sql(), hybrid_sql(LINKED)


@query("recall_hybrid", "mem vecs queries edges", f"WITH {HYBRID} SELECT query_id, id, rank, hops, round(v, 6) AS vector_score, round(g, 6) AS graph_score, round(final, 6) AS score FROM hy")
def recall_hybrid(t):
    return gr.recall_hybrid(t.memv, t.edges, t.queries).select("query_id", "id", pos("rank"), "hops", r6("vector_score", "vector_score"), r6("graph_score", "graph_score"), r6("score", "score"))


@query("recall_hybrid_links", "mem vecs queries edges mentions", f"WITH {HYBRID_LINKS} SELECT query_id, id, rank, hops, round(v, 6) AS vector_score, round(g, 6) AS graph_score, round(final, 6) AS score FROM hy")
def recall_hybrid_links(t):
    """With all shared-entity links."""
    out = gr.recall_hybrid(t.memv, t.edges, t.queries, factors=gr.entity_link_factors(t.mentions))
    return out.select("query_id", "id", pos("rank"), "hops", r6("vector_score", "vector_score"), r6("graph_score", "graph_score"), r6("score", "score"))


NAMES = "CASE WHEN q.query_id < 5 THEN 'hub ' || (100 + q.query_id % 7) ELSE 'ALIAS ' || q.query_id END"


@query("recall_with_entities", "mem vecs queries ent mentions", f"""
WITH {SEEDS}, nm AS (SELECT agent_id, lower(n) AS key, min(entity_id) AS entity_id FROM (SELECT agent_id, entity_id, unnest([name, alias]) AS n FROM ent) x GROUP BY ALL),
named AS (SELECT DISTINCT q.query_id, nm.entity_id FROM queries q JOIN nm ON nm.agent_id = q.agent_id AND nm.key = lower({NAMES})),
em AS (SELECT * FROM (SELECT entity_id, m.id, m.confidence, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, created_at DESC, m.id) AS rk FROM (SELECT DISTINCT entity_id, memory_id FROM mentions) x JOIN mem m ON m.id = x.memory_id WHERE NOT m.is_archived) y WHERE rk <= 10),
lift AS (SELECT query_id, id, max(confidence::DOUBLE) AS c FROM named JOIN em USING (entity_id) GROUP BY ALL)
SELECT s.query_id, s.id, round(s.score + 0.1 * coalesce(c, 0), 6) AS score FROM seeds s LEFT JOIN lift l ON l.query_id = s.query_id AND l.id = s.id""")
def recall_with_entities(t):
    res = recall_similarity(t.memv, t.queries, k=20, keep=())
    q = F.col("query_id")
    names = t.queries.select("query_id", "agent_id", F.when(q < 5, F.concat(F.lit("hub "), (100 + q % 7).cast("string"))).otherwise(F.concat(F.lit("ALIAS "), q.cast("string"))).alias("name"))
    ent = t.ent.withColumn("aliases", F.array("alias"))
    return gr.recall_with_entities(res, names, ent, t.mentions, t.mem).select("query_id", "id", r6("score", "score"))


@query("memories_for_entity", "mem mentions", """
SELECT entity_id, id, rank FROM (SELECT entity_id, m.id, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, created_at DESC, m.id) AS rank FROM (SELECT DISTINCT entity_id, memory_id FROM mentions) x JOIN mem m ON m.id = x.memory_id WHERE NOT m.is_archived) y WHERE rank <= 50""")
def memories_for_entity(t):
    return gr.memories_for_entity(t.mentions, t.mem).select("entity_id", "id", pos("rank"))


@query("entities_for_memory", "ent mentions", "SELECT m.memory_id, e.entity_id, e.name, e.entity_type, m.mention_type FROM mentions m JOIN ent e ON e.entity_id = m.entity_id")
def entities_for_memory(t):
    return gr.entities_for_memory(t.mentions, t.ent)


@query("traverse_paths", "starts edges", f"""
WITH b AS (SELECT node, other, strength::DOUBLE AS s FROM {BW} x WHERE relation_type IN ('supports', 'causal', 'derived_from')), f0 AS (SELECT query_id, id AS node, 1.0::DOUBLE AS strength, [id] AS path FROM starts),
s1 AS (SELECT f.query_id, b.other AS node, f.strength * b.s AS strength, list_append(path, b.other) AS path FROM f0 f JOIN b ON b.node = f.node WHERE b.other <> f.node),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY round(strength, 9) DESC, path) AS rk FROM s1) x WHERE rk = 1),
s2 AS (SELECT f.query_id, b.other AS node, f.strength * b.s AS strength, list_append(path, b.other) AS path FROM f1 f JOIN b ON b.node = f.node WHERE NOT EXISTS (SELECT 1 FROM f0 z WHERE z.query_id = f.query_id AND z.node = b.other) AND NOT EXISTS (SELECT 1 FROM f1 z WHERE z.query_id = f.query_id AND z.node = b.other)),
p AS (SELECT query_id, path, strength FROM s1 UNION ALL SELECT query_id, path, strength FROM s2)
SELECT query_id, len(path) AS path_length, path[len(path)] AS node, count(*) AS n, round(sum(strength), 6) AS total, round(max(strength), 6) AS best FROM p GROUP BY ALL""")
def traverse_paths(t):
    p = gr.traverse_paths(t.starts, t.edges, 2, ["supports", "causal", "derived_from"])
    return p.groupBy("query_id", F.col("path_length").cast("long").alias("path_length"), F.element_at("path", -1).alias("node")).agg(
        F.count("*").alias("n"), r6(F.sum("strength"), "total"), r6(F.max("strength"), "best"))


@query("relationships", "starts edges", "SELECT query_id, source_id, target_id, relation_type, round(strength::DOUBLE, 6) AS strength, traversal_count FROM starts s JOIN edges e ON e.source_id = s.id OR e.target_id = s.id")
def relationships(t):
    return gr.relationships(t.starts, t.edges, 1).select("query_id", "source_id", "target_id", "relation_type", r6("strength", "strength"), "traversal_count")


@query("relationships_deep", "starts edges", """
WITH d1 AS (SELECT query_id, e.*, 1 AS depth FROM starts s JOIN edges e ON e.source_id = s.id OR e.target_id = s.id), n1 AS (SELECT DISTINCT query_id, unnest([source_id, target_id]) AS node FROM d1),
d2 AS (SELECT DISTINCT query_id, e.source_id, e.target_id, e.relation_type, e.strength FROM n1 JOIN edges e ON e.source_id = n1.node OR e.target_id = n1.node)
SELECT d2.query_id, d2.relation_type, CASE WHEN d1.query_id IS NULL THEN 2 ELSE 1 END AS depth, count(*) AS n, round(sum(d2.strength::DOUBLE), 4) AS total FROM d2 LEFT JOIN d1 ON d1.query_id = d2.query_id AND d1.source_id = d2.source_id AND d1.target_id = d2.target_id AND d1.relation_type = d2.relation_type GROUP BY ALL""")
def relationships_deep(t):
    return gr.relationships(t.starts, t.edges, 2).groupBy("query_id", "relation_type", "depth").agg(F.count("*").alias("n"), F.round(F.sum(F.col("strength").cast("double")), 4).alias("total"))


@query("derived_closure", "mem edges", """
WITH RECURSIVE c AS (SELECT tenant_id, id FROM mem WHERE anchor_id IS NOT NULL
 UNION SELECT c.tenant_id, e.source_id FROM c JOIN edges e ON e.target_id = c.id AND e.relation_type = 'derived_from' JOIN mem m ON m.id = e.source_id AND m.tenant_id = c.tenant_id WHERE NOT m.is_archived)
SELECT * FROM c WHERE id NOT IN (SELECT id FROM mem WHERE anchor_id IS NOT NULL)""")
def derived_closure(t):
    return gr.derived_closure(t.mem.where(F.col("anchor_id").isNotNull()), t.edges, t.mem)


@query("apply_traversals", "edges hits", """
WITH e AS (SELECT relation_type, target_id, source_id, count(*) AS n FROM edges JOIN hits h ON h.memory_id = source_id GROUP BY ALL)
SELECT edges.source_id, edges.target_id, edges.relation_type, round(least(1.0, strength::DOUBLE + 0.03 * coalesce(n, 0)), 6) AS strength, traversal_count + coalesce(n, 0) AS traversal_count FROM edges LEFT JOIN e USING (source_id, target_id, relation_type)""")
def apply_traversals(t):
    ev = t.edges.select(*gr.EDGE).join(t.hits.select(F.col("memory_id").alias("source_id"), "ts"), "source_id")
    return gr.apply_traversals(t.edges, ev).select(*gr.EDGE, r6("strength", "strength"), "traversal_count")


@query("cap_edges", "edges", "SELECT source_id, target_id, relation_type FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, target_id, relation_type) AS rk FROM edges) x WHERE rk <= 50")
def cap_edges(t):
    return gr.cap_edges(t.edges).select(*gr.EDGE)


@query("prune_graph", "edges", "SELECT source_id, target_id, relation_type FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, target_id, relation_type) AS rk FROM edges WHERE strength >= 0.05::FLOAT AND NOT (created_at < :now - INTERVAL 90 DAY AND traversal_count < 3)) x WHERE rk <= 50")
def prune_graph(t):
    return gr.prune_graph(t.edges, NOW).select(*gr.EDGE)


@query("purge_links", "mem mentions edges assoc", """
WITH g AS (SELECT id FROM mem WHERE anchor_id IS NOT NULL)
SELECT 'mention' AS kind, count(*) AS n FROM mentions WHERE memory_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edge', count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'assoc', count(*) FROM assoc WHERE NOT (source_type = 'semantic' AND source_id IN (SELECT id FROM g)) AND NOT (target_type = 'semantic' AND target_id IN (SELECT id FROM g))""")
def purge_links(t):
    parts = gr.purge_links(t.mem.where(F.col("anchor_id").isNotNull()), t.mentions, t.edges, t.assoc)
    out = [p.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, p in zip(("mention", "edge", "assoc"), parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])
