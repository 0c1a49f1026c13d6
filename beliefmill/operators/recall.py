"""Recall: similarity, recency, keyword fusion, scope composition, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmill.functions import scalar as sc
from beliefmill.functions.lexicon import TIERS
from beliefmill.functions.stems import stems
from beliefmill.operators.ordering import number_rows
from beliefmill.operators.similarity import match_blocks, score_queries, top_by
from beliefmill.session import days_between, hours_between, instant, pin, small_side

DEFAULT_K = 10
RRF_OFFSET, RRF_MISSING, RRF_VECTOR_LIST = 60, 1000, 100
BM25_K1, BM25_B = 1.2, 0.75


def recall_scope(mem: DataFrame, *, mem_type: str | None = None, min_confidence: float | None = None,
                 date_from=None, date_to=None, open_scope: bool = True, quarantined: bool = False) -> DataFrame:
    """Rows a recall may see. ``open_scope`` keeps rows bound to no subject or session."""
    out = mem.where(~F.col("is_archived"))
    if not quarantined:
        out = out.where(F.col("binding") != "quarantine")
    if open_scope:
        out = out.where(F.col("anchor_id").isNull() & F.col("session_id").isNull())
    if mem_type:
        out = out.where(F.col("type") == mem_type)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= F.lit(min_confidence).cast("float"))
    when = F.coalesce("event_date", "created_at")
    if date_from is not None:
        out = out.where(when >= instant(date_from))
    if date_to is not None:
        out = out.where(when <= instant(date_to))
    return out


def relative_recency(scoped: DataFrame, boost: float = 1.0) -> DataFrame:
    """Add ``rr``: position of the row's date in its agent's range (0.5 for a point)."""
    at = F.unix_micros(F.coalesce("event_date", "created_at"))
    span = scoped.groupBy("agent_id").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    rr = F.when(F.col("_hi") > F.col("_lo"), (at - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.5))
    return scoped.join(span, "agent_id").withColumn("rr", rr * F.lit(float(boost))).drop("_lo", "_hi")


def recall_similarity(mem: DataFrame, queries: DataFrame, k: int = DEFAULT_K, recency_boost: float = 0.0,
                      keep: tuple[str, ...] = ("content", "confidence"), **scope) -> DataFrame:
    rows = recall_scope(mem, **scope)
    bonus = None
    if recency_boost > 0:
        rows, bonus = relative_recency(rows.where(F.col("emb").isNotNull()), recency_boost), "rr"
    return score_queries(rows, queries, k=k, bonus=bonus, keep=keep)


def recall_exhaustive(mem: DataFrame, queries: DataFrame, min_sim: float = 0.25, max_results: int | None = None) -> DataFrame:
    """Every scoped row by plain dot product; ``max_results`` keeps that many per query."""
    return score_queries(recall_scope(mem), queries, k=max_results, min_sim=min_sim, cosine=False)


def lexical_scores(mem: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): rows holding every query word, by their stems, scored by BM25
    over the given rows as corpus; scope is tenant and agent of the query.

    Each query meets the rows of its scope that hold its rarest word there, and no others;
    whether a row holds the rest, and how often, is read from the row's own words.
    """
    words = pin(mem.select("id", "tenant_id", "agent_id", stems(sc.tokens(F.col("content"))).alias("_w")))
    size = F.greatest(F.coalesce(F.avg(F.size("_w")), F.lit(1.0)), F.lit(1e-9))
    corpus = words.agg(F.count("*").alias("n_docs"), size.alias("avg_len"))
    asked = pin(queries.select("query_id", F.col("tenant_id").alias("q_tenant"), F.col("agent_id").alias("q_agent"), F.array_distinct(stems(sc.tokens(F.col("text")))).alias("terms")).where(F.size("terms") > 0))
    terms = asked.select("query_id", "q_tenant", "q_agent", F.explode("terms").alias("token"))
    vocab = pin(terms.select("token").distinct())
    slim = words.select("id", "tenant_id", "agent_id", F.explode(F.array_distinct("_w")).alias("token")).join(small_side(vocab), "token")
    counts = pin(slim.groupBy("token", "tenant_id", "agent_id").agg(F.count("*").alias("n")))
    idf = counts.groupBy("token").agg(F.sum("n").alias("df")).join(F.broadcast(corpus)).select("token", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    # rows per query word in the query's scope; a word that the scope lacks leaves the query without hits
    here = terms.join(counts.select("token", F.col("tenant_id").alias("q_tenant"), "agent_id", "n"), ["token", "q_tenant"]).where(F.col("q_agent").isNull() | (F.col("agent_id") == F.col("q_agent")))
    here = here.groupBy("query_id", "token").agg(F.sum("n").alias("n")).join(idf, "token")
    rare = here.groupBy("query_id").agg(F.min(F.struct("n", "token")).alias("least"), F.collect_list(F.struct("token", "idf")).alias("weights"))
    rare = pin(asked.join(rare, "query_id").where(F.size("weights") == F.size("terms")).select("query_id", "q_tenant", "q_agent", F.col("least.token").alias("token"), "weights"))
    met = slim.join(small_side(rare.drop("weights")), ["token"]).where((F.col("tenant_id") == F.col("q_tenant")) & (F.col("q_agent").isNull() | (F.col("agent_id") == F.col("q_agent"))))
    met = met.select("query_id", "id").join(words.select("id", "_w"), "id").join(rare.select("query_id", "weights"), "query_id")
    full = met.where(F.forall("weights", lambda t: F.array_contains("_w", t["token"]))).join(F.broadcast(corpus))

    def part(t: Column) -> Column:
        tf = F.size(F.filter("_w", lambda w: w == t["token"])).cast("double")
        return t["idf"] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.size("_w") / F.col("avg_len")))

    return full.select("query_id", "id", F.aggregate(F.transform(F.array_sort("weights"), part), F.lit(0.0), lambda a, x: a + x).alias("score"))


def recall_rrf(mem: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Keyword and vector lists fused by reciprocal rank. Quarantined rows keep
    their ranks and are dropped afterwards."""
    seen = recall_scope(mem, quarantined=True)
    lex = number_rows(lexical_scores(seen, queries), ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], "lex_rank")
    vec = score_queries(seen, queries, k=RRF_VECTOR_LIST).withColumnRenamed("rank", "vec_rank")
    miss = F.lit(RRF_MISSING)
    fused = lex.select("query_id", "id", "lex_rank").join(
        vec.select("query_id", "id", "vec_rank"), ["query_id", "id"], "full_outer"
    ).withColumn(
        "score",
        1.0 / (RRF_OFFSET + F.coalesce("lex_rank", miss)) + 1.0 / (RRF_OFFSET + F.coalesce("vec_rank", miss)),
    )
    live = mem.where(~F.col("is_archived") & (F.col("binding") != "quarantine")).select("id")
    return top_by(fused.join(live, "id"), ["query_id"], [F.desc("score"), F.asc("id")], k)


GROUPS = [("private", 0.0), ("canon", 0.0), ("anchored", 0.05), ("session", 0.10)]


def recall_composed(mem: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """One pass over the rows for up to four scopes per query: own private rows,
    tenant canon, rows about the subject, rows of the conversation."""
    budget, canon_cap = max(4, k), max(1, k // 4)
    parts = F.array(*[
        F.struct(
            F.lit(i).alias("grp"), F.lit(b).alias("binding"),
            (F.lit(None) if b == "canon" else F.col("agent_id")).cast("long").alias("agent_id"),
            (F.col("anchor_id") if b == "anchored" else F.lit(None)).cast("long").alias("anchor_id"),
            (F.col("session_id") if b == "session" else F.lit(None)).cast("long").alias("session_id"),
        )
        for i, (b, _) in enumerate(GROUPS)
    ])
    sub = queries.select("query_id", "vec", "tenant_id", F.explode(parts).alias("p")).select(
        (F.col("query_id") * 4 + F.col("p.grp")).alias("query_id"), "vec", "tenant_id",
        "p.binding", "p.agent_id", "p.anchor_id", "p.session_id",
    ).where(
        ((F.col("binding") != "anchored") | F.col("anchor_id").isNotNull())
        & ((F.col("binding") != "session") | F.col("session_id").isNotNull())
        & (F.col("binding").isin("canon", "anchored", "session") | F.col("agent_id").isNotNull())
    )
    rows = recall_scope(mem, open_scope=False)
    hits = score_queries(rows, sub, k=budget, scope=("tenant_id", "binding", "agent_id", "anchor_id", "session_id"))
    grp = F.col("query_id") % 4
    boost = sc.lookup(grp, {i: 1.0 + b for i, (_, b) in enumerate(GROUPS)}, 1.0)
    return (
        hits.withColumn("grp", grp).where((F.col("grp") != 1) | (F.col("rank") <= canon_cap))
        .select(
            F.floor(F.col("query_id") / 4).cast("long").alias("query_id"), "id",
            sc.lookup(F.col("grp"), {i: b for i, (b, _) in enumerate(GROUPS)}, "private").alias("scope"),
            (F.col("score") * boost).alias("score"), F.col("rank").alias("scope_rank"),
        )
    )


def filter_by_tier(scored: DataFrame, tiers: list[str]) -> DataFrame:
    t = sc.tier(F.col("confidence"))
    return scored.where(t.isin(*tiers) & (F.col("score") >= sc.tier_behaviour(t)["retrieval_threshold"]))


def parse_tiers(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.isin(*TIERS))


def rerank_weighted(mem: DataFrame, queries: DataFrame, policies: DataFrame, now, k: int = DEFAULT_K,
                    tiers: tuple[str, ...] = ("hot", "warm"), min_confidence: float = 0.70) -> DataFrame:
    """similarity * confidence * freshness * type weight over max(30, 3k) candidates."""
    cands = recall_similarity(mem, queries, k=max(30, 3 * k), min_confidence=min_confidence,
                              keep=("agent_id", "type", "confidence", "updated_at"))
    gated = filter_by_tier(cands, list(tiers))
    weights = policies.select("agent_id", F.col("memory_type").alias("type"), F.col("priority_weight").cast("double").alias("_w"))
    age = hours_between(instant(now), F.col("updated_at"))
    scored = gated.join(weights, ["agent_id", "type"], "left").select(
        "query_id", "id", F.col("score").alias("similarity"), F.col("confidence").cast("double").alias("confidence"),
        F.exp(-0.0001 * F.greatest(F.lit(0.0), age)).alias("freshness"), F.coalesce("_w", F.lit(1.0)).alias("weight"),
    ).withColumn("score", F.col("similarity") * F.col("confidence") * F.col("freshness") * F.col("weight"))
    return top_by(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def similar_rows(rows: DataFrame, queries: DataFrame, theta: float, k: int | None,
                 scope: tuple[str, ...] = ("tenant_id", "agent_id"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Threshold search used for episodes, procedures, schemas and entities."""
    return score_queries(rows, queries, k=k, min_sim=theta, scope=scope, keep=keep)


def find_similar(left: DataFrame, mem: DataFrame, theta: float, keys=("tenant_id", "agent_id"), **kw) -> DataFrame:
    """Pairs (lid, rid, sim) of live rows at or above theta inside equal keys."""
    live = mem.where(~F.col("is_archived") & (F.col("binding") != "quarantine"))
    return match_blocks(
        left.select(F.col("id").alias("lid"), F.col("emb").alias("lvec"), *keys),
        live.select(F.col("id").alias("rid"), F.col("emb").alias("rvec"), *keys, *([kw["ord_col"].alias("rord")] if "ord_col" in kw else [])),
        list(keys), theta, **{a: b for a, b in kw.items() if a != "ord_col"},
    )


def with_success_rate(proc: DataFrame) -> DataFrame:
    rate = F.when(F.col("use_count") > 0, F.col("success_count").cast("double") / F.col("use_count")).otherwise(F.lit(0.0))
    return proc.withColumn("success_rate", rate)


def applicable_procedures(proc: DataFrame, queries: DataFrame, now, limit: int = 5) -> DataFrame:
    """Trigger match, then success * confidence * similarity * recency."""
    cands = similar_rows(with_success_rate(proc), queries, 0.75, 2 * limit,
                         keep=("success_rate", "confidence", "last_used_at"))
    conf = F.col("confidence").cast("double")
    recency = F.when(F.col("last_used_at").isNull(), F.lit(0.5)).otherwise(
        F.exp(-days_between(instant(now), F.col("last_used_at")) / 30.0)
    )
    fit = cands.where((F.col("success_rate") >= 0.5) & (F.col("confidence") >= F.lit(0.4).cast("float"))).withColumn(
        "fit", F.col("success_rate") * conf * F.col("score") * recency
    )
    return top_by(fit.drop("rank"), ["query_id"], [F.desc("fit"), F.asc("id")], limit)
