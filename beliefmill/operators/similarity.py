"""Exact cosine matching of vectors.

Two forms:

* ``score_queries`` - few query vectors against a large table. The query set is
  fetched only up to a fixed bound and shipped to the tasks; each Arrow batch is
  one matrix product and gives back at most the best k rows per query.
* ``match_blocks`` - table against table inside equal keys. A group larger than a
  block is cut in two per side, or into as many blocks as it takes to keep one
  within ``BLOCK_BYTES``, so that a row is sent to two tasks in groups of any
  ordinary size and no task holds more than two blocks whatever the skew. Where the
  vectors are so clustered that it takes less moving, rows are first routed by pivots
  (an exact bisector bound: two unit vectors closer than d can only meet in cells
  whose bisector is within d). Only pairs that pass the threshold (or the k best per
  row and block) leave a task. Without k they leave it tile by tile: a task then holds
  two blocks and a tile, however many pairs there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beliefmill.functions.vectors import matrix, unit_rows
from beliefmill.session import pin

MAX_SHIPPED_QUERIES = 4096
BLOCK_ROWS = 4096
BLOCK_BYTES = 32 << 20  # of vectors
SPLIT = 2  # blocks per side of a group that one block doesn't hold, while they fit
TILE_LEFT, TILE_RIGHT = 1024, 8192
PAIR_LEFT, PAIR_RIGHT = 1024, 2048  # where all pairs are wanted, every pair of a tile may qualify
PAIR_ROWS = 1 << 17  # pairs handed back at once
PIVOTS = 64
ROUTE_SAMPLE = 512
# equal vectors must tie exactly, wherever they stand in a matrix product
SIM_DIGITS = 12


def top_by(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First k rows per key; Spark prunes to k per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def _keep_best(scores: np.ndarray, ok: np.ndarray, k: int | None) -> np.ndarray:
    """Boolean mask of the k best per column (ties at the edge are kept)."""
    if k is None or scores.shape[0] <= k:
        return ok
    masked = np.where(ok, scores, -np.inf)
    edge = np.partition(masked, scores.shape[0] - k, axis=0)[scores.shape[0] - k]
    return ok & (masked >= edge[None, :])


def score_queries(rows: DataFrame, queries: DataFrame, *, k: int | None = None, min_sim: float | None = None,
                  cosine: bool = True, vec: str = "emb", bonus: str | None = None,
                  scope: tuple[str, ...] = ("tenant_id", "agent_id"), keep: tuple[str, ...] = (),
                  max_shipped: int = MAX_SHIPPED_QUERIES) -> DataFrame:
    """(query_id, id, score, *keep) for rows inside each query's scope.

    A null scope value in a query matches every row. ``bonus`` names a column
    added to the similarity before the best k are taken.
    """
    rows = rows.where(F.col(vec).isNotNull())
    q = queries.where(F.col("vec").isNotNull()).select("query_id", "vec", *scope)
    head = q.take(max_shipped + 1)
    if len(head) > max_shipped:
        return _score_many(rows, q, k, min_sim, cosine, vec, bonus, scope, keep)

    qids = np.array([r["query_id"] for r in head])
    qm = np.array([list(r["vec"]) for r in head], dtype=np.float64) if head else np.zeros((0, 0))
    if cosine and len(head):
        qm = unit_rows(qm)
    # queries of one scope share a row selection and one product
    shared: dict[tuple, list[int]] = {}
    for i, r in enumerate(head):
        shared.setdefault(tuple(r[s] for s in scope), []).append(i)
    groups = [(want, np.array(members)) for want, members in shared.items()]
    known = [[w for w in dict.fromkeys(want[i] for want in shared) if w is not None] for i in range(len(scope))]
    extra = [bonus] if bonus else []
    base = rows.select("id", *scope, vec, *extra, *[c for c in keep if c not in scope and c not in extra and c != "id"])
    out_cols = ["id", *[c for c in keep if c != "id"]]
    schema = T.StructType(
        [T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("score", T.DoubleType())]
        + [base.schema[c] for c in out_cols]
    )
    if not head:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            m = matrix(b.column(vec))
            if cosine:
                m = unit_rows(m)
            add = b.column(bonus).to_numpy(zero_copy_only=False) if bonus else None
            codes = [
                pc.fill_null(pc.index_in(b.column(name), pa.array(known[i], b.column(name).type)), -1).to_numpy(zero_copy_only=False)
                for i, name in enumerate(scope)
            ]
            found = []
            for want, members in groups:
                pick = np.ones(b.num_rows, dtype=bool)
                for i, w in enumerate(want):
                    if w is not None:
                        pick &= codes[i] == known[i].index(w)
                at = np.nonzero(pick)[0]
                if len(at) == 0:
                    continue
                s = np.round(m[at] @ qm[members].T, SIM_DIGITS)
                ok = np.ones(s.shape, dtype=bool) if min_sim is None else s >= min_sim
                if add is not None:
                    s = s + add[at][:, None]
                ri, qi = np.nonzero(_keep_best(s, ok, k))
                if len(ri):
                    found.append((at[ri], members[qi], s[ri, qi]))
            if not found:
                continue
            ri, qi, sim = (np.concatenate(x) for x in zip(*found))
            taken = [b.column(c).take(pa.array(ri)) for c in out_cols]
            yield pa.RecordBatch.from_arrays([pa.array(qids[qi]), pa.array(sim)] + taken, names=["query_id", "score"] + out_cols)

    scored = base.mapInArrow(run, schema)
    if k is None:
        return scored
    return top_by(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def _score_many(rows, q, k, min_sim, cosine, vec, bonus, scope, keep) -> DataFrame:
    """Query sets beyond the shipping bound: blocks against blocks."""
    spec = [(s, F.col(s)) for s in scope]
    parts = []
    for bits in range(2 ** len(spec)):
        fixed = [s for i, (s, _) in enumerate(spec) if bits >> i & 1]
        sub = q
        for i, (s, c) in enumerate(spec):
            sub = sub.where(c.isNotNull() if bits >> i & 1 else c.isNull())
        left = sub.select(F.col("query_id").alias("lid"), F.col("vec").alias("lvec"), *fixed)
        right = rows.select(F.col("id").alias("rid"), F.col(vec).alias("rvec"), *fixed,
                            *([F.col(bonus).alias("rbonus")] if bonus else []))
        parts.append(match_blocks(left, right, fixed, min_sim if min_sim is not None else -math.inf, k=k,
                                  cosine=cosine, bonus="rbonus" if bonus else None))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    pairs = pairs.select(F.col("lid").alias("query_id"), F.col("rid").alias("id"), F.col("sim").alias("score"))
    if k is not None:
        pairs = top_by(pairs, ["query_id"], [F.desc("score"), F.asc("id")], k)
    extra = [c for c in keep if c != "id"]
    return pairs.join(rows.select("id", *extra), "id") if extra else pairs


def _route(df: DataFrame, id_col: str, vec_col: str, pivots: np.ndarray, reach: float | None) -> DataFrame:
    """Add ``cells``: the home cell, and with ``reach`` every cell a partner within
    that distance may call home."""
    schema = T.StructType(df.schema.fields + [T.StructField("cells", T.ArrayType(T.IntegerType()))])
    gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(-1), 1e-24))

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            m = unit_rows(matrix(b.column(vec_col)))
            d2 = np.maximum(2 - 2 * (m @ pivots.T), 0)
            d2 = np.where(np.sqrt((m * m).sum(1))[:, None] == 0, 1.0, d2)
            home = d2.argmin(axis=1)
            if reach is None:
                cells = [[int(h)] for h in home]
            else:
                h2 = d2[np.arange(len(home)), home]
                near = (d2 - h2[:, None]) / (2 * gap[home]) <= reach + 1e-9
                near[np.arange(len(home)), home] = True
                cells = [np.nonzero(r)[0].tolist() for r in near]
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array(cells, pa.list_(pa.int32()))], names=list(b.schema.names) + ["cells"]
            )

    return df.mapInArrow(run, schema)


def _cells_a_row(vectors: np.ndarray, pivots: np.ndarray, reach: float) -> float:
    """Mean number of cells that a row of the right side is sent to."""
    gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(-1), 1e-24))
    d2 = np.maximum(2 - 2 * (vectors @ pivots.T), 0)
    home = d2.argmin(axis=1)
    return float(((d2 - d2[np.arange(len(home)), home][:, None]) / (2 * gap[home]) <= reach + 1e-9).sum(axis=1).mean())


def _group_sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of every group on the left (_l) and on the right (_r)."""
    side = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return side.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))


def _places(right: pa.Table) -> np.ndarray:
    """Place of every right row by (rord, rid). Where many rows have one rord, all that tie
    at the edge of the k best would otherwise leave the task."""
    at = pc.sort_indices(right.select(["rord", "rid"]), sort_keys=[("rord", "ascending"), ("rid", "ascending")], null_placement="at_start").to_numpy()
    rord, rid = (right.column(c).to_numpy(zero_copy_only=False)[at] for c in ("rord", "rid"))
    out = np.zeros(len(at))
    out[at[1:]] = np.cumsum((rord[1:] != rord[:-1]) | (rid[1:] != rid[:-1]))
    return out


def _blocks(n, least: int, most: int):
    """Number of blocks for n rows: one up to ``least`` rows, then ``SPLIT`` until a block has ``most``."""
    return F.ceil(n / F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n / SPLIT)))).cast("int")


def match_blocks(left: DataFrame, right: DataFrame, keys: list[str], theta: float, *, k: int | None = None,
                 order: str = "sim", cosine: bool = True, bonus: str | None = None, drop_self: bool = False,
                 one_way: bool = False, band: bool = False, before: bool = False, carry: tuple[str, ...] = (),
                 count_on: tuple[DataFrame, DataFrame] | None = None, block_rows: int = BLOCK_ROWS,
                 n_pivots: int = PIVOTS) -> DataFrame:
    """Pairs (lid, rid, sim) with similarity >= theta and equal keys.

    left: lid, lvec, *keys; right: rid, rvec, *keys and ``rord`` when ``order``
    is "rord" (smallest first). With k, only the k best per left row. ``one_way``
    keeps pairs with lid < rid; ``band`` limits each left row to its own
    similarity range [lfloor, lcap). ``before`` keeps pairs with ``rat`` < ``lat``,
    of equal similarity those of smallest rat first, and adds rat. ``count_on`` names cheaper tables, with at
    least as many rows per key, to take the group sizes from. ``carry`` names columns of the
    left rows that pairs bring along, so that no join has to bring them to all pairs.
    """
    if not keys:
        left, right, keys = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0)), ["_all"]
    by_ord = order == "rord"
    if before and (by_ord or bonus or drop_self):
        raise ValueError("before goes with plain similarity only")
    if carry and k is not None:
        raise ValueError("carry goes with all pairs only")
    right_cols = ["rid", "rvec", *keys] + (["rord"] if by_ord else []) + ([bonus] if bonus else []) + (["rat"] if before else [])
    limits = (["lfloor", "lcap"] if band else []) + (["lat"] if before else [])
    left = left.select(*[F.col(c).alias(c) for c in ["lid", "lvec", *keys, *limits, *carry]])
    right = right.select(*[F.col(c).alias(c) for c in right_cols])

    # counted before the vectors are touched, so only the keys are read
    sizes = _group_sizes(*(count_on or (left, right)), keys)
    most_right, most_left = sizes.agg(F.max("_r"), F.max("_l")).first()
    big = max(most_right or 0, most_left or 0) > block_rows
    left = left.where(F.col("lvec").isNotNull())
    right = right.where(F.col("rvec").isNotNull())
    group = list(keys)
    rows = left
    want = None if k is None else k + (1 if drop_self else 0)
    collapse = big and k is not None
    # every left row has its own lat, so with before none is a copy
    stands_in = collapse and not before
    copies = [*keys, *limits, "lvec"]
    head = []
    if big:
        prune = cosine and theta > -1.0 and (most_right or 0) > block_rows
        head = [list(r[0]) for r in right.select("rvec").orderBy(F.xxhash64("rid"), "rid").limit(n_pivots + ROUTE_SAMPLE if prune else 1).collect()]
    if collapse:
        # copies of one vector score alike: k of them are enough on the right,
        # and one representative is enough on the left
        tie = [F.asc("rord"), F.asc("rid")] if by_ord else ([F.desc(bonus)] if bonus else []) + ([F.asc("rat")] if before else []) + [F.asc("rid")]
        right = top_by(right, [*keys, "rvec"], tie, want, "_copy").drop("_copy")
    if stands_in:
        rows = left.groupBy(*copies).agg(F.min("lid").alias("lid"))
    if big:
        most = max(block_rows, BLOCK_BYTES // (8 * max(len(head[0]) if head else 1, 1)))
        routed = False
        if prune and len(head) > n_pivots:
            drawn = unit_rows(np.array(head, dtype=np.float64))
            piv, reach = np.unique(drawn[:n_pivots], axis=0), math.sqrt(max(2 - 2 * theta, 0.0))
            routed = _cells_a_row(drawn[n_pivots:], piv, reach) <= SPLIT
        if routed:
            rows = pin(_route(rows, "lid", "lvec", piv, None).withColumn("_cell", F.explode("cells")).drop("cells"))
            right = pin(_route(right, "rid", "rvec", piv, reach).withColumn("_cell", F.explode("cells")).drop("cells"))
            group = [*keys, "_cell"]
            sizes = _group_sizes(rows, right, group)
        # few: each stands for more rows than a block has
        grid = sizes.where(F.greatest("_l", "_r") > block_rows).select(*group, _blocks(F.col("_l"), block_rows, most).alias("_nl"), _blocks(F.col("_r"), block_rows, most).alias("_nr"))
        each = F.greatest(F.coalesce("_nl", F.lit(1)), F.lit(1)), F.greatest(F.coalesce("_nr", F.lit(1)), F.lit(1))
        rows = (
            rows.join(F.broadcast(grid), group, "left")
            .withColumn("_lb", F.pmod(F.xxhash64("lid"), each[0]).cast("int"))
            .withColumn("_rb", F.explode(F.sequence(F.lit(0), each[1] - 1)))
            .drop("_nl", "_nr")
        )
        right = (
            right.join(F.broadcast(grid), group, "left")
            .withColumn("_rb", F.pmod(F.xxhash64("rid"), each[1]).cast("int"))
            .withColumn("_lb", F.explode(F.sequence(F.lit(0), each[0] - 1)))
            .drop("_nl", "_nr")
        )
        group = [*group, "_lb", "_rb"]

    fields = [T.StructField("lid", rows.schema["lid"].dataType), T.StructField("rid", right.schema["rid"].dataType),
              T.StructField("sim", T.DoubleType())]
    if by_ord:
        fields.append(T.StructField("rord", right.schema["rord"].dataType))
    if before:
        fields.append(T.StructField("rat", T.LongType()))
    fields += [rows.schema[c] for c in carry]
    schema = T.StructType(fields)

    def all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of one group, whose rows of both sides come mixed."""
        ends = {"l": ["lid", *limits, *carry], "r": [c for c in right_cols if c != "rvec" and c not in keys]}
        rest, vectors = {"l": [], "r": []}, {"l": [], "r": []}
        for b in batches:
            for side, vec in (("l", "lvec"), ("r", "rvec")):
                part = b.filter(b.column(vec).is_valid())
                if part.num_rows:
                    m = matrix(part.column(vec))
                    vectors[side].append(unit_rows(m) if cosine else m)
                    rest[side].append(part.select(ends[side]))
        if not vectors["l"] or not vectors["r"]:
            return
        lt, rt = (pa.Table.from_batches(rest[side]).combine_chunks() for side in "lr")
        lm, rm = (np.concatenate(vectors.pop(side)) for side in "lr")

        tested = {c: lt.column(c).to_numpy(zero_copy_only=False) for c in [*limits, *(["lid"] if drop_self or one_way else [])]}
        tested |= {c: rt.column(c).to_numpy(zero_copy_only=False) for c in [*(["rat"] if before else []), *(["rid"] if drop_self or one_way else [])]}
        for a in range(0, len(lm), PAIR_LEFT):
            for b in range(0, len(rm), PAIR_RIGHT):
                s = lm[a:a + PAIR_LEFT] @ rm[b:b + PAIR_RIGHT].T
                li, ri = np.nonzero(s >= theta - 1e-9)
                sim = np.round(s[li, ri], SIM_DIGITS)
                ok, li, ri = sim >= theta, li + a, ri + b
                if band:
                    ok &= (sim >= tested["lfloor"][li]) & (sim < tested["lcap"][li])
                if drop_self:
                    ok &= tested["lid"][li] != tested["rid"][ri]
                if before:
                    ok &= tested["rat"][ri] < tested["lat"][li]
                if one_way:
                    ok &= tested["lid"][li] < tested["rid"][ri]
                li, ri, sim = li[ok], ri[ok], sim[ok]
                for at in range(0, len(sim), PAIR_ROWS):
                    cut = slice(at, at + PAIR_ROWS)
                    ours, theirs = lt.take(pa.array(li[cut])), rt.take(pa.array(ri[cut]))
                    cols = [pa.array(sim[cut]) if f.name == "sim" else (ours if f.name in ends["l"] else theirs).column(f.name).combine_chunks() for f in fields]
                    yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    if k is None:
        both = rows.unionByName(right, allowMissingColumns=True)
        return both.groupBy(*group).applyInArrow(all_pairs, schema)

    def match(lt: pa.Table, rt: pa.Table) -> pa.Table:
        names = [f.name for f in fields]
        kinds = [lt.schema.field("lid").type, rt.schema.field("rid").type, pa.float64()]
        if by_ord:
            kinds.append(rt.schema.field("rord").type)
        if before:
            kinds.append(pa.int64())
        if lt.num_rows == 0 or rt.num_rows == 0:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        lm, rm = matrix(lt.column("lvec")), matrix(rt.column("rvec"))
        if cosine:
            lm, rm = unit_rows(lm), unit_rows(rm)
        lid = lt.column("lid").to_numpy(zero_copy_only=False)
        rid = rt.column("rid").to_numpy(zero_copy_only=False)
        rord = rt.column("rord").to_numpy(zero_copy_only=False) if by_ord else None
        place = _places(rt) if by_ord else None
        extra = rt.column(bonus).to_numpy(zero_copy_only=False) if bonus else None
        rat = rt.column("rat").to_numpy(zero_copy_only=False) if before else None
        lat = lt.column("lat").to_numpy(zero_copy_only=False) if before else None
        if band:
            low, high = (lt.column(c).to_numpy(zero_copy_only=False) for c in ("lfloor", "lcap"))

        def fits(s, li, ri):
            ok = s >= theta
            if band:
                ok &= (s >= low[li]) & (s < high[li])
            if drop_self and not collapse:
                ok &= lid[li] != rid[ri]
            if before:
                ok &= rat[ri] < lat[li]
            if one_way:
                ok &= lid[li] < rid[ri]
            return ok

        def worth(s, ri):
            return -place[ri] if by_ord else s if extra is None else s + extra[ri]

        outs = []
        for a in range(0, len(lid), TILE_LEFT):
            lpart = np.arange(a, min(a + TILE_LEFT, len(lid)))
            # what a pair must reach; rises to the worst of the k best found so far
            floor = np.full(len(lpart), theta) if not band else np.maximum(low[lpart], theta)
            kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
            for b in range(0, len(rid), TILE_RIGHT):
                rpart = np.arange(b, min(b + TILE_RIGHT, len(rid)))
                s = lm[a:a + TILE_LEFT] @ rm[b:b + TILE_RIGHT].T
                ok = s >= (floor - 1e-9)[:, None]
                if np.count_nonzero(ok) > 64 * want * len(lpart):
                    s = np.round(s, SIM_DIGITS)
                    ok = fits(s, lpart[:, None], rpart[None, :])
                    w = np.broadcast_to(worth(s, rpart[None, :]), s.shape)
                    ok = _keep_best(w.T, ok.T, want).T
                    li, ri = np.nonzero(ok)
                    sim = s[li, ri]
                else:
                    li, ri = np.nonzero(ok)
                    sim = np.round(s[li, ri], SIM_DIGITS)
                    ok = fits(sim, lpart[li], rpart[ri])
                    li, ri, sim = li[ok], ri[ok], sim[ok]
                li, ri, sim, w = (np.concatenate(x) for x in zip(kept, (li, rpart[ri], sim, worth(sim, rpart[ri])), strict=True))
                sort = np.lexsort((-w, li))
                li, ri, sim, w = li[sort], ri[sort], sim[sort], w[sort]
                first = np.searchsorted(li, np.arange(len(lpart)))
                edge = first[li] + want - 1
                full = (edge < len(li)) & (li[np.minimum(edge, len(li) - 1)] == li) if len(li) else np.zeros(0, bool)
                take = ~full
                take[full] = w[full] >= w[edge[full]]
                kept = li[take], ri[take], sim[take], w[take]
                if not by_ord and extra is None and full.any():
                    floor[li[full]] = np.maximum(floor[li[full]], w[edge[full]])
            li, ri, sim, _ = kept
            outs.append((lid[lpart[li]], rid[ri], sim, rord[ri] if by_ord else rat[ri] if before else None))
        cols = [np.concatenate([o[0] for o in outs]), np.concatenate([o[1] for o in outs]),
                np.concatenate([o[2] for o in outs])]
        if by_ord or before:
            cols.append(np.concatenate([o[3] for o in outs]))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds)})

    pairs = rows.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(match, schema)
    if stands_in:
        owners = left.select("lid", F.min("lid").over(Window.partitionBy(*copies)).alias("_rep"))
        pairs = pairs.withColumnRenamed("lid", "_rep").join(owners, "_rep").select("lid", *[f.name for f in fields[1:]])
        if drop_self:
            pairs = pairs.where(F.col("lid") != F.col("rid"))
    by = [F.asc("rord"), F.asc("rid")] if by_ord else [F.desc("sim"), *([F.asc("rat")] if before else []), F.asc("rid")]
    return top_by(pairs, ["lid"], by, k)
