"""Nearest neighbours through stable projections and kd-trees.

Vectors are projected on AXES Gaussian directions (a 2-stable projection: squared projected
over squared true distance follows a chi-square law with AXES degrees of freedom). Every
block of rows has a kd-tree over the projections. A query visits tree nodes in order of
projected distance and verifies the rows of each leaf on the original vectors. It stops when
the next node is so far that a row nearer than the k-th best would, by the chi-square law, have
been met already with probability STOP.

The directions are drawn from a fixed seed; nothing is fitted, every row is indexed.

Defined results: rows without id, null vectors, zero vectors and vectors with null or
non-finite components take no part; rows of equal id are one row; vectors of another length
than the query's are compared as if padded with zeros; of equal vectors only the k + 1
smallest ids can be among the k nearest, so the others are set aside exactly; ties go to the
smaller vec_id; fewer candidates than k are all returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beliefmill.llm.blocks import blocked, met, usable
from beliefmill.session import pin

AXES, STOP, K = 8, 0.99, 10
LEAF_ROWS, BLOCK_ROWS, QUERY_ROWS = 32, 16384, 256
SEED = 20


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((AXES, width)).T


def chi_square(x: float) -> float:
    """Distribution function with AXES (even) degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    if half > 700:
        return 1.0
    for i in range(AXES // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total


class Tree:
    """A kd-tree over projections; leaves hold at most LEAF_ROWS rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.axes = directions(vectors.shape[1])
        points = vectors @ self.axes
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (low corner, high corner, left, right) or (.., .., from, to) of a leaf
        self.leaf: list[bool] = []
        self._grow(points, order, 0, len(order))
        self.ids, self.vectors, self.points = ids[order], vectors[order], points[order]
        self.low, self.high = np.array([n[0] for n in self.nodes]), np.array([n[1] for n in self.nodes])

    def _grow(self, points: np.ndarray, order: np.ndarray, lo: int, hi: int) -> int:
        own = points[order[lo:hi]]
        low, high = own.min(axis=0), own.max(axis=0)
        me = len(self.nodes)
        self.nodes.append((low, high, lo, hi))
        self.leaf.append(hi - lo <= LEAF_ROWS)
        if hi - lo > LEAF_ROWS:
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, (high - low).argmax()], mid)]
            left = self._grow(points, order, lo, lo + mid)
            right = self._grow(points, order, lo + mid, hi)
            self.nodes[me] = (low, high, left, right)
        return me

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest (distance, id) found among rows other than the query's own."""
        width = self.vectors.shape[1]
        extra = float((q[width:] ** 2).sum())  # components that no row of the block has
        q = np.pad(q, (0, max(0, width - len(q))))[:width]
        p = q @ self.axes
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        bound = (gap * gap).sum(axis=1).tolist()
        ahead, best_d, best_i, worst = [(bound[0], 0)], np.zeros(0), np.zeros(0, np.int64), math.inf
        while ahead:
            far, node = heapq.heappop(ahead)
            if len(best_i) == k and far > 0 and (worst == 0 or chi_square(far / worst) >= STOP):
                break
            _, _, a, b = self.nodes[node]
            if not self.leaf[node]:
                heapq.heappush(ahead, (bound[a], a))
                heapq.heappush(ahead, (bound[b], b))
                continue
            ids, diff = self.ids[a:b], self.vectors[a:b] - q
            d = (diff * diff).sum(axis=1)
            ok = (d <= worst) & (ids != query_id)
            if ok.any():
                d, ids = np.concatenate([best_d, d[ok]]), np.concatenate([best_i, ids[ok]])
                keep = np.lexsort((ids, d))[:k]
                best_d, best_i = d[keep], ids[keep]
                if len(best_i) == k:
                    worst = float(best_d[-1])
        return list(zip(np.sqrt(best_d + extra).tolist(), best_i.tolist(), strict=True))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as one row each: ids, width, and the vectors as bytes."""
    ids: list[int] = []
    rows: list[list[float]] = []

    def flush() -> pa.RecordBatch:
        width = max(map(len, rows))
        data = np.array([r + [0.0] * (width - len(r)) for r in rows], np.float64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([data], pa.binary())], ["ids", "width", "data"])

    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            ids.append(i)
            rows.append(v)
            if len(rows) == 2 * BLOCK_ROWS:
                yield flush()
                ids, rows = [], []
    if rows:
        yield flush()


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, width, data = (batch.column(c)[i].as_py() for c in ("ids", "width", "data"))
                if known != (ids[0], len(ids)):
                    known, tree = (ids[0], len(ids)), Tree(np.array(ids), np.frombuffer(data, np.float64).reshape(-1, width))
                for q in batch.column("queries")[i].as_py():
                    found = tree.nearest(q["vec_id"], np.array(q["v"], np.float64), k)
                    if found:
                        d, n = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([q["vec_id"]] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(table: DataFrame, chosen: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that ``chosen`` selects."""
    rows = pin(usable(table, nonzero=True))
    queries = rows.where(chosen)
    copies = Window.partitionBy("v").orderBy("vec_id")
    firsts = rows.withColumn("at", F.row_number().over(copies)).where(F.col("at") <= k + 1).drop("at")
    index = blocked(firsts, rows.count(), BLOCK_ROWS).mapInArrow(_gather, "ids array<bigint>, width int, data binary")
    found = met(index, queries, queries.count(), QUERY_ROWS).mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
