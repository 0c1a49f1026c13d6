"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to floor(64 * x). A block of rows is stored as bitmaps: one per
component and bit of (value - smallest value in the block). A query adds the bitmaps that its
own bits select, each at its weight, with carry-save adders, so the sums of all rows arise
as bitmaps at once. The best rows are then taken from the most significant sum bitmap
downward; rows still equal at the boundary go by id, and the scores of the rows taken are
read from the bitmaps.

Defined results: vectors null or with null or non-finite components, and rows without id, take
no part; rows of equal id are one row; missing components of shorter vectors are 0; ties go to
the smaller vec_id; a query with fewer candidates than k returns them all; sums must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beliefmill.llm.blocks import blocked, met, usable
from beliefmill.session import pin

SCALE = 64
BLOCK_ROWS, QUERY_ROWS = 8192, 256
K = 20


def quantised(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x * float(SCALE)).cast("long"))


INDEX = "ids array<bigint>, lows array<bigint>, widths array<int>, slices binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    rows: list[list[int]] = []

    def flush() -> pa.RecordBatch:
        d = max(map(len, rows))
        v = np.array([r + [0] * (d - len(r)) for r in rows], np.int64)
        low = v.min(axis=0)
        u = (v - low).astype(np.uint64)
        widths = [int(x).bit_length() for x in u.max(axis=0)]
        n = -(-len(rows) // 64) * 64
        maps = []
        for k, w in enumerate(widths):
            for b in range(w):
                bit = np.zeros(n, bool)
                bit[: len(rows)] = (u[:, k] >> np.uint64(b)) & np.uint64(1)
                maps.append(np.packbits(bit, bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([widths], pa.list_(pa.int32())), pa.array([b"".join(maps)], pa.binary())], ["ids", "lows", "widths", "slices"])

    for batch in batches:
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            ids.append(i)
            rows.append(v)
            if len(rows) == 2 * BLOCK_ROWS:
                yield flush()
                ids, rows = [], []
    if rows:
        yield flush()


class Slices:
    """One block's bitmaps."""

    def __init__(self, ids: list[int], lows: list[int], widths: list[int], slices: bytes):
        self.ids, self.lows, self.widths = np.array(ids, np.int64), np.array(lows, np.int64), np.array(widths, np.int64)
        words = -(-len(ids) // 64)
        self.maps = np.frombuffer(slices, np.uint64).reshape(-1, words)
        self.component = np.repeat(np.arange(len(widths)), self.widths)
        self.bit = np.concatenate([np.arange(w) for w in widths]) if len(widths) else np.zeros(0, np.int64)
        valid = np.zeros(words * 64, bool)
        valid[: len(ids)] = True
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of a non-negative sum from the least significant up, and what to add to it."""
        size, below = np.abs(q), q < 0
        constant = int((q * self.lows).sum()) - int((size * ((1 << self.widths) - 1))[below].sum())
        maps = np.where(below[self.component][:, None], ~self.maps, self.maps)
        at: dict[int, list[np.ndarray]] = {}
        for p in range(int(size.max(initial=0)).bit_length()):
            chosen = ((size[self.component] >> p) & 1).astype(bool)
            for b in np.unique(self.bit[chosen]).tolist():
                at.setdefault(p + b, []).append(maps[chosen & (self.bit == b)])
        out: list[np.ndarray] = []
        place = 0
        while at:
            own = np.concatenate(at.pop(place)) if place in at else np.zeros((1, len(self.valid)), np.uint64)
            carries = []
            while len(own) > 2:
                n = len(own) // 3
                a, b, c = own[:n], own[n : 2 * n], own[2 * n : 3 * n]
                x = a ^ b
                carries.append((a & b) | (x & c))
                own = np.concatenate([x ^ c, own[3 * n :]])
            if len(own) == 2:
                carries.append((own[:1] & own[1:]))
                own = own[:1] ^ own[1:]
            out.append(own[0])
            if carries:
                at.setdefault(place + 1, []).extend(carries)
            place += 1
        return out, constant

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k rows other than the query's own."""
        d = max(len(q), len(self.lows))
        if len(q) < d:
            q = np.pad(q, (0, d - len(q)))
        sums, constant = self.sums(q[: len(self.lows)])
        open_, taken = self.valid.copy(), np.zeros_like(self.valid)
        own = np.searchsorted(self.ids, query_id)
        if own < len(self.ids) and self.ids[own] == query_id:
            open_[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        for s in reversed(sums):
            ones = open_ & s
            n = int(np.bitwise_count(taken | ones).sum())
            if n > k:
                open_ = ones
            else:
                taken, open_ = taken | ones, open_ & ~s
                if n == k:
                    break
        rows = self.rows(taken)
        if len(rows) < k:
            rows = np.concatenate([rows, self.rows(open_)[: k - len(rows)]])
        score = np.zeros(len(rows), np.int64)
        for p, s in enumerate(sums):
            score += ((s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p
        return self.ids[rows], score + constant

    @staticmethod
    def rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Slices(*(batch.column(c)[i].as_py() for c in ("ids", "lows", "widths", "slices")))
                for q in batch.column("queries")[i].as_py():
                    ids, score = block.top(q["vec_id"], np.array(q["v"], np.int64), k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q["vec_id"])), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def build(table: DataFrame) -> DataFrame:
    """The index: one row per block."""
    rows = pin(usable(table).select("vec_id", quantised(F.col("v")).alias("v")))
    return blocked(rows, rows.count(), BLOCK_ROWS).mapInArrow(_index, INDEX)


def search(table: DataFrame, chosen: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that ``chosen`` selects."""
    rows = pin(usable(table).select("vec_id", quantised(F.col("v")).alias("v")))
    queries = rows.where(chosen)
    index = blocked(rows, rows.count(), BLOCK_ROWS).mapInArrow(_index, INDEX)
    found = met(index, queries, queries.count(), QUERY_ROWS).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SEARCH_SQL = """
    WITH rows AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
                  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding) GROUP BY vec_id),
    q AS (SELECT vec_id, [floor(64 * x) FOR x IN v] AS v FROM rows),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
