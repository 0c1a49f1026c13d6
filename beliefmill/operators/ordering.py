"""Order-dependent work without ever gathering a whole group in one task.

Rows are range-partitioned by (key, order); a hot key then spans many
partitions. Each (key, partition) slice is handled alone and the slices are
stitched together through a small summary per slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beliefmill.functions import lexicon as lx
from beliefmill.functions.scalar import LOGIT_HI, LOGIT_LO, clip, logit, sigmoid
from beliefmill.session import pin, shuffle_width

BIG = 1.0e300


def sliced(df: DataFrame, keys: list[str], order: list[Column], pinned: bool = True) -> DataFrame:
    """Add ``_slice``, increasing along (keys, order).

    The slice number is only stable inside one run of the plan, so it is pinned
    whenever more than one branch reads it.
    """
    width = shuffle_width(df.sparkSession)
    out = df.repartitionByRange(width, *[F.col(k).asc() for k in keys], *order).withColumn("_slice", F.spark_partition_id())
    return pin(out) if pinned else out


def number_rows(df: DataFrame, keys: list[str], order: list[Column], out: str = "seq") -> DataFrame:
    """Row number per key in the given order, for groups of any size."""
    s = sliced(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = s.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")).select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    here = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        s.withColumn("_rn", F.row_number().over(here))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_rn", "_off", "_slice")
    )


def with_previous(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, str],
                  step: str | None = None) -> DataFrame:
    """Add the previous row's value per key: ``values`` maps column -> new name.
    ``step`` also numbers the rows."""
    s = sliced(df, keys, order)
    here = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = s.withColumn("_rn", F.row_number().over(here))
    last = numbered.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_n"),
        *[F.max_by(F.struct(c), "_rn").alias(f"_last_{c}") for c in values],
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    carry = last.select(
        *keys, "_slice",
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        *[F.lag(f"_last_{c}").over(along).alias(f"_in_{c}") for c in values],
    )
    out = numbered
    for c, n in values.items():
        out = out.withColumn(n, F.lag(c).over(here))
    out = out.join(carry, [*keys, "_slice"])
    for c, n in values.items():
        out = out.withColumn(n, F.when(F.col("_rn") == 1, F.col(f"_in_{c}")[c]).otherwise(F.col(n)))
    if step:
        out = out.withColumn(step, (F.col("_rn") + F.col("_off")).cast("long"))
    return out.drop("_rn", "_off", "_slice", *[f"_in_{c}" for c in values])


# -- clamped folds ----------------------------------------------------------
#
# A clamped step x -> clamp(x + d, lo, hi) composed with another is again of the
# form clamp(x + d, l, h). So a long ordered run of steps can be folded slice by
# slice and the slice results composed, in order, into one triple (d, l, h).

def _identity() -> Column:
    return F.struct(F.lit(0.0).alias("d"), F.lit(-BIG).alias("l"), F.lit(BIG).alias("h"))


def _then(a: Column, d: Column, lo: Column, hi: Column) -> Column:
    return F.struct(
        (a["d"] + d).alias("d"),
        clip(a["l"] + d, lo, hi).alias("l"),
        clip(a["h"] + d, lo, hi).alias("h"),
    )


def clamped(x: float, lo: float, hi: float) -> float:
    return lo if x < lo else hi if x > hi else x


def in_slices(rows: DataFrame, key: str, order: list, in_place: bool = False) -> DataFrame:
    """The rows of every (key, _slice) one after another, in order, in one partition. With
    ``in_place`` the rows still lie where ``sliced`` put them and don't move."""
    return (rows if in_place else rows.repartition(key, "_slice")).sortWithinPartitions(key, "_slice", *order)


def fold_slices(events: DataFrame, key: str, order: list[str], steps: dict[str, tuple], in_place: bool = False) -> DataFrame:
    """One row per (key, _slice): its number of rows n and for every named step the composed
    triple. The rows stream through in order and a task holds one triple per step, so the time
    is linear and the memory constant for a slice of any size. A step is (column, low, high),
    the bounds numbers or columns; a null step changes nothing, a null bound doesn't bind."""
    given = {x: F.coalesce(F.col(x).cast("double"), F.lit(fill)).alias(x)
             for step in steps.values() for x, fill in zip(step, (0.0, -BIG, BIG), strict=True) if isinstance(x, str)}
    rows = in_slices(events.select(key, "_slice", *order, *given.values()), key, order, in_place).drop(*order)
    bounds, columns = list(steps.values()), list(given)
    triple = T.StructType([T.StructField(x, T.DoubleType()) for x in "dlh"])
    schema = T.StructType([events.schema[key], T.StructField("_slice", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(s, triple) for s in steps]])
    arrow = to_arrow_schema(schema)

    def closed(done: list) -> pa.RecordBatch:
        keys, slices, sizes, *folds = zip(*done, strict=True)
        made = [[dict(zip("dlh", t, strict=True)) for t in f] for f in folds]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, slices, sizes, *made), arrow, strict=True)], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n, state = None, 0, []
        for batch in batches:
            done, column = [], {x: batch.column(x).to_pylist() for x in columns}
            each = [[column[x] if isinstance(x, str) else repeat(float(x)) for x in step] for step in bounds]
            moves = zip(*[zip(*e, strict=False) for e in each], strict=True)
            for where, move in zip(zip(batch.column(key).to_pylist(), batch.column("_slice").to_pylist(), strict=True), moves, strict=True):
                if where != here:
                    if here is not None:
                        done.append((*here, n, *state))
                    here, n, state = where, 0, [(0.0, -BIG, BIG)] * len(bounds)
                n += 1
                state = [(d + x, clamped(low + x, lo, hi), clamped(high + x, lo, hi)) for (d, low, high), (x, lo, hi) in zip(state, move, strict=True)]
            if done:
                yield closed(done)
        if here is not None:
            yield closed([(*here, n, *state)])

    return rows.mapInArrow(fold, schema)


def _composed(name: str):
    return lambda a, p: _then(a, p[name]["d"], p[name]["l"], p[name]["h"])


def compose_slices(slices: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Compose the slice triples of each key in slice order (few rows per key)."""
    out = slices.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_slice", *names))).alias("_parts"), F.sum("n").alias("n")
    )
    for name in names:
        out = out.withColumn(name, F.aggregate("_parts", _identity(), _composed(name)))
    return out.drop("_parts")


def prefix_slices(slices: DataFrame, key: str, names: list[str]) -> DataFrame:
    """For every (key, _slice) the composition ``in_<name>`` of all earlier slices of the key."""
    rows = slices.select(key, "_slice", *names).repartition(key).sortWithinPartitions(key, "_slice")
    schema = T.StructType([slices.schema[key], slices.schema["_slice"], *[T.StructField(f"in_{s}", slices.schema[s].dataType) for s in names]])
    arrow = to_arrow_schema(schema)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = object(), {}
        for batch in batches:
            before = []
            for row in batch.to_pylist():
                if row[key] != here:
                    here, state = row[key], {s: {"d": 0.0, "l": -BIG, "h": BIG} for s in names}
                before.append({key: here, "_slice": row["_slice"], **{f"in_{s}": t for s, t in state.items()}})
                state = {s: {"d": t["d"] + row[s]["d"], "l": clamped(t["l"] + row[s]["d"], row[s]["l"], row[s]["h"]),
                             "h": clamped(t["h"] + row[s]["d"], row[s]["l"], row[s]["h"])} for s, t in state.items()}
            yield pa.RecordBatch.from_pylist(before, schema=arrow)

    return rows.mapInArrow(carry, schema)


def apply_triple(x: Column, t: Column) -> Column:
    return clip(x + t["d"], t["l"], t["h"])


CONF_STEP = (LOGIT_LO, LOGIT_HI)
COUNT_STEP = (0.0, BIG)


def folded_confidence(conf: Column, triple: Column) -> Column:
    p = sigmoid(apply_triple(logit(conf), triple))
    return clip(p, lx.PROB_LO, lx.PROB_HI)
