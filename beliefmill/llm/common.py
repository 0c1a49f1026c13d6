"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per different text: tid (md5, 16 bytes), text, copies. Copies are combined
    before the shuffle, so a huge group of copies costs one row per map task."""
    text = docs.select(text_of(text_col).alias("text"))
    return text.select(text_id("text").alias("tid"), "text").groupBy("tid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def text_id(column: str) -> Column:
    return F.unhex(F.md5(text_of(column).cast("binary")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut consecutive items into runs of about ``most`` in total, one item at least."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


ODD_SPACES = re.compile("[\x1c-\x1f]")  # not white space to all
