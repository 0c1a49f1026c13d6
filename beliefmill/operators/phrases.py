"""Which words occur inside which texts, without comparing every word with every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = 4


def text_key(x) -> Column:
    return F.md5(F.col(x) if isinstance(x, str) else x)


def words_inside(words: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, w, tid) for words(*keys, w) that texts(*keys, x) contain; tid = md5(x).

    A word is anchored at its first four characters (all of a shorter one) and meets only
    texts of its keys that hold this anchor; ``contains`` settles the rest. Different texts
    and words count once; nulls meet nothing, the empty word is inside every text. Texts are
    cut into their different short pieces once, so the work follows the length of the texts
    and the hits, not words times texts.
    """
    w = words.where(F.col("w").isNotNull()).select(*keys, "w").distinct().withColumn("_g", F.substring("w", 1, ANCHOR))
    x = texts.where(F.col("x").isNotNull()).select(*keys, "x").distinct().withColumn("tid", text_key("x"))
    cut = x.select(*keys, "tid", F.split("x", "").alias("_c"))

    def pieces(c, i):
        return F.array(*[F.concat_ws("", c, *[F.get(F.col("_c"), i + j) for j in range(1, n)]) for n in range(1, ANCHOR + 1)])

    grams = F.array_union(F.flatten(F.transform("_c", pieces)), F.array(F.lit("")))
    met = cut.select(*keys, "tid", F.explode(grams).alias("_g")).join(w, [*keys, "_g"]).select(*keys, "tid", "w")
    return met.join(x, [*keys, "tid"]).where(F.col("x").contains(F.col("w"))).select(*keys, "w", "tid")
