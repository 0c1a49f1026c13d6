"""Language identification by prediction by partial matching.

A language is a tree of byte contexts up to ORDER bytes long with frozen counts. The
code length of a byte is that of the longest context in which the language has seen it;
every longer known context adds its escape (method C: distinct symbols / (total +
distinct)). A text goes to the language that codes it in the fewest bits.

Defined results: null texts and texts without a letter are ``und`` with score 0; equal
code lengths go to the first language by name; without training rows all texts are ``und``.
Only the id, text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beliefmill.llm.common import U64, slices, text_of

ORDER = 4
#: Bound of the training sample: so many different whole texts per language, of at most so many bytes each.
SAMPLE_DOCS = 400
SAMPLE_DOC_BYTES = 65_536
#: A language that has only longer texts trains on so many of them, the shortest.
LONG_DOCS = 4
#: The pipeline rejects a text that its best language codes in more bits per byte than this.
REJECT_BITS = 6.0
UNDETERMINED = "und"
CHUNK = 1 << 20
RUN = 1 << 17  # bytes coded together: some matrices of these by languages are held at once
NOT_LETTERS = re.compile(r"[\W\d_]+")
PAD = b" " * ORDER


def letters(text: str | None) -> bytes:
    """Lower-case letters, everything else one blank; empty without a letter."""
    out = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return PAD + out.encode("utf-8") + b" " if out else b""


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For every byte after the padding: its context of ``order`` bytes and itself, packed."""
    n = len(data) - ORDER
    key = np.zeros(n, U64)
    for k in range(order, -1, -1):
        key = (key << U64(8)) | data[ORDER - k : ORDER - k + n]
    return key


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if data := letters(text):
                by_lang.setdefault(lang, []).append(data)
        for lang, texts in by_lang.items():
            for order in range(ORDER + 1):
                keys, n = np.unique(np.concatenate([grams(np.frombuffer(t, np.uint8), order) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "order": np.full(len(keys), order, np.int32), "gram": keys.astype(np.int64), "n": n.astype(np.int64)})


def training_sample(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text): per language the different texts with the smallest digests, whole. Copies
    are combined before they are ranked. A language without a text of at most SAMPLE_DOC_BYTES
    trains on its LONG_DOCS shortest ones. Only digests are ranked; the texts of the chosen ones
    are fetched by a second read."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.md5(F.col("text").cast("binary")).alias("_md5"))
    each = rows.groupBy("lang", "_md5").agg(F.min(F.octet_length("text")).alias("_bytes"))
    short = F.col("_bytes") <= SAMPLE_DOC_BYTES
    w = Window.partitionBy("lang")
    # within a language short texts come first, by digest; longer ones follow by length
    at = F.row_number().over(w.orderBy(F.when(short, 0).otherwise(F.col("_bytes")), "_md5"))
    best = each.withColumn("_at", at).where(F.col("_at") <= docs_per_language)
    fewest = best.withColumn("_least", F.min("_bytes").over(w))
    chosen = fewest.where(short | (F.col("_least") > SAMPLE_DOC_BYTES) & (F.col("_at") <= LONG_DOCS)).select("lang", "_md5")
    return rows.join(F.broadcast(chosen), ["lang", "_md5"], "left_semi").groupBy("lang", "_md5").agg(F.first("text").alias("text")).select("lang", "text")


class Model:
    """Frozen statistics of all languages. For each order: the packed grams any language has
    seen with their code lengths in every language (escapes included), and the contexts with
    their escapes."""

    def __init__(self, langs: list[str], orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.orders = langs, orders

    @staticmethod
    def fit(counts: pa.Table) -> Model:
        lang, order, gram, n = (counts.column(c).to_numpy() for c in ("lang", "order", "gram", "n"))
        langs = sorted(set(lang))
        at = np.array([langs.index(x) for x in lang], np.int64)
        orders: list = []
        for k in range(ORDER + 1):
            own = order == k
            grams_k, row = np.unique(gram[own].astype(U64), return_inverse=True)
            c = np.zeros((len(grams_k), len(langs)))
            c[row, at[own]] = n[own]
            contexts, ctx = np.unique(grams_k >> U64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, ctx, c)
            np.add.at(distinct, ctx, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(c / (total + distinct)[ctx])
            if k:
                below_grams, below = orders[k - 1][0], orders[k - 1][1]
                lower = below[np.searchsorted(below_grams, grams_k & U64((1 << (8 * k)) - 1))]
            else:
                lower = np.full(c.shape, 8.0)
            orders.append((grams_k, np.where(c > 0, seen, escape[ctx] + lower).astype(np.float32), contexts, escape.astype(np.float32)))
        return Model(langs, orders)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of every byte after the padding in every language."""
        out = np.zeros((len(data) - ORDER, len(self.langs)), np.float32)
        left = np.arange(len(out))
        key = grams(data, ORDER)
        for k in range(ORDER, -1, -1):
            known, cost, contexts, escape = self.orders[k]
            at, hit = self._find(known, key)
            out[left[hit]] += cost[at[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            at, hit = self._find(contexts, key >> U64(8))
            out[left[hit]] += escape[at[hit]]
            key = key & U64((1 << (8 * k)) - 1)
        out[left] += 8.0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior under equal priors, and bits per byte of the best language."""
        names, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if not self.langs:
            return names, score, rate
        data = [letters(t) for t in texts]
        sizes = [len(d) for d in data]
        for lo, hi in slices(sizes, CHUNK):
            total = np.zeros((hi - lo, len(self.langs)))
            # one long text is coded piece by piece, each piece with the contexts before it
            flat = np.frombuffer(b"".join(data[lo:hi]), np.uint8)
            start = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
            real = np.ones(len(flat), bool)
            begins = start[:-1][np.diff(start) > 0]
            for k in range(ORDER):
                real[begins + k] = False
            owner = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            for p in range(ORDER, len(flat), RUN):
                q = min(p + RUN, len(flat))
                cost = self.bits(flat[p - ORDER : q]) * real[p:q, None]
                own = owner[p:q]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
            best = total.argmin(axis=1)
            for i in np.flatnonzero(np.diff(start) > 0):
                gap = total[i] - total[i, best[i]]
                names[lo + i], score[lo + i] = self.langs[best[i]], 1.0 / np.exp2(-np.minimum(gap, 1000)).sum()
                rate[lo + i] = total[i, best[i]] / (sizes[lo + i] - ORDER)
        return names, score, rate


def fit(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS) -> Model:
    """Fit on rows (lang, text). The counts of the bounded sample are summed by Spark; what
    reaches the driver is bounded by the sample, not by the table."""
    # the sample is bounded, so one task counts a language's texts and gives each gram once
    sample = training_sample(labelled, docs_per_language).repartition("lang")
    counts = sample.mapInArrow(_count, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    return Model.fit(counts.toArrow())


def predictor(spark, model: Model):
    """A column function text -> struct(lang_pred, score, bits_per_byte)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, score, rate = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": score, "bits_per_byte": rate})

    return predict


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by checksum of its id is never learned from; a row without id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row of documents."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(rows.where(~held_out()))
    found = rows.select("doc_id", held_out().alias("held_out"), predictor(docs.sparkSession, model)("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits_per_byte")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows whose text has a language: not ``und``, and coded in at most REJECT_BITS a byte."""
    rows = docs.select("doc_id", text_of("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    predict = predictor(docs.sparkSession, fit(rows.where(~held_out())))
    mark = "_ppm_" + "_".join(docs.columns)
    kept = docs.withColumn(mark, predict(F.col("text").cast("string")))
    return kept.where((F.col(f"`{mark}`.lang_pred") != UNDETERMINED) & (F.col(f"`{mark}`.bits_per_byte") <= REJECT_BITS)).select(*[F.col(f"`{c}`") for c in docs.columns])
