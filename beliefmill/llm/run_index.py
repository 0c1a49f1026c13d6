"""Removal of long repeated byte strings with run-length suffix indexes.

A string of WINDOW bytes is removed wherever it starts if it also starts anywhere else. The
corpus is never indexed as a whole. Every window has an anchor: the position in it whose
GRAM bytes hash lowest (leftmost of equals), so equal windows have equal anchors at equal
offsets. Consecutive windows with one anchor form a stretch. Steps:

1. All stretches are counted by anchor hash; those with an anchor of their own are done.
2. Equal stretches (by digest of their bytes) are combined: a stretch found twice is
   repeated as a whole, and one of it stands for all from here on.
3. Different stretches that share an anchor hash meet in one task, a bounded number at a
   time, and are indexed: Burrows-Wheeler transform over the window starts, run-compressed,
   with the suffix positions sampled at both ends of each run. Common prefixes with the
   neighbour in suffix order are compared only at run ends; inside runs they follow by
   subtracting one, which gives matching statistics as a stream in text order. Statistics
   of at least WINDOW bytes mark a start.
4. An anchor with over GROUP_MOST different stretches is resolved without an index: its
   windows are counted by digest, combined before the shuffle.

Defined results: null texts are empty; a text under WINDOW bytes loses nothing; equal texts of at least WINDOW bytes lose everything;
repeated rows are separate documents; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.llm.common import U64, distinct_texts, mix, slices, text_id
from beliefmill.session import pin, shuffle_width

WINDOW, GRAM = 400, 128
GROUP_MOST = 4096
BLOCK = 2048  # stretches indexed together, more only to complete an anchor's group
CHUNK = 1 << 20
POSITION_BITS = U64(24)
BASE = U64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * BASE)


CODES = _byte_codes()


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of ``data``: gram hashes, and per window the position of its anchor."""
    h, power, length = CODES[data], int(BASE), 1
    while length < GRAM:
        h = h[:-length] * U64(power) + h[length:]
        power, length = power * power % (1 << 64), 2 * length
    h = mix(h)
    low = U64((1 << int(POSITION_BITS)) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=U64)
    width, span = 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = span - width
    best = np.minimum(best[: len(best) - rest], best[rest:]) if rest else best
    return h, (best & low).astype(np.int64), best


def stretches(texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(text number, anchor hash, first window start, windows) of every stretch."""
    for lo, hi in slices([len(t) for t in texts], CHUNK):
        start = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])])
        flat = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        for at in range(0, len(flat), 8 * CHUNK):
            part = flat[at : at + 8 * CHUNK + WINDOW - 1]
            if len(part) < WINDOW:
                break
            h, anchor, _ = anchors(part)
            owner = np.searchsorted(start, np.arange(at, at + len(anchor)), "right") - 1
            inside = np.arange(at, at + len(anchor)) + WINDOW <= start[owner + 1]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
            first = np.flatnonzero(new)
            count = np.add.reduceat(inside.astype(np.int64), first)  # windows past the end of a text come last in a stretch
            ok = (count > 0) & inside[first]
            f, c = first[ok], count[ok]
            yield from zip((lo + owner[f]).tolist(), h[anchor[f]].astype(np.int64).tolist(), (at + f - start[owner[f]]).tolist(), c.tolist(), strict=True)


STRETCH = "anchor long, digest binary, tid binary, first int, windows int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tids, texts = batch.column("tid").to_pylist(), [t.encode("utf-8") for t in batch.column("text").to_pylist()]
        for lo, hi in slices([len(t) for t in texts], 8 * CHUNK):
            out: list[tuple] = []
            for i, h, first, n in stretches(texts[lo:hi]):
                out.append((h, hashlib.md5(texts[lo + i][first : first + n + WINDOW - 1], usedforsecurity=False).digest(), tids[lo + i], first, n))
            if out:
                h, d, t, f, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.binary()), pa.array(t, pa.binary()), pa.array(f, pa.int32()), pa.array(n, pa.int32())], ["anchor", "digest", "tid", "first", "windows"])


class RunIndex:
    """Run-compressed transform of the window starts of some stretches."""

    def __init__(self, texts: list[bytes], windows: list[int]):
        sizes = np.array([len(t) for t in texts])
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.windows = np.array(windows)
        flat = np.frombuffer(b"\0".join(texts) + b"\0" * 8, np.uint8)
        total = int((sizes + 1).sum())
        end = np.repeat(self.begin + sizes, sizes + 1)  # where the text of each position ends
        self.starts = np.concatenate([np.arange(b, b + w) for b, w in zip(self.begin, windows, strict=True)])
        # ranks by 8 bytes, then doubled up to a length no stretch exceeds; what lies past an
        # end ranks below all else and is different for every text
        word = np.zeros(total, U64)
        left = end - np.arange(total)
        for k in range(8):
            byte = np.where(left > k, flat[k : k + total], 0).astype(U64)
            word = (word << U64(8)) | byte
        ranks = [np.unique(word, return_inverse=True)[1].astype(np.int32)]
        length, longest = 8, int(sizes.max())
        self.lengths = [8]
        own = np.repeat(np.arange(len(texts)), sizes + 1)
        while length < longest:
            nxt = np.minimum(np.arange(total) + length, total - 1)
            tail = np.where(left > length, ranks[-1][nxt] + len(texts) + 1, own + 1)
            key = ranks[-1].astype(np.int64) * (total + len(texts) + 2) + tail
            ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
            length *= 2
            self.lengths.append(length)
        self.flat, self.left, self.ranks = flat, left, ranks
        s = self.starts
        self.order = s[np.argsort(ranks[-1][s], kind="stable")]
        # the transform: the byte before each suffix; a stretch's first start has none
        before = np.where(np.isin(self.order, self.begin), -1 - np.arange(len(self.order)), flat[self.order - 1].astype(np.int64))
        edge = np.r_[True, before[1:] != before[:-1]]
        self.heads = np.flatnonzero(edge)
        self.tails = np.r_[self.heads[1:] - 1, len(s) - 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at positions a and b, ends never matching."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        last = len(self.left) - 1
        for rank, length in zip(reversed(self.ranks), reversed(self.lengths), strict=True):
            same = (rank[a] == rank[b]) & (self.left[a] >= length) & (self.left[b] >= length)
            out += same * length
            a, b = np.minimum(a + same * length, last), np.minimum(b + same * length, last)
        alive = np.ones(len(a), bool)
        for k in range(8):
            alive &= (self.left[a] > k) & (self.left[b] > k)
            alive[alive] &= self.flat[a[alive] + k] == self.flat[b[alive] + k]
            out += alive
        return out

    def statistics(self) -> np.ndarray:
        """For every start in text order the longest match with another start's suffix."""
        n = len(self.order)
        at = np.full(len(self.left), -1, np.int64)
        at[self.starts] = np.arange(n)
        best = np.zeros(n, np.int64)
        for sampled, step in ((self.heads, -1), (self.tails, 1)):
            value, known = np.zeros(n, np.int64), np.zeros(n, bool)
            other = sampled + step
            real = (other >= 0) & (other < n)
            here = self.order[sampled]
            known[at[here]] = True
            value[at[here[real]]] = self.common(here[real], self.order[other[real]])
            # a start inside a run matches one byte less than the start before it
            source = np.maximum.accumulate(np.where(known, np.arange(n), 0))
            best = np.maximum(best, value[source] - (np.arange(n) - source))
        return best

    def repeated(self) -> list[list[tuple[int, int]]]:
        """Per stretch the runs [from, to) of its starts that begin a repeated window."""
        hit = self.statistics() >= WINDOW
        out, lo = [], 0
        for w in self.windows.tolist():
            own = np.diff(np.r_[0, hit[lo : lo + w].astype(np.int8), 0])
            out.append(list(zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True)))
            lo += w
        return out


MARKS = "digest binary, lo int, hi int"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush(own: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = RunIndex([r[2] for r in own], [r[3] for r in own]).repeated()
        marks = [(r[1], lo, hi) for r, spans in zip(own, found, strict=True) for lo, hi in spans]
        if marks:
            d, lo, hi = zip(*marks, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["digest", "lo", "hi"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "bytes", "windows")), strict=True):
            if len(rows) >= BLOCK and row[0] != rows[-1][0]:
                yield from flush(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from flush(rows)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode("utf-8")
            a, d, w = zip(*((x["anchor"], x["digest"], x["windows"]) for x in wanted), strict=True)
            cut = [data[x["first"] : x["first"] + x["windows"] + WINDOW - 1] for x in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.binary()), pa.array(cut, pa.binary()), pa.array(w, pa.int32())], ["anchor", "digest", "bytes", "windows"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digest, data, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "bytes", "windows")), strict=True):
            own = [hashlib.md5(data[i : i + WINDOW], usedforsecurity=False).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(own, pa.binary())], ["digest", "lo", "window"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tid, text, copies, starts in zip(*(batch.column(c).to_pylist() for c in ("tid", "text", "copies", "starts")), strict=True):
            data = text.encode("utf-8")
            spans: list[list[int]] = []
            if copies > 1 and len(data) >= WINDOW:
                spans = [[0, len(data)]]
            else:
                for lo, hi in sorted((x["lo"], x["hi"]) for x in starts or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(data[at:lo])
                at = hi
            kept.append(data[at:])
            out.append((tid, len(data), sum(hi - lo for lo, hi in spans), len(spans), b"".join(kept)))
        if out:
            t, n, r, s, k = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.binary())], ["tid", "n_bytes", "n_removed", "n_spans", "kept"])


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_cut``, only texts that lose something, and what is kept as text. Decoding here takes no
    second Python worker beside the one that cuts."""
    for batch in _cut(batches):
        some = batch.filter(pc.greater(batch.column("n_removed"), 0))
        kept = pa.array([x.decode("utf-8", "ignore") for x in some.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([some.column("tid"), kept], ["tid", "kept"])


CUT = "tid binary, n_bytes long, n_removed long, n_spans long, kept binary"


def shared_stretches(texts: DataFrame) -> DataFrame:
    """Stretches whose anchor hash occurs at least twice; ``several``: with different bytes."""
    found = texts.select("tid", "text").mapInArrow(_scan, STRETCH)
    counts = texts.select("tid", "text").mapInArrow(_scan, STRETCH).select("anchor", F.xxhash64("digest").alias("d")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    counts = counts.where("n > 1").select("anchor", (F.col("d0") != F.col("d1")).alias("several"))
    return found.join(counts, "anchor")


def repeated_starts(texts: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """(tid, lo, hi): byte ranges covered by repeated windows, of distinct texts."""
    shared = pin(shared_stretches(texts))
    kinds = shared.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("several"), F.min(F.struct("tid", "first", "windows", "anchor")).alias("r"))
    kinds = pin(kinds.select("digest", "n", "several", "r.*"))
    whole = kinds.where("n > 1").select("digest", F.lit(0).alias("lo"), F.col("windows").alias("hi"))
    wanted = kinds.where("several").groupBy("tid").agg(F.collect_list(F.struct("anchor", "digest", "first", "windows")).alias("wanted"))
    cut = texts.select("tid", "text").join(wanted, "tid").select("text", "wanted").mapInArrow(_extract, "anchor long, digest binary, bytes binary, windows int")
    groups = kinds.where("several").groupBy("anchor").agg(F.count(F.lit(1)).alias("members"))
    cut = pin(cut)
    large = groups.where(F.col("members") > group_most).select("anchor")
    small = cut.join(large, "anchor", "left_anti")
    width = shuffle_width(texts.sparkSession)
    indexed = small.repartition(width, "anchor").sortWithinPartitions("anchor", "digest").mapInArrow(_index, MARKS)
    windows = cut.join(large, "anchor", "left_semi").mapInArrow(_windows, "digest binary, lo int, window binary")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    counted = windows.join(again, "window").select("digest", "lo", (F.col("lo") + 1).alias("hi"))
    marks = whole.unionByName(indexed).unionByName(counted)
    return shared.join(marks, "digest").select("tid", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + WINDOW - 1).alias("hi"))


def remove_repeats(docs: DataFrame, text_col: str = "text", group_most: int = GROUP_MOST, changed_texts: bool = False) -> DataFrame:
    """tid, n_bytes, n_removed, n_spans, kept (bytes) for every distinct text of ``docs``; with
    ``changed_texts`` tid and kept, as text without bytes of split characters, of those that lose something."""
    texts = distinct_texts(docs, text_col)
    starts = repeated_starts(texts, group_most).groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    return texts.join(starts, "tid", "left").select("tid", "text", "copies", "starts").mapInArrow(*((_cut_texts, "tid binary, kept string") if changed_texts else (_cut, CUT)))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of documents."""
    cut = remove_repeats(docs).select("tid", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_id("text").alias("tid")).join(cut, "tid").drop("tid")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """documents with the repeated strings cut out of their texts; bytes of characters that a
    cut splits go too. Rows stay, n_chars follows the text, a null text stays null."""
    cut = remove_repeats(docs, changed_texts=True).select(F.col("tid").alias("_tid"), F.col("kept").alias("_kept"))
    d, c = docs.alias("d"), cut.alias("c")
    joined = d.join(c, text_id("d.text") == F.col("c._tid"), "left")
    text = F.when(F.col("c._tid").isNull() | F.col("d.text").isNull(), F.col("d.text")).otherwise(F.col("c._kept"))
    own = {"text": text, "n_chars": F.when(F.col("c._tid").isNull() | F.col("d.text").isNull(), F.col("d.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("c._kept"))}
    return joined.select(*[(own[x].cast(docs.schema[x].dataType) if x in own else F.col(f"d.`{x}`")).alias(x) for x in docs.columns])

