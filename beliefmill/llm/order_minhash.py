"""Near-duplicate detection by order MinHash, verified by banded alignment.

A text is the sequence of its SHINGLE-word shingles (lower case, split at white space; a
shorter text is one shingle), each labelled with how often it occurred before. Each of
SKETCHES hash functions takes the PICKS labelled shingles with the smallest hashes and keeps
them in text order; the ordered picks are one key. Texts that share a key are candidates.

Two texts are linked if an order-preserving alignment of their labelled shingles within the
band that the threshold leaves matches m of them with m / (a + b - m) >= SIMILARITY.
Labelled shingles are unique in a text, so the best alignment is the longest increasing
run of matched positions. Linked texts form groups by transitive closure.

Equal texts are combined first. No key ever has all its pairs emitted: its texts are compared
with one leader, the text that shares keys with most others. Texts of one key that are still
in different groups can only be linked if they share some of what they differ in from their
leader, or if both are close to it (see ``candidates``); those pairs, found by equality joins,
are compared too, so no link between texts that share a key is lost.

Defined results: null texts and texts without a word are empty and form one group of equal
texts only if they are equal; repeated rows fall into one group; the class id is the smallest
doc_id of the group (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beliefmill.llm.common import U64, distinct_texts, mix, slices, text_id
from beliefmill.session import pin

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICKS = 24, 3
CHUNK = 1 << 18  # bytes sketched together: some arrays of longs of that length are held at once
CACHE = 1 << 22  # shingles that a task keeps of texts it compares
BASE = 0x9E3779B97F4A7C15
CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
FACTORS = [U64((0xD6E8FEB86659FD93 * (2 * i + 1) + 2 * i) % (1 << 64) | 1) for i in range(SKETCHES)]
PARITY = 8  # words of 64 parities of a text's shingles
TOP = U64(0xFFFFFFFFFFFFFFFF)


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([[U64(1)], np.cumprod(np.full(max(n - 1, 0), U64(base)), dtype=U64)])[:n]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all texts in order, and where each text's begin (one more at the end)."""
    lowered = [t.lower().encode("utf-8") for t in texts]
    flat = np.frombuffer(b" ".join(lowered) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    blank = (flat <= 32) & ((flat == 32) | ((flat >= 9) & (flat <= 13)))
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    stop = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    sums = np.concatenate([[U64(0)], np.cumsum(CODES[flat] * _powers(len(flat), BASE), dtype=U64)])
    inverse = _powers(len(flat), pow(BASE, -1, 1 << 64))
    word = mix((sums[stop] - sums[begin]) * inverse[begin] if len(begin) else np.zeros(0, U64))
    owner = np.searchsorted(ends, begin, "right")
    words = np.bincount(owner, minlength=len(texts))
    # a shingle of every run of SHINGLE words; shorter texts: of what there is
    count = np.where(words >= SHINGLE, words - SHINGLE + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])
    room = np.repeat(words, count) - (at - np.repeat(first, count))
    padded = np.concatenate([word, np.zeros(SHINGLE, U64)])
    out = np.zeros(len(at), U64)
    for k in range(SHINGLE):
        out = out * U64(BASE) + np.where(room > k, padded[at + k], U64(k + 1))
    text_of = np.repeat(np.arange(len(texts)), count)
    key = mix(out) ^ mix(text_of.astype(U64) * U64(BASE) + U64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1] if len(order) else np.zeros(0, bool)
    label = np.zeros(len(out), U64)
    if same.any():
        run = np.r_[False, same] | np.r_[same, False]
        inside = order[run]
        inside = inside[np.lexsort((inside, key[inside]))]
        new = np.r_[True, key[inside][1:] != key[inside][:-1]]
        begins = np.maximum.accumulate(np.where(new, np.arange(len(inside)), 0))
        label[inside] = (np.arange(len(inside)) - begins).astype(U64)
    return mix(out + label * U64(0xC2B2AE3D27D4EB4F)), bounds


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SKETCHES keys for every text that has a shingle."""
    count = np.diff(bounds)
    full = np.flatnonzero(count)
    begin, owner = bounds[:-1][full], np.repeat(np.arange(len(full)), count[full])
    keys = np.zeros((len(full), SKETCHES), U64)
    for f, factor in enumerate(FACTORS):
        value = mix(hashes * factor) if len(hashes) < 2 else (hashes * factor) ^ (hashes >> U64(32))
        picked = np.full((len(full), PICKS), len(hashes), np.int64)
        for p in range(PICKS):
            least = np.minimum.reduceat(value, begin)
            at = np.flatnonzero(value == least[owner])
            at = at[value[at] != TOP]
            own, one = np.unique(owner[at], return_index=True)
            picked[own, p] = at[one]
            value[at[one]] = TOP
        picked.sort(axis=1)
        chosen = np.append(hashes, U64(0))[picked]
        key = np.full(len(full), U64(f + 1))
        for p in range(PICKS):
            key = mix(key * U64(BASE) + chosen[:, p])
        keys[:, f] = key
    return keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tids, texts = batch.column("tid").to_pylist(), batch.column("text").to_pylist()
        for lo, hi in slices([len(t) for t in texts], CHUNK):
            hashes, bounds = shingles(texts[lo:hi])
            if not len(hashes):
                continue
            keys = sketches(hashes, bounds)
            own = [tids[lo + i] for i in np.flatnonzero(np.diff(bounds)).tolist()]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SKETCHES, dtype=np.int32)), pa.array(keys.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), flat], ["tid", "keys"])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether a banded alignment of two labelled shingle sequences reaches the threshold."""
    least = int(np.ceil(similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9))  # matches needed
    if min(len(a), len(b)) < least or not least:
        return False
    band = len(a) + len(b) - 2 * least
    order_a, order_b = np.argsort(a), np.argsort(b)
    sa, sb = a[order_a], b[order_b]
    spot = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    hit = sb[spot] == sa
    i, j = order_a[hit], order_b[spot[hit]]
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least:
        return False
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        return True
    tails: list[int] = []
    for x in j.tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails) >= least


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        size = 0
        for batch in batches:
            kept: list[tuple] = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                for tid, text in ((a, ta), (b, tb)):
                    if tid not in known:
                        if size > CACHE:
                            known, size = {k: known[k] for k in (a, b) if k in known}, 0
                        known[tid] = shingles([text])[0]
                        size += len(known[tid])
                if aligned(known[a], known[b], similarity):
                    kept.append((a, b))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*kept, strict=True)], ["a", "b"])

    return run


def linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of text ids that the alignment links."""
    t = texts.select("tid", "text")
    both = pairs.join(t.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a").join(t.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")
    return both.sortWithinPartitions("b", "a").mapInArrow(_verify(similarity), "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(tid, root) for every end of an edge: smallest id reachable. Labels hook onto their
    smallest neighbour's and then jump to the label of their label until nothing changes."""
    both = pin(edges.union(edges.select("b", "a")).distinct().toDF("src", "tid"))
    labels = pin(both.groupBy("tid").agg(F.min("src").alias("m")).select("tid", F.least("tid", "m").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("tid").alias("src"), "root"), "src").groupBy("tid").agg(F.min("root").alias("m"))
        hooked = labels.join(seen, "tid").select("tid", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("tid").alias("root"), F.col("root").alias("up"))
        new = pin(hooked.join(jump, "root").select("tid", F.least("root", "up").alias("root"), "old"))
        labels = new.select("tid", "root")
        if new.where("root <> old").isEmpty():
            return labels


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITY words: bit i tells whether an odd number of shingles fall on i. Two texts differ
    in at least as many shingles as their parities in bits."""
    bits = np.bincount((hashes % U64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _differences(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            out: list[tuple] = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if b not in known:
                    known = {b: shingles([tb])[0]}
                x, led = shingles([ta])[0], known[b]
                differ = np.setxor1d(x, led, assume_unique=True)
                few = differ[: int((1 - similarity) / similarity * len(x) + 1e-6) + 1] ^ U64(1 << 63)
                out.append((a, b, len(x), len(led), len(differ), aligned(x, led, similarity), few.astype(np.int64), *parities(x).tolist()))
            if out:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.int64()] * PARITY)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["tid", "leader", "n", "n_leader", "apart", "linked", "differ", *_words()])

    return run


def differences(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """For pairs (a, b) of a text and a leader: sizes, the size of the symmetric difference of
    their labelled shingles, whether they are linked, and the smallest shingles of that
    difference: one more than a linked text may differ in; and the parities of the text."""
    t = texts.select("tid", "text")
    both = pairs.join(t.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a").join(t.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")
    return both.sortWithinPartitions("b", "a").mapInArrow(_differences(similarity), "tid binary, leader binary, n long, n_leader long, apart long, linked boolean, differ array<bigint>, " + ", ".join(f"{w} long" for w in _words()))


def _words() -> list[str]:
    return [f"p{i}" for i in range(PARITY)]


def _signature() -> list:
    """Two sums over the texts of a group that, with its size, tell sets of texts apart."""
    half = [F.xxhash64("tid", F.lit(i)).cast("decimal(20,0)") for i in (0, 1)]
    return [F.sum(h).alias(f"s{i}") for i, h in enumerate(half)]


def candidates(member: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of one leader's texts in different groups that may still be linked.

    What two texts differ in is what their differences from the leader differ in, and linked
    texts differ in at most u (n(x) + n(y)) shingles, u = (1 - similarity) / (1 + similarity).
    So either both differences together are that small, and then the text that is not linked
    to the leader is close to it but in another order; or they share a shingle. The first that
    they share is among the kept ones of both, and its places there bound what is shared.
    """
    u = (1 - similarity) / (1 + similarity)
    room = u * (F.col("x.n") + F.col("y.n")) + 1e-6
    # groups differ, and sizes and parities leave room for a link
    odd = reduce(add, [F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in _words()])
    other = (odd <= room) & (F.col("x.n") >= F.col("y.n") * similarity - 1e-6) & (F.col("y.n") >= F.col("x.n") * similarity - 1e-6) & (F.col("x.leader") == F.col("y.leader"))
    token = member.select("leader", "tid", "root", "n", "apart", *_words(), F.posexplode("differ").alias("at", "token")).withColumn("rest", F.col("apart") - F.col("at"))
    # shingles that only one group has link nothing, and of those that the very same texts have the first will do
    held = token.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("held"), *_signature(), F.min("root").alias("r0"), F.max("root").alias("r1"))
    one = held.where("r0 <> r1").groupBy("leader", "held", "s0", "s1").agg(F.min("token").alias("token")).select("leader", "token")
    token = token.join(one, ["leader", "token"])
    least = F.col("x.at") + F.col("y.at") + F.abs(F.col("x.rest") - F.col("y.rest"))
    shared = token.alias("x").join(token.alias("y"), other & (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & (least <= room))
    near = member.where(F.col("apart") <= (1 - similarity) / similarity * F.col("n") + 1e-6).drop("differ")
    moved = near.where(~F.col("linked") & (F.col("apart") <= u * (F.col("n") + F.col("n_leader")) + 1e-6))
    close = moved.alias("x").join(near.alias("y"), other & (F.col("x.root") != F.col("y.root")) & (F.col("x.apart") + F.col("y.apart") <= room))
    pick = [F.least("x.tid", "y.tid").alias("a"), F.greatest("x.tid", "y.tid").alias("b")]
    return shared.select(*pick).union(close.select(*pick)).distinct()


def near_links(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(tid, root) of every text that has a near-duplicate among the distinct ``texts``."""
    keys = texts.select("tid", "text").mapInArrow(_sketch, "tid binary, keys array<bigint>").select("tid", F.explode("keys").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = pin(keys.join(counts, "key"))
    own = pin(texts.select("tid", "text").join(shared.select("tid").distinct(), "tid"))
    degree = shared.groupBy("tid").agg(F.sum("n").alias("degree"))
    leaders = shared.join(degree, "tid").groupBy("key").agg(F.max(F.struct("degree", "tid")).alias("top"))
    led = pin(shared.join(leaders, "key").select("key", "tid", "top"))
    best = led.groupBy("tid").agg(F.max("top").alias("top")).select(F.col("tid").alias("a"), F.col("top.tid").alias("b")).where("a <> b")
    edges = pin(linked(best, own, similarity))

    def open_keys(root: DataFrame) -> DataFrame:
        """Rows (key, tid, leader) of the keys whose texts are in more than one group."""
        member = led.select("key", "tid", F.col("top.tid").alias("leader")).join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
        several = member.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        return member.join(several, "key")

    pairs = open_keys(components(edges)).where("tid <> leader").select(F.col("tid").alias("a"), F.col("leader").alias("b")).distinct()
    compared = pin(differences(pairs, own, similarity))
    edges = edges.union(compared.where("linked").select("tid", "leader"))
    root = components(edges)
    left = open_keys(root).select("leader").distinct()
    member = compared.join(left, "leader", "left_semi").join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    last = pin(linked(candidates(pin(member), similarity), own, similarity))
    return components(edges.union(last))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group), members (rows of the group) per row."""
    root = near_links(distinct_texts(docs), similarity)
    rows = docs.select("doc_id", text_id("text").alias("tid")).join(root, "tid", "left").select("doc_id", F.coalesce("root", "tid").alias("root"))
    groups = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return rows.join(groups, "root").select("doc_id", "class_id", "members")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The row with the smallest doc_id of every group (nulls last; one of repeated rows)."""
    root = near_links(distinct_texts(docs), similarity)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("row"), F.col("doc_id").alias("id"), text_id("text").alias("tid"))
    order = [F.col("id").asc_nulls_last(), F.col("tid")]
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("tid").orderBy(*order))).where("at = 1").drop("at")
    rows = rows.join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("at = 1")
    return rows.select("row.*")
