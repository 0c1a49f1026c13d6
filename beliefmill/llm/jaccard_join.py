"""N-gram Jaccard join with set-relation skipping.

A text's set holds its distinct SHINGLE-word shingles, lower-cased in A-Z; a shorter text is one
shingle. Two texts link if NUM / DEN of the union of their sets is common to both. The join
is exact; it gives the groups of linked texts.

Order. Shingles are ordered by hash, those of more than HOT sets after all others. Two linked
sets share a shingle of their prefixes, the first ``reach(n)`` of n in that order, so
only prefixes are indexed, and what many texts have in common gets there last.

Relations. A set is a member of a highly similar set, its leader, if they link and the leader
is no member itself; leaders come from MINIMA smallest hashes, and of sets alike in these that
with the fewest shingles outside of HOT ones leads. Members keep only what they
have more and less than their leader. In the index a group is one entry per shingle: its
sizes and the best room its members leave after the shingle's position.

Skipping. An index list joins its entries only where room and sizes allow a link; long lists
run in blocks of BLOCK entries by size and position, and pairs of blocks whose bounds rule all
links out are skipped. A pair that the list of the shingle before has found is not given again.
Lists of over LIST_MOST sets are dealt over tasks as pairs of blocks.

Answers. A candidate set is intersected with the other group's leader only, unless parities of
both tell that it is too far from all the group. The sizes of its
intersections with all members follow from that one and from the shingles in which they
differ, by lists over those; members are dealt in bounded blocks. Leaders ask first. The members
of a group ask only where the links found until then leave it apart from the other group, as
a link inside a component changes no answer.

List rows. What an index entry is compared by is cut to fields of FIELD bits, hashes to their
lowest TOKEN_BITS, and packed into longs. That loses no pair: a full field counts as without
bound, and lists of shingles alike in those bits are one list, also as the list of the shingle before.

Shingles are 64-bit hashes; two different ones of a pair of texts are taken for one with
a probability of about 1e-13 for texts of 1,000 words.

Defined results: a null or empty text, and one of blanks, has an empty set and links with
nothing, not even its copies; equal texts link; repeated rows link; a group without any id has
no component id; a very long text is one array in a task; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmill.llm.common import U64, mix, slices, text_id, text_of
from beliefmill.llm.order_minhash import BASE, CODES, FACTORS, components
from beliefmill.session import pin, small_side

SHINGLE = 5
NUM, DEN = 4, 5
MINIMA = 8
HOT = 16
BLOCK, LIST_MOST, MEMBERS_MOST = 256, 8192, 4096
TOKEN_BITS, FIELD, PART_BITS = 40, 24, 19
ALONE = -1  # component of a set without a known link
CHUNK = 1 << 20
SUM = NUM + DEN  # linked: SUM * common >= NUM * (n + m)


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([[U64(1)], np.cumprod(np.full(max(n - 1, 0), U64(base)), dtype=U64)])[:n]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending."""
    lowered = [t.lower() for t in texts]  # of bytes: A-Z only
    flat = np.frombuffer(b" ".join(lowered) + b" ", np.uint8)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    stop = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    sums = np.concatenate([[U64(0)], np.cumsum(CODES[flat] * _powers(len(flat), BASE), dtype=U64)])
    inverse = _powers(len(flat), pow(BASE, -1, 1 << 64))
    word = mix((sums[stop] - sums[begin]) * inverse[begin]) if len(begin) else np.zeros(0, U64)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    words = np.bincount(np.searchsorted(ends, begin, "right"), minlength=len(texts))
    padded = np.concatenate([word, np.zeros(SHINGLE, U64)])
    rolled = np.zeros(len(word), U64)
    for k in range(SHINGLE):
        rolled = rolled * U64(BASE) + padded[k : k + len(word)]
    rolled = mix(rolled)
    out, lo = [], 0
    for n in words.tolist():
        if n >= SHINGLE:
            out.append(np.unique(rolled[lo : lo + n - SHINGLE + 1]))
        elif n:
            short = np.full(1, n, U64)
            for i in range(lo, lo + n):
                short = mix(short * U64(BASE) + word[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
        lo += n
    return out


def reach(n):
    """Length of the prefix: a set of (NUM / DEN) n is the smallest that may link."""
    return n - -(-n * NUM // DEN) + 1


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Lists of longs as unsigned arrays; a null list is empty."""
    flat = column.values.to_numpy(zero_copy_only=False).view(U64)
    ends = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _parities(tokens: np.ndarray) -> np.ndarray:
    """A power of two of bits, two a shingle at least; bit i tells whether an odd number of
    shingles fall on i. Two sets differ in at least as many shingles as in parities."""
    size = 1 << max(8, (2 * len(tokens) - 1).bit_length())
    bits = np.bincount((tokens & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(U64)


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        tids, texts = batch.column("tid").to_pylist(), batch.column("text").to_pylist()
        for lo, hi in slices([len(t) for t in texts], CHUNK):
            yield tids[lo:hi], shingle_sets(texts[lo:hi])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tids, sets in _each_set(batches):
        probes = [s[: reach(len(s)) + len(s) // 20 + 2] for s in sets]
        keys = [np.array([s[0], *((s * f ^ (s >> U64(32))).min() for f in FACTORS[1:MINIMA])], U64) if len(s) else s for s in sets]
        odd = [_parities(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(probes), _lists(keys), _lists(odd)], ["tid", "n", "probe", "keys", "odd"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tids, sets in _each_set(batches):
        yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), _lists(sets)], ["tid", "tokens"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_id("text").alias("tid"), text_of("text").cast("binary").alias("text"))


def all_sets(docs: DataFrame) -> DataFrame:
    """One row per different text with a word: id, tid, n, doc_id (the smallest), the first of
    its shingles by hash (more than its prefix), the keys that name its leader, parities."""
    read = docs.select(F.col("doc_id").alias("doc_id"), text_id("text").alias("tid"))
    least = read.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    found = _texts(docs).mapInArrow(_probe, "tid binary, n long, probe array<bigint>, keys array<bigint>, odd array<bigint>").where("n > 0")
    once = found.groupBy("tid").agg(F.first(F.struct("n", "probe", "keys", "odd")).alias("s"))
    return pin(once.join(least, "tid").select(F.monotonically_increasing_id().alias("id"), "tid", "doc_id", "s.*"))


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens): all shingles of the sets of ``ids`` (id, tid), read again from the texts."""
    wanted = pin(ids.select("id", "tid").distinct())
    own = _texts(docs).join(small_side(wanted.select("tid")), "tid", "left_semi")
    found = own.mapInArrow(_whole, "tid binary, tokens array<bigint>").groupBy("tid").agg(F.first("tokens").alias("tokens"))
    return pin(found.join(wanted, "tid").select("id", "tokens"))


# -- leaders ----------------------------------------------------------------


def with_apart(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """Add the sizes n and m of sets ``a`` and ``b`` and ``apart``, a number of shingles in which they differ at least."""
    own = sets.select("id", "n", "odd")
    both = pairs.join(own.toDF(a, "n", "odd_a"), a).join(own.toDF(b, "m", "odd_b"), b)

    def folded(x: str, y: str) -> Column:
        """x at the size of y, if it is twice that."""
        half = F.size(y)
        two = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) == 2 * half, two).otherwise(F.col(x))

    differ = F.zip_with(folded("odd_a", "odd_b"), folded("odd_b", "odd_a"), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long"))
    apart = F.aggregate(differ, F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x, F.lit(0)))
    return both.withColumn("apart", F.when(F.greatest(F.size("odd_a"), F.size("odd_b")) <= 2 * F.least(F.size("odd_a"), F.size("odd_b")), apart).otherwise(F.abs(F.col("n") - F.col("m")))).drop("odd_a", "odd_b")


def leaders(sets: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): sets beside the set that leads most of their keys, where parities leave room for a link,
    with a set that leads over HOT others also for one with a member of its group.
    ``own`` (id, hot): the hot ones of their probes. Of sets with the same keys that with the fewest
    others leads: it has the least of its own, so what the others have changed lies around it."""
    keys = sets.select("id", F.posexplode("keys").alias("f", "key")).select("id", F.xxhash64("f", "key").alias("key"))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = pin(keys.join(counts, "key"))
    few = own.join(sets.select("id", F.size("probe").alias("known")), "id").select("id", (F.size("hot") - F.col("known")).alias("few"))
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree")).join(few, "id", "left")
    top = shared.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", "few", "id")).alias("top"))
    votes = shared.join(top, "key").groupBy("id", "top").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "top")).alias("best"))
    pairs = best.select(F.col("id").alias("a"), F.col("best.top.id").alias("b")).where("a <> b")
    voters = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("voters"))
    # what links with a member lies up to about twice as far from the leader
    far = F.when(F.col("voters") > HOT, 2).otherwise(1)
    return with_apart(pairs.join(voters, "b"), sets, "a", "b").where(SUM * F.col("apart") <= far * (F.col("n") + F.col("m"))).select("a", "b")


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        xs, ys = _arrays(batch.column("tokens_a")), _arrays(batch.column("tokens_b"))
        gain = [np.setdiff1d(x, y, assume_unique=True) for x, y in zip(xs, ys, strict=True)]
        lost = [np.setdiff1d(y, x, assume_unique=True) for x, y in zip(xs, ys, strict=True)]
        n, m, common = ([f(i) for i in range(len(xs))] for f in (lambda i: len(xs[i]), lambda i: len(ys[i]), lambda i: len(xs[i]) - len(gain[i])))
        yield pa.RecordBatch.from_arrays([a, b, *(pa.array(v, pa.int64()) for v in (n, m, common)), _lists(gain), _lists(lost)], ["a", "b", "n", "m", "common", "gain", "lost"])


def differences(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """For pairs (a, b): sizes n and m, the size of the intersection, and what a has more and less."""
    both = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    both = both.join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), "b").select("a", "b", "tokens_a", "tokens_b")
    return both.mapInArrow(_differ, "a long, b long, n long, m long, common long, gain array<bigint>, lost array<bigint>")


def linked(common: Column, n: Column, m: Column) -> Column:
    return SUM * common >= NUM * (n + m)


# -- the index --------------------------------------------------------------


def hot_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > HOT)


def hot_of(sets: DataFrame, column: str, hot: DataFrame) -> DataFrame:
    """(id, hot): the hot shingles of ``column`` with their numbers of sets, where there are any."""
    return sets.select("id", F.explode(column).alias("token")).join(small_side(hot), "token").groupBy("id").agg(F.collect_list(F.struct("token", "sets")).alias("hot"))


def crowded(sets: DataFrame, own: DataFrame) -> DataFrame:
    """(id, tid) of sets whose prefix may lie past what is known of them, as many of that are hot."""
    known = sets.select("id", "tid", "n", F.size("probe").alias("known")).join(own, "id")
    return known.where((F.col("known") - F.size("hot") < F.expr(f"n - ceil(n * {NUM} / {DEN}) + 1")) & (F.col("n") > F.col("known"))).select("id", "tid")


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix entries of sets whose ``tokens`` reach as far as the prefix."""
    for batch in batches:
        out: list[tuple] = []
        sets = _arrays(batch.column("tokens"))
        for gid, root, n, s, hot in zip(*(batch.column(c).to_pylist() for c in ("gid", "root", "n")), sets, batch.column("hot").to_pylist(), strict=True):
            size = reach(n)
            lists = np.zeros(min(size, len(s)), np.int64)
            if hot:
                many = np.array([x["token"] for x in hot], np.int64).view(U64)
                counts = np.array([x["sets"] for x in hot], np.int64)[np.argsort(many)]
                many.sort()
                cold = s[~np.isin(s, many, assume_unique=True)]
                s = np.concatenate([cold, many])
                lists = np.concatenate([np.zeros(len(cold), np.int64), counts])[:size]
            s = s[:size]
            before = np.concatenate([[s[0]], s[:-1]])  # the first one has none: itself
            out.append((s, np.full(len(s), gid), np.full(len(s), root), np.full(len(s), n), SUM * (n - np.arange(len(s))) - NUM * n, before, lists))
        if out:
            t, g, root, n, room, before, lists = (np.concatenate(c) for c in zip(*out, strict=True))
            cols = [t.view(np.int64), g, root, n, room, before.view(np.int64), lists]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["token", "gid", "root", "n", "room", "before", "sets"])


def entries(sets: DataFrame, tokens: DataFrame, groups: DataFrame, root: DataFrame, own: DataFrame, hot: DataFrame) -> DataFrame:
    """Index entries (token, gid, root, least, most, room, before, sets), one per group and shingle.
    ``own``: hot shingles of sets; ``tokens``: whole sets of the crowded ones (id); ``root``
    (id, root): components known so far, ALONE for sets of none."""
    leads = groups.groupBy("b").agg(F.first("b").alias("gid")).select(F.col("b").alias("id"), "gid")
    place = groups.select(F.col("a").alias("id"), F.col("b").alias("gid")).union(leads)
    place = place.join(root, "id", "full")
    long = tokens.join(place, "id", "left").join(hot_of(tokens, "tokens", hot), "id", "left").join(sets.select("id", "n"), "id")
    side = pin(own.join(place, "id", "full").join(tokens.select("id", F.lit(True).alias("long")), "id", "full"))
    short = sets.select("id", "n", F.col("probe").alias("tokens")).join(side, "id", "left").where("long IS NULL")
    cols = ["id", "n", "tokens", "hot", "gid", "root"]
    ready = short.select(*cols).union(long.select(*cols)).na.fill(ALONE, ["root"])
    kind = "token long, gid long, root long, n long, room long, before long, sets long"
    one = ready.where("gid IS NULL").withColumn("gid", F.col("id")).mapInArrow(_prefix, kind)
    one = one.select("token", "gid", "root", F.col("n").alias("least"), F.col("n").alias("most"), "room", "before", "sets")
    many = ready.where("gid IS NOT NULL").mapInArrow(_prefix, kind).groupBy("token", "gid").agg(
        F.first("root").alias("root"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"),
        F.when(F.min("before") == F.max("before"), F.min("before")).otherwise(F.col("token")).alias("before"), F.max("sets").alias("sets"))
    return one.union(many.select(*one.columns))


def _allowed(x: tuple, y: tuple) -> np.ndarray:
    """Whether entries may link: room and sizes allow it, groups and, where they are given, components
    differ, no earlier list has them."""
    (gx, lx, mx, rx, bx, tx), (gy, ly, my, ry, by, ty) = x[:6], y[:6]
    known = (bx == by) & (bx != tx) & (by != ty)
    for cx, cy in zip(x[6:], y[6:], strict=True):
        known = known | (cx == cy) & (cx != ALONE)
    return (gx != gy) & (rx >= NUM * ly) & (ry >= NUM * lx) & (DEN * my >= NUM * lx) & (DEN * mx >= NUM * ly) & ~known


def _long_list(cols: list[np.ndarray], block: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one long list, by blocks of entries of like size and position."""
    order = np.lexsort((-cols[3], cols[1]))
    cols = [c[order] for c in cols]
    side = None if block is None else block[order]
    cut = np.arange(0, len(order), BLOCK)
    least, most, room = np.minimum.reduceat(cols[1], cut), np.maximum.reduceat(cols[2], cut), np.maximum.reduceat(cols[3], cut)
    for i, at in enumerate(cut.tolist()):
        maybe = (room >= NUM * least[i]) & (room[i] >= NUM * least) & (DEN * most >= NUM * least[i]) & (DEN * most[i] >= NUM * least)
        for j in (np.flatnonzero(maybe[i:]) + i).tolist():
            x = [c[at : at + BLOCK, None] for c in cols]
            y = [c[None, cut[j] : cut[j] + BLOCK] for c in cols]
            fits = _allowed(x, y)
            if side is not None:
                fits &= side[at : at + BLOCK, None] != side[None, cut[j] : cut[j] + BLOCK]
            p, q = np.nonzero(fits)
            yield cols[0][at + p], cols[0][cut[j] + q]


def _packed(high: Column, low: Column) -> Column:
    """The lowest TOKEN_BITS of ``high`` above ``low``, cut to a field; none of it is negative."""
    most = (1 << FIELD) - 1
    return F.shiftleft(high, FIELD).bitwiseOR(F.least(F.greatest(low, F.lit(0)), F.lit(most)).cast("long"))


def _unpacked(entry: np.ndarray, limits: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """gid and root go beside: least, most, room, before, token, part_a, part_b, and which of the two parts."""
    most, parts = (1 << FIELD) - 1, (1 << PART_BITS) - 1
    free = np.int64(1 << 56)  # a full field
    token, room = entry.view(U64) >> U64(FIELD), entry & most
    before, least = limits.view(U64) >> U64(FIELD), limits & most
    size = place & most
    a, b = place >> FIELD & parts, place >> (FIELD + PART_BITS) & parts
    side = place >> (FIELD + 2 * PART_BITS) & 1
    return [least, np.where(size == most, free, size), np.where(room == most, free, room), before.view(np.int64), token.view(np.int64), a, b, np.where(side == 1, b, a)]


def _join_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of groups from rows in order of their lists."""
    held: list[np.ndarray] | None = None

    def joined(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.r_[True, (cols[5][1:] != cols[5][:-1]) | (cols[7][1:] != cols[7][:-1]) | (cols[8][1:] != cols[8][:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(new)])
        for k in np.unique(size[size > 1]).tolist():
            at = first[size == k]
            if k <= 16 and not (cols[7][at] != cols[8][at]).any():
                for i in range(k):
                    for j in range(i + 1, k):
                        fits = _allowed(tuple(c[at + i] for c in cols[:7]), tuple(c[at + j] for c in cols[:7]))
                        yield from given(cols[0][at + i][fits], cols[0][at + j][fits])
            else:
                for lo in at.tolist():
                    split = cols[7][lo] != cols[8][lo]
                    for p, q in _long_list([c[lo : lo + k] for c in cols[:7]], cols[9][lo : lo + k] if split else None):
                        yield from given(p, q)

    def given(p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(p):
            once = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], ["g", "h"])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "root", "entry", "limits", "place")]
        unpacked = _unpacked(*cols[2:])
        cols = [cols[0], *unpacked[:5], cols[1], *unpacked[5:]]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        # the last list may go on in the next batch
        last = (cols[5] == cols[5][-1]) & (cols[7] == cols[7][-1]) & (cols[8] == cols[8][-1])
        cut = len(last) - int(last.sum())
        if cut:
            yield from joined([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield from joined(held)


def candidates(index: DataFrame) -> DataFrame:
    """Pairs (g, h), g < h, of groups that may hold linked sets and are of no known common component."""
    parts = F.greatest(F.ceil(F.col("sets") / LIST_MOST), F.lit(1)).cast("long")
    dealt = index.withColumn("part", F.pmod(F.xxhash64("gid"), parts))
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.struct(F.least("part", other).alias("part_a"), F.greatest("part", other).alias("part_b")))
    small = dealt.where(F.col("sets") <= LIST_MOST).select("*", F.lit(0).cast("long").alias("part_a"), F.lit(0).cast("long").alias("part_b"))
    large = dealt.where(F.col("sets") > LIST_MOST).select("*", F.explode(met).alias("m")).select(*dealt.columns, "m.part_a", "m.part_b")
    both = small.unionByName(large)
    place = F.least("most", F.lit((1 << FIELD) - 1)).bitwiseOR(F.shiftleft("part_a", FIELD)).bitwiseOR(F.shiftleft("part_b", FIELD + PART_BITS))
    place = place.bitwiseOR(F.when((F.col("part") == F.col("part_b")) & (F.col("part_a") != F.col("part_b")), F.lit(1 << (FIELD + 2 * PART_BITS))).otherwise(F.lit(0)))
    packed = both.select(_packed(F.col("token"), F.col("room")).alias("entry"), _packed(F.col("before"), F.col("least")).alias("limits"), "gid", "root", place.cast("long").alias("place"))
    key = [F.shiftrightunsigned("entry", FIELD), F.shiftright("place", FIELD).bitwiseAND((1 << (2 * PART_BITS)) - 1)]
    return packed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_join_lists, "g long, h long").distinct()


# -- answers ----------------------------------------------------------------


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of asking sets to a group's members, from both's differences to the leader.
    Rows come by group and block, members before asking sets."""
    here, members = None, None
    rows: list[tuple] = []

    def listed(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(arrays)
        owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    def shared(lists: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, n: int) -> np.ndarray:
        flat, owner = lists
        lo, hi = np.searchsorted(flat, tokens), np.searchsorted(flat, tokens, "right")
        at = [owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
        return np.bincount(np.concatenate(at), minlength=n) if at else np.zeros(n, np.int64)

    for batch in batches:
        out: list[tuple] = []
        gains, losses = _arrays(batch.column("gain")), _arrays(batch.column("lost"))
        keys = zip(*(batch.column(c).to_pylist() for c in ("b", "block", "asks", "a", "n", "common")), strict=True)
        for (b, block, asks, a, n, common), gain, lost in zip(keys, gains, losses, strict=True):
            if (b, block) != here:
                here, rows, members = (b, block), [], None
            if not asks:
                rows.append((a, n, gain.copy(), lost.copy()))
                continue
            if not rows:
                continue
            if members is None:
                ids, sizes, g, r = zip(*rows, strict=True)
                members = np.array(ids), np.array(sizes), np.array([len(x) for x in r]), listed(list(g)), listed(list(r))
            ids, sizes, fewer, gained, lacked = members
            both = common - fewer + shared(lacked, lost, len(ids)) + shared(gained, gain, len(ids))
            hit = np.flatnonzero(SUM * both >= NUM * (n + sizes))
            if len(hit):
                out.append((a, int(ids[hit[0]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def facing(pairs: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, b, off, most): the smaller group of each candidate pair beside the other, where parities leave
    room for a link; how far the other's members are from its leader, and its largest size."""
    members = pin(groups.groupBy("b").agg(F.count(F.lit(1)).alias("members"), F.max("n").alias("most"), F.max(F.size("gain") + F.size("lost")).alias("off")))
    sized = with_apart(pairs, sets, "g", "h")
    for side, size in (("g", "n"), ("h", "m")):
        sized = sized.join(members.toDF(side, f"of_{side}", f"most_{side}", f"off_{side}"), side, "left").na.fill(0, [f"of_{side}", f"off_{side}"])
        sized = sized.withColumn(f"most_{side}", F.greatest(size, f"most_{side}"))
    sized = sized.where(SUM * (F.col("apart") - F.col("off_g") - F.col("off_h")) <= F.col("most_g") + F.col("most_h"))
    small = F.col("of_g") <= F.col("of_h")
    return sized.select(*[F.when(small, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("g", "h", "g"), ("h", "g", "b"), ("off_h", "off_g", "off"), ("most_h", "most_g", "most"))])


def asking(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the rows (a, b, off, most): (a, b) of sets beside a leader, where parities leave room for a
    link to it or to one of its members."""
    return with_apart(rows, sets, "a", "b").where(SUM * (F.col("apart") - F.col("off")) <= F.col("n") + F.col("most")).select("a", "b")


def members_asking(sides: DataFrame, groups: DataFrame, root: DataFrame) -> DataFrame:
    """(a, b, off, most): the members of the smaller group of the pairs that ``root`` (id, root) leaves apart."""
    own = groups.select(F.col("b").alias("g"), "a")
    apart = sides.join(own.select("g").distinct(), "g", "left_semi")
    for side in ("g", "b"):
        apart = apart.join(root.toDF(side, f"root_{side}"), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    apart = apart.where("root_g <> root_b").select("g", "b", "off", "most")
    return apart.join(own, "g").select("a", "b", "off", "most")


def answers(compared: DataFrame, groups: DataFrame, one_block: bool = False) -> DataFrame:
    """Links (a, b) of the asking sets, compared with the leaders, to these, or to a member of each
    block of theirs; with ``one_block`` of one of the blocks only."""
    members = pin(groups.groupBy("b").agg(F.count(F.lit(1)).alias("members"), F.max(SUM * F.size("gain") - NUM * F.col("n")).alias("best")))
    is_link = linked(F.col("common"), F.col("n"), F.col("m"))
    blocks = F.ceil(F.col("members") / MEMBERS_MOST).cast("long")
    # a member adds at most what it has more than its leader
    left = compared.where(~is_link).join(members, "b").where(SUM * F.col("common") - NUM * F.col("n") + F.col("best") >= 0)
    asked = F.pmod(F.xxhash64("a"), blocks).cast("long") if one_block else F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    asks = left.select("b", asked.alias("block"), F.lit(True).alias("asks"), "a", "n", "common", "gain", "lost")
    met = groups.join(left.select("b").distinct(), "b", "left_semi").join(members, "b")
    own = met.select("b", F.pmod(F.xxhash64("a"), blocks).cast("long").alias("block"), F.lit(False).alias("asks"), "a", "n", "common", "gain", "lost")
    rows = own.union(asks).repartition("b", "block").sortWithinPartitions("b", "block", "asks")
    return compared.where(is_link).select("a", "b").union(rows.mapInArrow(_derive, "a long, b long"))


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between different texts, enough to connect each that has any."""
    hot = pin(hot_tokens(sets.select(F.explode("probe").alias("token"))))
    own = pin(hot_of(sets, "probe", hot))
    led = pin(leaders(sets, own))
    full = pin(crowded(sets, own))
    named = led.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "tid"), "id")
    tokens = whole_sets(docs, full.union(named))
    # shingles past the probes are counted where many of a set's are hot
    past = hot_tokens(full.select("id").join(tokens, "id").select(F.explode("tokens").alias("token")))
    more = pin(past.join(hot, "token", "left_anti"))
    if not more.isEmpty():
        hot = pin(hot.union(more))
        own = pin(hot_of(sets, "probe", hot))
        new = crowded(sets, own).join(full, "id", "left_anti")
        tokens = tokens.union(whole_sets(docs, new.join(tokens.select("id"), "id", "left_anti")))
        full = full.union(new)
    compared = pin(differences(led, tokens))
    first = compared.where(linked(F.col("common"), F.col("n"), F.col("m")))
    groups = pin(first.join(first.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b", "n", "m", "common", "gain", "lost"))
    # sets that their leader doesn't link with may link with one of its members
    near = pin(answers(compared, groups, one_block=True))
    root = components(near).select(F.col("tid").alias("id"), "root")
    pairs = candidates(entries(sets, tokens.join(full.select("id"), "id", "left_semi"), groups, root, own, hot))
    sides = pin(facing(pin(pairs), groups, sets))

    def answered(rows: DataFrame) -> DataFrame:
        nonlocal tokens
        asked = pin(asking(rows, sets))
        ids = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        tokens = tokens.union(whole_sets(docs, ids.join(tokens.select("id"), "id", "left_anti").join(sets.select("id", "tid"), "id")))
        return answers(pin(differences(asked, tokens)), groups)

    found = pin(near.union(answered(sides.withColumnRenamed("g", "a"))))
    root = components(found).select(F.col("tid").alias("id"), "root")
    more = pin(members_asking(sides, groups, root))
    return found if more.isEmpty() else found.union(answered(more))


def components_of_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    sets = all_sets(docs)
    root = components(pin(links(docs, sets))).select(F.col("tid").alias("id"), "root")
    own = pin(sets.select("id", "tid", "n", "doc_id").join(root, "id", "left").withColumn("root", F.coalesce("root", "id")))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = own.join(least, "root").select("tid", "n", "component_id")
    rows = docs.select("doc_id", text_id("text").alias("tid")).join(known, "tid", "left")
    return rows.select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: All pairs that share a shingle.
COMPONENTS_SQL = r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT r, doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
    s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM w),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    e AS (SELECT x.r AS a, y.r AS b FROM s x JOIN s y ON x.s = y.s AND x.r < y.r GROUP BY x.r, y.r
          HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.r = x.r) + (SELECT n FROM n WHERE n.r = y.r) - count(*))),
    c(r, o) AS (SELECT r, r FROM n UNION SELECT e.b, c.o FROM c JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) e ON e.a = c.r)
    SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, CASE WHEN any_value(n.n) IS NULL THEN w.doc_id ELSE min(o.doc_id) END AS component_id
    FROM w LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN w o ON o.r = c.o GROUP BY w.r, w.doc_id"""
