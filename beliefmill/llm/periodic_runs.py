"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of words with smallest period q, of at least LEAST words and two periods,
that no neighbouring word extends. At the scale of blocks of b words (b = 4, 8, 16, ..) runs
of q in a range of distances around 2 b to 4 b hold a whole block that occurs again q words on:

1. Each block meets the window that follows it. The squared differences of word numbers, summed
   over the block at every distance, come from sums of squares and one number-theoretic
   transform of the products, exact integers modulo MODULUS; a distance without a mismatch
   has sum 0.
2. Distances with sum 0 are seeds. Each is extended word by word to both sides, which also
   discards sums that are 0 only modulo MODULUS, and gives the maximal stretch.
3. Scales and distances ascend, so a stretch found again at a multiple of its smallest period
   is known already.

Blocks are left out where no occurrence is possible (a word does not return in the window) or
where all occurrences are known: a block of at least q words whose window lies in a run of
period q occurs at multiples of q only. Texts are dealt in chunks, with a word of its own after
each, so one transform serves many texts.

Defined results: a null or empty text and one of blanks have no words, no runs and the digests
of nothing; repeated rows are rows of their own; a null id is never made periodic; any id and
extra columns pass by; an empty table gives no rows. A very long text is one chunk: its words
are held by one task. No row leaves its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.llm.common import slices

LEAST = 12
CHUNK = 1 << 20
MODULUS, GENERATOR = 15 * (1 << 27) + 1, 31  # a prime and a primitive root
ELEMENTS = 1 << 18  # of one transform
P = np.uint64(MODULUS)


def _roots(n: int, inverse: bool) -> np.ndarray:
    """The powers 0 to n / 2 - 1 of a root of unity of order n."""
    root = pow(GENERATOR, (MODULUS - 1) // n, MODULUS)
    if inverse:
        root = pow(root, -1, MODULUS)
    out = np.ones(max(n // 2, 1), np.uint64)
    done = 1
    while done < len(out):
        k = min(done, len(out) - done)
        out[done : done + k] = out[:k] * np.uint64(pow(root, done, MODULUS)) % P
        done += k
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order."""
    m, n = x.shape
    half = n // 2
    while half:
        pair = x.reshape(m, n // (2 * half), 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1]
        x = np.stack([(u + v) % P, (u + P - v) * _roots(2 * half, False) % P], axis=2)
        half //= 2
    return x.reshape(m, n)


def inverse_transform(x: np.ndarray) -> np.ndarray:
    """The rows whose ``transform`` is x."""
    m, n = x.shape
    half = 1
    while half < n:
        pair = x.reshape(m, n // (2 * half), 2, half)
        u, v = pair[:, :, 0], pair[:, :, 1] * _roots(2 * half, True) % P
        x = np.stack([(u + v) % P, (u + P - v) % P], axis=2)
        half *= 2
    return x.reshape(m, n) * np.uint64(pow(n, -1, MODULUS)) % P


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo MODULUS, of every block against each place of its window."""
    b, places = blocks.shape[1], windows.shape[1] - blocks.shape[1] + 1
    n = 1 << (windows.shape[1] - 1).bit_length()
    blocks, windows = blocks.astype(np.uint64) % P, windows.astype(np.uint64) % P
    x, y = (np.zeros((len(blocks), n), np.uint64) for _ in range(2))
    x[:, : windows.shape[1]] = windows
    y[:, 0] = blocks[:, 0]
    y[:, n - b + 1 :] = blocks[:, :0:-1]  # backwards, so that the product is a correlation
    both = inverse_transform(transform(x) * transform(y) % P)[:, :places]
    total = np.zeros((len(windows), windows.shape[1] + 1), np.uint64)
    np.cumsum(windows * windows % P, axis=1, out=total[:, 1:])
    own = (blocks * blocks % P).sum(axis=1) % P
    return (own[:, None] + (total[:, b:] - total[:, :places]) % P + np.uint64(2) * (P - both)) % P


def scales(longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(block length, stride, least distance, greatest distance) for periods up to half a text.

    The words of a run that have a like one period on number at least its period, and LEAST
    less the period: 6 at least, which hold a block of 4 at stride 3; or 2 b - 1, which hold
    an aligned block of b."""
    if longest >= LEAST:
        yield 4, 3, 1, 14
    b = 8
    while 2 * (2 * b - 1) <= longest:
        yield b, b, 2 * b - 1, 4 * b - 2
        b *= 2


def _extend(w: np.ndarray, lo: int, hi: int, d: int) -> tuple[int, int]:
    """The maximal stretch of words equal to the word d on that holds [lo, hi); empty if that doesn't hold."""
    if not np.array_equal(w[lo:hi], w[lo + d : hi + d]):
        return lo, lo
    step = 32
    while hi + d < len(w):
        end = min(hi + step, len(w) - d)
        differ = w[hi:end] != w[hi + d : end + d]
        at = int(differ.argmax())
        if differ[at]:
            hi += at
            break
        hi, step = end, 2 * step
    step = 32
    while lo > 0:
        begin = max(lo - step, 0)
        differ = (w[begin:lo] != w[begin + d : lo + d])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            lo -= at
            break
        lo, step = begin, 2 * step
    return lo, hi


def _survivors(w: np.ndarray, key: np.ndarray, nearest: np.ndarray, scale: tuple, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Starts of the blocks that may occur in their windows at a distance not yet known."""
    b, stride, least, most = scale
    n = len(w)
    starts = np.arange(0, n - b - least + 1, stride)
    if stride == b:
        far = nearest[: n // b * b].reshape(-1, b).max(axis=1)[: len(starts)]
    else:
        far = np.max([nearest[k : k + len(starts) * stride : stride][: len(starts)] for k in range(b)], axis=0)
    starts = starts[far <= most]
    for k in (0, b // 2, b - 1):  # each of these words returns within the asked distances
        if len(starts):
            low = w[starts + k] * np.int64(n) + starts + k + least
            found = key[np.minimum(np.searchsorted(key, low), n - 1)]
            starts = starts[(found >= low) & (found - low <= most - least)]
    if len(starts):
        known = np.zeros(n + 1, bool)
        for lo, hi, q in runs:
            if q <= b and hi - lo >= most + b:
                known[lo : hi - most - b + 1] = True
        starts = starts[~known[starts]]
    return starts


def find_runs(w: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run in the word numbers, 0 or more, of texts with
    a word of its own after each; ``longest``: words of the longest text."""
    n = len(w)
    w = w.astype(np.int64)
    order = np.argsort(w, kind="stable")
    key = w[order] * np.int64(n) + order
    nearest = np.full(n, n, np.int64)
    same = w[order[1:]] == w[order[:-1]]
    nearest[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: list[tuple[int, int, int]] = []
    for scale in scales(longest):
        b, _, least, most = scale
        starts = _survivors(w, key, nearest, scale, runs)
        if not len(starts):
            continue
        ends = np.concatenate([w, np.arange(most + b) + w.max() + 1])  # words of their own past the end
        size = 1 << (most - least + b - 1).bit_length()
        seeds = []
        for i in range(0, len(starts), max(1, ELEMENTS // size)):
            s = starts[i : i + max(1, ELEMENTS // size)]
            sums = mismatches(ends[s[:, None] + np.arange(b)], ends[s[:, None] + np.arange(least, most + b)])
            row, place = np.nonzero(sums == 0)
            seeds.append(np.stack([s[row], least + place]))
        at, apart = np.concatenate(seeds, axis=1)
        alive = np.ones(len(at), bool)
        spans = {(lo, hi) for lo, hi, _ in runs}

        def settle(lo: int, hi: int, q: int) -> None:
            """Seeds at multiples of q inside the run lead to it again."""
            i, j = np.searchsorted(at, (lo, hi - least - b + 1))
            if j > i:
                alive[i:j] &= (apart[i:j] % q != 0) | (at[i:j] + apart[i:j] + b > hi)

        for run in runs:
            settle(*run)
        for i in np.lexsort((at, apart)).tolist():
            if not alive[i]:
                continue
            d = int(apart[i])
            lo, hi = _extend(w, int(at[i]), int(at[i]) + b, d)
            end = hi + d
            if hi > lo:
                settle(lo, end, d)
                if end - lo >= max(LEAST, 2 * d) and (lo, end) not in spans:
                    spans.add((lo, end))
                    runs.append((lo, end, d))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def made_periodic(words: list[bytes], h: int) -> list[bytes]:
    """The words, a tail of them repeated in place as h says, for one h in ten."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of the runs of every text, by start and period."""
    if not texts:
        return []
    flat: list[bytes] = []
    for words in texts:
        flat += words
    number = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    w = np.insert(codes, stops, len(number) + np.arange(len(texts)))
    first = stops - sizes + np.arange(len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for lo, hi, q in find_runs(w, int(sizes.max())):
        i = int(np.searchsorted(first, lo, "right")) - 1
        out[i].append((lo - int(first[i]), hi - int(first[i]), q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie past the first period of any run."""
    keep = np.ones(len(words), bool)
    for lo, hi, q in runs:
        keep[lo + q : hi] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()] if runs else words


RUNS = "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    top = max(((hi - lo, -lo, -q) for lo, hi, q in runs), default=None)
    best = (-top[1], top[0], -top[2], 1000 * top[0] // -top[2]) if top else (None,) * 4
    listed = "".join(f"{lo},{hi - lo},{q}\n" for lo, hi, q in runs).encode("ascii")
    return doc_id, len(runs), *best, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices([len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0 for i in range(len(texts))], CHUNK):
            part = batch.slice(lo, hi - lo)
            words = [(t or b"").split() for t in part.column("text").to_pylist()]
            words = [w if h is None else made_periodic(w, h) for w, h in zip(words, part.column("h").to_pylist(), strict=True)]
            rows = [_report(*x) for x in zip(part.column("doc_id").to_pylist(), words, text_runs(words), strict=True)]
            kinds = [part.schema.field("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.string()]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Per row: its id, the number of runs, the longest one (of equals the first, then of smallest
    period; nulls if there is none), digests of all runs and of the text without what
    repeats. ``plant`` first makes the tail of one text in ten periodic, by crc32 of its id."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string")) if plant else F.lit(None).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), h.alias("h"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(_run, RUNS.format(id=rows.schema["doc_id"].dataType.simpleString()))
    return out.withColumnRenamed("doc_id", id_col)
