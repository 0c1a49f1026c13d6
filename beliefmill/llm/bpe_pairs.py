"""Byte-pair encoding and decoding with a pair occurrence index.

All new words of a batch are laid out as one symbol array with links to their neighbours.
The index maps each mergeable pair to all its positions; the active pairs are taken in
ascending rank, each applied at all its positions at once, and only the lists of the pairs
that touch a merged position are updated.

Defined results: a null text is empty and has no ids; ids outside the vocabulary decode to
nothing; special strings in a text become their special ids and decode to themselves; rows
pass one by one, so repeated rows and empty tables need no care. Only id and text are read.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.llm.common import ODD_SPACES, slices, strings, text_of

#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts whose characters beyond ASCII are all Latin letters, for the faster library.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
BEYOND_LATIN = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
CACHE_WORDS = 400_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others are numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@contextmanager
def no_collector():
    """Many small lists and no cycles: Python's cycle search would only cost time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Vocabulary:
    """A byte-level vocabulary with a bounded cache of the ids of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        end = spec["model"].get("end_of_word_suffix") or ""
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.of_last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.left, self.right, self.joined = (np.array(c, np.int64) for c in zip(*merges, strict=True))
        pairs = self.left << 32 | self.right
        self.by_pair = np.argsort(pairs)
        self.pairs = pairs[self.by_pair]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of = {i: bytes(back[c] for c in s.removesuffix(end)) for s, i in vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        parts = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)] + [b""]  # the last stands for unknown ids
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where they don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.by_pair[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and where each word's begin (one more at the end)."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol, n = self.of_byte[data], len(data)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = ends[sizes > 0]
        symbol[full - 1] = self.of_last[data[full - 1]]
        nxt[full - 1] = -1
        prv[full[:-1]] = -1
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions into the index."""
            rank = self.ranks(symbol[at], symbol[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for own, r in zip(np.split(at, cut) if len(cut) else [at], rank[np.r_[0, cut]].tolist(), strict=True):
                if (known := where.get(r)) is None:
                    where[r] = [own]
                    heapq.heappush(active, r)
                else:
                    known.append(own)

        add(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = where.pop(r)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            a, b, new = int(self.left[r]), int(self.right[r]), int(self.joined[r])
            at = at[(symbol[at] == a) & (nxt[at] >= 0)]
            at = at[symbol[nxt[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping pairs in a row every second one merges
                at = np.unique(at)
                head = np.r_[True, nxt[at[:-1]] != at[1:]]
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            gone = nxt[at]
            symbol[at], symbol[gone] = new, -1
            after = nxt[gone]
            nxt[at] = after
            more = after >= 0
            prv[after[more]] = at[more]
            before = prv[at]
            before = before[before >= 0]
            both = (symbol[before] == new).any()  # neighbours that merged at once touch the same pair
            touched = np.concatenate([before, at[more]])
            add(np.unique(touched) if both else touched)
        alive = symbol >= 0
        bounds = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] if len(words) else np.zeros(1, np.int64)
        return symbol[alive], bounds

    def ids_of(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        ids, bounds = self.merge([w.encode("utf-8") for w in words])
        data, cut = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
        return {w: data[lo:hi] for w, lo, hi in zip(words, cut, cut[1:], strict=False)}

    def words(self, text: str, special: bool = True) -> list[str]:
        """What a text is split into before merging; special strings, if asked for, stand alone."""
        if special and self.specials is not None and self.specials.search(text):
            return [w for t in self.specials.split(text) if t for w in ([t] if t in self.special else self.words(t, False))]
        if BEYOND_LATIN.search(text) is None and ODD_SPACES.search(text) is None:
            return LATIN.findall(text)
        return self.split.findall(text)

    def learn(self, texts: list[list[str]]) -> None:
        """Merge the words that are not known yet, after emptying a cache beyond its bound."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        self.known |= {s: np.array([i], "<i4").tobytes() for s, i in self.special.items()}
        new: set[str] = set()
        for words in texts:
            new.update(words)
        if new := new - self.known.keys():
            self.known |= self.ids_of(list(new))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        with no_collector():
            words = [self.words(t) for t in texts]
            self.learn(words)
            join, get = b"".join, self.known.__getitem__
            return [join(map(get, w)) for w in words]

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        ids = np.where((ids >= 0) & (ids < len(self.sizes) - 1), ids, len(self.sizes) - 1)
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.begins[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[bounds].tolist()
        return [data[lo:hi].decode("utf-8", "replace") for lo, hi in zip(cut, cut[1:], strict=False)]


@lru_cache(maxsize=1)
def vocabulary_at(path: str) -> Vocabulary:
    """Kept by a Python worker from one task to the next."""
    return Vocabulary(path)


CHUNK = 1 << 21  # bytes of text encoded together


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids of every whole text; ``decoded`` adds the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary_at(vocabulary)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
            for lo, hi in slices(sizes, CHUNK):
                own = batch.slice(lo, hi - lo)
                ids = vocab.encode_batch(strings(own, "text"))
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = np.frombuffer(b"".join(ids), "<i4")
                columns = [own.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]
                if decoded:
                    columns.append(pa.array(vocab.decode_batch(values, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, text of every row of ids (null ids: empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary_at(vocabulary)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column("ids")), 0).to_pylist()
            for lo, hi in slices(sizes, CHUNK // 8):
                own = batch.slice(lo, hi - lo)
                ids = own.column("ids").flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = vocab.decode_batch(ids, np.concatenate([[0], np.cumsum(sizes[lo:hi])]))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them."""
    back = encode(docs, vocabulary, decoded=True)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
