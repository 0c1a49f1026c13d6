"""Packing examples into sequences under several limits at once (vector bin packing).

An example has a demand for each limit, such as tokens, segments and loss-bearing tokens.
One sequence is filled at a time: among the examples that still fit, the one whose demand
vector has the largest dot product with what the sequence has left goes in next (both in
units of the limits).

Rows are dealt evenly by a hash of their key and sorted, then packed in chunks of bounded
size, so results do not depend on arrival order and no task holds its whole partition. The
last open sequence of a chunk is taken up again in the next one: at most one sequence per
partition stays open.

Defined results: a null text is empty and packs as its end token alone; an example beyond a
limit gets a sequence of its own; repeated rows are separate examples; an empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefmill.llm.bpe_pairs import BEYOND_LATIN, CHUNK, LETTERS, Vocabulary, no_collector
from beliefmill.llm.common import ODD_SPACES, slices, strings, text_of
from beliefmill.session import shuffle_width

TOKENS, SEGMENTS = 2048, 512
CHUNK_ROWS = 4096
CACHE_BYTES = 64 << 20  # of words and their ids, a Python worker
# Fixed value: how the vocabulary splits a normalised text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_ID = 1
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")  # for Latin texts


class WordTokens:
    """Ids of a tokenizer that drops white space, with a bounded cache of words. New words are
    merged together by a pair index; texts with a special string or with separators that not
    all call white space go to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(SPLIT)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str] | None:
        """The words of a normalised text; None if it is one for the library."""
        if ODD_SPACES.search(text) or "<|" in text and self.vocabulary.specials.search(text):
            return None
        if text.isascii():
            form = text.lower()
        elif "\u03a3" in text:  # the one letter whose lower case depends on its place
            form = self.tokenizer.normalizer.normalize_str(text)
        else:
            form = unicodedata.normalize("NFC", text).lower()
        return LATIN.findall(form) if BEYOND_LATIN.search(form) is None else self.split.findall(form)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of whole texts."""
        with no_collector():
            if self.held > CACHE_BYTES:
                self.known, self.held = {}, 0
            words = [self.words(t) for t in texts]
            new: set[str] = set()
            for w in words:
                new.update(w or ())
            if new := new - self.known.keys():
                found = self.vocabulary.ids_of(list(new))
                self.known |= found
                self.held += sum(map(sys.getsizeof, found)) + sum(map(sys.getsizeof, found.values())) + 100 * len(found)
            join, get = b"".join, self.known.__getitem__
            return [self.library(t) if w is None else join(map(get, w)) for t, w in zip(texts, words, strict=True)]

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def tokens_at(path: str) -> WordTokens:
    """Kept by a Python worker from one task to the next."""
    return WordTokens(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize every whole text, append ``end_id``, cut into pieces of at most ``capacity``
    ids. ``with_ids`` adds the ids themselves."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_at(tokenizer)
        for batch in batches:
            texts, out = strings(batch, "text"), []
            coded = [x for lo, hi in slices([len(t) for t in texts], CHUNK) for x in tokens.encode_batch(texts[lo:hi])]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                ids += end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, *([np.frombuffer(piece, "<i4")] if with_ids else [])))
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if with_ids and cols else [])
            if cols:
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def place(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Sequences as lists of row numbers. Rows of equal demand are one class, taken in order."""
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    members = np.argsort(kind_of.ravel(), kind="stable")
    left = np.bincount(kind_of.ravel(), minlength=len(kinds))
    first = np.concatenate([[0], np.cumsum(left)[:-1]])
    weight = kinds / limits
    out: list[list[int]] = []
    open_kinds = np.arange(len(kinds))
    while len(open_kinds):
        room, rows = limits.astype(np.int64), []
        while True:
            fits = open_kinds[(kinds[open_kinds] <= room).all(axis=1)]
            if not len(fits):
                if rows:
                    break
                fits = open_kinds[:1]  # beyond a limit by itself
            best = fits[(weight[fits] @ (np.maximum(room, 0) / limits)).argmax()]
            rows.append(int(members[first[best]]))
            first[best] += 1
            left[best] -= 1
            room = room - kinds[best]
            if not left[best]:
                open_kinds = open_kinds[open_kinds != best]
            if (room <= 0).any():
                break
        out.append(rows)
    return out


def pack(items: DataFrame, key: list[str], demands: dict[str, int]) -> DataFrame:
    """Add sequence_id and offset (running sum of the first demand within the sequence).

    ``key`` orders the examples; ``demands`` maps demand columns to their limits, the first
    being the one that positions count in. A null demand counts as 0."""
    names, limits = list(demands), np.array(list(demands.values()), np.int64)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, kept = TaskContext.get().partitionId(), 0, None

        def emit(rows: pa.Table, last: bool):
            nonlocal made, kept
            demand = np.stack([rows.column(n).fill_null(0).to_numpy().astype(np.int64) for n in names], axis=1)
            placed = place(demand, limits)
            kept = None
            if not last and (demand[placed[-1]].sum(axis=0) < limits).all():
                kept = rows.take(placed.pop())
            order = [i for s in placed for i in s]
            number = np.repeat(np.arange(made, made + len(placed)), [len(s) for s in placed])
            made += len(placed)
            run = demand[order, 0].cumsum() - demand[order, 0]
            base = np.repeat(run[np.cumsum([0] + [len(s) for s in placed[:-1]])], [len(s) for s in placed]) if placed else run
            done = rows.take(order).append_column("sequence_id", pa.array((part << 40) + number, pa.int64())).append_column("offset", pa.array(run - base, pa.int64()))
            yield from done.to_batches()

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                waiting.append(batch.slice(at, CHUNK_ROWS))
                if sum(b.num_rows for b in waiting) >= CHUNK_ROWS:
                    rows, waiting = pa.Table.from_batches(waiting), []
                    yield from emit(pa.concat_tables([kept, rows]) if kept is not None else rows, False)
        rows = [kept] * (kept is not None) + ([pa.Table.from_batches(waiting)] if waiting else [])
        if rows:
            yield from emit(pa.concat_tables(rows), True)

    from pyspark.sql.types import LongType, StructType

    schema = StructType(list(items.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    dealt = items.repartition(shuffle_width(items.sparkSession), F.xxhash64(*key)).sortWithinPartitions(*items.columns)
    return dealt.mapInArrow(chunks, schema)


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents with their places. In plain documents every token bears loss."""
    pieces = token_pieces(docs, tokenizer).select("*", F.lit(1).cast("long").alias("segments"), F.col("length").alias("loss_tokens"))
    return pack(pieces, ["doc_id", "start"], {"length": TOKENS, "segments": SEGMENTS, "loss_tokens": TOKENS}).drop("segments", "loss_tokens")


def pack_conversations(turns: DataFrame, tokenizer: str, loss_limit: int = TOKENS) -> DataFrame:
    """Pack (conv_id, turn, role, text): assistant turns bear loss, other turns do not."""
    numbered = turns.select(F.struct("conv_id", "turn", "role").alias("k"), F.xxhash64("conv_id", "turn", "role", "text").alias("doc_id"), "text")
    pieces = token_pieces(numbered, tokenizer).join(numbered.select("doc_id", "k.*").dropDuplicates(["doc_id"]), "doc_id")
    loss = F.when(F.col("role") == "assistant", F.col("length")).otherwise(0).cast("long")
    items = pieces.select("conv_id", "turn", "start", "length", F.lit(1).cast("long").alias("segments"), loss.alias("loss_tokens"))
    return pack(items, ["conv_id", "turn", "start"], {"length": TOKENS, "segments": SEGMENTS, "loss_tokens": loss_limit})
