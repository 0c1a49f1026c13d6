"""Token counts kept up to date under edits.

A text is cut before every LEAF-th blank at which a pre-token must begin, and a segment tree over
the leaves holds characters and tokens of every subtree. An edit descends to the leaves it
touches; they are encoded anew together with one leaf of context where a cut might depend
on the edit, and the sums on the way to the root are updated. All other text is not encoded.

Defined results: null texts are empty and have no tokens; positions beyond the text mean its
end and a removal stops there; null or no edits change nothing; edits of a text are applied in
their given order, each to the text that the one before left; repeated rows are separate
documents. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmill.llm.bpe_pairs import Vocabulary, no_collector, vocabulary_at
from beliefmill.llm.common import slices, strings, text_of

LEAF = 16
CHUNK = 1 << 21  # bytes of text handled together


def leaves(texts: list[str], vocab: Vocabulary) -> list[tuple[list[int], list[int]]]:
    """Characters and tokens of the leaves of each text. Special strings are ordinary text here."""
    with no_collector():
        parts, out = [vocab.words(t, special=False) for t in texts], []
        vocab.learn(parts)
        get = vocab.known.__getitem__
        for words in parts:
            chars, tokens = np.array([*map(len, words)], np.int64), np.array([*map(len, map(get, words))], np.int64) // 4
            # leaves begin where a blank precedes a visible character: a word starts there whatever comes before
            cut = [i for i, w in enumerate(words) if i and w[0] == " " and len(w) > 1 and not w[1].isspace()]
            at = np.array([0, *cut[LEAF - 1 :: LEAF]])
            out.append((np.add.reduceat(chars, at).tolist(), np.add.reduceat(tokens, at).tolist()) if words else ([], []))
        return out


class Tree:
    """A heap-shaped segment tree: node k has children 2k and 2k + 1, node 1 is the root."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @staticmethod
    def of(chars: list[int], tokens: list[int]) -> Tree:
        width = 1 << max(0, (len(chars) - 1).bit_length())
        out = []
        for leaf in (chars, tokens):
            nodes = np.zeros(2 * width, np.int64)
            nodes[width : width + len(leaf)] = leaf
            for lo in (1 << k for k in range(width.bit_length() - 2, -1, -1)):
                nodes[lo : 2 * lo] = nodes[2 * lo : 4 * lo : 2] + nodes[2 * lo + 1 : 4 * lo : 2]
            out.append(nodes)
        return Tree(*out)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it begins."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if at >= begin + self.chars[k] and self.chars[k + 1]:
                begin += int(self.chars[k])
                k += 1
        return k - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.width
        dc, dt = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2

    def touch(self, text: str, at: int, removed: int, inserted: str) -> tuple[str, tuple[int, int], str]:
        """The edited text, the first and last leaf that the edit touches, and their new text."""
        at = min(max(at, 0), len(text))
        stop = min(at + max(removed, 0), len(text))
        first, begin = self.find(max(at - 2, 0))
        if begin > at - 2 and begin:  # its cut depends on the edit
            first, begin = self.find(begin - 1)
        last, end = first, begin + int(self.chars[self.width + first])
        while end < stop:  # a leaf that begins at or after the edit's end stays
            last, _ = self.find(end)
            end += int(self.chars[self.width + last])
        return text[:at] + inserted + text[stop:], (first, last), text[begin:at] + inserted + text[stop:end]

    def settle(self, touched: tuple[int, int], chars: int, tokens: int) -> None:
        """Give the new text of the touched leaves to the first of them."""
        for leaf in range(touched[0] + 1, touched[1] + 1):
            self.put(leaf, 0, 0)
        self.put(touched[0], chars, tokens)


def revise(texts: list[str], trees: list[Tree], edits: list[list[dict]], vocab: Vocabulary) -> tuple[list[str], list[int]]:
    """Apply each text's edits in order, the n-th edits of all texts together, so that new words
    are merged in one go. Returns the edited texts and the characters encoded for each."""
    texts, encoded = list(texts), [0] * len(texts)
    for n in range(max(map(len, edits), default=0)):
        own = [i for i, e in enumerate(edits) if len(e) > n]
        spots, regions = [], []
        for i in own:
            e = edits[i][n]
            texts[i], spot, region = trees[i].touch(texts[i], e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
            spots.append(spot)
            regions.append(region)
            encoded[i] += len(region)
        for i, spot, (chars, tokens) in zip(own, spots, leaves(regions, vocab), strict=True):
            trees[i].settle(spot, sum(chars), sum(tokens))
    return texts, encoded


TREE = "doc_id long, text string, tree_chars array<bigint>, tree_tokens array<bigint>"


EDITS = "array<struct<at:bigint,removed:bigint,inserted:string>>"
COUNTED = TREE + ", tokens_before long, tokens_after long, chars_encoded long"


def _built(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary_at(vocabulary)
    for batch in batches:
        texts = strings(batch, "text")
        for lo, hi in slices([len(t) for t in texts], CHUNK):
            own = batch.slice(lo, hi - lo)
            trees = [Tree.of(*x) for x in leaves(texts[lo:hi], vocab)]
            sums = [pa.array([getattr(t, k) for t in trees], pa.list_(pa.int64())) for k in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text"), *sums, own.column("edits")], ["doc_id", "text", "tree_chars", "tree_tokens", "edits"])


def _edited(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary_at(vocabulary)
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).to_pylist()
        for lo, hi in slices(sizes, CHUNK):
            own = batch.slice(lo, hi - lo)
            doc_ids, texts, chars, tokens, edits = (own.column(c).to_pylist() for c in ("doc_id", "text", "tree_chars", "tree_tokens", "edits"))
            heaps = [Tree(np.array(c, np.int64), np.array(t, np.int64)) for c, t in zip(chars, tokens, strict=True)]
            before = [int(t.tokens[1]) for t in heaps]
            texts, encoded = revise(texts, heaps, [[e for e in x or () if e is not None] for x in edits], vocab)
            out = (doc_ids, texts, [t.chars for t in heaps], [t.tokens for t in heaps], before, [int(t.tokens[1]) for t in heaps], encoded)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "text", "tree_chars", "tree_tokens", "tokens_before", "tokens_after", "chars_encoded"])


def _with_edits(docs: DataFrame, edits: Column | None) -> DataFrame:
    none = F.lit(None).cast(EDITS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), (none if edits is None else edits).alias("edits"))


def build(docs: DataFrame, vocabulary: str, edits: Column | None = None) -> DataFrame:
    """doc_id, text, the tree's character and token sums, and the edits column to apply later:
    an array of struct(at, removed, inserted)."""
    return _with_edits(docs, edits).mapInArrow(lambda b: _built(b, vocabulary), f"{TREE}, edits {EDITS}")


def apply_edits(trees: DataFrame, vocabulary: str) -> DataFrame:
    """The edited texts with their trees, tokens before and after, and characters encoded."""
    return trees.mapInArrow(lambda b: _edited(b, vocabulary), COUNTED)


def revisions(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Three edits that depend on the row: an insertion, a removal and a replacement."""
    n = F.length(text_of(text)).cast("long")
    h = F.abs(F.xxhash64(F.col(doc_id)) % 1000)
    spot = lambda part: (n * (h + part) / 4000).cast("long")
    edit = lambda at, removed, inserted: F.struct(at.alias("at"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return F.array(edit(spot(0), 0, F.lit(" revised")), edit(spot(1000), 12, F.lit("")), edit(spot(2500), 7, F.concat(F.lit(" edit "), F.col(doc_id).cast("string"))))


def recount(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token counts of every document before and after its revisions."""
    # one pass, so that a task needs one Python worker and one vocabulary
    done = _with_edits(docs, revisions()).mapInArrow(lambda b: _edited(_built(b, vocabulary), vocabulary), COUNTED)
    return done.select("doc_id", "tokens_before", "tokens_after", "chars_encoded", F.length("text").cast("long").alias("chars_after"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
