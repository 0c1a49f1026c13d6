"""Periodic runs and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefmill.llm import merkle_manifest, periodic_runs


def rows(df):
    return [r.asDict() for r in df.collect()]


# periodic runs


def all_runs(w):
    """Every period, every maximal stretch; the smallest period of equal stretches counts."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_all_stretches():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 5)):
            base = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(0, 90))]
            if base and rng.random() < 0.6:
                p = rng.randint(1, len(base))
                base = base[: rng.randint(0, len(base))] + (base[:p] * 40)[: rng.randint(0, 250)] + base[: rng.randint(0, 20)]
            texts.append(base)
        assert periodic_runs.text_runs(texts) == [all_runs(t) for t in texts]


def test_nested_and_long_runs():
    inner = [b"a", b"b"] * 9 + [b"c"]
    w = [b"x"] + inner * 7 + [b"y"]
    got = periodic_runs.text_runs([w, [b"z"] * 40_000])
    assert got[0] == all_runs(w) and {q for _, _, q in got[0]} == {2, 19}
    assert got[1] == [(0, 40_000, 1)]  # found once, not at each of its multiples


def test_transform_counts_mismatches_exactly():
    rng = np.random.default_rng(1)
    for b, places in ((4, 14), (8, 16), (64, 128)):
        blocks, windows = rng.integers(0, 9, (5, b)), rng.integers(0, 9, (5, b + places - 1))
        want = [[int(((x - y[k : k + b]) ** 2).sum()) for k in range(places)] for x, y in zip(blocks, windows, strict=True)]
        assert periodic_runs.mismatches(blocks, windows).tolist() == want


def report(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    of_best = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b - a},{q}\n" for a, b, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *of_best, *sha)


@pytest.mark.parametrize("plant", [True, False])
def test_run_report_edges(docs, no_docs, plant):
    given = docs.where("length(text) < 10000 OR text IS NULL")
    got = [tuple(r) for r in periodic_runs.periodic_runs(given, plant=plant).collect()]
    want = [report(r.doc_id, r.text, plant) for r in given.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in got)
    assert periodic_runs.periodic_runs(no_docs).count() == 0


def test_runs_of_very_long_text(spark):
    rng = random.Random(2)
    head = [str(rng.randrange(5000)) for _ in range(200_000)]
    text = " ".join(head + head[:9000] * 3)
    r = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (r.n_runs, r.start, r.length, r.period) == (1, 200_000, 27_000, 9000)


def test_planted_runs_of_sample(sample):
    got = {r.doc_id: tuple(r) for r in periodic_runs.periodic_runs(sample, plant=True).collect()}
    for r in sample.where("length(text) < 3000").collect():
        assert got[r.doc_id] == report(r.doc_id, r.text, True)


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, i, start):
    """Last node, siblings of node i up to it, and what ``start`` in its place folds to."""
    siblings = []
    while len(nodes) > 1:
        run = list(range(i - i % 8, min(i - i % 8 + 8, len(nodes))))
        siblings += [nodes[k] for k in run if k != i]
        start = h(*(start if k == i else nodes[k] for k in run))
        nodes, i = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], i // 8
    return nodes[0], siblings, start


def whole_manifest(docs):
    """From all rows in one place."""
    by_lang = defaultdict(list)
    for r in docs.select(*merkle_manifest.LEAF_COLUMNS).collect():
        touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if touched else r.text
        by_lang[r.lang].append((r.doc_id, leaf(r), leaf([*r[:-1], text])))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by_lang[x].sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1:]))
    tops = [climb([v[1] for v in by_lang[x]], 0, "")[0] for x in langs]
    out = []
    for j, x in enumerate(langs):
        for i, (doc_id, own, given) in enumerate(by_lang[x]):
            subroot, lower, part = climb([v[1] for v in by_lang[x]], i, given)
            root, upper, folded = climb(tops, j, part)
            out.append((doc_id, own, subroot, root, h(*lower, *upper), folded, folded == root))
    return out


def same(got, want):
    return sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_manifest_edges(docs, no_docs):
    given = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "").when(F.col("doc_id") == 4, "Ä").otherwise(F.col("lang"))).withColumn("text", F.initcap("text"))
    want = whole_manifest(given)
    assert same(merkle_manifest.tampered_manifest(given).collect(), want)
    assert {r[-1] for r in want} == {True, False} and len({r[3] for r in want}) == 1
    assert merkle_manifest.tampered_manifest(no_docs).count() == 0
    alone = given.where("doc_id = 1")
    row = merkle_manifest.manifest(alone).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h()


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_over_many_superblocks(spark, depth):
    """Several rounds of superblocks, in the tree of keys too."""
    given = spark.range(700).selectExpr("id AS doc_id", "'s' AS source", "CASE WHEN id < 600 THEN 'hot' WHEN id > 690 THEN NULL ELSE concat('k', id) END AS lang", "id AS n_chars", "concat('Text ', id) AS text")
    assert same(merkle_manifest.tampered_manifest(given, depth).collect(), whole_manifest(given))


def test_any_change_is_found(sample):
    clean = merkle_manifest.manifest(sample)
    assert clean.where("NOT verified").count() == 0
    changed = merkle_manifest.manifest(sample, tamper=("n_chars", F.when(F.col("doc_id") == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars"))))
    assert [r.doc_id for r in changed.where("NOT verified").collect()] == [5]
