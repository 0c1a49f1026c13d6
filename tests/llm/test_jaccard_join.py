"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from beliefmill.llm import jaccard_join


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def all_pairs(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.components_of_links(docs).collect()]
    assert sorted(got, key=repr) == sorted(all_pairs(rows), key=repr)
    return got


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1, 1])] = [f"e{rng.randrange(60)}"] * rng.choice([0, 1, 1])
    return " ".join(words)


def crowd(rng, groups=3, members=50):
    """Groups of near copies on both sides of the threshold, of common parts, and texts of a shared passage."""
    texts, passage = [], [f"p{i}" for i in range(70)]
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(60, 130))]
        texts += [edited(rng, base, rng.randint(0, 7)) for _ in range(members)]
        texts += [edited(rng, base[:40] + passage + base[40:], rng.randint(0, 3)) for _ in range(members // 5)]
    texts += [" ".join(passage + [f"u{rng.randrange(9000)}" for _ in range(rng.randint(3, 40))]) for _ in range(members)]
    return texts + rng.sample(texts, 9)


@pytest.mark.parametrize("bounds", [{}, {"HOT": 4, "LIST_MOST": 6, "MEMBERS_MOST": 5}])
def test_join_equals_all_pairs(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(11)
    got = check(spark, list(enumerate(crowd(rng))))
    assert 3 <= len({c for _, _, c in got}) < len(got)


def test_join_edges(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in jaccard_join.components_of_links(docs).collect()}
    assert got == set(all_pairs([r for r in rows if r[1] is None or len(r[1]) < 10_000])) | {(r[0], len(shingles(r[1])), r[0]) for r in rows if r[1] and len(r[1]) >= 10_000}
    assert jaccard_join.components_of_links(no_docs).count() == 0
    check(spark, [(1, "a b"), (2, "A  b"), (3, "a b c d"), (4, "É é"), (5, "é é"), (6, ""), (7, " "), (8, None), (None, "x y"), (None, "x y"), (9, "a b c d e"), (10, "a\x0bb\x0cc d\x1ce")])


def test_threshold_is_exact(spark):
    """Sets of 8 and 10 with 8 in common link at exactly 0.8; 7 of 9 and 8 don't."""
    w = [f"w{i}" for i in range(40)]
    got = check(spark, [(1, " ".join(w[:12])), (2, " ".join(w[:14])), (3, " ".join(w[20:32])), (4, " ".join(w[21:33] + ["x"]))])
    assert [c for _, _, c in sorted(got)] == [1, 1, 3, 4]


def test_lists_skip_blocks_of_other_sizes():
    n = 3000
    cols = [np.arange(n), np.arange(1, n + 1), np.arange(1, n + 1), 5 * np.arange(1, n + 1), np.full(n, 7), np.full(n, 7)]
    got = {tuple(sorted(p)) for a, b in jaccard_join._long_list(cols, None) for p in zip(a.tolist(), b.tolist(), strict=True) if p[0] != p[1]}
    assert got == {(i, j) for j in range(n) for i in range(j) if 5 * (i + 1) >= 4 * (j + 1)}


def test_members_answers_follow_from_the_leader(spark):
    """One comparison with the leader settles all members: candidate rows grow with the texts."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(140)]
    sizes = []
    for n in (60, 240):
        texts = [edited(rng, base, rng.randint(1, 6)) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sets = jaccard_join.all_sets(docs)
        sizes.append(jaccard_join.links(docs, sets).count() / n)
    assert sizes[1] < 2 * sizes[0] + 2


def test_members_of_one_component_do_not_ask(spark):
    """Pairs of groups that the links between leaders have joined bring no member rows."""
    n = 40
    ids = "id long, root long"
    groups = spark.createDataFrame([(100 * g + i, 100 * g) for g in range(1, n) for i in range(1, 6)], "a long, b long")
    sides = spark.createDataFrame([(100 * g, 100 * h, 3, 90) for h in range(1, n) for g in range(h + 1, n)], "g long, b long, off long, most long")
    joined = spark.createDataFrame([(100 * g, 100) for g in range(1, n - 1)], ids)
    got = jaccard_join.members_asking(sides, groups, joined).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((100 * (n - 1) + i, 100 * h) for h in range(1, n - 1) for i in range(1, 6))


@pytest.mark.parametrize("crowd_of", [60, 180])
def test_pairs_of_a_crowd_grow_with_its_texts(spark, monkeypatch, crowd_of):
    """Near copies about the threshold from one another, which links join into one component, bring no pair each."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(140)]
    texts = [edited(rng, base, 3 + i % 4) for i in range(crowd_of)] + [" ".join(base)]
    rows, found = list(enumerate(texts)), []
    listed = jaccard_join.candidates

    def counted(index):
        pairs = listed(index)
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "candidates", counted)
    check(spark, rows)
    assert found[0] <= crowd_of


def test_list_rows_keep_what_a_pair_is_judged_by(spark):
    """Fields survive the packing, full ones count as unbounded, hashes keep their lowest bits."""
    big, low = (1 << jaccard_join.FIELD) + 5, (1 << jaccard_join.TOKEN_BITS) - 1
    rows = [(-7, 3, 12), (12345678901234, big, 0), (low, (1 << jaccard_join.FIELD) - 2, 1)]
    got = spark.createDataFrame(rows, "token long, room long, least long").select(jaccard_join._packed(jaccard_join.F.col("token"), jaccard_join.F.col("room")).alias("e"), jaccard_join._packed(jaccard_join.F.col("token"), jaccard_join.F.col("least")).alias("l")).toArrow()
    e, lim = (got.column(c).to_numpy() for c in ("e", "l"))
    place = np.array([9 | 2 << 24 | 5 << 43 | 1 << 62, (1 << 24) - 1, 4 | 3 << 24 | 3 << 43], np.int64)
    least, most, room, before, token, a, b, part = jaccard_join._unpacked(e, lim, place)
    assert token.tolist() == before.tolist() == [t & low for t, _, _ in rows]
    assert room[0] == 3 and room[1] >= 1 << 56 and room[2] == (1 << 24) - 2 and least.tolist() == [12, 0, 1]
    assert most[0] == 9 and most[1] >= 1 << 56 and (a.tolist(), b.tolist(), part.tolist()) == ([2, 0, 3], [5, 0, 3], [5, 0, 3])
