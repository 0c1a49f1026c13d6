"""Operators on texts against brute force, the tokenizer library and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from beliefmill.llm import bpe_pairs, language_id, license_scan, license_texts, order_minhash, run_index, token_edits, vector_packing
from beliefmill.llm.queries import tokenizer

BYTES, WORDS = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


# language identification


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edges(docs, no_docs, texts):
    out = rows(language_id.identify(docs))
    assert len(out) == docs.count()
    for r in out:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "?"
        if text is None or not any(c.isalpha() for c in text) and text != "?":
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held
    assert language_id.identify(no_docs).count() == 0
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and all(r.text and any(c.isalpha() for c in r.text) for r in kept.collect())


def test_language_unlabelled_is_undetermined(docs):
    assert {r["lang_pred"] for r in rows(language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


def test_language_sample_counts_different_texts(spark):
    copies = [("aa", "the same words")] * 900
    given = copies + [("aa", f"other words {i}") for i in range(30)] + [("bb", "x" * (language_id.SAMPLE_DOC_BYTES + i)) for i in (1, 1, 2, 3, 4, 5, 6)] + [("cc", "short"), ("cc", "y" * 70_000)]
    labelled = spark.createDataFrame(given, "lang string, text string")
    got = Counter((r.lang, len(r.text), r.text) for r in language_id.training_sample(labelled).collect())
    assert got == Counter({("aa", len(t), t) for k, t in given if k == "aa"} | {("bb", len(t), t) for k, t in given if k == "bb" and len(t) <= language_id.SAMPLE_DOC_BYTES + 4} | {("cc", 5, "short")})
    # whatever the digests, a bound of 31 reaches all texts and a bound of 5 takes five different ones
    assert language_id.training_sample(labelled, 5).where("lang = 'aa'").distinct().count() == 5
    assert "bb" in language_id.fit(labelled).langs


def test_language_code_length_by_hand():
    """Bits of each byte follow from counts, escape by escape."""
    import pyarrow as pa

    seen = defaultdict(Counter)
    for lang, text in (("a", "abab abc"), ("b", "bcd bcd")):
        data = np.frombuffer(language_id.letters(text), np.uint8)
        for k in range(language_id.ORDER + 1):
            for g in language_id.grams(data, k).tolist():
                seen[lang, k][g] += 1
    cols = list(zip(*[(lang, k, g, n) for (lang, k), c in seen.items() for g, n in c.items()], strict=True))
    model = language_id.Model.fit(pa.table({"lang": cols[0], "order": cols[1], "gram": cols[2], "n": cols[3]}))
    data = language_id.letters("abcd zb")

    def bits(lang, i):
        total = 0.0
        for k in range(language_id.ORDER, -1, -1):
            context, c = data[i - k : i], Counter()
            for g, n in seen[lang, k].items():
                raw = g.to_bytes(k + 1, "big")
                if raw[:-1] == context:
                    c[raw[-1]] += n
            if not c:
                continue
            if data[i] in c:
                return total - np.log2(c[data[i]] / (sum(c.values()) + len(c)))
            total -= np.log2(len(c) / (sum(c.values()) + len(c)))
        return total + 8

    got = model.bits(np.frombuffer(data, np.uint8))
    for col, lang in enumerate(model.langs):
        assert got[:, col] == pytest.approx([bits(lang, i) for i in range(language_id.ORDER, len(data))], abs=1e-4)


def test_language_long_text_is_coded_in_pieces(monkeypatch, sample):
    model = language_id.fit(sample.select("lang", "text"))
    texts = [r.text for r in sample.select("text").limit(20).collect()]
    whole = model.predict(texts)
    monkeypatch.setattr(language_id, "CHUNK", 777)
    cut = model.predict(texts)
    assert whole[0] == cut[0] and np.allclose(whole[2], cut[2])


# licences


def test_license_scan_forms(spark):
    full = dict((k, t) for k, t in license_scan.KNOWN if len(t) > 500)["MIT"]
    given = [(1, "words\nReleased under the MIT licence!\nmore"), (2, full.upper().replace("<year> <holder>", "2020 Some One")), (3, None), (4, ""), (5, "Copyright 2020 me"), (1, "LICENSED UNDER CC-BY-NC 4.0\nReleased under the MIT License.")]
    out = rows(license_scan.scan(spark.createDataFrame(given, "doc_id long, text string").withColumn("license", F.lit("x"))))
    by = {(r["doc_id"], r["license"], r["line_licenses"], r["license_lines"]) for r in out}
    assert by == {(1, None, "MIT", 1), (2, "MIT", None, 0), (3, None, None, 0), (4, None, None, 0), (5, None, None, 0), (1, None, "CC-BY-NC-4.0,MIT", 2)}


def test_license_scan_full_texts(spark):
    kept = dict(license_texts.texts())
    given = list(license_texts.texts())
    given += [(k, license_texts.wrapped(kept[k], w)) for k in ("GPL-3.0", "BSD-3-Clause", "Apache-2.0") for w in (0, 72, 79)]
    given += [("BSD-3-Clause", kept["BSD-3-Clause"].replace("<year> <holder>", "2020 Some One. All rights reserved.")), ("Apache-2.0", kept["Apache-2.0"].split("APPENDIX")[0]), (None, kept["GPL-2.0"][:9000])]
    out = rows(license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(given)], "doc_id long, text string")))
    assert {r["doc_id"]: r["license"] for r in out} == {i: k for i, (k, _) in enumerate(given)}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "BSD-2-Clause", "BSD-3-Clause"} <= kept.keys()


def test_license_digests_are_those_of_the_texts(spark):
    want = {(r.digest, r.license) for r in license_scan.known_digests(spark, license_texts.rows()).collect()}
    assert {(r.digest, r.license) for r in license_texts.full_digests(spark).collect()} == want


# repeated strings


def brute_repeats(texts, w):
    data = [(t or "").encode() for t in texts]
    where = Counter(d[i : i + w] for d in data for i in range(len(d) - w + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - w + 1):
            if where[d[i : i + w]] > 1:
                gone[i : i + w] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(docs):
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *x) for (i, _), x in zip(given, brute_repeats([t for _, t in given], run_index.WINDOW), strict=True))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(run_index.repeat_report(docs)))
    assert got == want


def test_repeats_edges(docs, no_docs):
    check_repeats(docs)
    assert run_index.repeat_report(no_docs).count() == 0


def test_repeats_sample(sample):
    check_repeats(sample)


def test_repeats_of_very_common_anchors(spark, docs):
    """The way without an index gives the same result."""
    want = {(r["tid"], r["n_removed"], r["n_spans"], r["kept"]) for r in rows(run_index.remove_repeats(docs))}
    got = {(r["tid"], r["n_removed"], r["n_spans"], r["kept"]) for r in rows(run_index.remove_repeats(docs, group_most=1))}
    assert bytes and {(bytes(a), b, c, bytes(d)) for a, b, c, d in got} == {(bytes(a), b, c, bytes(d)) for a, b, c, d in want}


def test_repeats_random_small_alphabet(spark):
    rng = random.Random(8)
    parts = ["".join(rng.choice("ab") for _ in range(rng.choice([150, 390, 401, 600]))) for _ in range(12)] + ["ab" * 300, "a" * 450]
    check_repeats(spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for i in range(60)], "doc_id long, text string"))


def test_dropped_repeats_take_one_worker(spark):
    """What is kept comes as text from the cutting worker: no second Python step in its task."""
    shared = "é" * 201 + "shared words " * 40
    rows = [(1, "aé" + shared + "é x"), (2, "b" + shared + "y"), (3, "alone"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = run_index.drop_repeats(docs)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    kept = {r["tid"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in run_index.remove_repeats(docs).collect()}
    tid = {r["doc_id"]: r["tid"] for r in docs.select("doc_id", run_index.text_id("text").alias("tid")).collect()}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == {i: None if t is None else kept[tid[i]] for i, t in rows} and got[1] != rows[0][1] and got[3] == "alone"


def test_run_index_statistics():
    """Matching statistics that reach the window agree with a scan of all pairs."""
    rng = random.Random(2)
    texts, windows = [], []
    for _ in range(30):
        n = rng.randint(1, 60)
        texts.append(("".join(rng.choice("ab") for _ in range(7)) * 100)[: n + run_index.WINDOW - 1].encode())
        windows.append(n)
    index = run_index.RunIndex(texts, windows)
    assert len(index.heads) < sum(windows)
    where = Counter(t[i : i + run_index.WINDOW] for t, n in zip(texts, windows, strict=True) for i in range(n))
    for t, n, spans in zip(texts, windows, index.repeated(), strict=True):
        marked = {i for lo, hi in spans for i in range(lo, hi)}
        assert marked == {i for i in range(n) if where[t[i : i + run_index.WINDOW]] > 1}


def test_drop_repeats_keeps_rows_and_columns(docs, texts):
    out = run_index.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[0].text == "" and by[0].n_chars == 0 and by[texts.index(None)].text is None
    assert by[4].text == texts[4] or len(texts[4].encode()) >= run_index.WINDOW


# token counts under edits


def test_edits_match_full_encoding(spark, texts):
    lib = Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    rng = random.Random(4)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    vocab = bpe_pairs.Vocabulary(BYTES)
    inserts = ["", " ", "x", " new words", "\n\n", "'s", "é", "  ", "1"]
    for text in [t or "" for t in texts]:
        tree = token_edits.Tree.of(*token_edits.leaves([text], vocab)[0])
        assert int(tree.tokens[1]) == count(text)
        for _ in range(12 if len(text) < 10_000 else 3):
            at, removed, inserted = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 300]), rng.choice(inserts)
            want = text[: min(at, len(text))] + inserted + text[min(at, len(text)) + removed :]
            (text,), _ = token_edits.revise([text], [tree], [[{"at": at, "removed": removed, "inserted": inserted}]], vocab)
            assert text == want and int(tree.tokens[1]) == count(text) and int(tree.chars[1]) == len(text)


def test_recount_query(docs, no_docs, sample):
    lib = Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    out = {r["doc_id"]: r for r in rows(token_edits.recount(sample, BYTES))}
    for r in rows(token_edits.apply_edits(token_edits.build(sample, BYTES, token_edits.revisions()), BYTES)):
        assert out[r["doc_id"]]["tokens_after"] == r["tokens_after"] == len(lib.encode(r["text"], add_special_tokens=False).ids)
        assert r["tree_tokens"][1] == r["tokens_after"]
    assert max(r["chars_encoded"] for r in out.values()) < 4000
    assert token_edits.recount(docs, BYTES).count() == docs.count() and token_edits.recount(no_docs, BYTES).count() == 0


# near-duplicates


def labelled(text):
    words, seen, out = (text or "").lower().split(), Counter(), []
    for i in range(max(len(words) - 4, min(len(words), 1))):
        s = tuple(words[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def similarity(a, b):
    from bisect import bisect_left

    place = {x: i for i, x in enumerate(b)}
    tails = []
    for x in a:
        if x in place:
            at = bisect_left(tails, place[x])
            tails[at : at + 1] = [place[x]]
    return len(tails) / (len(a) + len(b) - len(tails)) if a or b else 0.0


def brute_groups(texts):
    """Root of each text by all pairs."""
    own = [labelled(t) for t in texts]
    bags = [set(x) for x in own]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or own[i] and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]) and similarity(own[i], own[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_edges(docs, no_docs):
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    root = brute_groups([t for _, t in given])
    least = {}
    for (i, _), r in zip(given, root, strict=True):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = Counter((i, least[r], root.count(r)) for (i, _), r in zip(given, root, strict=True))
    assert Counter((r["doc_id"], r["class_id"], r["members"]) for r in rows(order_minhash.near_duplicates(docs))) == want
    assert order_minhash.near_duplicates(no_docs).count() == 0
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert order_minhash.keep_one(no_docs).count() == 0


def test_near_duplicates_sample(sample):
    given = sorted((r.doc_id, r.text) for r in sample.select("doc_id", "text").collect())
    root = brute_groups([t for _, t in given])
    want = {(i, given[r][0]) for (i, _), r in zip(given, root, strict=True)}
    assert {(r["doc_id"], r["class_id"]) for r in rows(order_minhash.near_duplicates(sample))} == want


def test_chain_of_near_duplicates(spark):
    """Only neighbours in the chain are alike; all are one group."""
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    given = []
    for i in range(25):
        given.append((i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(200)] = f"n{rng.randint(0, 10**6)}"
    out = rows(order_minhash.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")))
    assert {r["class_id"] for r in out} == {0}


def test_shuffled_sentences_are_not_edit_copies(spark):
    words = [f"w{i}" for i in range(200)]
    given = [(0, " ".join(words)), (1, " ".join(words[100:] + words[:100]))]
    assert {r["class_id"] for r in rows(order_minhash.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")))} == {0, 1}


# encoding


def test_round_trip_matches_library(docs, no_docs, sample):
    lib = Tokenizer.from_file(BYTES)
    for table in (docs, sample):
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            back = lib.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe_pairs.round_trip(table, BYTES).collect()) == want
        back = bpe_pairs.decode(bpe_pairs.encode(table, BYTES), BYTES)
        assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in table.collect())
    assert bpe_pairs.round_trip(no_docs, BYTES).count() == 0 and bpe_pairs.decode(bpe_pairs.encode(no_docs, BYTES), BYTES).count() == 0


def odd_text(rng):
    parts = ["a", "b", " ", "  ", "\n", "\t", "É", "Σ", "ß", "İ", "'s", "'LL", "12", "½", "<|endoftext|>", "<|", "|>", "\x1c", "\x85", " ", "中", "😀", "the", "!!", "é", "​", "_", "Ⅳ", " the", "\r\n", "\x00", "aaaa", "' s"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_tokenizers_agree_on_odd_texts(monkeypatch):
    rng = random.Random(5)
    texts = [odd_text(rng) for _ in range(1500)]
    byte, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    monkeypatch.setattr(bpe_pairs, "CACHE_WORDS", 50)
    monkeypatch.setattr(vector_packing, "CACHE_BYTES", 5000)
    a, b = bpe_pairs.Vocabulary(BYTES), vector_packing.WordTokens(WORDS)
    for lo in range(0, len(texts), 100):
        own = texts[lo : lo + 100]
        for t, x, y in zip(own, a.encode_batch(own), b.encode_batch(own), strict=True):
            assert np.frombuffer(x, "<i4").tolist() == byte.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(y, "<i4").tolist() == word.encode(t, add_special_tokens=False).ids


# packing


def check_packing(docs):
    lib = Tokenizer.from_file(WORDS)
    out = rows(vector_packing.pack_documents(docs, WORDS))
    given = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            given[r.doc_id, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == given
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and len(pieces) <= vector_packing.SEGMENTS
    return sum(r["length"] for r in out) / (2048 * len(by))


def test_packing(docs, no_docs, spark):
    check_packing(docs)
    assert vector_packing.pack_documents(no_docs, WORDS).count() == 0
    assert check_packing(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)) > 0.98


def test_packing_chunks(docs, monkeypatch):
    demand = np.array([[700, 1, 600], [700, 1, 100], [600, 1, 0], [48, 1, 48], [3000, 1, 1], [2048, 1, 2048], [0, 0, 0]])
    placed = vector_packing.place(demand, np.array([2048, 2, 700]))
    assert sorted(i for s in placed for i in s) == list(range(7)) and [4] in placed
    for s in placed:
        assert len(s) == 1 or (demand[s].sum(axis=0) <= [2048, 2, 700]).all()


def test_packing_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out = rows(vector_packing.pack_conversations(turns, WORDS, loss_limit=600))
    by = defaultdict(lambda: np.zeros(2, np.int64))
    for r in out:
        by[r["sequence_id"]] += [r["length"], r["loss_tokens"]]
    assert all(a <= 2048 for a, _ in by.values()) and len({(r["conv_id"], r["turn"]) for r in out}) == turns.select("conv_id", "turn").distinct().count()


# the pipeline


@pytest.mark.parametrize("given, most", [("10000", corpus_pipeline.ARROW_ROWS), ("-1", corpus_pipeline.ARROW_ROWS), ("70", 70)])
def test_stages_hand_texts_over_in_small_batches(spark, docs, given, most):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    was = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for _, stage in corpus_pipeline.STAGES[1:]:
            spark.conf.set(corpus_pipeline.BATCH, given)
            stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "")
            assert spark.range(0, 3000, 1, 1).mapInArrow(rows, "n long").agg({"n": "max"}).first()[0] == most
    finally:
        spark.conf.set(corpus_pipeline.BATCH, was)
