"""Vector searches and archives against brute force."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beliefmill.llm import bit_slices, stable_projection, warc

VECTORS = "vec_id long, embedding array<float>, label int, v string, score double, rank int"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    given = [(i, base[i % 25], 0, "x", 0.0, 1) for i in range(200)]
    given += [(200, None, 0, None, None, None), (220, [None] + base[0][1:], 0, None, None, None), (240, [float("nan")] * 6, 0, None, None, None), (260, [float("inf")] + base[0][1:], 0, None, None, None)]
    given += [(300, [0.0] * 6, 0, None, None, None), (None, base[1], 0, None, None, None), given[20], given[20], (320, [], 0, None, None, None), (-20, base[3], 0, None, None, None), (401, [5.0, -7.0, 0.0, 0.0, 1.0, 900.0], 0, None, None, None)]
    return spark.createDataFrame(given, VECTORS)


def usable(table, nonzero):
    out = {}
    for r in table.select("vec_id", "embedding").collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero):
            out[r.vec_id] = v
    return out


def best(table, every, k, score, nonzero):
    rows = usable(table, nonzero)
    out = {}
    for q in rows:
        if q % every == 0:
            ranked = sorted((score(rows[q], v), i) for i, v in rows.items() if i != q)
            out[q] = ranked[:k]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_bit_slices_exact(spark, odd_vectors):
    product = lambda a, b: -sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))
    for table in (odd_vectors, spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")):
        got = by_query(bit_slices.search(table, F.col("vec_id") % 20 == 0))
        assert {q: [(-s, i) for s, i in v] for q, v in got.items()} == best(table, 20, 20, product, False)
    assert bit_slices.search(odd_vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert bit_slices.search(odd_vectors.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_bit_slice_sums():
    rng = np.random.default_rng(0)
    v = rng.integers(-100, 100, (130, 5))
    batch = bit_slices.pa.RecordBatch.from_pydict({"vec_id": list(range(130)), "v": v.tolist()})
    (row,) = bit_slices._index(iter([batch]))
    block = bit_slices.Slices(*(row.column(c)[0].as_py() for c in ("ids", "lows", "widths", "slices")))
    for q in rng.integers(-50, 50, (20, 5)):
        ids, score = block.top(3, q, 130)
        assert len(ids) == 129 and (score == (v[ids] @ q)).all()


def test_projection_recall(spark, odd_vectors):
    distance = lambda a, b: math.dist(a, b)
    for table, least in ((odd_vectors, 0.9), (spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 0.95)):
        got = by_query(stable_projection.search(table, F.col("vec_id") % 100 == 0))
        want = best(table, 100, 10, distance, True)
        assert got.keys() == want.keys()
        hits = total = 0
        for q in want:
            assert len(got[q]) == len(want[q]) and got[q] == sorted(got[q])
            rows = usable(table, True)
            assert all(s == pytest.approx(distance(rows[q], rows[i]), rel=1e-12, abs=1e-12) for s, i in got[q])
            hits += len({i for _, i in got[q]} & {i for _, i in want[q]})
            total += len(want[q])
        assert hits / total >= least
    assert stable_projection.search(odd_vectors.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_projection_ties_and_copies(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0], 0, None, None, None) for i in range(300)], VECTORS)
    got = by_query(stable_projection.search(table, F.col("vec_id") % 100 == 0))
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[200] == [(0.0, i) for i in range(10)]


def record(body: bytes, name: str = "a", digest: bool = True) -> bytes:
    import hashlib

    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{name}>\r\nContent-Length: {len(body)}\r\n"
    return (head + f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n" * digest + "\r\n").encode() + body + b"\r\n\r\n"


def names(data):
    found = list(warc.salvage(data))
    at = 0
    for kind, offset, n, *_ in found:  # records and gaps cover everything once
        if not kind.startswith("inner"):
            assert offset in (at, at - n)
            at = max(at, offset + n)
    assert at == len(data)
    return [(h["warc-record-id"][5:-1] if k == "record" else "gap") for k, _, _, h, _ in found]


def test_salvage():
    a, b, c = record(b"x" * 50, "a"), record(b"in WARC/1.1\r\nside", "b"), record(b"", "c")
    assert names(a + b + c) == ["a", "b", "c"] and names(b"") == [] and names(b"junk") == ["gap"]
    assert names(b"noise" + a + b"noise" + c) == ["gap", "a", "gap", "c"]
    assert names(a[:-30] + b + c) == ["gap", "b", "c"]
    assert names(a.replace(b"xx", b"xy", 1) + b) == ["gap", "b"]
    assert names(a + b[: len(b) // 2]) == ["a", "gap"]
    assert names(a.replace(b"Content-Length: 50", b"Content-Length: 5x") + c) == ["gap", "c"]
    z = [gzip.compress(x) for x in (a, b, c)]
    assert names(z[0] + z[1] + z[2]) == ["a", "b", "c"]
    bad = bytearray(z[1])
    bad[len(bad) // 2] ^= 0xFF
    assert names(z[0] + bytes(bad) + z[2] + a) == ["a", "gap", "c", "a"]
    assert names(z[0][:-9] + z[2]) == ["gap", "c"] and names(z[0] + z[1][:-5]) == ["a", "gap"]


def test_many_members_with_damage():
    rng = np.random.default_rng(3)
    bodies = [rng.bytes(int(n)) for n in rng.integers(0, 60_000, 300)]  # some above a piece
    z = [bytearray(gzip.compress(record(b, str(i)))) for i, b in enumerate(bodies)]
    for i in (0, 7, 8, 150, 299):
        z[i][len(z[i]) // 2] ^= 0xFF
    got = names(b"".join(map(bytes, z)))
    assert [x for x in got if x != "gap"] == [str(i) for i in range(300) if i not in (0, 7, 8, 150, 299)] and got.count("gap") == 4


def test_broken_member_keeps_records_before_the_fault(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    warc.write(pages.coalesce(1), str(tmp_path / "w"), compression="gzip")
    (path,) = (tmp_path / "w").glob("part-*")
    whole, n = path.read_bytes(), pages.count()

    def kept(data):
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / "x.gz").write_bytes(data)
        out = warc.read(spark, str(tmp_path / "d"), payloads=True).collect()
        assert sum(r.kind == "gap" for r in out) == (data != whole)
        return {(r.record_id, r.payload) for r in out if r.kind == "record"}

    every = kept(whole)
    assert len(every) == n
    cut = kept(whole[:-9])
    assert cut <= every and len(cut) >= n - 1
    flipped = bytearray(whole)
    flipped[2 * len(whole) // 3] ^= 0x10
    some = kept(bytes(flipped))
    assert some <= every and len(some) >= n // 2
    undigested = gzip.compress(record(b"x" * 50, "a", digest=False))[:-5]
    assert [k for k, *_ in warc.salvage(undigested, partial=True)] == ["gap"]


PAGE = "page_id long, url string, html string, payload_bytes long, digest string, block string"


def test_archive_round_trip(spark, tmp_path):
    import hashlib

    big, other = "é" * 700, "y" * 1000
    given = [(1, "http://a", big), (5, "http://b\nX: y", big), (3, None, big), (7, "u", other), (8, "u", "y" * 999), (9, "u", "y" * 999), (10, "u", None), (11, "u", ""), (5, "http://b\nX: y", big), (None, "u", other), (12, "u", "WARC/1.1\r\nfoo\r\n\r\n" * 90)]
    pages = spark.createDataFrame([(*x, 0, "d", "b") for x in given], PAGE)
    got = sorted(map(tuple, warc.archive_report(pages).collect()), key=str)
    want = []
    for i, _, html in given:
        data = (html or "").encode()
        same = [j for j, _, h in given if (h or "") == (html or "") and j is not None]
        top = max(same) if len(data) >= 1000 else None
        again = top is not None and i is not None and i != top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_report(pages.where("false")).count() == 0


def test_damaged_archive_is_read_on(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    warc.write(pages.coalesce(1), str(tmp_path / "w"))
    (path,) = (tmp_path / "w").glob("part-*")
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 0x20
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc").write_bytes(bytes(data))
    out = warc.read(spark, str(tmp_path / "d"), payloads=True).collect()
    assert sum(r.kind == "record" for r in out) == pages.count() - 1 and sum(r.kind == "gap" for r in out) == 1
    assert sum(r.length for r in out) == len(data)
