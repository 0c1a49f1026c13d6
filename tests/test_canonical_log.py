"""Logs in the encoding of a database trigger, against texts written out by hand."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from beliefmill.operators import audit as au

FIELDS = ("id long, memory_id string, agent_id string, tenant_id string, mutation_type string, source_type string, source_id string, old_confidence float, new_confidence float, "
          "old_reinforcement_count int, new_reinforcement_count int, reason string, metadata string, content_hash string, content_snapshot string, actor_type string, actor_id string, "
          "anchor_id string, binding string, created_at timestamp, seq long, prev_hash string, hash_version int, row_hash string")
SNAP = 'say "é"\n\\ \x01\t😀/'
ROWS = [
    (1, "m", "a", "t", "decay", "system", None, 0.85, 1.0, None, None, None, None, None, None, None, None, None, None, dt.datetime(2024, 1, 2, 3, 4, 5)),
    (2, "m", "a", "t", "feedback", "user", "s", None, 0.00001, 2, 3, "a|b", '{"k": [1, "x"]}', hashlib.sha256(SNAP.encode()).hexdigest(), SNAP, "system", "u", "n", "hard", dt.datetime(2024, 1, 2, 3, 4, 6, 120000)),
    (3, "m", "a", "t", "feedback", "user", None, 0.0005, 0.1, 0, 1, "", None, "", None, "key", None, None, None, dt.datetime(2024, 1, 2, 3, 4, 7, 5)),
]
NUMBERS = [("0.85", "1"), (None, "1e-05"), ("0.0005", "0.1")]
TIMES = ["1704164645.000000", "1704164646.120000", "1704164647.000005"]


def sealed():
    """Row 1 in the first form, the others as JSON arrays."""
    out, prev = [], ""
    for n, (r, (old, new), at) in enumerate(zip(ROWS, NUMBERS, TIMES, strict=True), 1):
        text = lambda x: "" if x is None else x
        if n == 1:
            body = "|".join([str(n), prev, *map(text, r[1:4]), r[4], r[5], text(r[6]), text(old), text(new), text(r[11]), text(r[13]), text(r[16]), at])
        else:
            quote = lambda x: "null" if x is None else json.dumps(x, ensure_ascii=False)
            raw = lambda x: "null" if x is None else str(x)
            number = {"1e-05": "0.00001"}
            body = "[" + ", ".join(["2", str(n), quote(prev), *map(quote, r[1:7]), number.get(old, raw(old)), number.get(new, raw(new)), raw(r[9]), raw(r[10]),
                                    quote(r[11]), raw(r[12]), *map(quote, r[13:19]), quote(at)]) + "]"
        own = hashlib.sha256(body.encode()).hexdigest()
        out.append((*r, n, prev, 1 if n == 1 else 2, own))
        prev = own
    return out


def test_rows_sealed_elsewhere_verify(spark):
    log = spark.createDataFrame(sealed(), FIELDS)
    got = log.select("id", (au.canonical_hash(log) == F.col("row_hash")).alias("same")).collect()
    assert {r["id"]: r["same"] for r in got} == {1: True, 2: True, 3: True}
    heads = au.chain_heads(log)
    assert [(r["valid"], r["checked"]) for r in au.verify_chain(log, heads, canonical=True).collect()] == [(True, 3)]
    bad = log.withColumn("actor_type", F.when(F.col("seq") == 2, "user").otherwise(F.col("actor_type")))
    r = au.verify_chain(bad, heads, canonical=True).first()
    assert (r["valid"], r["break_seq"], r["reason"]) == (False, 2, au.EDIT)


def test_sealing_goes_on_behind_a_head(spark):
    log = spark.createDataFrame(sealed(), FIELDS)
    more = au.seal_canonical(log.where("seq > 1").drop("seq", "prev_hash", "row_hash", "hash_version"), au.chain_heads(log.where("seq = 1")), segment_rows=1)
    assert {r["id"]: r["row_hash"] for r in more.collect()} == {r[0]: r[-1] for r in sealed()[1:]}
