"""Change log: sealing and verifying per-tenant hash chains, history, export."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beliefmill.functions import scalar as sc
from beliefmill.operators.ordering import number_rows, with_previous
from beliefmill.operators.similarity import top_by
from beliefmill.session import instant, pin

NO_TENANT = "00000000-0000-0000-0000-000000000000"
SEGMENT_ROWS = 2_000_000
CANONICAL_SEGMENT_ROWS = 50_000

# Order of the sealed fields in both forms.
BODY = ["memory_id", "agent_id", "tenant_id", "mutation_type", "source_type", "source_id", "old_confidence", "new_confidence",
        "old_reinforcement_count", "new_reinforcement_count", "reason", "metadata", "content_hash", "content_snapshot",
        "actor_type", "actor_id", "anchor_id", "binding", "created_at"]
FIRST_VERSION = ["memory_id", "agent_id", "tenant_id", "mutation_type", "source_type", "source_id", "old_confidence",
                 "new_confidence", "reason", "content_hash", "actor_id", "created_at"]


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    if name in ("old_confidence", "new_confidence"):
        return F.round(F.col(name).cast("double") * 1_000_000).cast("long").cast("string")
    if name == "created_at":
        return F.unix_micros(name).cast("string")
    return F.col(name).cast("string")


def body_digest(df: DataFrame) -> Column:
    """sha256 over length-prefixed fields; null ('-') differs from the empty text ('0:').
    Confidences count in millionths, times in microseconds."""
    parts = []
    for n in BODY:
        x = _text(df, n)
        parts.append(F.when(x.isNull(), "-").otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x)))
    return F.sha2(F.concat(*parts), 256)


def _plain_number(name: str, exponents: bool) -> Column:
    """A 4-byte real in its shortest form without trailing zeros: as a number of a JSON
    document (0.00001), or as plain text, which turns to exponents below 0.0001 (1e-05)."""
    x = F.col(name).cast("float").cast("string")
    plain = F.col(name).cast("float").cast("string").cast("decimal(38,18)").cast("string")
    plain = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    plain = F.when(F.col(name).cast("float") == 0, F.lit("0")).otherwise(plain)
    if not exponents:
        return plain
    small = F.regexp_replace(F.regexp_replace(x, r"\.0E", "E"), "E-([0-9])$", "E-0$1")
    size = F.abs(F.col(name).cast("float"))
    return F.when((size > 0) & (size < F.lit(0.0001).cast("float")), F.lower(small)).otherwise(plain)


def _epoch(name: str) -> Column:
    """Seconds since 1970 with six decimals."""
    return (F.unix_micros(name).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(26,6)").cast("string")


def _json_text(x: Column) -> Column:
    """A JSON string that escapes quotes, backslashes and control characters alone."""
    x = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    # the rare controls are looked for only in texts that hold one
    odd = x
    for code in range(1, 32):
        odd = F.replace(odd, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(x.rlike("[\\x01-\\x1f]"), odd).otherwise(x), F.lit('"'))


def json_body(df: DataFrame) -> Column:
    """The sealed fields as the elements of a JSON array, separated by comma and blank; null is
    ``null``. ``metadata`` is taken as the text of a JSON document, as the log's database prints it."""
    def one(n):
        if n not in df.columns:
            return F.lit("null")
        if n in ("old_confidence", "new_confidence"):
            x = _plain_number(n, False)
        elif n == "created_at":
            x = F.concat(F.lit('"'), _epoch(n), F.lit('"'))
        elif n in ("old_reinforcement_count", "new_reinforcement_count", "metadata"):
            x = F.col(n).cast("string")
        else:
            x = _json_text(F.col(n).cast("string"))
        return F.coalesce(x, F.lit("null"))

    return F.concat_ws(", ", *[one(n) for n in BODY])


def pipe_text(df: DataFrame) -> Column:
    """The first form: seq, prev_hash and twelve fields between bars; only the two types are left out when null."""
    def one(n):
        if n not in df.columns:
            return F.lit(None).cast("string") if n in ("mutation_type", "source_type") else F.lit("")
        x = _plain_number(n, True) if n in ("old_confidence", "new_confidence") else _epoch(n) if n == "created_at" else F.col(n).cast("string")
        return x if n in ("mutation_type", "source_type") else F.coalesce(x, F.lit(""))

    return F.concat_ws("|", F.col("seq").cast("string"), "prev_hash", *[one(n) for n in FIRST_VERSION])


def canonical_hash(df: DataFrame) -> Column:
    """Row hash of logs sealed by a database trigger: version 2 and later hash a JSON array,
    version 1 a text between bars. Every row holds its prev_hash, so rows are hashed in parallel."""
    prev = F.coalesce(_json_text(F.col("prev_hash")), F.lit("null"))
    array = F.concat(F.lit("["), F.col("hash_version").cast("string"), F.lit(", "), F.col("seq").cast("string"), F.lit(", "), prev, F.lit(", "), json_body(df), F.lit("]"))
    return F.when(F.col("hash_version") >= 2, F.sha2(array, 256)).otherwise(F.sha2(pipe_text(df), 256))


def first_version_text(df: DataFrame, prev: Column) -> Column:
    return F.concat_ws("|", F.col("seq").cast("string"), prev, *[F.coalesce(_text(df, n), F.lit("")) for n in FIRST_VERSION])


def row_hash(df: DataFrame) -> Column:
    prev = F.coalesce("prev_hash", F.lit(""))
    second = F.sha2(F.concat_ws("|", F.lit("2"), F.col("seq").cast("string"), prev, body_digest(df)), 256)
    return F.when(F.col("hash_version") >= 2, second).otherwise(F.sha2(first_version_text(df, prev), 256))


def seal_canonical(rows: DataFrame, heads: DataFrame | None = None, segment_rows: int = CANONICAL_SEGMENT_ROWS) -> DataFrame:
    """``seal_chain`` in the form of ``canonical_hash``. There the previous hash stands before
    the body, so whole bodies travel to the linking task: segments hold fewer rows."""
    return seal_chain(rows, heads, segment_rows, canonical=True)


def seal_chain(rows: DataFrame, heads: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS, canonical: bool = False) -> DataFrame:
    """Rows with seq, prev_hash, row_hash in (created_at, id) order per tenant.

    Linking is serial by nature, but only over (seq, digest): the bodies are
    hashed in parallel beforehand. A long chain is linked in segments of bounded
    length; each round links one segment of every tenant and hands the heads to
    the next, so no task ever holds more than one segment.
    """
    rows = rows.withColumn("_tenant", F.coalesce(F.col("tenant_id").cast("string"), F.lit(NO_TENANT)))
    # only ids and times are numbered; the bodies are hashed where they are and
    # travel as digests
    numbered = number_rows(rows.select("_tenant", "id", "created_at"), ["_tenant"], [F.asc("created_at"), F.asc("id")], "_n")
    numbered = numbered.select("_tenant", "id", "_n").join(rows.select("_tenant", "id", (json_body(rows) if canonical else body_digest(rows)).alias("_digest")), ["_tenant", "id"])
    if heads is None:
        heads = rows.sparkSession.createDataFrame([], "tenant_id string, last_seq long, last_hash string")
    start = heads.select(F.col("tenant_id").cast("string").alias("_tenant"), F.col("last_seq").alias("_s"), F.col("last_hash").alias("_h"))
    links = pin(numbered.join(start, "_tenant", "left").select(
        "_tenant", "id", (F.col("_n") + F.coalesce("_s", F.lit(0))).alias("seq"), F.floor((F.col("_n") - 1) / segment_rows).cast("int").alias("_seg"),
        "_digest", F.coalesce("_h", F.lit("")).alias("_h")), split_by="_seg")
    last = links.agg(F.max("_seg")).first()[0]
    schema = T.StructType([T.StructField("_tenant", T.StringType()), T.StructField("id", links.schema["id"].dataType),
                           T.StructField("seq", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])

    def link(head: pa.Table, seg: pa.Table) -> pa.Table:
        if seg.num_rows == 0:
            return schema_empty
        seg = seg.sort_by("seq")
        prev = head.column("_head")[0].as_py() if head.num_rows else seg.column("_h")[0].as_py()
        before, after = [], []
        for n, digest in zip(seg.column("seq").to_pylist(), seg.column("_digest").to_pylist()):
            before.append(prev)
            text = f'[2, {n}, "{prev}", {digest}]' if canonical else f"2|{n}|{prev}|{digest}"
            prev = hashlib.sha256(text.encode()).hexdigest()
            after.append(prev)
        return pa.table({"_tenant": seg.column("_tenant"), "id": seg.column("id"), "seq": seg.column("seq"),
                         "prev_hash": pa.array(before), "row_hash": pa.array(after)})

    schema_empty = pa.table({"_tenant": pa.array([], pa.string()), "id": pa.array([], pa.int64() if isinstance(links.schema["id"].dataType, T.LongType) else pa.string()),
                             "seq": pa.array([], pa.int64()), "prev_hash": pa.array([], pa.string()), "row_hash": pa.array([], pa.string())})
    done, head = None, None
    for seg in range((last if last is not None else -1) + 1):
        part = links.where(F.col("_seg") == seg)
        if head is None:
            head_rows = part.sparkSession.createDataFrame([], "_tenant string, _head string")
        else:
            head_rows = head
        linked = pin(head_rows.groupBy("_tenant").cogroup(part.groupBy("_tenant")).applyInArrow(link, schema))
        head = linked.groupBy("_tenant").agg(F.max_by("row_hash", "seq").alias("_head"))
        done = linked if done is None else done.unionByName(linked)
    if done is None:
        done = rows.sparkSession.createDataFrame([], schema)
    return rows.join(done, ["_tenant", "id"]).drop("_tenant").withColumn("hash_version", F.lit(2))


def chain_heads(sealed: DataFrame) -> DataFrame:
    return sealed.groupBy(F.coalesce(F.col("tenant_id").cast("string"), F.lit(NO_TENANT)).alias("tenant_id")).agg(
        F.max("seq").alias("last_seq"), F.max_by("row_hash", "seq").alias("last_hash"))


LINK, EDIT, SNAPSHOT = ("chain link broken (seq or prev_hash mismatch)", "row hash mismatch (row edited)",
                        "content_snapshot does not match sealed content_hash")


def verify_chain(mlog: DataFrame, heads: DataFrame, canonical: bool = False) -> DataFrame:
    """Per tenant: valid, checked, break_seq, reason; ``canonical`` for logs hashed by
    ``canonical_hash``. Rows are hashed once and written as
    digests; every row is checked against its predecessor by an equi-join on (tenant, seq), so
    long chains spread over all tasks; the first break is a minimum."""
    tenant = F.coalesce(F.col("tenant_id").cast("string"), F.lit(NO_TENANT))
    snap = F.col("content_snapshot").isNotNull() & (F.coalesce("content_hash", F.lit("")) != "") & (F.sha2("content_snapshot", 256) != F.col("content_hash"))
    local = mlog.select(tenant.alias("t"), "seq", F.coalesce("prev_hash", F.lit("")).alias("prev"), F.coalesce("row_hash", F.lit("")).alias("hash"),
                        ((canonical_hash(mlog) if canonical else row_hash(mlog)) != F.coalesce("row_hash", F.lit(""))).alias("edited"), F.coalesce(snap, F.lit(False)).alias("snap"))
    # a duplicated seq counts as a broken link
    rows = pin(local.groupBy("t", "seq").agg(F.count("*").alias("n"), F.min("prev").alias("prev"), F.max("hash").alias("hash"),
                                             F.max("edited").alias("edited"), F.max("snap").alias("snap")))
    before = rows.select("t", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("want"))
    joined = rows.join(before, ["t", "seq"], "left")
    linked = F.when(F.col("seq") == 1, F.col("prev") == "").otherwise(F.coalesce(F.col("want") == F.col("prev"), F.lit(False))) & (F.col("n") == 1)
    reason = F.when(~linked, LINK).when(F.col("edited"), EDIT).when(F.col("snap"), SNAPSHOT)
    flagged = joined.select("t", "seq", "hash", "n", reason.alias("why"))
    state = flagged.groupBy("t").agg(
        F.min(F.when(F.col("why").isNotNull(), F.struct("seq", "why"))).alias("brk"), F.sum("n").alias("rows"), F.max_by("hash", "seq").alias("tail"))
    upto = flagged.join(state.where(F.col("brk").isNotNull()).select("t", F.col("brk.seq").alias("bs")), "t").where(
        F.col("seq") < F.col("bs")).groupBy("t").agg(F.sum("n").alias("good"))
    h = heads.select(F.col("tenant_id").cast("string").alias("t"), "last_seq", "last_hash")
    all_ = state.join(upto, "t", "left").join(h, "t", "full_outer").withColumn("rows", F.coalesce("rows", F.lit(0)))
    checked = F.when(F.col("brk").isNotNull(), F.coalesce("good", F.lit(0))).otherwise(F.col("rows"))
    why = (
        F.when(F.col("brk").isNotNull(), F.col("brk.why"))
        .when(F.col("last_seq").isNull(), F.when(F.col("rows") > 0, "chain head row missing"))
        .when((F.col("last_seq") != F.col("rows")) | (F.coalesce("last_hash", F.lit("")) != F.coalesce("tail", F.lit(""))),
              F.concat(F.lit("head mismatch: head_seq="), F.col("last_seq").cast("string"), F.lit(" checked="), F.col("rows").cast("string"), F.lit(" (tail truncated or head edited)")))
    )
    return all_.select(F.col("t").alias("tenant_id"), why.isNull().alias("valid"), checked.cast("long").alias("checked"),
                       F.col("brk.seq").alias("break_seq"), why.alias("reason"))


def chain_tail(sealed: DataFrame, n: int = 500) -> DataFrame:
    if not 1 <= n <= 500:
        raise ValueError("n must be between 1 and 500")
    return top_by(sealed, ["tenant_id"], [F.desc("seq")], n)


def beliefs_as_of(mem: DataFrame, mlog: DataFrame, at, n: int = 100) -> DataFrame:
    """Confidence each belief had at an instant: newest change up to it, else the
    value before the earliest change, else the current one. One pass over the log."""
    t = instant(at)
    order = F.struct("created_at", "id")
    past = (F.col("created_at") <= t) & F.col("new_confidence").isNotNull()
    seen = mlog.groupBy("memory_id").agg(
        F.max_by(F.when(past, F.col("new_confidence")), F.when(past, order)).alias("_past"),
        F.min_by(F.when(F.col("old_confidence").isNotNull(), F.col("old_confidence")), F.when(F.col("old_confidence").isNotNull(), order)).alias("_first"))
    rows = mem.where((F.col("created_at") <= t) & ~F.col("is_archived"))
    held = rows.join(seen, rows.id == seen.memory_id, "left").withColumn("conf_at", F.coalesce("_past", "_first", "confidence"))
    total = rows.groupBy("agent_id").agg(F.count("*").alias("total"))
    top = top_by(held.select("agent_id", "id", "conf_at"), ["agent_id"], [F.desc("conf_at"), F.asc("id")], n)
    return top.join(total, "agent_id").withColumn("tier", sc.tier(F.col("conf_at")))


def confidence_history(mlog: DataFrame) -> DataFrame:
    """Steps of each belief's confidence with the previous recorded value."""
    rows = mlog.select("memory_id", "id", "created_at", "old_confidence", "new_confidence", "mutation_type")
    out = with_previous(rows, ["memory_id"], [F.asc("created_at"), F.asc("id")], {"new_confidence": "previous"}, "step")
    return out.withColumn("jump", F.col("old_confidence").cast("double") - F.col("previous").cast("double"))


def _signature(key: bytes):
    @F.pandas_udf(T.StringType())
    def sign(head: pd.Series) -> pd.Series:
        return head.map(lambda h: hmac.new(key, (h or "").encode(), hashlib.sha256).hexdigest())

    return sign


def export_lines(sealed: DataFrame, fields: list[str], exported_at, key: bytes | None = None) -> DataFrame:
    """(tenant_id, pos, line): one JSON line per row in seq order, then a trailer."""
    body = sealed.select(F.col("tenant_id").cast("string").alias("tenant_id"), F.col("seq").alias("pos"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))
    heads = chain_heads(sealed)
    if key is not None:
        heads = heads.withColumn("signature", _signature(key)("last_hash"))
    trailer = F.struct(
        F.lit(True).alias("_trailer"), F.col("tenant_id"), F.col("n").alias("count"), F.col("last_seq").alias("head_seq"),
        F.col("last_hash").alias("head_hash"), F.date_format(instant(exported_at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("exported_at"),
        *(["signature"] if key is not None else []))
    counts = body.groupBy("tenant_id").agg(F.count("*").alias("n"))
    tail = heads.join(counts, "tenant_id").select("tenant_id", (F.col("last_seq") + 1).alias("pos"), F.to_json(trailer).alias("line"))
    return body.unionByName(tail)


def export_audit(sealed: DataFrame, fields: list[str], exported_at, out: str, key: bytes | None = None) -> None:
    """Write the lines as text files, one folder per tenant, in order across files."""
    lines = export_lines(sealed, fields, exported_at, key)
    lines.repartitionByRange("tenant_id", "pos").sortWithinPartitions("tenant_id", "pos").select("tenant_id", "line").write.partitionBy("tenant_id").text(out)
