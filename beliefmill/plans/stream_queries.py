"""Streaming jobs over several micro-batches with repeated and late rows, checked against
their batch meaning, and the SQL surface.

The rows come in three parts in order of time, each drained by a run of its own that goes on
from the checkpoint. Later parts repeat a third of what came before, and a tenth of the first
part comes only with the last one, far behind the watermark."""

from pyspark.sql import functions as F

from beliefmill.functions.sql import register_functions, register_table_functions
from beliefmill.operators import audit as au
from beliefmill.operators import beliefs as bl
from beliefmill.plans.admission_queries import ORDERED
from beliefmill.plans.belief_queries import LG, TIER
from beliefmill.plans.dynamics_queries import fold_sql
from beliefmill.plans.learning_queries import stat_cols, stats_sql
from beliefmill.plans.recall_queries import r6
from beliefmill.plans.registry import query
from beliefmill.session import pin
from beliefmill.streaming import jobs
from beliefmill.streaming.jobs import scratch, taken


def _n(t):
    return t.embeddings.count()


def _arrive(t, rows, at, name, run, repeats=True, held=True):
    """Call ``run(stream)`` after each of three parts of the rows has been written."""
    rows, us = pin(rows), F.unix_micros(at)
    lo, hi = rows.agg(F.coalesce(F.min(us), F.lit(0)), F.coalesce(F.max(us), F.lit(0))).first()
    one, two = (F.lit(lo + (hi - lo) * k // 3) for k in (1, 2))
    late = (us < one) & (F.col("id") % 10 == 9) & F.lit(held)
    part = F.when(late, 2).when(us < one, 0).when(us < two, 1).otherwise(2)
    out = scratch(t.spark, name)
    for i in range(3):
        rows.where((part == i) | ((part < i) & (F.col("id") % 3 == 0) & F.lit(repeats))).write.parquet(f"{out}/{i}")
        run(t.spark.readStream.schema(rows.schema).parquet(f"{out}/*"))


def in_time(view, at):
    """Check SQL: rows of a view that are not late, and the last watermark for a delay."""
    us = f"epoch_us({at})"
    return f"(SELECT * FROM {view} WHERE NOT (id % 10 = 9 AND {us} < (SELECT min({us}) + (max({us}) - min({us})) // 3 FROM {view})))"


@query("usage_stream", "usage_events", f"""
SELECT tenant_id, strftime(ts, '%Y-%m') AS month, count(*) FILTER (kind = 'written')::BIGINT AS written, count(*) FILTER (kind = 'recall')::BIGINT AS recalls FROM {in_time('usage_events', 'ts')} x
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM usage_events) GROUP BY ALL""")
def usage_stream(t):
    out = scratch(t.spark, "usage")
    _arrive(t, t.usage_events, "ts", "usage-in", lambda s: jobs.append_closed(jobs.usage_stream(s, once="id"), f"{out}/days", f"{out}/ckpt"))
    return jobs.usage_months(taken(t.spark, f"{out}/days")).withColumn("month", F.date_format("month", "yyyy-MM"))


def _learned(t, name, width, slide):
    rows = t.signals.join(t.mem.select(F.col("id").alias("memory_id"), "agent_id"), "memory_id").select(
        "id", "agent_id", "created_at", F.lit("feedback").alias("mutation_type"), F.concat(F.lit("feedback: "), "signal_type").alias("reason"),
        F.lit(0.5).cast("float").alias("old_confidence"), F.when(F.col("signal_type").isin("used", "helpful"), 0.6).otherwise(0.4).cast("float").alias("new_confidence"))
    out = scratch(t.spark, name)
    _arrive(t, rows, "created_at", f"{name}-in", lambda s: jobs.append_closed(jobs.learning_stream(s, width, slide, once="id"), f"{out}/windows", f"{out}/ckpt"))
    return stat_cols(taken(t.spark, f"{out}/windows").withColumn("start", F.date_format("window.start", "yyyy-MM-dd")), "agent_id", "start")


def learned_sql(backs):
    """Each row in the windows of 7 days that hold it, by the start of the window."""
    return f"""
WITH w AS (SELECT m.agent_id, 'feedback' AS mutation_type, 'feedback: ' || signal_type AS reason, 0.5::FLOAT AS old_confidence, CASE WHEN signal_type IN ('used', 'helpful') THEN 0.6 ELSE 0.4 END::FLOAT AS new_confidence, {backs} AS back, s.created_at
  FROM {in_time('signals', 'created_at')} s JOIN mem m ON m.id = s.memory_id),
x AS (SELECT * REPLACE (strftime(start, '%Y-%m-%d') AS start) FROM (SELECT *, date_trunc('day', created_at) - INTERVAL 1 DAY * back AS start FROM w) y WHERE start + INTERVAL 7 DAY <= (SELECT max(created_at) - INTERVAL 2 DAY FROM signals)), {stats_sql('x', 'agent_id, start')}"""


@query("learning_stream", "signals mem", learned_sql("unnest(range(7))"))
def learning_stream(t):
    return _learned(t, "learning", "7 days", "1 day")


@query("learning_stream_tumbling", "signals mem", learned_sql("((epoch_us(s.created_at) // 86400000000) % 7)"))
def learning_stream_tumbling(t):
    """Windows that don't overlap, counted from the epoch."""
    return _learned(t, "tumbling", "7 days", "7 days")


SESSIONS = f"""
WITH v AS (SELECT event_id AS id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM {in_time('v', 'ts')} x WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM e),
s AS (SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 43200000000 AS ending, count(*) AS n FROM g GROUP BY user_id, grp),
closed AS (SELECT * FROM s WHERE ending <= (SELECT max(epoch_us(ts)) - 86400000000 FROM v))"""


def _visits(t):
    return t.events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"))


@query("session_stream", "", f"{SESSIONS} SELECT * FROM closed")
def session_stream(t):
    out = scratch(t.spark, "sessions")
    _arrive(t, _visits(t), "ts", "sessions-in", lambda s: jobs.append_closed(jobs.session_stream(s, "12 hours", "1 day", once="id"), f"{out}/closed", f"{out}/ckpt"))
    return taken(t.spark, f"{out}/closed").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("ending"), "n")


@query("session_expiry_stream", "mem", f"""{SESSIONS}
SELECT m.id, count(*) AS expired, max(ending) AS expired_at FROM mem m JOIN closed c ON m.session_id = c.user_id WHERE m.binding = 'session' AND NOT m.is_archived GROUP BY m.id""")
def session_expiry_stream(t):
    """Session beliefs are archived when a session of their user expires."""
    out = scratch(t.spark, "expiry")
    bound = t.mem.where("binding = 'session' AND NOT is_archived").select("id", F.col("session_id").alias("user_id"))

    def archive(sessions, batch):
        jobs.put(sessions.join(bound, "user_id").select("id", F.unix_micros("end").alias("expired_at")), f"{out}/archived", batch)

    _arrive(t, _visits(t), "ts", "expiry-in", lambda s: jobs.session_expiry_stream(s, "12 hours", "1 day", archive, f"{out}/ckpt", once="id"))
    return taken(t.spark, f"{out}/archived").groupBy("id").agg(F.count("*").alias("expired"), F.max("expired_at").alias("expired_at"))


DUE = f"ev AS (SELECT * FROM {in_time('signals', 'created_at')} x WHERE date_trunc('minute', created_at) + INTERVAL 1 MINUTE <= (SELECT max(created_at) - INTERVAL 1 DAY FROM signals))"


@query("feedback_stream", "signals mem", fold_sql(DUE).replace("SELECT memory_id, n_events AS n, ", "SELECT memory_id, ").replace(", review FROM j", " FROM j"))
def feedback_stream(t):
    """Events of the last day still wait; beliefs touched by those before it."""
    out = scratch(t.spark, "feedback")
    job = jobs.FeedbackStream(t.spark, t.mem, out)
    _arrive(t, t.signals, "created_at", "feedback-in", lambda s: job.run(s, f"{out}/ckpt"))
    touched = taken(t.spark, job.steps).select(F.col("memory_id").alias("id")).distinct()
    return job.result().join(touched, "id", "left_semi").select(F.col("id").alias("memory_id"), r6("confidence", "new_confidence"), F.col("reinforcement_count").cast("long").alias("new_count"))


@query("access_stream", "hits mem", """
SELECT m.id, round(greatest(m.confidence::DOUBLE, least(m.confidence::DOUBLE + 0.02 * coalesce(n, 0), 0.99)), 6) AS confidence, (m.access_count + coalesce(n, 0))::BIGINT AS access_count
FROM mem m LEFT JOIN (SELECT memory_id, count(*) AS n FROM hits GROUP BY 1) h ON h.memory_id = m.id""")
def access_stream(t):
    """Hits have no watermark: late ones count."""
    out = scratch(t.spark, "access")
    job = jobs.AccessStream(t.spark, t.mem, out)
    _arrive(t, t.hits, "ts", "access-in", lambda s: job.run(s, f"{out}/ckpt"), repeats=False)
    return job.result().select("id", r6("confidence", "confidence"), "access_count")


@query("seal_stream", "mlog", "SELECT tenant_id::VARCHAR AS tenant_id, true AS valid, count(*) AS checked FROM mlog GROUP BY 1")
def seal_stream(t):
    """The delay spans all rows: repeats are met, late rows are sealed with their batch."""
    out = scratch(t.spark, "seal")
    job = jobs.SealStream(t.spark, out, delay="60 days")
    _arrive(t, t.mlog, "created_at", "seal-in", lambda s: job.run(s, f"{out}/ckpt"))
    return au.verify_chain(job.log(), job.heads()).select("tenant_id", "valid", "checked")


ARRIVING = """arriving AS (SELECT i.* REPLACE (e.ts AS created_at) FROM incoming i JOIN (SELECT event_id % (SELECT count(*) FROM embeddings) + 1000000 AS id, min(CAST(ts AS TIMESTAMP)) AS ts FROM events GROUP BY ALL) e ON e.id = i.id)"""


@query("admit_stream", "mem vecs incoming", f"WITH {ORDERED.replace('RECURSIVE iv', f'RECURSIVE {ARRIVING}, iv', 1)}")
def admit_stream(t):
    """Every belief named by an event is written once more, with a neighbour's vector, in the
    order of its first event, over several micro-batches."""
    named = t.events.groupBy((F.col("event_id") % _n(t) + 1000000).alias("id")).agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
    rows = t.with_vec(t.incoming).drop("created_at").join(named, "id")
    out = scratch(t.spark, "admit")
    job = jobs.AdmissionStream(t.spark, t.memv, bl.resolve_settings(t.tenants, t.settings_raw), out)
    _arrive(t, rows, "created_at", "arriving", lambda s: job.run(s, f"{out}/ckpt", delay="60 days"), held=False)
    return job.result().select("id", "decision", "existing_id", r6("sim", "sim"))


@query("sql_functions", "mem", f"SELECT id, round({LG}, 6) AS lo, {TIER} AS tier, CASE WHEN session_id IS NOT NULL THEN 'session' WHEN anchor_id IS NOT NULL THEN 'anchored' ELSE 'private' END AS bound FROM mem")
def sql_functions(t):
    register_functions(t.spark)
    return t.spark.sql("SELECT id, round(bm_logit(confidence), 6) AS lo, bm_tier(confidence) AS tier, bm_binding(anchor_id, session_id) AS bound FROM {mem}", mem=t.mem)


@query("token_rows", "ep", "SELECT id, count(*) AS n, count(DISTINCT w) AS words FROM (SELECT id, unnest(regexp_extract_all(lower(raw_content), '[a-z0-9]+')) AS w FROM ep) x GROUP BY 1")
def token_rows(t):
    register_table_functions(t.spark)
    rows = t.spark.sql("SELECT e.id, k.token FROM {ep} e, LATERAL bm_tokens(e.raw_content) k", ep=t.ep)
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("words"))
