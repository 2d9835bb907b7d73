"""State, retention, feedback, sinks and the streaming poll over the adapters."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import state as ST
from ..session import checkpoint_dir
from ..sources import adapters as A
from ..sources.adapters import with_adapters
from ..sources.tables import read_table
from ..streaming import claims as CL
from ..streaming import poll as POLL
from .catalog import register
from .q_ingest import _FEED_BUILDS_SQL

NOW = _dt.datetime(2024, 7, 15)
STATE_NOW = _dt.datetime(2024, 1, 20)


@register("x22_solution_ids", oracle=with_adapters("""
SELECT id, lower(trim(id)) AS by_session,
       sha256(lower(coalesce(job_full_name, '') || '|' || coalesce(CAST(build_number AS VARCHAR), '0') || '|' || coalesce(stage_name, '') || '|' || trim(coalesce(fingerprint, '')))) AS by_content
FROM sessions""", "sessions"))
def x22_solution_ids(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    no = F.lit(None).cast("string")
    return s.select("id", ST.solution_doc_id(F.col("id"), F.col("job_full_name"), F.col("build_number"), F.col("stage_name"), F.col("fingerprint")).alias("by_session"),
                    ST.solution_doc_id(no, F.col("job_full_name"), F.col("build_number"), F.col("stage_name"), F.col("fingerprint")).alias("by_content"))


_U5_SQL = """
, d AS (SELECT session_id AS id, lower(trim(decision)) AS decision, ts FROM decisions WHERE lower(trim(decision)) IN ('accept', 'reject')),
j AS (
  SELECT s.id, s.feedback_status, d.decision, d.ts FROM sessions s JOIN d ON s.id = d.id
  WHERE d.decision = 'reject' OR trim(coalesce(nullif(s.suggested_fix, ''), s.analysis, '')) <> ''
), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, decision) AS r FROM j) WHERE r = 1),
u5 AS (
  SELECT id,
         CASE WHEN lower(trim(coalesce(feedback_status, ''))) IN ('accepted', 'rejected') THEN lower(trim(coalesce(feedback_status, '')))
              WHEN decision = 'accept' THEN 'accepted' WHEN decision = 'reject' THEN 'rejected' ELSE feedback_status END AS feedback_status,
         NOT (lower(trim(coalesce(feedback_status, ''))) IN ('accepted', 'rejected')) AND decision = 'accept' AS store_solution,
         lower(trim(coalesce(feedback_status, ''))) IN ('accepted', 'rejected') AS idempotent
  FROM f
)
"""


@register("u5_feedback", oracle=with_adapters(_U5_SQL + "SELECT * FROM u5", "sessions", "decisions"))
def u5_feedback(spark, sf_dir):
    return ST.apply_feedback(A.sessions(spark, sf_dir), A.decisions(spark, sf_dir))


@register("s9_solution_upsert", oracle=with_adapters(_U5_SQL + """
, inc AS (
  SELECT lower(trim(s.id)) AS doc_id, s.fingerprint AS fingerprint_text, trim(coalesce(nullif(s.suggested_fix, ''), s.analysis, '')) AS solution,
         s.created_at, 1 AS src
  FROM sessions s JOIN u5 ON s.id = u5.id WHERE u5.store_solution
), allrows AS (
  SELECT doc_id, fingerprint_text, solution, created_at, 0 AS src FROM solutions UNION ALL SELECT * FROM inc
)
SELECT doc_id, fingerprint_text, solution, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src DESC, created_at DESC NULLS LAST) AS r FROM allrows) WHERE r = 1
""", "sessions", "decisions", "solutions"))
def s9_solution_upsert(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    fb = ST.apply_feedback(s, A.decisions(spark, sf_dir)).filter("store_solution").select("id")
    inc = s.join(fb, "id").select(
        ST.solution_doc_id(F.col("id"), F.col("job_full_name"), F.col("build_number"), F.col("stage_name"), F.col("fingerprint")).alias("doc_id"),
        F.col("fingerprint").alias("fingerprint_text"),
        F.trim(F.coalesce(F.nullif(F.col("suggested_fix"), F.lit("")), F.col("analysis"), F.lit(""))).alias("solution"), "created_at")
    ex = A.solutions(spark, sf_dir).select("doc_id", "fingerprint_text", "solution", "created_at")
    return ST.upsert_solutions(ex, inc)


@register("z5_retention", oracle=with_adapters(f"""
SELECT CAST((SELECT count(*) FROM sessions WHERE updated_at < TIMESTAMP '{NOW}' - INTERVAL 180 DAY) AS BIGINT) AS sessions_deleted,
       CAST((SELECT count(*) FROM messages WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY) AS BIGINT) AS messages_deleted,
       CAST((SELECT count(*) FROM messages m WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY
             AND m.session_id IN (SELECT id FROM sessions WHERE updated_at >= TIMESTAMP '{NOW}' - INTERVAL 180 DAY)) AS BIGINT) AS messages_kept
""", "sessions", "messages"))
def z5_retention(spark, sf_dir):
    _, kept_m, counts = ST.retention(A.sessions(spark, sf_dir), A.messages(spark, sf_dir), NOW)
    kept = kept_m.agg(F.count(F.lit(1)).alias("messages_kept"))
    return counts.unionByName(kept.select(F.lit(None).cast("bigint").alias("sessions_deleted"), F.lit(None).cast("bigint").alias("messages_deleted"), "messages_kept"),
                              allowMissingColumns=True).agg(F.max("sessions_deleted").alias("sessions_deleted"), F.max("messages_deleted").alias("messages_deleted"),
                                                            F.max("messages_kept").alias("messages_kept"))


_Z3_SQL = _FEED_BUILDS_SQL + f"""
, x AS (SELECT fb.job_full_name, fb.build_number, fb.item_id, e.ts FROM fb JOIN events e ON e.event_id = fb.item_id),
ev AS (
  SELECT job_full_name, build_number, ts, 'claim' AS action, CAST(NULL AS VARCHAR) AS error FROM x
  UNION ALL
  SELECT job_full_name, build_number, ts + INTERVAL 1 SECOND,
         CASE WHEN item_id % 3 = 0 THEN 'failed' ELSE 'processed' END,
         CASE WHEN item_id % 3 = 0 THEN 'worker forward: unavailable' END FROM x
), evn AS (SELECT *, row_number() OVER (PARTITION BY job_full_name, build_number ORDER BY ts, action, error NULLS FIRST) AS rn FROM ev),
rec AS (
  WITH RECURSIVE r(job_full_name, build_number, rn, status, attempt_count, last_error, first_seen_at, processed_at, claims_granted) AS (
    SELECT job_full_name, build_number, rn,
           CASE WHEN action = 'claim' THEN 'processing' END, 0, CAST(NULL AS VARCHAR),
           CASE WHEN action = 'claim' THEN ts END, CAST(NULL AS TIMESTAMP), CASE WHEN action = 'claim' THEN 1 ELSE 0 END
    FROM evn WHERE rn = 1
    UNION ALL
    SELECT e.job_full_name, e.build_number, e.rn,
           CASE WHEN e.action = 'claim' AND (r.status IS NULL OR r.status IN ('seen', 'failed')) THEN 'processing'
                WHEN e.action = 'processed' AND r.status IS NOT NULL THEN 'processed'
                WHEN e.action = 'failed' AND r.status IS NOT NULL THEN 'failed' ELSE r.status END,
           r.attempt_count + CASE WHEN e.action IN ('processed', 'failed') AND r.status IS NOT NULL THEN 1 ELSE 0 END,
           CASE WHEN e.action = 'processed' AND r.status IS NOT NULL THEN NULL
                WHEN e.action = 'failed' AND r.status IS NOT NULL THEN coalesce(e.error, '') ELSE r.last_error END,
           CASE WHEN r.status IS NULL AND e.action = 'claim' THEN e.ts ELSE r.first_seen_at END,
           CASE WHEN e.action = 'processed' AND r.status IS NOT NULL THEN e.ts ELSE r.processed_at END,
           r.claims_granted + CASE WHEN e.action = 'claim' AND (r.status IS NULL OR r.status IN ('seen', 'failed')) THEN 1 ELSE 0 END
    FROM r JOIN evn e ON e.job_full_name = r.job_full_name AND e.build_number = r.build_number AND e.rn = r.rn + 1
  ) SELECT * FROM r
), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_full_name, build_number ORDER BY rn DESC) AS k FROM rec) WHERE k = 1)
SELECT job_full_name, build_number,
       CASE WHEN status = 'processing' AND first_seen_at < TIMESTAMP '{STATE_NOW}' - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status,
       CAST(attempt_count AS INTEGER) AS attempt_count,
       CASE WHEN status = 'processing' AND first_seen_at < TIMESTAMP '{STATE_NOW}' - INTERVAL 30 MINUTE THEN 'stale processing reclaim' ELSE last_error END AS last_error,
       first_seen_at, processed_at, CAST(claims_granted AS INTEGER) AS claims_granted
FROM last WHERE status IS NOT NULL
"""


_Z3_SQL_PURGE = _Z3_SQL.replace("SELECT job_full_name, build_number,\n       CASE WHEN status = 'processing' AND first", ", folded AS (SELECT job_full_name, build_number,\n       CASE WHEN status = 'processing' AND first") + f""")
SELECT job_full_name, build_number, status, processed_at FROM folded
WHERE NOT (status = 'processed' AND processed_at IS NOT NULL AND processed_at < TIMESTAMP '{_dt.datetime(2024, 2, 10)}' - INTERVAL 30 DAY)"""


RETENTION_NOW = _dt.datetime(2024, 3, 1, 4)     # 60 days behind some sessions
PURGE_NOW = _dt.datetime(2026, 12, 31, 4)
STATE_PURGE_NOW = _dt.datetime(2024, 2, 10)


@register("z5_kept_messages", oracle=with_adapters(f"""
SELECT m.id, m.session_id FROM messages m JOIN sessions s ON s.id = m.session_id
WHERE m.created_at >= TIMESTAMP '{RETENTION_NOW}' - INTERVAL 90 DAY AND s.updated_at >= TIMESTAMP '{RETENTION_NOW}' - INTERVAL 60 DAY
""", "sessions", "messages"))
def z5_kept_messages(spark, sf_dir):
    """Retention at a time when some sessions are old: their messages go with them."""
    _, kept, _ = ST.retention(A.sessions(spark, sf_dir), A.messages(spark, sf_dir), RETENTION_NOW, session_days=60)
    return kept.select("id", "session_id")


@register("z5_purge_solutions", oracle=with_adapters(f"""
SELECT doc_id, created_at FROM solutions WHERE created_at >= TIMESTAMP '{PURGE_NOW}' - INTERVAL 1095 DAY""", "solutions"))
def z5_purge_solutions(spark, sf_dir):
    return ST.purge_solutions(A.solutions(spark, sf_dir), PURGE_NOW).select("doc_id", "created_at")


@register("z5_purge_state", oracle=with_adapters(_Z3_SQL_PURGE, "feed"))
def z5_purge_state(spark, sf_dir):
    """Processed builds go 30 days after their end, all others stay."""
    return ST.purge_state(z3_status_fold(spark, sf_dir), STATE_PURGE_NOW).select("job_full_name", "build_number", "status", "processed_at")


@register("z4_stale_reclaim", oracle=with_adapters(f"""
SELECT job_full_name, build_number,
       CASE WHEN status = 'processing' AND first_seen_at < TIMESTAMP '{STATE_NOW}' - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status,
       CASE WHEN status = 'processing' AND first_seen_at < TIMESTAMP '{STATE_NOW}' - INTERVAL 30 MINUTE THEN 'stale processing reclaim' END AS last_error
FROM ingest_state""", "ingest_state"))
def z4_stale_reclaim(spark, sf_dir):
    st = A.ingest_state(spark, sf_dir).withColumn("last_error", F.lit(None).cast("string"))
    return ST.reclaim_stale(st, STATE_NOW).select("job_full_name", "build_number", "status", "last_error")


@register("z3_status_fold", oracle=with_adapters(_Z3_SQL, "feed"))
def z3_status_fold(spark, sf_dir):
    """Claims and outcomes replayed per (job, build) from the failed-build feed."""
    fb = I.feed_builds(A.feed(spark, sf_dir))
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"]).withColumnRenamed("event_id", "item_id")
    x = fb.join(ev, "item_id")
    claims = x.select("job_full_name", "build_number", F.col("ts").cast("timestamp").alias("ts"), F.lit("claim").alias("action"),
                      F.lit(None).cast("string").alias("error"))
    outcome = x.select("job_full_name", "build_number", (F.col("ts").cast("timestamp") + F.make_interval(secs=F.lit(1))).alias("ts"),
                       F.when(F.col("item_id") % 3 == 0, F.lit("failed")).otherwise(F.lit("processed")).alias("action"),
                       F.when(F.col("item_id") % 3 == 0, F.lit("worker forward: unavailable")).alias("error"))
    return ST.status_fold(claims.unionByName(outcome), now=STATE_NOW)


@register("s8_touch_parents", oracle=with_adapters("""
SELECT s.id, greatest(s.updated_at, coalesce(m.last, s.updated_at)) AS updated_at
FROM sessions s LEFT JOIN (SELECT session_id, max(created_at) AS last FROM messages GROUP BY session_id) m ON s.id = m.session_id
""", "sessions", "messages"))
def s8_touch_parents(spark, sf_dir):
    return ST.touch_parents(A.sessions(spark, sf_dir), A.messages(spark, sf_dir)).select("id", "updated_at")


@register("s7_session_rows", oracle=with_adapters(f"""
SELECT sha256(id || '|' || job_full_name || '|' || CAST(build_number AS VARCHAR) || '|' || stage_name) AS id,
       job_full_name, build_number, stage_name, build_url, fingerprint, analysis, suggested_fix, filtered_logs, '' AS raw_logs,
       '' AS matched_solution, CAST(coalesce(match_score, 0) AS DOUBLE) AS match_score, coalesce(recommendation, '') AS recommendation,
       '[]' AS similar_past, coalesce(filter_meta, '{{}}') AS filter_meta, '' AS feedback_status, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at
FROM sessions""", "sessions"))
def s7_session_rows(spark, sf_dir):
    return ST.new_session_rows(A.sessions(spark, sf_dir), NOW, F.col("id"))


@register("z1_poll_stream", oracle=with_adapters(_FEED_BUILDS_SQL + """
SELECT job_full_name, build_number, build_url, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY job_full_name, build_number ORDER BY item_id) AS r FROM fb) WHERE r = 1
""", "feed"))
def z1_poll_stream(spark, sf_dir):
    """The feed replayed through Structured Streaming (availableNow) with keyed watermark state."""
    import uuid
    ev_schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = spark.readStream.schema(ev_schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    job = F.concat(F.lit("team » job-"), (F.col("user_id") % 20).cast("string"))
    build = (F.dayofmonth("ts") * 100 + F.hour("ts")).cast("string")
    feed = src.filter(F.col("event_type") == "error").select(
        F.concat(job, F.lit(" #"), build, F.lit(" (Failed)")).alias("title"),
        F.concat(F.lit("https://ci.example/job/team/job/job-"), (F.col("user_id") % 20).cast("string"), F.lit("/"), build, F.lit("//")).alias("link"),
        F.col("event_id").alias("item_id"))
    out = POLL.new_failures(feed)
    base = f"{checkpoint_dir(spark).rstrip('/')}/poll-{uuid.uuid4().hex}"
    q = (out.writeStream.outputMode("append").foreachBatch(POLL.forward_batch(f"{base}/out"))
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(POLL.OUT_SCHEMA).parquet(f"{base}/out/epoch=*")


@register("z6_claimed_builds", oracle=with_adapters(_FEED_BUILDS_SQL + """
, f AS (SELECT job_full_name, build_number, item_id, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END AS poll FROM fb WHERE build_number > 0),
p1 AS (SELECT job_full_name, build_number, min(item_id) AS item_id FROM f WHERE poll = 1 GROUP BY ALL),
wm AS (SELECT job_full_name, max(build_number) AS top FROM p1 WHERE item_id % 3 <> 0 GROUP BY ALL),
p2 AS (SELECT f.job_full_name, f.build_number, min(item_id) AS item_id FROM f LEFT JOIN wm ON wm.job_full_name = f.job_full_name
       WHERE poll = 2 AND f.build_number > coalesce(top, 0) GROUP BY ALL)
SELECT 1 AS poll, job_full_name, build_number, item_id, 0 AS attempts FROM p1
UNION ALL
SELECT 2, p2.job_full_name, p2.build_number, p2.item_id, CASE WHEN p1.item_id IS NULL THEN 0 ELSE 1 END
FROM p2 LEFT JOIN p1 ON p1.job_full_name = p2.job_full_name AND p1.build_number = p2.build_number
""", "feed"))
def z6_claimed_builds(spark, sf_dir):
    """Two polls of the feed (even, then odd items); every third item's forwarding fails, one by one.

    The second poll restarts from the first one's checkpoint: builds at or below a job's highest processed one
    vanish, failed ones are claimed again.
    """
    import uuid
    base = f"{checkpoint_dir(spark).rstrip('/')}/claims-{uuid.uuid4().hex}"
    items = I.feed_builds(A.feed(spark, sf_dir)).select("job_full_name", F.col("build_number").cast("int").alias("build_number"), "build_url",
                                                        F.col("item_id").cast("long").alias("item_id"))
    failing = F.when(F.col("item_id") % 3 == 0, F.lit("unavailable"))
    sink = CL.forward(f"{base}/claims", f"{base}/outcomes", lambda d: d.withColumn("error", failing), send_batch=False)
    # a first, empty outcome folder: the stream's pattern must match something
    spark.createDataFrame([], CL.OUTCOME).write.parquet(f"{base}/outcomes/none")
    for poll in (1, 2):
        ts = F.lit(_dt.datetime(2024, 1, 1, poll)).cast("timestamp")
        items.filter(F.col("item_id") % 2 == poll - 1).withColumn("ts", ts).write.parquet(f"{base}/feed/{poll}")
        CL.poll_once(spark, f"{base}/feed", f"{base}/outcomes", f"{base}/state", sink)
    claimed = spark.read.schema(CL.CLAIM).parquet(f"{base}/claims/*")
    return claimed.select(F.hour("ts").cast("int").alias("poll"), "job_full_name", "build_number", "item_id", "attempts")
