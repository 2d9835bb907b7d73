"""Derived inputs built from the driver tables.

The driver tables hold no CI data, so each reference entity is derived from one
of them with a fixed rule. Every adapter exists twice with the same meaning: as a
DataFrame plan here and as SQL text in ``ADAPTER_SQL`` (used by the DuckDB
oracle). Work grows with the tables: nothing is sampled or capped.

``log_lines``: one log line per event. A user's events, ordered by time, form
that user's log, whole. Lines are numbered in two levels (within a user's day, then
by the line counts of the days before), so a very hot user is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """``_seq``: 0-based place of each row among its user's rows by ``ts`` and ``order``."""
    df = df.withColumn("_day", F.to_date("ts"))
    days = df.groupBy("user_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("user_id", "_day", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("user_id", "_day").orderBy("ts", *order)) - 1
    return df.withColumn("_in", place).join(days, ["user_id", "_day"]).withColumn("_seq", F.col("_in") + F.col("_before"))


def _k() -> Column:
    return F.col("event_id") % 100


def event_log_line() -> Column:
    """The raw log line of one event (see ``log_lines``)."""
    k = _k()
    body = (
        F.when((F.col("event_type") == "view") & (k < 10), F.lit("----------------"))
        .when((F.col("event_type") == "view") & (k < 20),
              F.concat(F.lit("\tat com.acme.Step"), (k % 3).cast("string"), F.lit(".run(Step.java:"), k.cast("string"), F.lit(")")))
        .when((F.col("event_type") == "view") & (k < 25), F.concat(F.lit('{"step": '), k.cast("string"), F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit("INFO step "), k.cast("string"), F.lit(" ok")))
        .when(F.col("event_type") == "click", F.concat(F.lit("+ run task-"), k.cast("string")))
        .when(F.col("event_type") == "purchase",
              F.concat(F.lit("WARN endpoint=http://svc-"), (k % 5).cast("string"), F.lit("/health 50"), (k % 4).cast("string")))
        .when(F.col("event_type") == "signup",
              F.concat(F.lit("Downloading chunk "), k.cast("string"), F.lit(" of /tmp/a/"), k.cast("string"), F.lit(" 12MB")))
        .when(k % 4 == 0, F.concat(F.lit("script returned exit code "), (k % 3 + 1).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("Caused by: com.acme.Svc"), (k % 7).cast("string"), F.lit("Exception: code "), k.cast("string")))
        .otherwise(F.concat(F.lit("ERROR com.acme.Svc"), (k % 7).cast("string"), F.lit("Exception: code "), k.cast("string")))
    )
    stamped = F.col("event_type").isin("error", "purchase")
    return F.when(stamped, F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), body)).otherwise(body)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    raw = event_log_line()
    df = _numbered(ev.select("user_id", "event_id", "ts", raw.alias("raw")), "event_id")
    return df.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("log_id"), F.col("_seq").cast("int").alias("idx"), "raw")


def payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload corpus: every event's properties pretty-printed as a 6-line JSON block."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    block = F.array(
        F.lit("{"),
        F.format_string('  "event": %d,', F.col("event_id")),
        F.format_string('  "k": %d,', F.col("event_id") % 100),
        F.format_string('  "type": "%s",', F.col("event_type")),
        F.format_string('  "value": %.2f', F.col("value")),
        F.lit("}"),
    )
    df = ev.select("user_id", "ts", "event_id", F.posexplode(block).alias("pos", "raw"))
    df = _numbered(df, "event_id", "pos")
    return df.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("log_id"), F.col("_seq").cast("int").alias("idx"), "raw")


def stack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack-trace corpus: every error event becomes an exception line, an optional cause
    line and 3-8 Java frames (every third one a JDK frame), in the user's event order."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"]).filter(F.col("event_type") == "error")
    k = _k()
    head = F.array(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] ERROR com.acme.Svc"),
                            (k % 7).cast("string"), F.lit("Exception: code "), k.cast("string")))
    cause = F.when(k % 2 == 0, F.array(F.concat(F.lit("Caused by: java.io.IOException: disk "), (k % 5).cast("string")))).otherwise(
        F.array().cast("array<string>"))
    frames = F.transform(F.sequence(F.lit(0), (k % 6 + 2).cast("int")), lambda j: F.when(
        j % 3 == 1, F.concat(F.lit("\tat java.base/java.lang.Thread.run(Thread.java:"), j.cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("\tat com.acme.svc"), (k % 7).cast("string"), F.lit(".Worker"), j.cast("string"), F.lit(".call(Worker"),
                 j.cast("string"), F.lit(".java:"), (j + 10).cast("string"), F.lit(")"))))
    df = ev.select("user_id", "ts", "event_id", F.posexplode(F.concat(head, cause, frames)).alias("pos", "raw"))
    df = _numbered(df, "event_id", "pos")
    return df.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("log_id"), F.col("_seq").cast("int").alias("idx"), "raw")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analysis_sessions rows, one per event."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    e, k, et = F.col("event_id"), _k(), F.col("event_type")
    es = lambda c: c.cast("string")
    job = F.concat(F.lit("team/job-"), es(F.col("user_id") % 20))
    fingerprint = (
        F.when(k % 11 == 0, F.lit(""))
        .when(et == "view", F.concat(F.lit("build failed at step "), es(k)))
        .otherwise(F.concat(F.lit("exceptions: Svc"), es(e % 7), F.lit("Exception / stage: "), et))
    )
    analysis = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("The AssertionError in step "), es(k), F.lit(" broke the run")))
    fix = F.concat(F.lit("Retry task-"), es(k % 9))
    filtered = F.concat(F.lit("L"), es(k), F.lit(": ERROR something fatal happened"))
    feedback = (F.when(e % 5 == 0, F.lit("accepted")).when(e % 5 == 1, F.lit("rejected"))
                .when(e % 5 == 2, F.lit("")).when(e % 5 == 3, F.lit("new")))
    recommendation = (F.when(e % 4 == 0, F.lit("verified_past_solution")).when(e % 4 == 1, F.lit("fresh_analysis"))
                      .when(e % 4 == 2, F.lit("")))
    meta = F.when(k % 6 == 5, F.lit(None).cast("string")).otherwise(F.concat(
        F.lit('{"confidence":"'), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit("")), (k % 4 + 1).cast("int")),
        F.lit('","activated_detectors":["generic_shell",""'), F.when(k % 2 == 0, F.lit(',"java_stack"')).otherwise(F.lit("")),
        F.lit('],"raw_chars":'), es(k * 100), F.lit(',"body_chars":'), es(k * 10),
        F.lit(',"body_tokens":'), es(k * 3), F.lit(',"selected_count":'), es(k % 9),
        F.lit(',"baseline_version":"'), F.when(k % 2 == 0, F.lit("self/0.30/1")).otherwise(F.lit("")),
        F.lit('","primary_location":'),
        F.when(k % 3 == 0, F.concat(F.lit('{"kind":"source","file":"A'), es(k), F.lit('.java","line":7}')))
        .when(k % 3 == 1, F.lit("null")).otherwise(F.lit('"none"')),
        F.lit(',"collapse_stats":'), F.when(k % 4 == 0, F.concat(F.lit('{"banner":'), es(k), F.lit("}"))).otherwise(F.lit("{}")),
        F.lit(',"unknown_field":1}')))
    return ev.select(
        F.concat(F.lit("run-"), es(e)).alias("id"),
        job.alias("job_full_name"),
        F.dayofmonth("ts").cast("int").alias("build_number"),
        F.when(k % 13 == 0, F.lit("")).otherwise(et).alias("stage_name"),
        F.concat(F.lit("https://ci.example/job/job-"), es(F.col("user_id") % 20), F.lit("/"), es(F.dayofmonth("ts")), F.lit("/")).alias("build_url"),
        fingerprint.alias("fingerprint"),
        analysis.alias("analysis"),
        fix.alias("suggested_fix"),
        filtered.alias("filtered_logs"),
        F.round(F.col("value") / 50.0, 4).alias("match_score"),
        recommendation.alias("recommendation"),
        feedback.alias("feedback_status"),
        meta.alias("filter_meta"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("ts").cast("timestamp") + F.make_interval(mins=k.cast("int"))).alias("updated_at"),
        F.when(k % 17 == 0, F.lit("not-a-date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp_text"),
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline stage rows: one build per user and day, one stage per event."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return ev.select(
        F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("build_key"),
        (F.col("event_id") * 10).alias("stage_id"),
        F.concat(F.lit("stage-"), F.col("event_type")).alias("name"),
        F.when(F.col("event_type") == "error", F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"),
        F.floor(F.col("value") * 600000).cast("bigint").alias("duration_ms"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-node parallel markers: a block opens before each signup stage, closes before each purchase stage."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return ev.filter(F.col("event_type").isin("signup", "purchase")).select(
        F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("build_key"),
        (F.col("event_id") * 10 - 1).alias("node_id"),
        F.when(F.col("event_type") == "signup", F.lit("start")).otherwise(F.lit("end")).alias("kind"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed-build feed items: one per error event (duplicates per build kept)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    job = F.concat(F.lit("team » job-"), (F.col("user_id") % 20).cast("string"))
    build = (F.dayofmonth("ts") * 100 + F.hour("ts")).cast("string")
    return ev.filter(F.col("event_type") == "error").select(
        F.concat(job, F.lit(" #"), build, F.lit(" (Failed)")).alias("title"),
        F.concat(F.lit("https://ci.example/job/team/job/job-"), (F.col("user_id") % 20).cast("string"), F.lit("/"), build, F.lit("//")).alias("link"),
        F.col("event_id").alias("item_id"),
    )


def ingest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest-state rows: builds already known, one per (job, build) of click events."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    k = _k()
    status = (F.when(k % 4 == 0, F.lit("seen")).when(k % 4 == 1, F.lit("processing"))
              .when(k % 4 == 2, F.lit("processed")).otherwise(F.lit("failed")))
    rows = ev.filter(F.col("event_type") == "click").select(
        F.concat(F.lit("team/job-"), (F.col("user_id") % 20).cast("string")).alias("job_full_name"),
        (F.dayofmonth("ts") * 100 + F.hour("ts")).cast("int").alias("build_number"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("first_seen_at"),
        F.col("event_id"),
    )
    w = Window.partitionBy("job_full_name", "build_number").orderBy("event_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "event_id")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback decisions: one per session a minute after it, a contrary second one for every third."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    first = ev.select(F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("session_id"),
                      F.when(F.col("event_id") % 2 == 0, F.lit("Accept")).otherwise(F.lit("reject ")).alias("decision"),
                      (F.col("ts").cast("timestamp") + F.make_interval(mins=F.lit(1))).alias("ts"))
    second = ev.filter(F.col("event_id") % 3 == 0).select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("session_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("reject")).otherwise(F.lit("accept")).alias("decision"),
        (F.col("ts").cast("timestamp") + F.make_interval(mins=F.lit(2))).alias("ts"))
    return first.unionByName(second)


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored solutions with their fingerprint vectors (from ``embeddings``)."""
    em = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    v = F.col("vec_id")
    return em.select(
        F.concat(F.lit("sol-"), v.cast("string")).alias("doc_id"),
        F.when(v % 5 == 0, F.concat(F.lit("exceptions: Svc"), (v % 7).cast("string"), F.lit("Exception / stage: "),     # as sessions have it
                                    F.element_at(F.array(*map(F.lit, ("click", "error", "purchase", "signup"))), (v % 4 + 1).cast("int"))))
        .otherwise(F.concat(F.lit("exceptions: E"), F.col("label").cast("string"), F.lit("Error / stage: stage-"), (v % 3).cast("string"))).alias("fingerprint_text"),
        F.concat(F.lit("Fix for E"), F.col("label").cast("string")).alias("solution"),
        F.concat(F.lit("job-"), (v % 10).cast("string")).alias("job_name"),
        F.concat(F.lit("stage-"), (v % 3).cast("string")).alias("stage_name"),
        (v % 50).cast("int").alias("build_number"),
        (F.lit(1.0) - F.lit(0.1) * (v % 3)).alias("solution_score"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=v.cast("int"))).alias("created_at"),
        F.col("embedding").alias("vector"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_messages rows from ``conversations`` (one session per conversation)."""
    cv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return cv.select(
        F.concat(F.lit("m-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("session_id"),
        "role",
        F.col("text").alias("content"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("turn").cast("int"))).alias("created_at"),
    )


# ── Same adapters as SQL (DuckDB oracle) ─────────────────────────────────────

EVENT_BODY_SQL = r"""CASE
             WHEN event_type = 'view' AND event_id % 100 < 10 THEN '----------------'
             WHEN event_type = 'view' AND event_id % 100 < 20 THEN chr(9) || 'at com.acme.Step' || CAST(event_id % 100 % 3 AS VARCHAR) || '.run(Step.java:' || CAST(event_id % 100 AS VARCHAR) || ')'
             WHEN event_type = 'view' AND event_id % 100 < 25 THEN '{"step": ' || CAST(event_id % 100 AS VARCHAR) || '}'
             WHEN event_type = 'view' THEN 'INFO step ' || CAST(event_id % 100 AS VARCHAR) || ' ok'
             WHEN event_type = 'click' THEN '+ run task-' || CAST(event_id % 100 AS VARCHAR)
             WHEN event_type = 'purchase' THEN 'WARN endpoint=http://svc-' || CAST(event_id % 100 % 5 AS VARCHAR) || '/health 50' || CAST(event_id % 100 % 4 AS VARCHAR)
             WHEN event_type = 'signup' THEN 'Downloading chunk ' || CAST(event_id % 100 AS VARCHAR) || ' of /tmp/a/' || CAST(event_id % 100 AS VARCHAR) || ' 12MB'
             WHEN event_id % 100 % 4 = 0 THEN 'script returned exit code ' || CAST(event_id % 100 % 3 + 1 AS VARCHAR)
             WHEN event_id % 100 % 4 = 1 THEN 'Caused by: com.acme.Svc' || CAST(event_id % 100 % 7 AS VARCHAR) || 'Exception: code ' || CAST(event_id % 100 AS VARCHAR)
             ELSE 'ERROR com.acme.Svc' || CAST(event_id % 100 % 7 AS VARCHAR) || 'Exception: code ' || CAST(event_id % 100 AS VARCHAR)
           END"""
EVENT_LINE_SQL = ("CASE WHEN event_type IN ('error','purchase') THEN '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' ELSE '' END || "
                  + EVENT_BODY_SQL)

ADAPTER_SQL = {
    "log_lines": r"""
log_lines AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS log_id, CAST(seq AS INTEGER) AS idx,
         CASE WHEN event_type IN ('error','purchase') THEN '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || body ELSE body END AS raw
  FROM (
    SELECT user_id, event_type, ts,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
           {EVENT_BODY} AS body
    FROM events
  )
)""".replace("{EVENT_BODY}", EVENT_BODY_SQL),
    "payload_lines": r"""
payload_lines AS (
  SELECT 'p' || CAST(user_id AS VARCHAR) AS log_id, CAST(seq AS INTEGER) AS idx, raw
  FROM (
    SELECT user_id, raw, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, pos) - 1 AS seq FROM (
      SELECT user_id, ts, event_id,
             unnest(['{', printf('  "event": %d,', event_id), printf('  "k": %d,', event_id % 100),
                     printf('  "type": "%s",', event_type), printf('  "value": %.2f', value), '}']) AS raw,
             unnest(range(6)) AS pos
      FROM events
    )
  )
)""",
    "stack_lines": r"""
stack_lines AS (
  SELECT 's' || CAST(user_id AS VARCHAR) AS log_id, CAST(seq AS INTEGER) AS idx, raw
  FROM (
    SELECT user_id, raw, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, pos) - 1 AS seq FROM (
      SELECT user_id, ts, event_id, unnest(arr) AS raw, unnest(range(len(arr))) AS pos FROM (
        SELECT user_id, ts, event_id, list_concat(
          ['[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ERROR com.acme.Svc' || CAST(event_id % 100 % 7 AS VARCHAR) || 'Exception: code ' || CAST(event_id % 100 AS VARCHAR)],
          CASE WHEN event_id % 100 % 2 = 0 THEN ['Caused by: java.io.IOException: disk ' || CAST(event_id % 100 % 5 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END,
          list_transform(range(CAST(event_id % 100 % 6 + 3 AS BIGINT)), lambda j:
            CASE WHEN j % 3 = 1 THEN chr(9) || 'at java.base/java.lang.Thread.run(Thread.java:' || CAST(j AS VARCHAR) || ')'
                 ELSE chr(9) || 'at com.acme.svc' || CAST(event_id % 100 % 7 AS VARCHAR) || '.Worker' || CAST(j AS VARCHAR) || '.call(Worker'
                      || CAST(j AS VARCHAR) || '.java:' || CAST(j + 10 AS VARCHAR) || ')' END)) AS arr
        FROM events WHERE event_type = 'error'
      )
    )
  )
)""",
    "sessions": r"""
sessions AS (
  SELECT 'run-' || CAST(event_id AS VARCHAR) AS id,
         'team/job-' || CAST(user_id % 20 AS VARCHAR) AS job_full_name,
         CAST(day(ts) AS INTEGER) AS build_number,
         CASE WHEN event_id % 100 % 13 = 0 THEN '' ELSE event_type END AS stage_name,
         'https://ci.example/job/job-' || CAST(user_id % 20 AS VARCHAR) || '/' || CAST(day(ts) AS VARCHAR) || '/' AS build_url,
         CASE WHEN event_id % 100 % 11 = 0 THEN ''
              WHEN event_type = 'view' THEN 'build failed at step ' || CAST(event_id % 100 AS VARCHAR)
              ELSE 'exceptions: Svc' || CAST(event_id % 7 AS VARCHAR) || 'Exception / stage: ' || event_type END AS fingerprint,
         CASE WHEN event_id % 100 % 3 = 0 THEN '' ELSE 'The AssertionError in step ' || CAST(event_id % 100 AS VARCHAR) || ' broke the run' END AS analysis,
         'Retry task-' || CAST(event_id % 100 % 9 AS VARCHAR) AS suggested_fix,
         'L' || CAST(event_id % 100 AS VARCHAR) || ': ERROR something fatal happened' AS filtered_logs,
         round(value / 50.0, 4) AS match_score,
         CASE event_id % 4 WHEN 0 THEN 'verified_past_solution' WHEN 1 THEN 'fresh_analysis' WHEN 2 THEN '' END AS recommendation,
         CASE event_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN '' WHEN 3 THEN 'new' END AS feedback_status,
         CASE WHEN event_id % 100 % 6 = 5 THEN NULL ELSE
           '{"confidence":"' || (['high','medium','low',''])[event_id % 100 % 4 + 1] ||
           '","activated_detectors":["generic_shell",""' || CASE WHEN event_id % 100 % 2 = 0 THEN ',"java_stack"' ELSE '' END ||
           '],"raw_chars":' || CAST(event_id % 100 * 100 AS VARCHAR) || ',"body_chars":' || CAST(event_id % 100 * 10 AS VARCHAR) ||
           ',"body_tokens":' || CAST(event_id % 100 * 3 AS VARCHAR) || ',"selected_count":' || CAST(event_id % 100 % 9 AS VARCHAR) ||
           ',"baseline_version":"' || CASE WHEN event_id % 100 % 2 = 0 THEN 'self/0.30/1' ELSE '' END || '","primary_location":' || CASE event_id % 100 % 3 WHEN 0 THEN '{"kind":"source","file":"A' || CAST(event_id % 100 AS VARCHAR) || '.java","line":7}'
               WHEN 1 THEN 'null' ELSE '"none"' END || ',"collapse_stats":' || CASE WHEN event_id % 100 % 4 = 0 THEN '{"banner":' || CAST(event_id % 100 AS VARCHAR) || '}' ELSE '{}' END ||
           ',"unknown_field":1}' END AS filter_meta,
         ts AS created_at,
         ts + to_minutes(CAST(event_id % 100 AS BIGINT)) AS updated_at,
         CASE WHEN event_id % 100 % 17 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp_text
  FROM events
)""",
    "stages": r"""
stages AS (
  SELECT 'b' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS build_key,
         event_id * 10 AS stage_id,
         'stage-' || event_type AS name,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         epoch_ms(ts) AS start_ms,
         CAST(floor(value * 600000) AS BIGINT) AS duration_ms
  FROM events
)""",
    "markers": r"""
markers AS (
  SELECT 'b' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS build_key, event_id * 10 - 1 AS node_id,
         CASE WHEN event_type = 'signup' THEN 'start' ELSE 'end' END AS kind
  FROM events WHERE event_type IN ('signup', 'purchase')
)""",
    "feed": r"""
feed AS (
  SELECT 'team » job-' || CAST(user_id % 20 AS VARCHAR) || ' #' || CAST(day(ts) * 100 + hour(ts) AS VARCHAR) || ' (Failed)' AS title,
         'https://ci.example/job/team/job/job-' || CAST(user_id % 20 AS VARCHAR) || '/' || CAST(day(ts) * 100 + hour(ts) AS VARCHAR) || '//' AS link,
         event_id AS item_id
  FROM events WHERE event_type = 'error'
)""",
    "ingest_state": r"""
ingest_state AS (
  SELECT job_full_name, build_number, status, first_seen_at FROM (
    SELECT 'team/job-' || CAST(user_id % 20 AS VARCHAR) AS job_full_name,
           CAST(day(ts) * 100 + hour(ts) AS INTEGER) AS build_number,
           CASE event_id % 100 % 4 WHEN 0 THEN 'seen' WHEN 1 THEN 'processing' WHEN 2 THEN 'processed' ELSE 'failed' END AS status,
           ts AS first_seen_at,
           row_number() OVER (PARTITION BY 'team/job-' || CAST(user_id % 20 AS VARCHAR), day(ts) * 100 + hour(ts) ORDER BY event_id) AS r
    FROM events WHERE event_type = 'click'
  ) WHERE r = 1
)""",
    "solutions": r"""
solutions AS (
  SELECT 'sol-' || CAST(vec_id AS VARCHAR) AS doc_id,
         CASE WHEN vec_id % 5 = 0 THEN 'exceptions: Svc' || CAST(vec_id % 7 AS VARCHAR) || 'Exception / stage: ' || (['click', 'error', 'purchase', 'signup'])[vec_id % 4 + 1]
              ELSE 'exceptions: E' || CAST(label AS VARCHAR) || 'Error / stage: stage-' || CAST(vec_id % 3 AS VARCHAR) END AS fingerprint_text,
         'Fix for E' || CAST(label AS VARCHAR) AS solution,
         'job-' || CAST(vec_id % 10 AS VARCHAR) AS job_name,
         'stage-' || CAST(vec_id % 3 AS VARCHAR) AS stage_name,
         CAST(vec_id % 50 AS INTEGER) AS build_number,
         CAST(1.0 AS DOUBLE) - CAST(0.1 AS DOUBLE) * (vec_id % 3) AS solution_score,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS created_at,
         embedding AS vector
  FROM embeddings
)""",
    "decisions": r"""
decisions AS (
  SELECT 'run-' || CAST(event_id AS VARCHAR) AS session_id, CASE WHEN event_id % 2 = 0 THEN 'Accept' ELSE 'reject ' END AS decision,
         ts + INTERVAL 1 MINUTE AS ts FROM events
  UNION ALL
  SELECT 'run-' || CAST(event_id AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN 'reject' ELSE 'accept' END, ts + INTERVAL 2 MINUTE
  FROM events WHERE event_id % 3 = 0
)""",
    "messages": r"""
messages AS (
  SELECT 'm-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
         'run-' || CAST(conv_id AS VARCHAR) AS session_id,
         role, text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS created_at
  FROM conversations
)""",
}


REPLIES_SQL = """
replies AS (
  SELECT conv_id, turn,
         CASE conv_id % 4 WHEN 0 THEN '## Exact match found' || chr(10) || chr(10) || 'Returning previously accepted fix (similarity 93%).' || chr(10) || chr(10)
                          WHEN 1 THEN repeat('Match with similarity ' || CAST(80 + turn AS VARCHAR) || '%' || chr(10) || chr(10), 8) ELSE '' END || text ||
         CASE conv_id % 3 WHEN 0 THEN chr(10) || '## Step-by-Step Fix' || chr(10) || 'Run task ' || CAST(turn AS VARCHAR)
                          WHEN 1 THEN chr(10) || '2. **Step by step fix**: retry' ELSE '' END AS text
  FROM conversations WHERE role = 'assistant'
)"""
ADAPTER_SQL["replies"] = REPLIES_SQL


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: assistant turns, some with announcing paragraphs before and a fix section after them."""
    cv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).filter(F.col("role") == "assistant")
    nl, turn = F.lit("\n"), F.col("turn").cast("string")
    many = F.repeat(F.concat(F.lit("Match with similarity "), (F.col("turn") + 80).cast("string"), F.lit("%\n\n")), 8)
    head = F.when(F.col("conv_id") % 4 == 0, F.lit("## Exact match found\n\nReturning previously accepted fix (similarity 93%).\n\n")).when(
        F.col("conv_id") % 4 == 1, many).otherwise(F.lit(""))
    tail = F.when(F.col("conv_id") % 3 == 0, F.concat(nl, F.lit("## Step-by-Step Fix\nRun task "), turn)).when(
        F.col("conv_id") % 3 == 1, F.lit("\n2. **Step by step fix**: retry")).otherwise(F.lit(""))
    return cv.select("conv_id", "turn", F.concat(head, F.col("text"), tail).alias("text"))


def with_adapters(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named adapter CTEs (DuckDB dialect)."""
    ctes = ",\n".join(ADAPTER_SQL[n].strip() for n in names)
    body = sql.strip()
    sep = "\n" if body.startswith(",") else "\n"
    return f"WITH {ctes}{sep}{body}"
