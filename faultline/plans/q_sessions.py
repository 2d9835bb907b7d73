"""Session analytics queries over the ``sessions`` / ``solutions`` / ``messages`` adapters."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources import adapters as A
from ..sources.adapters import with_adapters
from .catalog import register
from .oracle import q

NOW = _dt.datetime(2024, 1, 17, 15, 30, 0)
NOW_SQL = "TIMESTAMP '2024-01-17 15:30:00'"

_ERR_SQL = "substr(coalesce(" + ", ".join(
    f"nullif(regexp_extract(coalesce({f}, ''), {q(rx)}, 1), '')"
    for f in S.ERR_CLASS_FIELDS for rx in (S.ERR_CLASS_TYPED, S.ERR_CLASS_GENERIC)
) + ", 'UnknownError'), 1, 80)"

_ITEMS_SQL = f""", items AS (
  SELECT id AS run_id, coalesce(job_full_name, '') AS job_full_name, coalesce(build_number, 0) AS build_number,
         coalesce(stage_name, '') AS stage_name, {_ERR_SQL} AS error_class,
         substr(coalesce(fingerprint, ''), 1, 500) AS signature, coalesce(filtered_logs, '') AS cleaned_log,
         coalesce(nullif(recommendation, ''), 'session') AS source, created_at AS timestamp,
         coalesce(analysis, '') AS analysis, coalesce(suggested_fix, '') AS suggested_fix,
         coalesce(nullif(feedback_status, ''), 'new') AS feedback_status, timestamp_text
  FROM sessions
)
"""
_FB_SQL = "CASE lower(coalesce(nullif(feedback_status, ''), 'new')) WHEN 'accepted' THEN 'accepted' WHEN 'rejected' THEN 'rejected' ELSE 'new' END"


def _items(spark, sf_dir):
    return S.result_items(A.sessions(spark, sf_dir), keep=("timestamp_text",))


def _sql(body: str, *adapters: str) -> str:
    return with_adapters(body, *adapters)


@register("p6_result_items", oracle=_sql(_ITEMS_SQL + "SELECT * EXCLUDE (timestamp_text) FROM items", "sessions"))
def p6_result_items(spark, sf_dir):
    return _items(spark, sf_dir).drop("timestamp_text")


@register("x19_error_class", oracle=_sql(_ITEMS_SQL + "SELECT error_class, CAST(count(*) AS BIGINT) AS n FROM items GROUP BY error_class", "sessions"))
def x19_error_class(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


@register("p1_scope_filter", oracle=_sql(_ITEMS_SQL + f"""
SELECT run_id, job_full_name, stage_name, error_class, feedback_status, timestamp FROM items
WHERE (timestamp IS NULL OR (timestamp >= date_trunc('week', {NOW_SQL}) AND timestamp <= {NOW_SQL}))
  AND {_FB_SQL.replace('feedback_status', 'feedback_status')} = 'accepted'
  AND strpos(lower(concat_ws(' ', job_full_name, stage_name, error_class, signature)), 'svc3') > 0
""", "sessions"))
def p1_scope_filter(spark, sf_dir):
    out = S.scope_filter(_items(spark, sf_dir), search="  SVC3 ", preset="thisWeek", feedback="accepted", now=NOW)
    return out.select("run_id", "job_full_name", "stage_name", "error_class", "feedback_status", "timestamp")


_PRESETS = ("today", "yesterday", "thisWeek", "lastWeek")


@register("p2_date_presets", oracle=_sql(f"""
SELECT preset, n FROM (
  SELECT CAST(count(*) FILTER (WHERE created_at >= date_trunc('day', {NOW_SQL}) AND created_at <= {NOW_SQL}) AS BIGINT) AS today,
         CAST(count(*) FILTER (WHERE created_at >= date_trunc('day', {NOW_SQL}) - INTERVAL 1 DAY AND created_at <= date_trunc('day', {NOW_SQL})) AS BIGINT) AS yesterday,
         CAST(count(*) FILTER (WHERE created_at >= date_trunc('week', {NOW_SQL}) AND created_at <= {NOW_SQL}) AS BIGINT) AS thisWeek,
         CAST(count(*) FILTER (WHERE created_at >= date_trunc('week', {NOW_SQL}) - INTERVAL 7 DAY AND created_at <= date_trunc('week', {NOW_SQL})) AS BIGINT) AS lastWeek
  FROM sessions
) UNPIVOT (n FOR preset IN (today, yesterday, thisWeek, lastWeek))
""", "sessions"))
def p2_date_presets(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    aggs = []
    for p in _PRESETS:
        start, end = S.date_range(p, NOW)
        aggs.append(F.count_if(S.within_range(F.col("created_at"), start, end) & F.col("created_at").isNotNull()).alias(p))
    wide = s.agg(*aggs)
    return wide.unpivot([], list(_PRESETS), "preset", "n")


@register("p3_within_range", oracle=_sql("""
SELECT id, timestamp_text FROM sessions
WHERE try_strptime(timestamp_text, '%Y-%m-%d %H:%M:%S') IS NULL
   OR (try_strptime(timestamp_text, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '2024-01-05 00:00:00'
       AND try_strptime(timestamp_text, '%Y-%m-%d %H:%M:%S') <= TIMESTAMP '2024-01-12 23:59:59.999')
""", "sessions"))
def p3_within_range(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    start, end = S.date_range("custom", NOW, "2024-01-05", "2024-01-12")
    ts = F.try_to_timestamp(F.col("timestamp_text"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return s.filter(S.within_range(ts, start, end)).select("id", "timestamp_text")


@register("p4_feedback_normalise", oracle=_sql(f"""
SELECT {_FB_SQL} AS feedback, CAST(count(*) AS BIGINT) AS n FROM sessions GROUP BY 1
""", "sessions"))
def p4_feedback_normalise(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    return s.groupBy(S.normalise_feedback(F.col("feedback_status")).alias("feedback")).agg(F.count(F.lit(1)).alias("n"))


@register("p5_error_class_filter", oracle=_sql(_ITEMS_SQL + """
SELECT run_id, error_class FROM items WHERE lower(error_class) = 'svc3exception'
UNION ALL
SELECT run_id, error_class FROM items WHERE error_class = 'AssertionError'
""", "sessions"))
def p5_error_class_filter(spark, sf_dir):
    items = _items(spark, sf_dir)
    api = S.error_class_filter(items, "  SVC3Exception ")
    client = S.error_class_filter(items, "AssertionError", exact=True)
    return api.select("run_id", "error_class").unionByName(client.select("run_id", "error_class"))


_TEL_SQL = """
SELECT id AS run_id,
       nullif(upper(coalesce(json_extract_string(filter_meta, '$.confidence'), '')), '') AS confidence,
       nullif(array_to_string(list_filter(CAST(json_extract(filter_meta, '$.activated_detectors') AS VARCHAR[]), lambda x: x IS NOT NULL AND x <> ''), ','), '') AS activated_detectors,
       CAST(json_extract(filter_meta, '$.raw_chars') AS BIGINT) AS raw_chars,
       CAST(json_extract(filter_meta, '$.body_chars') AS BIGINT) AS body_chars,
       CAST(json_extract(filter_meta, '$.body_tokens') AS BIGINT) AS body_tokens,
       CAST(json_extract(filter_meta, '$.selected_count') AS BIGINT) AS selected_count,
       nullif(json_extract_string(filter_meta, '$.baseline_version'), '') AS baseline_version,
       CASE WHEN json_type(filter_meta, '$.primary_location') = 'OBJECT' THEN CAST(json_extract(filter_meta, '$.primary_location') AS VARCHAR) END AS primary_location,
       CASE WHEN json_type(filter_meta, '$.collapse_stats') = 'OBJECT' AND len(json_keys(filter_meta, '$.collapse_stats')) > 0
            THEN CAST(json_extract(filter_meta, '$.collapse_stats') AS VARCHAR) END AS collapse_stats
FROM sessions
"""


@register("p7_telemetry", oracle=_sql(_TEL_SQL, "sessions"))
def p7_telemetry(spark, sf_dir):
    return S.telemetry(A.sessions(spark, sf_dir))


@register("a1_feedback_totals", oracle=_sql("""
SELECT lower(coalesce(nullif(feedback_status, ''), 'new')) AS status, CAST(count(*) AS BIGINT) AS count FROM sessions GROUP BY 1
""", "sessions"))
def a1_feedback_totals(spark, sf_dir):
    return S.feedback_totals(A.sessions(spark, sf_dir))


@register("a2_fingerprint_sessions", oracle=_sql("""
SELECT fingerprint, CAST(count(*) AS BIGINT) AS total FROM sessions WHERE fingerprint <> '' GROUP BY fingerprint
""", "sessions"))
def a2_fingerprint_sessions(spark, sf_dir):
    return S.fingerprint_counts(A.sessions(spark, sf_dir))


@register("a3_reuse_summary", oracle=_sql("""
SELECT CAST(count(*) FILTER (WHERE feedback_status = 'accepted') AS BIGINT) AS accepted_sessions,
       CAST(count(*) FILTER (WHERE recommendation = 'verified_past_solution') AS BIGINT) AS matched_sessions,
       CAST(count(*) AS BIGINT) AS total_sessions
FROM sessions
""", "sessions"))
def a3_reuse_summary(spark, sf_dir):
    return S.reuse_summary(A.sessions(spark, sf_dir))


@register("a4_coverage", oracle=_sql("""
, r AS (
  SELECT CAST(count(*) FILTER (WHERE feedback_status = 'accepted') AS BIGINT) AS accepted_sessions,
         CAST(count(*) FILTER (WHERE recommendation = 'verified_past_solution') AS BIGINT) AS matched_sessions,
         CAST(count(*) AS BIGINT) AS total_sessions,
         (SELECT CAST(count(*) AS BIGINT) FROM solutions) AS total_solutions
  FROM sessions
)
SELECT accepted_sessions, matched_sessions, total_sessions, total_solutions,
       round(least(1.0, CASE WHEN accepted_sessions > 0 THEN total_solutions / accepted_sessions ELSE 0.0 END), 3) AS kb_coverage,
       CASE WHEN total_sessions > 0 THEN CAST(round(matched_sessions / total_sessions * 100) AS BIGINT) END AS reuse_rate_pct
FROM r
""", "sessions", "solutions"))
def a4_coverage(spark, sf_dir):
    return S.coverage(A.sessions(spark, sf_dir), A.solutions(spark, sf_dir))


@register("a5_error_class_histogram", oracle=_sql(_ITEMS_SQL + """
SELECT error_class, CAST(count(*) AS BIGINT) AS count FROM items GROUP BY error_class
""", "sessions"))
def a5_error_class_histogram(spark, sf_dir):
    return S.error_class_histogram(A.sessions(spark, sf_dir))


@register("a6_scoped_metrics", oracle=_sql(_ITEMS_SQL + f"""
, scoped AS (
  SELECT coalesce(nullif(error_class, ''), 'Unknown') AS error_class, {_FB_SQL} AS fb FROM items
  WHERE timestamp IS NULL OR (timestamp >= date_trunc('week', {NOW_SQL}) - INTERVAL 7 DAY AND timestamp <= date_trunc('week', {NOW_SQL}))
)
SELECT CASE WHEN grouping(error_class) = 1 THEN 'total' ELSE 'class' END AS scope,
       CASE WHEN grouping(error_class) = 1 THEN NULL ELSE error_class END AS error_class,
       CAST(count(*) AS BIGINT) AS count,
       CAST(count(*) FILTER (WHERE fb = 'accepted') AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE fb = 'rejected') AS BIGINT) AS rejected,
       CAST(greatest(0, count(*) - count(*) FILTER (WHERE fb = 'accepted') - count(*) FILTER (WHERE fb = 'rejected')) AS BIGINT) AS unresolved
FROM scoped GROUP BY ROLLUP (error_class)
""", "sessions"))
def a6_scoped_metrics(spark, sf_dir):
    scoped = S.scope_filter(_items(spark, sf_dir), preset="lastWeek", now=NOW)
    return S.scoped_metrics(scoped)


@register("a7_group_by_build", oracle=_sql(_ITEMS_SQL + """
SELECT job_full_name, build_number,
       max(timestamp) OVER (PARTITION BY job_full_name, build_number) AS latest_ts,
       CAST(row_number() OVER (PARTITION BY job_full_name, build_number ORDER BY timestamp DESC, stage_name, run_id) AS INTEGER) AS stage_pos,
       stage_name, run_id, timestamp
FROM items
""", "sessions"))
def a7_group_by_build(spark, sf_dir):
    return S.group_by_build(_items(spark, sf_dir))


@register("a8_noisiest_top5", oracle=_sql(_ITEMS_SQL + """
SELECT key, count FROM (
  SELECT job_full_name || ' / ' || coalesce(nullif(stage_name, ''), 'unknown-stage') AS key, CAST(count(*) AS BIGINT) AS count, max(timestamp) AS last
  FROM items GROUP BY 1
) ORDER BY count DESC, last DESC, key LIMIT 5
""", "sessions"))
def a8_noisiest_top5(spark, sf_dir):
    return S.noisiest(_items(spark, sf_dir))


@register("s10_corpus_scan", oracle=_sql("""
SELECT doc_id, fingerprint_text, solution, job_name, stage_name, build_number, solution_score, created_at
FROM solutions ORDER BY created_at DESC, doc_id DESC
""", "solutions"))
def s10_corpus_scan(spark, sf_dir):
    return S.corpus_scan(A.solutions(spark, sf_dir))


@register("s11_point_lookup", oracle=_sql("SELECT * FROM sessions WHERE id = 'run-42'", "sessions"))
def s11_point_lookup(spark, sf_dir):
    return S.fetch_session(A.sessions(spark, sf_dir), "run-42")


@register("s12_recent_sessions", oracle=_sql("""
SELECT id, job_full_name, build_number, stage_name, feedback_status, created_at FROM sessions
ORDER BY created_at DESC, id DESC LIMIT 50
""", "sessions"))
def s12_recent_sessions(spark, sf_dir):
    return S.recent_sessions(A.sessions(spark, sf_dir))


@register("s13_session_records", oracle=_sql("""
SELECT id, job_full_name, build_number, stage_name, fingerprint, filtered_logs, analysis, suggested_fix,
       recommendation, feedback_status, filter_meta, created_at
FROM sessions WHERE job_full_name ILIKE '%JOB-1%' ORDER BY created_at DESC, id DESC LIMIT 50
""", "sessions"))
def s13_session_records(spark, sf_dir):
    return S.session_records(A.sessions(spark, sf_dir), limit=50, job="JOB-1")


@register("s14_session_messages", oracle=_sql("""
SELECT id, role, content, created_at FROM messages WHERE session_id = 'run-7' ORDER BY created_at, id
""", "messages"))
def s14_session_messages(spark, sf_dir):
    return S.session_messages(A.messages(spark, sf_dir), "run-7")
