"""Session analytics: projections, predicates and aggregates.

All functions take and return DataFrames (or Columns); parameters that the
dashboard passes at request time (search text, preset, ``now``) are plain
Python arguments so Catalyst sees them as literals and pushes them down.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Error-class patterns of the dashboard variant (X19), in order.
ERR_CLASS_TYPED = r"\b([A-Za-z_][A-Za-z0-9_]*(?:Exception|Error|Failure))\b"
ERR_CLASS_GENERIC = r"(?i)\b(error|failed|fatal)\b"
ERR_CLASS_FIELDS = ("fingerprint", "analysis", "suggested_fix", "filtered_logs")
UNKNOWN_ERROR = "UnknownError"

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("confidence", T.StringType()),
    T.StructField("activated_detectors", T.ArrayType(T.StringType())),
    T.StructField("raw_chars", T.LongType()),
    T.StructField("body_chars", T.LongType()),
    T.StructField("body_tokens", T.LongType()),
    T.StructField("selected_count", T.LongType()),
    T.StructField("baseline_version", T.StringType()),
])


def error_class(*fields: str) -> Column:
    """First typed class, else generic keyword, scanning fields in order; 80 chars."""
    fields = fields or ERR_CLASS_FIELDS
    cands = []
    for f in fields:
        for rx in (ERR_CLASS_TYPED, ERR_CLASS_GENERIC):
            cands.append(F.nullif(F.regexp_extract(F.coalesce(F.col(f), F.lit("")), rx, 1), F.lit("")))
    return F.substring(F.coalesce(*cands, F.lit(UNKNOWN_ERROR)), 1, 80)


def normalise_feedback(c: Column) -> Column:
    """Accepted / rejected / everything else is new."""
    s = F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("new")))
    return F.when(s == "accepted", "accepted").when(s == "rejected", "rejected").otherwise("new")


def result_items(sessions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One dashboard result item per session (``keep``: extra columns carried through)."""
    return sessions.select(
        F.col("id").alias("run_id"),
        F.coalesce(F.col("job_full_name"), F.lit("")).alias("job_full_name"),
        F.coalesce(F.col("build_number"), F.lit(0)).alias("build_number"),
        F.coalesce(F.col("stage_name"), F.lit("")).alias("stage_name"),
        error_class().alias("error_class"),
        F.substring(F.coalesce(F.col("fingerprint"), F.lit("")), 1, 500).alias("signature"),
        F.coalesce(F.col("filtered_logs"), F.lit("")).alias("cleaned_log"),
        F.coalesce(F.nullif(F.col("recommendation"), F.lit("")), F.lit("session")).alias("source"),
        F.col("created_at").alias("timestamp"),
        F.coalesce(F.col("analysis"), F.lit("")).alias("analysis"),
        F.coalesce(F.col("suggested_fix"), F.lit("")).alias("suggested_fix"),
        F.coalesce(F.nullif(F.col("feedback_status"), F.lit("")), F.lit("new")).alias("feedback_status"),
        *keep,
    )


def telemetry(sessions: DataFrame, meta_col: str = "filter_meta") -> DataFrame:
    """The UI-facing subset of filter telemetry; missing or blank values become null."""
    m = F.from_json(F.col(meta_col), TELEMETRY_SCHEMA)
    dets = F.filter(F.coalesce(m["activated_detectors"], F.array().cast("array<string>")),
                    lambda x: x.isNotNull() & (x != ""))
    present = m.isNotNull()
    return sessions.select(
        F.col("id").alias("run_id"),
        F.nullif(F.upper(F.coalesce(m["confidence"], F.lit(""))), F.lit("")).alias("confidence"),
        F.nullif(F.array_join(dets, ","), F.lit("")).alias("activated_detectors"),
        F.when(present, F.coalesce(m["raw_chars"], F.lit(0))).alias("raw_chars"),
        F.when(present, F.coalesce(m["body_chars"], F.lit(0))).alias("body_chars"),
        F.when(present, F.coalesce(m["body_tokens"], F.lit(0))).alias("body_tokens"),
        F.when(present, F.coalesce(m["selected_count"], F.lit(0))).alias("selected_count"),
        F.nullif(m["baseline_version"], F.lit("")).alias("baseline_version"),
        _json_object(meta_col, "primary_location").alias("primary_location"),
        _json_object(meta_col, "collapse_stats").alias("collapse_stats"),
    )


def _json_object(col: str, field: str) -> Column:
    """A JSON object inside a JSON text, as text; null unless it is an object with members."""
    own = F.get_json_object(col, f"$.{field}")
    return F.when(own.startswith("{") & (own != "{}"), own)


def date_range(preset: str, now: _dt.datetime, date_from: str = "", date_to: str = "") -> tuple[Column | None, Column | None]:
    """(start, end) timestamps of a dashboard date preset; None = open bound."""
    n = F.lit(now).cast("timestamp")
    day = F.date_trunc("day", n)
    week = F.date_trunc("week", n)  # ISO week: Monday
    if preset == "today":
        return day, n
    if preset == "yesterday":
        return day - F.expr("INTERVAL 1 DAY"), day
    if preset == "thisWeek":
        return week, n
    if preset == "lastWeek":
        return week - F.expr("INTERVAL 7 DAYS"), week
    if preset == "custom":
        start = F.to_timestamp(F.lit(date_from), "yyyy-MM-dd") if date_from else None
        end = (F.to_timestamp(F.lit(date_to), "yyyy-MM-dd") + F.expr("INTERVAL 86399999 MILLISECONDS")) if date_to else None
        return start, end
    return None, None


def within_range(ts: Column, start: Column | None, end: Column | None) -> Column:
    """Closed interval, open where a bound is None; unparseable timestamps pass."""
    if start is None and end is None:
        return F.lit(True)
    t = ts
    cond = F.lit(True)
    if start is not None:
        cond = cond & (t >= start)
    if end is not None:
        cond = cond & (t <= end)
    return t.isNull() | cond


def scope_filter(items: DataFrame, search: str = "", preset: str = "all", feedback: str = "all",
                 now: _dt.datetime | None = None, date_from: str = "", date_to: str = "",
                 ts_col: str = "timestamp") -> DataFrame:
    """Date range AND feedback AND substring search over job, stage, class, signature."""
    start, end = date_range(preset, now or _dt.datetime(1970, 1, 1), date_from, date_to)
    cond = within_range(F.col(ts_col), start, end)
    if feedback != "all":
        cond = cond & (normalise_feedback(F.col("feedback_status")) == feedback)
    q = search.strip().lower()
    if q:
        hay = F.lower(F.concat_ws(" ", "job_full_name", "stage_name", "error_class", "signature"))
        cond = cond & hay.contains(q)
    return items.filter(cond)


def error_class_filter(items: DataFrame, wanted: str, exact: bool = False) -> DataFrame:
    """P5: exact (client) or trimmed case-insensitive (API) error-class match."""
    if exact:
        return items.filter(F.col("error_class") == F.lit(wanted))
    return items.filter(F.lower(F.col("error_class")) == F.lit(wanted.strip().lower()))


def feedback_totals(sessions: DataFrame) -> DataFrame:
    """A1: sessions by feedback status, blank counted as new."""
    st = F.coalesce(F.nullif(F.col("feedback_status"), F.lit("")), F.lit("new"))
    return sessions.groupBy(F.lower(st).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def fingerprint_counts(sessions: DataFrame) -> DataFrame:
    """A2: sessions per non-blank fingerprint."""
    return sessions.filter(F.col("fingerprint") != "").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("total"))


def reuse_summary(sessions: DataFrame) -> DataFrame:
    """A3: accepted, matched (verified past solution) and total sessions."""
    return sessions.agg(
        F.count_if(F.col("feedback_status") == "accepted").alias("accepted_sessions"),
        F.count_if(F.col("recommendation") == "verified_past_solution").alias("matched_sessions"),
        F.count(F.lit(1)).alias("total_sessions"),
    )


def coverage(sessions: DataFrame, solutions: DataFrame) -> DataFrame:
    """A4: knowledge-base coverage and reuse rate.

    Both inputs reduce to partial count rows that are unioned and summed, so the
    result is one aggregate with map-side combine and no join.
    """
    z = F.lit(0).cast("bigint")
    s = sessions.select(
        F.when(F.col("feedback_status") == "accepted", 1).otherwise(0).cast("bigint").alias("accepted_sessions"),
        F.when(F.col("recommendation") == "verified_past_solution", 1).otherwise(0).cast("bigint").alias("matched_sessions"),
        F.lit(1).cast("bigint").alias("total_sessions"), z.alias("total_solutions"))
    k = solutions.select(z.alias("accepted_sessions"), z.alias("matched_sessions"), z.alias("total_sessions"),
                         F.lit(1).cast("bigint").alias("total_solutions"))
    t = s.unionByName(k).agg(*[F.coalesce(F.sum(c), z).alias(c) for c in
                               ("accepted_sessions", "matched_sessions", "total_sessions", "total_solutions")])
    acc = F.col("accepted_sessions")
    cov = F.when(acc > 0, F.col("total_solutions") / acc).otherwise(F.lit(0.0))
    return t.select(
        "accepted_sessions", "matched_sessions", "total_sessions", "total_solutions",
        F.round(F.least(F.lit(1.0), cov), 3).alias("kb_coverage"),
        F.when(F.col("total_sessions") > 0,
               F.round(F.col("matched_sessions") / F.col("total_sessions") * 100).cast("bigint")).alias("reuse_rate_pct"),
    )


def newest(df: DataFrame, n: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    """Newest ``n`` rows (total order: timestamp desc, key desc)."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def error_class_histogram(sessions: DataFrame, newest_n: int | None = None) -> DataFrame:
    """A5: error classes over all sessions (or the newest ``newest_n``), most frequent first."""
    recent = sessions if newest_n is None else newest(sessions, newest_n)
    return (recent.select(error_class().alias("error_class"))
            .groupBy("error_class").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "error_class"))


def scoped_metrics(items: DataFrame) -> DataFrame:
    """Per-class counts ('Unknown' if blank) plus the scope totals row.

    ``rollup`` yields the class rows and the grand total in one partial aggregate.
    """
    fb = normalise_feedback(F.col("feedback_status"))
    cls = F.coalesce(F.nullif(F.col("error_class"), F.lit("")), F.lit("Unknown"))
    g = (items.select(cls.alias("error_class"), (fb == "accepted").cast("int").alias("a"), (fb == "rejected").cast("int").alias("r"))
         .rollup("error_class").agg(F.count(F.lit(1)).alias("count"), F.sum("a").cast("bigint").alias("accepted"),
                                    F.sum("r").cast("bigint").alias("rejected"), F.grouping("error_class").alias("_g")))
    return g.select(
        F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.lit("class")).alias("scope"),
        F.when(F.col("_g") == 1, F.lit(None).cast("string")).otherwise(F.col("error_class")).alias("error_class"),
        "count", "accepted", "rejected",
        F.greatest(F.lit(0).cast("bigint"), F.col("count") - F.col("accepted") - F.col("rejected")).alias("unresolved"),
    )


def group_by_build(items: DataFrame) -> DataFrame:
    """Stages per (job, build), newest stage first then name; builds newest first.

    One output row per stage with its position, so no build is ever collected into
    one array (a build's stage count is not bounded by the API).
    """
    wb = Window.partitionBy("job_full_name", "build_number")
    ws = wb.orderBy(F.col("timestamp").desc(), F.col("stage_name"), F.col("run_id"))
    return items.select(
        "job_full_name", "build_number",
        F.max("timestamp").over(wb).alias("latest_ts"),
        F.row_number().over(ws).alias("stage_pos"),
        "stage_name", "run_id", "timestamp",
    )


def noisiest(items: DataFrame, top: int = 5) -> DataFrame:
    """Top job/stage keys by count; ties by most recent appearance."""
    key = F.concat(F.col("job_full_name"), F.lit(" / "),
                   F.coalesce(F.nullif(F.col("stage_name"), F.lit("")), F.lit("unknown-stage")))
    g = items.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("_last"))
    return g.orderBy(F.col("count").desc(), F.col("_last").desc(), F.col("key")).limit(top).drop("_last")


def corpus_scan(solutions: DataFrame, limit: int | None = None, include_vectors: bool = False) -> DataFrame:
    """Newest solutions first, all of them unless a limit is given; vectors optional."""
    cols = ["doc_id", "fingerprint_text", "solution", "job_name", "stage_name", "build_number",
            "solution_score", "created_at"] + (["vector"] if include_vectors else [])
    out = solutions.select(*cols).orderBy(F.col("created_at").desc(), F.col("doc_id").desc())
    return out if limit is None else out.limit(max(1, int(limit)))


def fetch_session(sessions: DataFrame, session_id: str) -> DataFrame:
    """One row or none."""
    return sessions.filter(F.col("id") == F.lit(session_id))


def recent_sessions(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """Six columns, newest first."""
    return newest(sessions.select("id", "job_full_name", "build_number", "stage_name", "feedback_status", "created_at"), limit)


def session_records(sessions: DataFrame, limit: int = 50, job: str | None = None) -> DataFrame:
    """Twelve columns, optional case-insensitive job substring, newest first."""
    cols = ["id", "job_full_name", "build_number", "stage_name", "fingerprint", "filtered_logs", "analysis",
            "suggested_fix", "recommendation", "feedback_status", "filter_meta", "created_at"]
    df = sessions.select(*cols)
    if job:
        df = df.filter(F.col("job_full_name").ilike(f"%{job}%"))
    return newest(df, limit)


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    """Messages of one session, oldest first."""
    return (messages.filter(F.col("session_id") == F.lit(session_id))
            .select("id", "role", "content", "created_at").orderBy("created_at", "id"))
