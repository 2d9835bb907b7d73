"""Persistent state as DataFrames: claim / status machine, stale reclaim, retention,
feedback, session and solution sinks (Z3-Z5, U5, S7-S9, X22).

Every "update" of the reference's stores is expressed as a new version of a
table: the caller writes the returned DataFrame (append or overwrite by key).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_MINUTES = 30
STALE_ERROR = "stale processing reclaim"
SESSION_DAYS, MESSAGE_DAYS, STATE_DAYS, SOLUTION_DAYS = 180, 90, 30, 1095


def solution_doc_id(session_id: Column, job: Column, build: Column, stage: Column, fingerprint: Column) -> Column:
    """Lower-cased session id, else sha256 of job|build|stage|fingerprint (lower-cased)."""
    sid = F.lower(F.trim(F.coalesce(session_id, F.lit(""))))
    seed = F.lower(F.concat_ws("|", F.coalesce(job, F.lit("")), F.coalesce(build.cast("string"), F.lit("0")),
                               F.coalesce(stage, F.lit("")), F.trim(F.coalesce(fingerprint, F.lit("")))))
    return F.when(sid != "", sid).otherwise(F.sha2(seed, 256))


def status_fold(events: DataFrame, now: _dt.datetime | None = None, error_chars: int | None = None) -> DataFrame:
    """Z3: ingest-state rows from ordered status events per (job, build).

    ``events``: job_full_name, build_number, ts, action in (claim, processed, failed), error.
    A claim inserts the row as seen and takes it when its status is seen or
    failed; processed / failed count an attempt. Returns the final state per key
    with ``claims_granted`` (how many claims succeeded); ``error_chars`` cuts the error texts, if given.
    """
    keys = ["job_full_name", "build_number"]
    order = F.struct("ts", "action", "error")
    w = Window.partitionBy(*keys).orderBy("ts", "action", "error")
    claim, outcome = F.col("action") == "claim", F.col("action").isin("processed", "failed")
    # Nothing happens to a row before its first claim. After that an outcome sets the status whatever it was, and a claim
    # is granted if it is the first or comes right behind a failure; so the last events tell the state.
    seen = F.max(claim.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    ev = events.filter(claim | outcome).withColumn("_seen", seen).filter("_seen")
    ev = ev.withColumn("_prev", F.lag("action").over(w))
    granted = claim & (F.col("_prev").isNull() | (F.col("_prev") == "failed"))
    st = ev.groupBy(*keys).agg(
        F.max_by("action", order).alias("_last"), F.max_by("action", F.when(outcome, order)).alias("_outcome"),
        F.max_by(F.struct("error"), F.when(outcome, order)).alias("_error"), F.count_if(outcome).cast("int").alias("attempt_count"),
        F.min(F.when(claim, F.col("ts"))).alias("first_seen_at"),
        F.max(F.when(F.col("action") == "processed", F.col("ts"))).alias("processed_at"), F.count_if(granted).cast("int").alias("claims_granted"))
    error = F.coalesce(F.col("_error.error"), F.lit(""))
    status = (F.when(F.col("_outcome").isNull(), "processing").when(F.col("_outcome") == "processed", "processed")
              .when(F.col("_last") == "claim", "processing").otherwise("failed"))
    st = st.select(
        *keys, status.alias("status"), "attempt_count",
        F.when(F.col("_outcome") == "failed", error if error_chars is None else F.substring(error, 1, error_chars)).alias("last_error"),
        "first_seen_at", "processed_at", "claims_granted")
    return reclaim_stale(st, now) if now is not None else st


def reclaim_stale(state: DataFrame, now: _dt.datetime, stale_minutes: int = STALE_MINUTES) -> DataFrame:
    """Processing rows first seen more than ``stale_minutes`` before ``now`` become failed."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(mins=F.lit(stale_minutes))
    stale = (F.col("status") == "processing") & (F.col("first_seen_at") < cutoff)
    return (state.withColumn("last_error", F.when(stale, F.lit(STALE_ERROR)).otherwise(F.col("last_error")))
            .withColumn("status", F.when(stale, F.lit("failed")).otherwise(F.col("status"))))


def _cutoff(now: _dt.datetime, days: int) -> Column:
    return F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))


def retention(sessions: DataFrame, messages: DataFrame, now: _dt.datetime, session_days: int = SESSION_DAYS,
              message_days: int = MESSAGE_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept sessions, kept messages (expired or orphaned by a deleted session removed), counts.

    ``days <= 0`` keeps everything for that table.
    """
    s_del = (F.col("updated_at") < _cutoff(now, session_days)) if session_days > 0 else F.lit(False)
    kept_s = sessions.filter(~s_del)
    m_del = (F.col("created_at") < _cutoff(now, message_days)) if message_days > 0 else F.lit(False)
    m_live = messages.filter(~m_del)
    kept_m = m_live.join(kept_s.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    counts = (sessions.select(F.lit(1).alias("s"), F.lit(0).alias("m"), s_del.cast("int").alias("sd"), F.lit(0).alias("md"))
              .unionByName(messages.select(F.lit(0).alias("s"), F.lit(1).alias("m"), F.lit(0).alias("sd"), m_del.cast("int").alias("md")))
              .agg(F.sum("sd").cast("bigint").alias("sessions_deleted"), F.sum("md").cast("bigint").alias("messages_deleted")))
    return kept_s, kept_m, counts


def purge_state(state: DataFrame, now: _dt.datetime, days: int = STATE_DAYS) -> DataFrame:
    """Z5 (ingest state): processed rows older than ``days`` by processed_at are removed."""
    if days <= 0:
        return state
    old = (F.col("status") == "processed") & F.col("processed_at").isNotNull() & (F.col("processed_at") < _cutoff(now, days))
    return state.filter(~old)


def purge_solutions(solutions: DataFrame, now: _dt.datetime, days: int = SOLUTION_DAYS) -> DataFrame:
    """Z5 (solutions): remove solutions created more than ``days`` ago."""
    return solutions if days <= 0 else solutions.filter(F.col("created_at") >= _cutoff(now, days))


def apply_feedback(sessions: DataFrame, decisions: DataFrame) -> DataFrame:
    """First decision per session wins; terminal feedback is never rewritten.

    ``decisions``: session_id, decision (accept / reject, any case), ts.
    Accept needs a suggested fix or analysis to store (else the decision is
    refused). Returns session id, new feedback status and whether a solution
    is stored.
    """
    d = decisions.withColumn("decision", F.lower(F.trim("decision"))).filter(F.col("decision").isin("accept", "reject"))
    s = sessions.select("id", "feedback_status", "suggested_fix", "analysis")
    sol = F.trim(F.coalesce(F.nullif(F.col("suggested_fix"), F.lit("")), F.col("analysis"), F.lit("")))
    j = s.join(d.withColumnRenamed("session_id", "id"), "id", "inner")
    # A refused accept (nothing to store) changes nothing, so the first *valid* decision wins.
    j = j.filter((F.col("decision") == "reject") | (sol != ""))
    j = j.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("ts", "decision"))).filter("_r = 1")
    current = F.lower(F.trim(F.coalesce(F.col("feedback_status"), F.lit(""))))
    terminal = current.isin("accepted", "rejected")
    accept_ok = F.col("decision") == "accept"
    new_status = (F.when(terminal, current).when(accept_ok, F.lit("accepted"))
                  .when(F.col("decision") == "reject", F.lit("rejected")).otherwise(F.col("feedback_status")))
    return j.select("id", new_status.alias("feedback_status"), (~terminal & accept_ok).alias("store_solution"),
                    terminal.alias("idempotent"))


def upsert_solutions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Write by doc id; the incoming write wins, and among incoming rows the newest."""
    u = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy(F.col("_src").desc(), F.col("created_at").desc_nulls_last())
    return u.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_src")


def new_session_rows(rows: DataFrame, now: _dt.datetime, source_key: Column) -> DataFrame:
    """Analysis rows with all their columns and defaults, ready to append.

    ``source_key`` names the event that a row comes from; the id is a hash of it with the row's
    job, build and stage, so a replayed event has the id that it had, and no two events share one.
    Columns that ``rows`` lacks take their defaults.
    """
    def text(c: str) -> Column:
        return (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c)

    def number(c: str, kind: str) -> Column:
        return (F.coalesce(F.col(c), F.lit(0)) if c in rows.columns else F.lit(0)).cast(kind).alias(c)

    def json(c: str, default: str) -> Column:
        return (F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)).alias(c)

    key = F.concat_ws("|", source_key.cast("string"), text("job_full_name"), number("build_number", "string"), text("stage_name"))
    ts = F.lit(now).cast("timestamp")
    return rows.select(
        F.sha2(key, 256).alias("id"), text("job_full_name"), number("build_number", "int"), text("stage_name"), text("build_url"),
        text("fingerprint"), text("analysis"), text("suggested_fix"), text("filtered_logs"), text("raw_logs"), text("matched_solution"),
        number("match_score", "double"), text("recommendation"), json("similar_past", "[]"), json("filter_meta", "{}"),
        F.lit("").alias("feedback_status"), ts.alias("created_at"), ts.alias("updated_at"))


def touch_parents(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """A session's updated_at becomes the newest of itself and its messages."""
    last = messages.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("_m"))
    return sessions.join(last, "id", "left").withColumn(
        "updated_at", F.greatest(F.col("updated_at"), F.coalesce(F.col("_m"), F.col("updated_at")))).drop("_m")
