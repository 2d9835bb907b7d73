"""Whole-filter queries (E8 and its per-log outputs) over the derived build logs.

Their oracles chain the whole filter in SQL (``filter_oracle``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import render as R
from ..operators import tokenize as T
from ..sources import adapters as A
from .catalog import register
from ..sources.adapters import with_adapters
from .oracle import q, tokenized_sql
from .filter_oracle import filter_sql
from .filter import annotated_lines, filter_lines


def _meta(lines):
    return lines.select("log_id").distinct().select(
        "log_id", F.concat(F.lit("job-"), F.expr("substring(log_id, 2)")).alias("job_name"),
        F.lit("build").alias("stage_name"))


def filtered(spark, sf_dir, detectors="auto"):
    ll = A.log_lines(spark, sf_dir)
    return filter_lines(annotated_lines(ll), detectors=detectors, logs_meta=_meta)


@register("e8_filter_logs", oracle=filter_sql("""SELECT log_id, confidence, primary_error, exit_code, fingerprint, raw_chars::BIGINT AS raw_chars, body_chars::INT AS body_chars,
       body_tokens::INT AS body_tokens, selected_count::BIGINT AS selected_count, detectors, pkind AS location_kind, pidx::INT AS location_line, body FROM results"""))
def e8_filter_logs(spark, sf_dir):
    res, _ = filtered(spark, sf_dir)
    return res.select("log_id", "confidence", "primary_error", "exit_code", "fingerprint", "raw_chars", "body_chars",
                      "body_tokens", "selected_count", F.array_join("detectors", ",").alias("detectors"),
                      F.col("primary_location.kind").alias("location_kind"),
                      F.col("primary_location.log_line_idx").alias("location_line"), "body")


@register("k1_budget_selection", oracle=filter_sql("SELECT log_id, idx, score, text, note FROM final WHERE selected"))
def k1_budget_selection(spark, sf_dir):
    _, final = filtered(spark, sf_dir)
    return final.filter("selected").select("log_id", "idx", "score", "text", "note")


@register("a16_compression_telemetry", oracle=filter_sql("""
SELECT confidence, count(*) AS logs, sum(raw_chars)::BIGINT AS raw_chars, sum(body_chars)::BIGINT AS body_chars, round(avg(ratio), 4) AS avg_ratio,
       round(median(ratio), 4) AS median_ratio, count(*) FILTER (WHERE ratio >= 1.05) AS shown_ratio_logs
FROM (SELECT *, raw_chars::DOUBLE / greatest(body_chars, 1) AS ratio FROM results) GROUP BY 1"""))
def a16_compression_telemetry(spark, sf_dir):
    res, _ = filtered(spark, sf_dir)
    ratio = F.col("raw_chars") / F.greatest(F.col("body_chars"), F.lit(1))
    return res.groupBy("confidence").agg(
        F.count(F.lit(1)).alias("logs"), F.sum("raw_chars").alias("raw_chars"), F.sum("body_chars").alias("body_chars"),
        F.round(F.avg(ratio), 4).alias("avg_ratio"),
        F.round(F.median(ratio), 4).alias("median_ratio"),
        F.count_if(ratio >= 1.05).alias("shown_ratio_logs"))


@register("x9_confidence_routing", oracle=filter_sql("SELECT confidence, low_reason AS low_confidence_reason, count(*) AS logs FROM results GROUP BY ALL"))
def x9_confidence_routing(spark, sf_dir):
    res, _ = filtered(spark, sf_dir)
    return res.groupBy("confidence", "low_confidence_reason").agg(F.count(F.lit(1)).alias("logs"))


@register("a12_location_clusters", oracle=filter_sql("""SELECT log_id, rank::INT AS rank, kind, file, line::INT AS line, detector, round(confidence::DOUBLE, 4) AS confidence,
       log_line_idx::INT AS log_line_idx, message FROM places"""))
def a12_location_clusters(spark, sf_dir):
    res, _ = filtered(spark, sf_dir)
    return res.select("log_id", F.posexplode("locations").alias("rank", "loc")).select(
        "log_id", "rank", "loc.kind", "loc.file", "loc.line", "loc.detector", F.round("loc.confidence", 4).alias("confidence"),
        "loc.log_line_idx", "loc.message")


@register("x15_legacy_body", oracle=filter_sql("SELECT log_id, confidence, primary_error, fingerprint, body FROM results", detectors=False, cite=False))
def x15_legacy_body(spark, sf_dir):
    """Legacy variant: no detectors, no citation prefixes."""
    ll = A.log_lines(spark, sf_dir)
    res, _ = filter_lines(annotated_lines(ll), detectors="none", logs_meta=_meta, with_citation=False)
    return res.select("log_id", "confidence", "primary_error", "fingerprint", "body")


def _history(lines):
    """Template history per job: every derived log is one build of job ``job-<user % 20>``."""
    uid = F.expr("substring(log_id, 2)").cast("bigint")
    return lines.withColumn("job_name", F.concat(F.lit("job-"), (uid % 20).cast("string"))).withColumn(
        "stage_name", F.lit("build")).withColumn("build_id", F.col("log_id"))


_SKETCH_SQL = A.ADAPTER_SQL["log_lines"].strip() + ",\n" + tokenized_sql("log_lines") + """,
hist AS (
  SELECT log_id, template, text, 'job-' || CAST(CAST(substr(log_id, 2) AS BIGINT) % 20 AS VARCHAR) AS job_name
  FROM lines
)
SELECT h.job_name, 'build' AS stage_name, h.template, round(count(DISTINCT h.log_id) / t.builds, 6) AS fraction
FROM hist h JOIN (SELECT job_name, count(DISTINCT log_id) AS builds FROM hist GROUP BY job_name) t ON h.job_name = t.job_name
WHERE h.text <> ''
GROUP BY h.job_name, h.template, t.builds"""


@register("a10_counter_sketch", oracle="WITH " + _SKETCH_SQL)
def a10_counter_sketch(spark, sf_dir):
    return B.counter_sketch(_history(T.annotate(A.log_lines(spark, sf_dir)))).withColumn("fraction", F.round("fraction", 6))


@register("j7_baseline_counter", oracle=filter_sql("""SELECT log_id, baseline_version, baseline_dropped, baseline_novel, confidence, selected_count::BIGINT AS selected_count
FROM results""", counter=True))
def j7_baseline_counter(spark, sf_dir):
    """Filter with the cross-build counter sketch instead of the self-baseline."""
    ll = A.log_lines(spark, sf_dir)
    uid = F.expr("substring(log_id, 2)").cast("bigint")

    def meta(lines):
        return lines.select("log_id").distinct().select("log_id", F.concat(F.lit("job-"), (uid % 20).cast("string")).alias("job_name"),
                                                        F.lit("build").alias("stage_name"))

    res, _ = filter_lines(annotated_lines(ll), detectors="auto", sketch=lambda lines: B.counter_sketch(_history(lines)), logs_meta=meta)
    return res.select("log_id", "baseline_version", "baseline_dropped", "baseline_novel", "confidence", "selected_count")


@register("x8_line_scores", oracle=filter_sql("SELECT log_id, idx, severity, score FROM final WHERE live"))
def x8_line_scores(spark, sf_dir):
    """Pass-4 score of every live line after detectors and baseline."""
    _, final = filtered(spark, sf_dir)
    return final.filter(~F.col("drop") & (F.col("text") != "")).select("log_id", "idx", "severity", "score")


_TXT = "concat(coalesce(filtered_logs, ''), chr(10), coalesce(analysis, ''), chr(10), coalesce(fingerprint, ''))"


def _first_sql(rx: str, txt: str) -> str:
    return f"nullif(trim(regexp_extract({txt}, {q(rx)}, 1)), '')"


def _exc_sql(txt: str) -> str:
    names = f"list_transform(regexp_extract_all({txt}, {q(R.EXCEPTION_LINE)}, 1), lambda x: string_split(x, '.')[-1])"
    return f"list_slice(list_filter({names}, lambda x, i: list_position({names}, x) = i), 1, 4)"


@register("a13_exception_list", oracle=with_adapters(f"SELECT id, array_to_string({_exc_sql(_TXT)}, ', ') AS exceptions FROM sessions", "sessions"))
def a13_exception_list(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    txt = F.concat(F.coalesce(F.col("filtered_logs"), F.lit("")), F.lit("\n"), F.coalesce(F.col("analysis"), F.lit("")), F.lit("\n"),
                   F.coalesce(F.col("fingerprint"), F.lit("")))
    return s.select("id", F.array_join(R.exception_names(txt), ", ").alias("exceptions"))


@register("x12_render_functions", oracle=with_adapters(f"""
SELECT id,
       coalesce({_first_sql(R.CAUSED_BY, _TXT)}, {_first_sql(R.EXCEPTION_LINE, _TXT)}, {_first_sql(R.ERROR_MARKER, _TXT)}, 'Unknown') AS primary_error,
       coalesce({_first_sql(R.EXIT_CODE, _TXT)}, 'N/A') AS exit_code,
       array_to_string(list_filter([
         CASE WHEN {_first_sql(R.CAUSED_BY, _TXT)} IS NOT NULL THEN 'root_cause: ' || substr({_first_sql(R.CAUSED_BY, _TXT)}, 1, 200) END,
         CASE WHEN len({_exc_sql(_TXT)}) > 0 THEN 'exceptions: ' || array_to_string({_exc_sql(_TXT)}, ', ') END,
         CASE WHEN {_first_sql(R.CAUSED_BY, _TXT)} IS NULL AND {_first_sql(R.ERROR_MARKER, _TXT)} IS NOT NULL
              THEN 'error: ' || substr({_first_sql(R.ERROR_MARKER, _TXT)}, 1, 200) END,
         'stage: ' || coalesce(stage_name, '')], lambda x: x IS NOT NULL), ' | ') AS fingerprint
FROM sessions""", "sessions"))
def x12_render_functions(spark, sf_dir):
    """X10 primary error, X11 exit code and X12 fingerprint on stored analysis texts."""
    s = A.sessions(spark, sf_dir)
    txt = F.concat(F.coalesce(F.col("filtered_logs"), F.lit("")), F.lit("\n"), F.coalesce(F.col("analysis"), F.lit("")), F.lit("\n"),
                   F.coalesce(F.col("fingerprint"), F.lit("")))
    return s.select("id", R.primary_error(txt).alias("primary_error"),
                    F.coalesce(R._first(R.EXIT_CODE, txt), F.lit("N/A")).alias("exit_code"),
                    R.fingerprint(txt, F.col("stage_name")).alias("fingerprint"))
