"""Dashboard projection facts (FIXTURES.md, sessions) on our own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import sessions as S

COLS = "id string, fingerprint string, analysis string, suggested_fix string, filtered_logs string"


def test_error_class_rules(spark):
    df = spark.createDataFrame([
        ("a", "exceptions: ConnectException, TimeoutException", "", "", ""),
        ("b", "", "the build failed at step 3", "", ""),
        ("c", "", "", "", ""),
    ], COLS)
    got = {r.id: r.c for r in df.select("id", S.error_class().alias("c")).collect()}
    assert got == {"a": "ConnectException", "b": "failed", "c": "UnknownError"}


def test_result_item_defaults(spark):
    df = spark.createDataFrame([("r1", "team/job", None, None, "AssertionError: x", "", "", "", "", None, None)],
                               "id string, job_full_name string, build_number int, stage_name string, fingerprint string, "
                               "analysis string, suggested_fix string, filtered_logs string, recommendation string, "
                               "feedback_status string, created_at timestamp")
    r = S.result_items(df).first()
    assert (r.error_class, r.feedback_status, r.build_number, r.source, r.stage_name) == ("AssertionError", "new", 0, "session", "")


def test_telemetry_projection(spark):
    meta = ('{"confidence":"medium","activated_detectors":["java_stack",""],"raw_chars":100,"body_chars":10,'
            '"body_tokens":3,"selected_count":2,"baseline_version":"","extra":{"x":1}}')
    df = spark.createDataFrame([("s1", meta), ("s2", None)], "id string, filter_meta string")
    got = {r.run_id: r for r in S.telemetry(df).collect()}
    t = got["s1"]
    assert (t.confidence, t.activated_detectors, t.raw_chars, t.baseline_version) == ("MEDIUM", "java_stack", 100, None)
    empty = got["s2"]
    assert all(getattr(empty, c) is None for c in ("confidence", "activated_detectors", "raw_chars", "baseline_version"))
    assert F is not None
