"""The whole filter on hand-made logs with literal results (its SQL oracle runs on the driver tables)."""

from __future__ import annotations

import pytest

from faultline.operators import tokenize
from faultline.plans import filter as plan
from faultline.plans import q_render
from faultline.plans.filter import annotated_lines, filter_lines, filter_logs


@pytest.fixture(scope="module")
def results(spark):
    storm = "\n".join(["INFO start"] * 5 + [f"WARN GET http://svc/{i} failed" for i in range(60)] + ["ERROR final failure"])
    shell = "\n".join(["+ npm run build", "compiling", "npm ERR! missing script", "script returned exit code 1"])
    info = "\n".join(["INFO same line"] * 20 + ["ERROR the real problem"])
    allinfo = "\n".join([f"INFO step {i} done" for i in range(40)])
    crlf = "a\r\nscript returned exit\r\ncode 7\r\nERROR x"
    late = "\n".join([f"INFO warming up cache entry number {i}" for i in range(400)]
                     + ["ERROR order failed", "java.lang.IllegalStateException: no stock", "\tat com.acme.Order.take(Order.java:12)",
                        "\tat java.base/java.lang.Thread.run(Thread.java:1)"])
    long = "\n".join([f"INFO tick {i} of the long run" for i in range(5000)] + ["FATAL disk full"])
    rows = [("storm", storm), ("shell", shell), ("info", info), ("allinfo", allinfo), ("empty", ""), ("crlf", crlf), ("late", late), ("long", long)]
    df = spark.createDataFrame([(k, v, "s") for k, v in rows], "log_id string, raw string, stage_name string")
    return dict(rows), {r.log_id: r for r in filter_logs(df, detectors="auto").collect()}


def test_storm_is_compressed(results):
    raw, out = results
    assert len(raw["storm"]) / out["storm"].body_chars >= 5 and "ERROR final failure" in out["storm"].body
    assert "(repeated" in out["storm"].body


def test_shell_failure(results):
    r = results[1]["shell"]
    assert (r.primary_location.kind, r.primary_location.command) == ("command", "npm run build")
    assert (r.exit_code, r.detectors, r.confidence) == ("1", ["generic_shell"], "MEDIUM")
    assert r.body.endswith("L0: + npm run build\nL1: compiling\nL2: npm ERR! missing script\nL3: script returned exit code 1\n---")


def test_error_survives_common_lines(results):
    assert results[1]["info"].body.endswith("L20: ERROR the real problem\n---")
    assert results[1]["info"].collapse_stats["repeat-elided"] == 18


def test_low_confidence_and_empty_logs(results):
    r = results[1]["allinfo"]
    assert r.confidence == "LOW" and "[FILTER: LOW CONFIDENCE]" in r.body and "L0: INFO step 0 done" in r.body
    assert results[1]["empty"].body == "" and results[1]["empty"].confidence == "LOW"


def test_raw_length_and_code_are_those_of_the_raw_log(results):
    raw, out = results
    assert out["crlf"].raw_chars == len(raw["crlf"]) and out["crlf"].exit_code == "7"


def test_a_trace_far_from_the_start_is_found(results):
    r = results[1]["late"]
    assert r.detectors == ["java_stack"] and r.confidence == "HIGH"
    assert (r.primary_location.file, r.primary_location.line, r.primary_location.log_line_idx) == ("Order.java", 12, 402)
    assert r.primary_error == "java.lang.IllegalStateException"     # a message needs a second colon


def test_a_log_of_thousands_of_lines_is_one_log(results):
    r = results[1]["long"]
    assert r.raw_chars == len(results[0]["long"]) and "L5000: FATAL disk full" in r.body


def test_explicit_bounds(spark):
    raw = "\n".join(f"ERROR problem number {i} of many" for i in range(400))
    lines = annotated_lines(spark.createDataFrame([("L", raw)], "log_id string, raw string"))
    whole, _ = filter_lines(lines, detectors="none", token_budget=10_000)
    cut, _ = filter_lines(lines, detectors="none", token_budget=10_000, body_max_chars=500)
    assert whole.first().body_chars > 8000
    assert cut.first().body.endswith("\n... [hard ceiling truncated]\n---") and cut.first().body_chars < 540


def test_lines_are_kept_once_between_the_detectors_and_the_selection(spark, monkeypatch):
    """scored lines are read by the selection alone, which keeps them with their costs."""
    kept, real = [], plan._materialize
    monkeypatch.setattr(plan, "_materialize", lambda df, how: kept.append(set(df.columns)) or real(df, how))
    logs = spark.createDataFrame([("L", "INFO a\n+ make\nERROR b\nscript returned exit code 2")], "log_id string, raw string")
    res, final = filter_lines(annotated_lines(logs))
    assert sum("baseline_version" in c for c in kept) == 2 and sum("keep" in c for c in kept if "idx" in c and "raw" in c) == 2
    assert [r.idx for r in final.filter("selected").orderBy("idx").collect()] == [0, 1, 2, 3] and res.first().exit_code == "2"


def test_the_counter_sketch_reads_the_lines_of_the_filter(spark, monkeypatch, tmp_path):
    """the history of ``j7_baseline_counter`` is the filter's own lines, which are annotated once."""
    spark.sql("""SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts, id % 4 AS user_id,
                 'click' AS event_type, 1D AS value, '' AS props FROM range(400)""").write.parquet(str(tmp_path / "events.parquet"))
    calls, seen, real = [], {}, tokenize.annotate
    monkeypatch.setattr(tokenize, "annotate", lambda *a, **k: calls.append(1) or real(*a, **k))

    def filtered(lines, **kw):
        lines = lines.persist()
        seen.update(sketch=kw["sketch"](lines).collect(), meta=kw["logs_meta"](lines).collect())
        return lines.selectExpr("log_id", "'' baseline_version", "0 baseline_dropped", "0 baseline_novel", "'' confidence", "0 selected_count"), None

    monkeypatch.setattr(q_render, "filter_lines", filtered)
    q_render.j7_baseline_counter(spark, str(tmp_path))
    assert len(calls) == 1
    assert sorted((r.job_name, r.stage_name, r.template, r.fraction) for r in seen["sketch"]) == [
        (f"job-{u}", "build", f"+ run task-{k}", 1.0) for u in range(4) for k in [*range(u, 10, 4), "N"]]     # one digit alone is no value
    assert sorted((r.log_id, r.job_name) for r in seen["meta"]) == [(f"u{u}", f"job-{u}") for u in range(4)]
