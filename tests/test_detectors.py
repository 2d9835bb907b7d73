"""Detector facts from the reference test-suite (FIXTURES.md), re-stated as our own fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faultline.operators import baseline as B
from faultline.operators import detectors as D
from faultline.operators import stacks as SK
from faultline.operators import structural as ST
from faultline.operators import tokenize as T
from faultline.plans.filter import filter_logs

JAVA = "\n".join([
    "INFO Starting payment run",
    "2024-04-06T05:59:53.123Z ERROR Payment failed for order 42",
    "Caused by: java.net.ConnectException: Connection refused",
    "\tat java.base/sun.nio.ch.Net.pollConnect(Native Method)",
    "\tat java.base/sun.nio.ch.Net.connect(Net.java:579)",
    "\tat java.base/java.net.Socket.connect(Socket.java:633)",
    "\tat java.base/java.net.Socket.connect0(Socket.java:600)",
    "\tat java.base/java.net.Socket.connect1(Socket.java:601)",
    "\tat org.apache.http.impl.Client.execute(Client.java:10)",
    "\tat com.acme.pay.PaymentClient.charge(PaymentClient.java:84)",
    "\tat com.acme.pay.Service.run(Service.java:20)",
    "\tat com.acme.pay.Main.main(Main.java:5)",
    "INFO shutting down",
])
JAVA_FW = "\n".join(["ERROR boom", "java.lang.IllegalStateException: bad", "\tat java.base/java.lang.Thread.run(Thread.java:1)",
                     "\tat java.base/java.lang.Object.wait(Object.java:2)", "\tat java.base/java.util.Timer.x(Timer.java:3)"])
PY = "\n".join([
    "INFO running handler",
    "Traceback (most recent call last):",
    '  File "/app/service/api.py", line 10, in call',
    "    result = handler(req)",
    '  File "/app/service/handler.py", line 17, in handler',
    "    row = session.query(X).one()",
    '  File "/usr/lib/python3.11/site-packages/sqlalchemy/orm/query.py", line 2870, in one',
    "    raise NoResultFound",
    "sqlalchemy.exc.NoResultFound: No row was found when one was required",
    "INFO done",
])
NODE = "\n".join([
    "TypeError: Cannot read properties of undefined (reading 'id')",
    "    at Object.charge (/app/src/payment.js:42:15)",
    "    at async Promise.all (index 0)",
    "    at handler (/app/src/server.js:128:5)",
    "    at Module._compile (node:internal/modules/cjs/loader:1254:14)",
    "    at /app/node_modules/express/lib/router.js:10:3",
])
GO = "\n".join([
    "panic: runtime error: invalid memory address or nil pointer dereference",
    "[signal SIGSEGV: segmentation violation code=0x1 addr=0x0 pc=0x4a2b3c]",
    "",
    "goroutine 1 [running]:",
    "main.processPayment(0x0)",
    "\t/app/cmd/handler.go:42 +0x1d",
    "main.main()",
    "\t/app/cmd/main.go:12 +0x25",
    "runtime.main()",
    "\t/usr/local/go/src/runtime/proc.go:250 +0x207",
])
SHELL = "\n".join(["+ npm run build", "building...", "npm ERR! code ELIFECYCLE", "script returned exit code 1"])


@pytest.fixture(scope="module")
def results(spark):
    rows = [("java", JAVA), ("java_fw", JAVA_FW), ("py", PY), ("node", NODE), ("go", GO), ("shell", SHELL),
            ("mixed", JAVA + "\n+ mvn verify\nscript returned exit code 1")]
    df = spark.createDataFrame(rows, "log_id string, raw string")
    return {r.log_id: r for r in filter_logs(df).collect()}


def test_java_top_project_frame(results):
    r = results["java"]
    pl = r.primary_location
    assert (pl.kind, pl.file, pl.line) == ("source", "PaymentClient.java", 84)
    assert "ConnectException" in pl.message and r.confidence == "HIGH"
    assert "java_stack" in r.detectors


def test_java_framework_only(results):
    r = results["java_fw"]
    assert r.primary_location.confidence < 0.6 and r.confidence in ("MEDIUM", "LOW")


def test_python_bottom_project_frame(results):
    r = results["py"]
    pl = r.primary_location
    assert (pl.file, pl.line) == ("/app/service/handler.py", 17)
    assert "NoResultFound" in pl.message and r.confidence == "HIGH"


def test_node_top_frame(results):
    r = results["node"]
    pl = r.primary_location
    assert (pl.file, pl.line, pl.column) == ("/app/src/payment.js", 42, 15)
    assert r.confidence == "HIGH"
    assert any(loc.file == "/app/src/server.js" for loc in r.locations)


def test_go_function_from_line_above(results):
    r = results["go"]
    pl = r.primary_location
    assert (pl.file, pl.line) == ("/app/cmd/handler.go", 42)
    assert pl.function == "main.processPayment" and "panic" in pl.message and r.confidence == "HIGH"


def test_shell_command(results):
    r = results["shell"]
    assert r.primary_location.kind == "command" and "npm" in r.primary_location.command


def test_source_beats_command(results):
    r = results["mixed"]
    assert r.primary_location.kind == "source"
    assert {"java_stack", "generic_shell"} <= set(r.detectors)


RUBY = "\n".join([
    "NoMethodError: undefined method `charge` for nil:NilClass",
    "    from /repo/app/services/payment.rb:42:in `process'",
    "    from /repo/app/controllers/orders_controller.rb:17:in `create'",
    "    from /usr/lib/ruby/3.2.0/gems/rails/lib/action_controller.rb:200:in `dispatch'",
    "[ERROR] tests failed",
])
RUBY_LANGUAGE = SK.StackLanguage(
    name="ruby_stack_test", priority=60, probe_pattern=r"^\s+from\s+\S+\.rb:\d+",
    frame_pattern=r"^\s+from\s+(\S+\.rb):(\d+)(?::in\s+`([^']+)')?", function_group=3,
    framework_paths=("/usr/lib/ruby/", "/gems/"),
    cause_pattern=r"^((?:[\w:]+\.)*[A-Z]\w*(?:Error|Exception))(?::\s*(.*))?$")


class Broken:
    """A detector whose plan raises."""

    name, priority = "broken", 99

    def activates(self, line):
        return F.lit(True)

    def contribute(self, lines):
        return lines.select("no_such_column"), lines


class BrokenProbe(Broken):
    name = "broken_probe"

    def activates(self, line):
        return F.col("no_such_column")


class Dropper:
    """Drops and annotates every line it is asked about."""

    name, priority = "dropper", 70

    def activates(self, line):
        return line.contains("[ERROR]")

    def contribute(self, lines):
        marks = lines.select("log_id", "idx", F.lit(self.name).alias("detector"), F.lit(-5).alias("delta"),
                             F.col("text").contains("create").alias("keep"), F.lit(True).alias("drop"), F.lit("seen").alias("note"))
        return marks, lines.sparkSession.createDataFrame([], D._loc_schema())


def _lines(spark, raw):
    lines = T.tokenize(spark.createDataFrame([("r", raw)], "log_id string, raw string"))
    return ST.init_state(lines)


def test_custom_language_and_isolation(spark):
    ruby = SK.GenericStackDetector(RUBY_LANGUAGE)
    lines, locs, names = D.run_detectors(_lines(spark, RUBY), [Broken(), ruby, BrokenProbe(), D.ShellDetector()])
    top = locs.orderBy("_seq").first()
    assert (top.kind, top.file, top.line, top.function) == ("source", "/repo/app/services/payment.rb", 42, "process")
    assert "NoMethodError" in top.message and names.first().detectors == ["ruby_stack_test"]
    assert [r.keep for r in lines.orderBy("idx").collect()] == [True, True, True, False, False]
    lines, locs, names = D.run_detectors(_lines(spark, RUBY), [Broken()])
    assert locs.count() == 0 and lines.filter("keep").count() == 0 and names.first().detectors == []


def test_cap_takes_the_first_by_priority(spark):
    """At most ``cap`` contributing detectors; drops spare errors and kept lines."""
    ruby = SK.GenericStackDetector(RUBY_LANGUAGE)
    lines, locs, names = D.run_detectors(_lines(spark, RUBY), [ruby, Dropper()], cap=1)
    assert names.first().detectors == ["dropper"] and locs.count() == 0
    state = [(r.drop, r.reason, r.note, r.score) for r in lines.orderBy("idx").collect()]
    assert state[1] == (True, "detector-drop:dropper", "seen", 0) and state[2] == (False, "", "seen", 0)
    assert state[0][0] is False and state[4][0] is False           # errors stay
    both, _, names = D.run_detectors(_lines(spark, RUBY), [ruby, Dropper()], cap=5)
    assert names.first().detectors == ["dropper", "ruby_stack_test"]
    assert [r.drop for r in both.orderBy("idx").collect()] == [False, False, False, True, False]


def test_selection_by_name(spark):
    """All, none, a list in its order, unknown names skipped."""
    assert [d.name for d in D.load_detectors("auto")] == list(D.BUNDLED)
    assert D.load_detectors("none") == [] and D.load_detectors("") == []
    assert [d.name for d in D.load_detectors(" go_panic, nope ,java_stack")] == ["go_panic", "java_stack"]


def test_empty_baseline(spark):
    """E5: without any sketch nothing is common and every INFO line is novel."""
    raw = "\n".join(["INFO same step"] * 30 + ["WARN careful", "ERROR bad"])
    own = B.apply_baseline(_lines(spark, raw))
    none = B.apply_baseline(_lines(spark, raw), self_baseline=False)
    assert own.filter("drop").count() == 30 and own.first().baseline_version == "self/0.30/1"
    assert none.filter("drop").count() == 0 and none.first().baseline_version == "empty"
    assert none.filter("score = 2").count() == 30


def test_detectors_deal_logs_to_tasks_by_their_lines(spark, monkeypatch):
    from faultline.operators import detectors as D
    from faultline.operators import structural as ST
    from faultline.operators import tokenize as T
    logs = spark.createDataFrame([(f"t{i}", "TypeError: no\n    at Object.a (/app/a.js:1:2)\nend") for i in range(400)], "log_id string, raw string")
    lines = ST.init_state(T.tokenize(logs))
    monkeypatch.setattr(D, "TASK_LINES", 50)
    assert D.spread(lines, 1200).rdd.getNumPartitions() == 24
    assert D.spread(lines, 0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    seen = []
    _, locs, _ = D.run_detectors(lines, D.load_detectors("node_stack"), reuse=lambda d: seen.append(d) or d)
    assert seen[0].rdd.getNumPartitions() == 24 and locs.count() == 400
