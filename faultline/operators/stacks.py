"""Stack-trace detectors (E2, E3a-E3d, W16-W18, J10, J12) as window plans.

Every detector finds frame runs per log with window sums (a run is broken by a
line that is neither a frame nor, where defined, a separator), looks for the
cause line in a bounded frame of rows above (or below) the run, ranks the
project frames inside each run and emits marks and locations. ``StackLanguage``
is the declarative description (E2); Node and Go are instances of it, and a
user can register more (e.g. Ruby) without code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .detectors import LOG, location, register

# Java frames, cause lines and framework lists.
JAVA_PROBE = r"(?m)^\s+at\s+[\w$./<>]+\([^)]*\)"
JAVA_FRAME = r"^\s+at\s+(?:([\w$.]+)/)?([\w$.<>]+)\(([^)]*)\)"
JAVA_FILE_LINE = r"^([^:]+?)(?::(\d+))?$"
JAVA_CAUSE = r"(?:^|\s)((?:[\w$]+\.)*[\w$]+(?:Exception|Error|Failure|Fault))(?::|$)"
JAVA_FRAMEWORK_PREFIXES = (
    "java.", "javax.", "jakarta.", "kotlin.", "kotlinx.", "scala.", "groovy.", "sun.", "com.sun.",
    "jdk.internal.", "org.junit.", "junit.", "org.testng.", "org.mockito.", "org.assertj.", "org.hamcrest.",
    "io.cucumber.", "org.springframework.", "org.springframework.boot.", "org.hibernate.", "org.eclipse.jetty.",
    "org.glassfish.", "org.apache.tomcat.", "org.apache.catalina.", "org.apache.coyote.", "org.apache.maven.",
    "org.apache.tools.ant.", "org.gradle.", "ch.qos.logback.", "org.slf4j.", "org.apache.log4j.",
    "org.apache.logging.log4j.", "org.apache.http.", "org.apache.commons.", "com.google.common.",
    "com.google.inject.", "com.google.gson.", "com.fasterxml.jackson.", "io.netty.", "io.micrometer.",
    "io.reactivex.", "reactor.core.", "okhttp3.", "retrofit2.", "com.zaxxer.hikari.", "feign.",
)
JAVA_FRAMEWORK_MODULES = (
    "java.base", "java.desktop", "java.logging", "java.management", "java.naming", "java.net.http",
    "java.security.jgss", "java.sql", "java.xml", "jdk.compiler", "jdk.internal", "jdk.proxy1", "jdk.proxy2",
    "jdk.unsupported",
)
JAVA_CAUSE_LOOKBACK = 7

# Python tracebacks.
PY_PROBE = r'(?m)^\s+File ".+", line \d+'
PY_FRAME = r'^\s+File "([^"]+)", line (\d+)(?:, in (\S+))?\s*$'
PY_START = (r"^Traceback \(most recent call last\):\s*$"
            r"|^During handling of the above exception, another exception occurred:\s*$"
            r"|^The above exception was the direct cause of the following exception:\s*$")
PY_SUMMARY = r"^((?:[\w]+\.)*[A-Z][\w]*)(?::\s*(.*))?$"
PY_FRAMEWORK_HINTS = ("/site-packages/", "/dist-packages/", "\\site-packages\\", "\\dist-packages\\", "/python3.",
                      "\\python3", "\\Lib\\", "/usr/lib/python", "/usr/local/lib/python", "<frozen ", "<built-in", "<string>")
PY_SUMMARY_WINDOW = 5


def _w(*extra):
    return Window.partitionBy(LOG, *extra).orderBy("idx")


def _any_contains(c: Column, hints) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | c.contains(h)
    return out


def _any_startswith(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def _confidence(offset: Column, file: Column, line: Column, top=0.85, decay=0.10, floor=0.55) -> Column:
    base = F.when(offset == 0, F.lit(top)).otherwise(F.greatest(F.lit(floor), F.lit(top) - decay * offset))
    return (F.when(file == "", F.least(base, F.lit(0.50)))
            .when(line <= 0, F.least(base, F.lit(0.65))).otherwise(base))


def _marks(df: DataFrame, name: str, delta: Column, keep: Column, note: Column | None = None) -> DataFrame:
    return df.select(LOG, "idx", F.lit(name).alias("detector"), delta.cast("int").alias("delta"), keep.alias("keep"),
                     F.lit(False).alias("drop"), (note if note is not None else F.lit("")).alias("note"))


def _runs(lines: DataFrame, is_frame: Column, is_sep: Column | None) -> DataFrame:
    """``_run`` = run id of frame lines (null elsewhere)."""
    breaker = ~is_frame if is_sep is None else (~is_frame & ~is_sep)
    df = lines.withColumn("_isf", is_frame).withColumn("_brk", breaker.cast("int"))
    df = df.withColumn("_seg", F.sum("_brk").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("_run", F.when(F.col("_isf"), F.col("_seg")))


@dataclass(frozen=True)
class StackLanguage:
    """One runtime's stack conventions (regexes use numbered groups)."""

    name: str
    priority: int
    probe_pattern: str
    frame_pattern: str                 # groups: see file_group / line_group / function_group / column_group
    file_group: int = 1
    line_group: int = 2
    function_group: int = 0            # 0 = none
    column_group: int = 0
    run_separator_pattern: str = ""
    framework_paths: tuple[str, ...] = ()
    bug_site: str = "top"
    function_on_previous_line: bool = False
    cause_pattern: str = ""            # groups: 1 = class, 2 = message
    cause_position: str = "above"
    cause_lookback: int = 8
    top_confidence: float = 0.85
    confidence_decay: float = 0.10
    min_confidence: float = 0.55
    fallback_confidence: float = 0.45
    top_boost: int = 3
    frame_boost: int = 2
    cause_boost: int = 2


class GenericStackDetector:
    """E2 interpreter: a ``StackLanguage`` compiled into one window plan."""

    def __init__(self, lang: StackLanguage):
        self.lang = lang
        self.name = lang.name
        self.priority = lang.priority

    def activates(self, line: Column) -> Column:
        return line.rlike(P.J("(?m)" + self.lang.probe_pattern))

    def contribute(self, lines: DataFrame, reuse=lambda d: d):
        g = self.lang
        fr = P.J(g.frame_pattern)
        is_frame = F.col("raw").rlike(fr)
        sep = F.col("raw").rlike(P.J(g.run_separator_pattern)) if g.run_separator_pattern else None
        df = _runs(lines, is_frame, sep)
        # Cause search (J10): nearest matching non-blank line within the lookback.
        if g.cause_pattern:
            cx = P.J(g.cause_pattern)
            cm = (F.col("text") != "") & F.col("text").rlike(cx)
            cs = F.when(cm, F.struct(F.col("idx").alias("i"), F.trim(F.regexp_extract("text", cx, 1)).alias("cls"),
                                     F.substring(F.trim(F.regexp_extract("text", cx, 2)), 1, 160).alias("msg")))
            if g.cause_position == "above":
                df = df.withColumn("_cz", F.last(cs, ignorenulls=True).over(_w().rowsBetween(-g.cause_lookback, -1)))
            else:
                df = df.withColumn("_cz", F.first(cs, ignorenulls=True).over(_w().rowsBetween(1, g.cause_lookback)))
        else:
            df = df.withColumn("_cz", F.lit(None).cast("struct<i:int,cls:string,msg:string>"))
        # Function from the first non-blank line above (J12), for Go-style frames.
        above = F.coalesce(*[F.when(F.lag("text", k).over(_w()) != "", F.lag("text", k).over(_w())) for k in (1, 2, 3)])
        fn_above = F.when(above.contains(".") & above.contains("("), F.trim(F.substring_index(above, "(", 1))).otherwise(F.lit(""))
        df = df.withColumn("_fnabove", fn_above if g.function_on_previous_line else F.lit(""))
        fr_df = df.filter(F.col("_isf"))
        file = F.trim(F.regexp_extract("raw", fr, g.file_group))
        line = F.regexp_extract("raw", fr, g.line_group)
        fn = F.trim(F.regexp_extract("raw", fr, g.function_group)) if g.function_group else F.lit("")
        col = F.regexp_extract("raw", fr, g.column_group) if g.column_group else F.lit("")
        fr_df = fr_df.select(
            LOG, "idx", "_run", "_cz", file.alias("_file"),
            F.when(line == "", 0).otherwise(line.cast("int")).alias("_line"),
            F.when(fn != "", fn).otherwise(F.col("_fnabove")).alias("_fn"),
            F.when(col == "", 0).otherwise(col.cast("int")).alias("_col"))
        fw = (F.col("_file") == "") | _any_contains(F.col("_file"), g.framework_paths)
        fr_df = fr_df.withColumn("_proj", ~fw)
        order = F.col("idx") if g.bug_site == "top" else -F.col("idx")
        wr = Window.partitionBy(LOG, "_run").orderBy(order)
        anchor_pos = "_top" if g.cause_position == "above" else "_bot"
        fr_df = (fr_df.withColumn("_top", F.min("idx").over(Window.partitionBy(LOG, "_run")))
                 .withColumn("_bot", F.max("idx").over(Window.partitionBy(LOG, "_run"))))
        cause = F.max(F.when(F.col("idx") == F.col(anchor_pos), F.col("_cz"))).over(Window.partitionBy(LOG, "_run"))
        fr_df = fr_df.withColumn("_cause", cause)
        fr_df = fr_df.withColumn("_poff", F.sum(F.col("_proj").cast("int")).over(wr.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        fr_df = reuse(fr_df.withColumn("_nproj", F.sum(F.col("_proj").cast("int")).over(Window.partitionBy(LOG, "_run"))))
        first_proj = F.col("_proj") & (F.col("_poff") == 0)
        cls, msg = F.coalesce(F.col("_cause.cls"), F.lit("")), F.coalesce(F.col("_cause.msg"), F.lit(""))
        message = F.when(cls != "", F.regexp_replace(F.concat(cls, F.lit(": "), msg), r"[: ]+$", "")).otherwise(
            F.when(F.col("_fn") != "", F.col("_fn")).otherwise(F.col("_file")))
        conf = _confidence(F.col("_poff"), F.col("_file"), F.col("_line"), g.top_confidence, g.confidence_decay, g.min_confidence)
        proj = fr_df.filter(F.col("_proj"))
        locs_p = proj.select(*location(F.col(LOG), self.name, "source", file=F.col("_file"), line=F.col("_line"),
                                       column=F.col("_col"), function=F.col("_fn"), confidence=conf,
                                       log_line_idx=F.col("idx"), message=message), F.col("idx").alias("_seq"))
        note = F.when(first_proj & (cls != ""), F.concat(F.lit("<-- "), cls, F.when(msg != "", F.concat(F.lit(": "), msg)).otherwise(F.lit("")))).otherwise(F.lit(""))
        marks_p = _marks(proj, self.name, F.when(first_proj, g.top_boost).otherwise(g.frame_boost), F.lit(True), note)
        # Framework-only runs: one fallback location on the bug-site frame.
        site = F.col("_top") if g.bug_site == "top" else F.col("_bot")
        fb = fr_df.filter((F.col("_nproj") == 0) & (F.col("idx") == site))
        locs_f = fb.select(*location(F.col(LOG), self.name, "source", file=F.col("_file"), line=F.col("_line"),
                                     function=F.col("_fn"), confidence=F.lit(g.fallback_confidence), log_line_idx=F.col("idx"),
                                     message=F.when(cls != "", cls).otherwise(F.lit("framework-internal stack"))), F.col("idx").alias("_seq"))
        marks_f = _marks(fb, self.name, F.lit(1), F.lit(True))
        # Cause lines: boost and keep (once per run that found it).
        cz = fr_df.filter((F.col("idx") == F.col(anchor_pos)) & F.col("_cause").isNotNull()).select(LOG, F.col("_cause.i").alias("idx"))
        marks_c = _marks(cz, self.name, F.lit(g.cause_boost), F.lit(True))
        return marks_p.unionByName(marks_f).unionByName(marks_c), locs_p.unionByName(locs_f)


class JavaStackDetector:
    """Java/Kotlin/Scala frames; topmost project frame wins."""

    name = "java_stack"
    priority = 50

    def activates(self, line: Column) -> Column:
        return line.rlike(P.J(JAVA_PROBE))

    def contribute(self, lines: DataFrame, reuse=lambda d: d):
        fr = P.J(JAVA_FRAME)
        df = _runs(lines, F.col("raw").rlike(fr), None)
        cx = P.J(JAVA_CAUSE)
        # Message: text after the first colon that follows the cause match.
        df = (df.withColumn("_jm0", F.regexp_extract("text", cx, 0))
              .withColumn("_jend", F.expr("locate(_jm0, text) + length(_jm0)"))
              .withColumn("_jcol", F.expr("locate(':', text, _jend)")))
        cmsg = F.when(F.col("_jcol") > 0, F.substring(F.trim(F.expr("substring(text, _jcol + 1)")), 1, 120)).otherwise(F.lit(""))
        cs = F.when((F.col("text") != "") & F.col("text").rlike(cx),
                    F.struct(F.col("idx").alias("i"), F.regexp_extract("text", cx, 1).alias("cls"), cmsg.alias("msg")))
        df = df.withColumn("_cz", F.last(cs, ignorenulls=True).over(_w().rowsBetween(-JAVA_CAUSE_LOOKBACK, -1)))
        f = df.filter(F.col("_isf"))
        module = F.regexp_extract("raw", fr, 1)
        fqcn = F.regexp_extract("raw", fr, 2)
        details = F.regexp_extract("raw", fr, 3)
        f = f.select(LOG, "idx", "_run", "_cz", module.alias("_mod"), fqcn.alias("_fq"), details.alias("_det"))
        dt = F.trim(F.col("_det"))
        known = ~F.col("_det").isin("", "Native Method", "Unknown Source") & dt.rlike(P.J(JAVA_FILE_LINE))
        file = F.when(known, F.regexp_extract(dt, P.J(JAVA_FILE_LINE), 1)).otherwise(F.lit(""))
        ln = F.regexp_extract(dt, P.J(JAVA_FILE_LINE), 2)
        line = F.when(known & (ln != ""), ln.cast("int")).otherwise(F.lit(0))
        dot = F.length("_fq") - F.locate(".", F.reverse(F.col("_fq"))) + 1  # 1-based position of the last dot
        has_dot = F.locate(".", F.col("_fq")) > 0
        cls_ = F.when(has_dot, F.substring(F.col("_fq"), F.lit(1), dot - 1)).otherwise(F.lit(""))
        method = F.when(has_dot, F.expr("substring(_fq, length(_fq) - locate('.', reverse(_fq)) + 2)")).otherwise(F.col("_fq"))
        f = f.withColumn("_file", file).withColumn("_line", line).withColumn("_cls", cls_).withColumn("_meth", method)
        mod = F.col("_mod")
        fw = ((mod != "") & (mod.isin(*JAVA_FRAMEWORK_MODULES) | (mod.startswith("java.") & ~mod.startswith("java.user."))))
        fw = fw | _any_startswith(F.col("_fq"), JAVA_FRAMEWORK_PREFIXES)
        f = f.withColumn("_proj", ~fw)
        wa = Window.partitionBy(LOG, "_run")
        f = (f.withColumn("_top", F.min("idx").over(wa))
             .withColumn("_cause", F.max(F.when(F.col("idx") == F.col("_top"), F.col("_cz"))).over(wa))
             .withColumn("_poff", F.sum(F.col("_proj").cast("int")).over(Window.partitionBy(LOG, "_run").orderBy("idx")
                                                                        .rowsBetween(Window.unboundedPreceding, 0)) - 1)
             .withColumn("_nproj", F.sum(F.col("_proj").cast("int")).over(wa)))
        f = reuse(f)
        disp = F.when(F.col("_mod") != "", F.concat(F.col("_mod"), F.lit("/"), F.col("_cls"))).otherwise(F.col("_cls"))
        function = F.when(disp != "", F.concat(disp, F.lit("."), F.col("_meth"))).otherwise(F.col("_meth"))
        cls, msg = F.coalesce(F.col("_cause.cls"), F.lit("")), F.coalesce(F.col("_cause.msg"), F.lit(""))
        message = F.when(cls != "", F.regexp_replace(F.concat(cls, F.lit(": "), msg), r"[: ]+$", "")).otherwise(
            F.when(F.col("_meth") != "", F.col("_meth")).otherwise(F.col("_fq")))
        first_proj = F.col("_proj") & (F.col("_poff") == 0)
        proj = f.filter(F.col("_proj"))
        locs_p = proj.select(*location(F.col(LOG), self.name, "source", file=F.col("_file"), line=F.col("_line"), function=function,
                                       confidence=_confidence(F.col("_poff"), F.col("_file"), F.col("_line")),
                                       log_line_idx=F.col("idx"), message=message), F.col("idx").alias("_seq"))
        marks_p = _marks(proj, self.name, F.when(first_proj, 3).otherwise(2), F.lit(True),
                         F.when(first_proj & (cls != ""), F.concat(F.lit("<-- "), cls)).otherwise(F.lit("")))
        fb = f.filter((F.col("_nproj") == 0) & (F.col("idx") == F.col("_top")))
        fb_fn = F.concat(F.when(F.col("_mod") != "", F.concat(F.col("_mod"), F.lit("/"), F.col("_cls"))).otherwise(F.col("_cls")),
                         F.lit("."), F.col("_meth"))
        locs_f = fb.select(*location(F.col(LOG), self.name, "source", file=F.col("_file"), line=F.col("_line"), function=fb_fn,
                                     confidence=F.lit(0.45), log_line_idx=F.col("idx"),
                                     message=F.when(cls != "", cls).otherwise(F.lit("framework-internal stack"))), F.col("idx").alias("_seq"))
        marks_f = _marks(fb, self.name, F.lit(1), F.lit(False))
        cz = f.filter((F.col("idx") == F.col("_top")) & F.col("_cause").isNotNull()).select(LOG, F.col("_cause.i").alias("idx"))
        marks_c = _marks(cz, self.name, F.lit(2), F.lit(True))
        return marks_p.unionByName(marks_f).unionByName(marks_c), locs_p.unionByName(locs_f)


class PythonTracebackDetector:
    """Tracebacks split at start markers; the bottom project frame wins."""

    name = "python_traceback"
    priority = 50

    def activates(self, line: Column) -> Column:
        return line.rlike(P.J(PY_PROBE))

    def contribute(self, lines: DataFrame, reuse=lambda d: d):
        fr = P.J(PY_FRAME)
        is_frame = F.col("raw").rlike(fr)
        is_start = (F.col("text") != "") & F.col("text").rlike(P.J(PY_START))
        wl = Window.partitionBy(LOG)
        df = (lines.withColumn("_isf", is_frame).withColumn("_iss", is_start)
              .withColumn("_fs", F.min(F.when(F.col("_iss"), F.col("idx"))).over(wl))
              .withColumn("_ff", F.min(F.when(F.col("_isf"), F.col("idx"))).over(wl)))
        implicit = F.col("_isf") & (F.col("idx") == F.col("_ff")) & (F.col("_fs").isNull() | (F.col("_ff") < F.col("_fs")))
        df = df.withColumn("_st", (F.col("_iss") | implicit).cast("int"))
        df = df.withColumn("_run", F.sum("_st").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
        df = df.filter(F.col("_run") > 0)
        wr = Window.partitionBy(LOG, "_run")
        df = (df.withColumn("_hi", F.max("idx").over(wr) + 1)
              .withColumn("_lastf", F.max(F.when(F.col("_isf"), F.col("idx"))).over(wr))
              .filter(F.col("_lastf").isNotNull()))
        sx = P.J(PY_SUMMARY)
        summ = (F.col("idx") > F.greatest(F.col("_lastf"), F.col("_hi") - (PY_SUMMARY_WINDOW + 1))) & (F.col("text") != "") & F.col("text").rlike(sx)
        df = df.withColumn("_sum", F.max(F.when(summ, F.struct(F.col("idx").alias("i"), F.regexp_extract("text", sx, 1).alias("cls"),
                                                               F.substring(F.trim(F.regexp_extract("text", sx, 2)), 1, 160).alias("msg")))).over(wr))
        nxt_text = F.lead("text", 1).over(_w())
        nxt_frame = F.lead("_isf", 1).over(_w())
        df = df.withColumn("_next_ok", (F.col("idx") + 1 < F.col("_hi")) & F.coalesce(nxt_text != "", F.lit(False)) & ~F.coalesce(nxt_frame, F.lit(True)))
        f = df.filter(F.col("_isf")).select(
            LOG, "idx", "_run", "_sum", "_next_ok", F.regexp_extract("raw", fr, 1).alias("_file"),
            F.regexp_extract("raw", fr, 2).cast("int").alias("_line"), F.regexp_extract("raw", fr, 3).alias("_fn"))
        fw = (F.col("_file") == "") | _any_contains(F.col("_file"), PY_FRAMEWORK_HINTS)
        f = f.withColumn("_proj", ~fw)
        wf = Window.partitionBy(LOG, "_run")
        f = (f.withColumn("_nf", F.count(F.lit(1)).over(wf))
             .withColumn("_pos", F.row_number().over(wf.orderBy("idx")) - 1)
             .withColumn("_botp", F.max(F.when(F.col("_proj"), F.col("idx"))).over(wf))
             .withColumn("_lastf", F.max("idx").over(wf)))
        f = reuse(f)
        depth = F.col("_nf") - 1 - F.col("_pos")
        is_bot = F.col("idx") == F.col("_botp")
        conf = F.when(is_bot, F.lit(0.85)).otherwise(F.greatest(F.lit(0.55), F.lit(0.85) - 0.10 * (depth + 1)))
        cls, msg = F.coalesce(F.col("_sum.cls"), F.lit("")), F.coalesce(F.col("_sum.msg"), F.lit(""))
        message = F.when(cls != "", F.regexp_replace(F.concat(cls, F.lit(": "), msg), r"[: ]+$", "")).otherwise(
            F.when(F.col("_fn") != "", F.col("_fn")).otherwise(F.col("_file")))
        proj = f.filter(F.col("_proj"))
        locs_p = proj.select(*location(F.col(LOG), self.name, "source", file=F.col("_file"), line=F.col("_line"), function=F.col("_fn"),
                                       confidence=conf, log_line_idx=F.col("idx"), message=message), F.col("idx").alias("_seq"))
        note = F.when(is_bot & (cls != ""), F.concat(F.lit("<-- "), cls, F.when(msg != "", F.concat(F.lit(": "), msg)).otherwise(F.lit("")))).otherwise(F.lit(""))
        marks_p = _marks(proj, self.name, F.when(is_bot, 3).otherwise(2), F.lit(True), note)
        nxt = proj.filter(F.col("_next_ok")).select(LOG, (F.col("idx") + 1).alias("idx"))
        marks_n = _marks(nxt, self.name, F.lit(1), F.lit(True))
        fb = f.filter(F.col("_botp").isNull() & (F.col("idx") == F.col("_lastf")))
        locs_f = fb.select(*location(F.col(LOG), self.name, "source", file=F.col("_file"), line=F.col("_line"), function=F.col("_fn"),
                                     confidence=F.lit(0.45), log_line_idx=F.col("idx"),
                                     message=F.when(cls != "", cls).otherwise(F.lit("framework-internal traceback"))), F.col("idx").alias("_seq"))
        marks_f = _marks(fb, self.name, F.lit(1), F.lit(False))
        sm = f.filter(F.col("_pos") == 0).filter(F.col("_sum").isNotNull()).select(LOG, F.col("_sum.i").alias("idx"))
        marks_s = _marks(sm, self.name, F.lit(2), F.lit(True))
        return marks_p.unionByName(marks_n).unionByName(marks_f).unionByName(marks_s), locs_p.unionByName(locs_f)


# The Node and Go stack languages.
NODE = StackLanguage(
    name="node_stack", priority=50,
    probe_pattern=r"^\s+at\s+(?:async\s+)?\S+\s*\([^)]+:\d+:\d+\)",
    frame_pattern=r"^\s+at\s+(?:(?:async\s+)?([\w$.<>\[\] ]+)\s+)?\(?([^():\n]+):(\d+):(\d+)\)?\s*$",
    function_group=1, file_group=2, line_group=3, column_group=4,
    run_separator_pattern=r"^\s+at\s+\S",
    framework_paths=("/node_modules/", "\\node_modules\\", "node:internal", "node:fs", "node:events", "node:async_hooks",
                     "internal/process/", "internal/modules/", "internal/main/"),
    bug_site="top",
    cause_pattern=r"^((?:[\w$.]+\.)*[A-Z]\w*(?:Error|Exception))(?::\s*(.*))?$",
    cause_position="above", cause_lookback=6,
)
GO = StackLanguage(
    name="go_panic", priority=50,
    probe_pattern=r"^\s+\S+\.go:\d+(?:\s+\+0x[0-9a-f]+)?\s*$",
    frame_pattern=r"^\s+(\S+\.go):(\d+)(?:\s+\+0x[0-9a-f]+)?\s*$",
    file_group=1, line_group=2,
    run_separator_pattern=(r"^(?:\(\*?[\w.]+\)|[\w./]+)\.[\w$]+\([^)]*\)\s*$"
                           r"|^goroutine\s+\d+\s+\["
                           r"|^\s+\S+\.go:\d+"
                           r"|^created\s+by\s+\S+\.\S+"),
    framework_paths=("/usr/local/go/src/", "/usr/lib/go/src/", "/go/pkg/mod/", "/go/src/runtime/", "runtime/proc.go",
                     "runtime/asm_", "runtime/panic.go", "runtime/signal_", "runtime/sigqueue.go"),
    bug_site="top", function_on_previous_line=True,
    cause_pattern=r"^(panic|fatal error|runtime error):\s*(.*)$",
    cause_position="above", cause_lookback=12,
)

register(JavaStackDetector())
register(PythonTracebackDetector())
register(GenericStackDetector(NODE))
register(GenericStackDetector(GO))
