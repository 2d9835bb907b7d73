"""Detector phase (E1-E4, U3, W20) and the always-on shell detector (E3e, J11).

A detector is a plain object with ``name``, ``priority``, ``activates(line)``
(a Column predicate over one raw line; any line of the log may activate it) and
``contribute(lines)`` returning two long tables::

    marks(log_id, idx, detector, delta int, keep bool, drop bool, note string)
    locations(log_id, detector, kind, file, line, column, function, test_name,
              command, confidence, log_line_idx, message)

Both are DataFrame -> DataFrame plans; user detectors register the same way. A detector whose predicate or plan
raises is logged and skipped; the others' marks stay.
``run_detectors`` keeps, per log, all detectors that contributed anything (or the
first ``cap`` by priority, when a cap is given), merges their marks order-independently and returns the
updated lines plus the kept locations and per-log detector names.
"""

from __future__ import annotations

import inspect
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

LOG = "log_id"
LOGGER = logging.getLogger(__name__)

MARK_COLS = ["log_id", "idx", "detector", "delta", "keep", "drop", "note"]
LOC_COLS = ["log_id", "detector", "kind", "file", "line", "column", "function", "test_name",
            "command", "confidence", "log_line_idx", "message"]

# Non-zero exit marker of the shell detector (three capture groups).
EXIT_NONZERO = (
    r"(?i)(?:exit|return)\s*(?:code|status)?\s*[:=]?\s*([1-9]\d*)\b|"
    r"script\s+returned\s+exit\s+code\s*([1-9]\d*)|"
    r"process\s+exited\s+with\s+(?:code\s+)?([1-9]\d*)"
)
SHELL_LOOKBACK = 59
TASK_LINES = 100_000


def location(log_id: Column, detector: str, kind: str, *, file=None, line=None, column=None, function=None,
             test_name=None, command=None, confidence=None, log_line_idx=None, message=None) -> list[Column]:
    """Columns of one location row in ``LOC_COLS`` order (defaults as in the reference)."""
    def s(c):
        return F.coalesce(c, F.lit("")) if c is not None else F.lit("")

    def i(c):
        return F.coalesce(c, F.lit(0)).cast("int") if c is not None else F.lit(0)

    return [
        log_id.alias("log_id"), F.lit(detector).alias("detector"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
        s(file).alias("file"), i(line).alias("line"), i(column).alias("column"), s(function).alias("function"),
        s(test_name).alias("test_name"), s(command).alias("command"),
        (confidence if confidence is not None else F.lit(0.0)).cast("double").alias("confidence"),
        (log_line_idx if log_line_idx is not None else F.lit(-1)).cast("int").alias("log_line_idx"),
        s(message).alias("message"),
    ]


@dataclass(frozen=True)
class ShellDetector:
    """E3e: last non-zero exit marker and the command that preceded it."""

    name: str = "generic_shell"
    priority: int = 0

    def activates(self, line: Column) -> Column:
        return F.lit(True)

    def contribute(self, lines: DataFrame, reuse=lambda d: d) -> tuple[DataFrame, DataFrame]:
        live = ~F.col("drop") & (F.col("text") != "")
        rx = P.J(EXIT_NONZERO)
        hit = live & F.col("text").rlike(rx)
        wl = Window.partitionBy(LOG)
        df = lines.withColumn("_exit", F.max(F.when(hit, F.col("idx"))).over(wl))
        df = df.filter(F.col("_exit").isNotNull())
        in_range = (F.col("idx") < F.col("_exit")) & (F.col("idx") >= F.col("_exit") - SHELL_LOOKBACK) & ~F.col("drop")
        is_cmd = in_range & (F.col("kind") == P.KIND_CMD)
        barrier = in_range & ((F.col("kind") == P.KIND_STACK) | (F.col("severity") >= P.SEV_EXIT))
        df = (df.withColumn("_cmd", F.max(F.when(is_cmd, F.col("idx"))).over(wl))
              .withColumn("_bar", F.max(F.when(barrier, F.col("idx"))).over(wl)))
        codes = [F.nullif(F.regexp_extract("text", rx, g), F.lit("")) for g in (1, 2, 3)]
        df = df.withColumn("_code", F.when(F.col("idx") == F.col("_exit"), F.coalesce(*codes, F.lit("1"))))
        cmd_ok = F.col("_cmd").isNotNull() & (F.col("_bar").isNull() | (F.col("_cmd") > F.col("_bar")))
        df = df.withColumn("_cmd_ok", cmd_ok)
        marked = reuse(df.filter((F.col("idx") == F.col("_exit")) | (cmd_ok & (F.col("idx") == F.col("_cmd")))))
        marks = marked.select(LOG, "idx", F.lit(self.name).alias("detector"), F.lit(2).alias("delta"),
                              F.lit(True).alias("keep"), F.lit(False).alias("drop"), F.lit("").alias("note"))
        # One location per log: command (if found) else the exit line itself.
        per_log = marked.groupBy(LOG).agg(
            F.max("_code").alias("_code"), F.max(F.col("_cmd_ok").cast("int")).alias("_ok"),
            F.max(F.when(F.col("idx") == F.col("_cmd"), F.col("text"))).alias("_ctext"),
            F.max("_exit").alias("_exit"), F.max("_cmd").alias("_cmd"))
        ctext = F.substring(F.trim(F.regexp_replace(F.coalesce(F.col("_ctext"), F.lit("")), r"^[+$> ]+", "")), 1, 200)
        is_cmd_loc = F.col("_ok") == 1
        locs = per_log.select(*location(
            F.col(LOG), self.name, F.when(is_cmd_loc, F.lit("command")).otherwise(F.lit("log")),
            command=F.when(is_cmd_loc, ctext),
            confidence=F.when(is_cmd_loc, F.when(ctext != "", 0.55).otherwise(0.40)).otherwise(0.30),
            log_line_idx=F.when(is_cmd_loc, F.col("_cmd")).otherwise(F.col("_exit")),
            message=F.when(is_cmd_loc, F.concat(F.lit("exited with code "), F.col("_code")))
            .otherwise(F.concat(F.lit("non-zero exit ("), F.col("_code"), F.lit(")"))),
        ))
        return marks, locs


def spread(lines: DataFrame, n: int) -> DataFrame:
    """The columns that detectors read of ``n`` lines, whole logs a task, about ``TASK_LINES`` lines in each.

    A task runs all branches of the detectors on its logs and holds their sorts until it ends, so its share is not left to the
    size of the shuffled data.
    """
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_LINES))
    return lines.select(LOG, "idx", "raw", "text", "kind", "severity", "drop").repartition(tasks, LOG)


def run_detectors(lines: DataFrame, detectors, cap: int | None = None,
                  materialize=None, reuse=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run, cap (W20) and merge (U3) detector contributions.

    Returns (lines with merged marks and ``keep``, kept locations, per-log names
    of the detectors that contributed, in priority order). ``materialize``
    (DataFrame -> DataFrame) is applied to the unioned marks and locations, which
    three later branches read.
    """
    materialize = materialize or (lambda d: d)
    reuse = reuse or (lambda d: d)
    dets = sorted(detectors, key=lambda d: -d.priority)  # stable: load order breaks ties
    spark = lines.sparkSession
    if not dets:
        return lines.withColumn("keep", F.lit(False)), _no_locations(spark), _no_names(lines)
    probes = []
    for order, d in enumerate(dets):
        try:
            lines.select(d.activates(F.col("raw")))          # analysed only
            probes.append((order, d))
        except Exception:  # noqa: BLE001
            LOGGER.exception("detector %r failed; skipping", d.name)
    if not probes:
        return lines.withColumn("keep", F.lit(False)), _no_locations(spark), _no_names(lines)
    # A detector that no line of any log activates has nothing to plan (one row of flags and a count reaches the driver).
    n, *flags = lines.agg(F.count(F.lit(1)), *[F.max(d.activates(F.col("raw"))) for _, d in probes]).first()
    asked = [probe for probe, on in zip(probes, flags, strict=True) if on]
    if not asked:
        return lines.withColumn("keep", F.lit(False)), _no_locations(spark), _no_names(lines)
    # Detectors read only these columns: keep their sorts and shuffles narrow.
    narrow = reuse(spread(lines, n))
    all_marks, all_locs = [], []
    for order, d in asked:
        active = F.max(d.activates(F.col("raw"))).over(Window.partitionBy(LOG))
        sub = narrow.withColumn("_active", active).filter("_active").drop("_active")
        hooks = {"reuse": reuse} if "reuse" in inspect.signature(d.contribute).parameters else {}
        try:
            m, loc = d.contribute(sub, **hooks)
            seq = F.col("_seq") if "_seq" in loc.columns else F.lit(0)
            m = m.select(*MARK_COLS).withColumn("_ord", F.lit(order))
            loc = loc.select(*LOC_COLS, seq.alias("_seq")).withColumn("_ord", F.lit(order))
        except Exception:  # noqa: BLE001 - a detector that can't be planned must not cost the others' marks
            LOGGER.exception("detector %r failed; skipping", d.name)
            continue
        all_marks.append(m)
        all_locs.append(loc)
    if not all_marks:
        return lines.withColumn("keep", F.lit(False)), _no_locations(spark), _no_names(lines)
    marks = all_marks[0]
    for m in all_marks[1:]:
        marks = marks.unionByName(m)
    locs = all_locs[0]
    for x in all_locs[1:]:
        locs = locs.unionByName(x)
    marks = materialize(marks)
    locs = materialize(locs)
    contributed = marks.select(LOG, "detector", "_ord").unionByName(locs.select(LOG, "detector", "_ord")).distinct()
    kept = contributed
    if cap is not None:
        kept = (contributed.withColumn("_r", F.row_number().over(Window.partitionBy(LOG).orderBy("_ord")))
                .filter(F.col("_r") <= max(1, int(cap))).select(LOG, "detector", "_ord"))
        marks = marks.join(kept, [LOG, "detector", "_ord"], "left_semi")
        locs = locs.join(kept, [LOG, "detector", "_ord"], "left_semi")
    names = kept.groupBy(LOG).agg(F.sort_array(F.collect_list(F.struct("_ord", "detector"))).alias("_d")).select(
        LOG, F.transform("_d", lambda s: s["detector"]).alias("detectors"))
    merged = marks.groupBy(LOG, "idx").agg(
        F.sum(F.greatest(F.col("delta"), F.lit(0))).cast("int").alias("_delta"),
        F.max(F.col("keep").cast("int")).alias("_keep"),
        F.max(F.col("drop").cast("int")).alias("_mdrop"),
        F.min_by(F.struct("detector", "note"), F.when(F.col("note") != "", F.col("_ord"))).alias("_firstnote"),
        F.min_by("detector", F.when(F.col("drop"), F.col("_ord"))).alias("_dropper"),
    )
    out = lines.join(merged, [LOG, "idx"], "left")
    keep = F.coalesce(F.col("_keep"), F.lit(0)) == 1
    mdrop = (F.coalesce(F.col("_mdrop"), F.lit(0)) == 1) & (F.col("severity") < P.SEV_ERROR)
    out = (out.withColumn("score", F.col("score") + F.coalesce(F.col("_delta"), F.lit(0)))
           .withColumn("reason", F.when(mdrop & ~keep & ~F.col("drop") & (F.col("reason") == ""),
                                        F.concat(F.lit("detector-drop:"), F.col("_dropper"))).otherwise(F.col("reason")))
           .withColumn("drop", (F.col("drop") | mdrop) & ~keep)
           .withColumn("keep", keep)
           .withColumn("note", F.when((F.col("note") == "") & F.col("_firstnote.note").isNotNull() & (F.col("_firstnote.note") != ""),
                                      F.col("_firstnote.note")).otherwise(F.col("note")))
           .drop("_delta", "_keep", "_mdrop", "_firstnote", "_dropper"))
    return out, locs, names


def _no_locations(spark) -> DataFrame:
    return spark.createDataFrame([], _loc_schema() + ", _seq int, _ord int")


def _no_names(lines: DataFrame) -> DataFrame:
    return lines.select(LOG).distinct().withColumn("detectors", F.array().cast("array<string>"))


def _loc_schema() -> str:
    return ("log_id string, detector string, kind string, file string, line int, column int, function string, "
            "test_name string, command string, confidence double, log_line_idx int, message string")


def load_detectors(selection: str | None = "auto", registry: dict | None = None) -> list:
    """E4: 'auto' = all bundled, 'none' = no detectors, else a comma list (unknown names skipped)."""
    from . import stacks  # noqa: F401  (registers the stack detectors)
    reg = registry if registry is not None else REGISTRY
    if not selection or selection.strip().lower() == "none":
        return []
    sel = selection.strip().lower()
    wanted = list(BUNDLED) if sel == "auto" else [s.strip() for s in sel.split(",") if s.strip()]
    return [reg[n] for n in wanted if n in reg]


REGISTRY: dict = {}
BUNDLED = ("java_stack", "python_traceback", "node_stack", "go_panic", "generic_shell")


def register(det) -> None:
    REGISTRY[det.name] = det


register(ShellDetector())
