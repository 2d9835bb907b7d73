"""Locator, confidence and rendering: lines back to one result row per log.

(A12, W19, K7, X9-X14, W15, K3, A13, A16.) A body is one text: it holds the lines that the
token budget selects, or for a LOW log without any its lines with text. ``body_max_chars`` cuts it, if given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

LOG = "log_id"

# Error-signature patterns of the renderer.
EXCEPTION_LINE = r"\b((?:[\w$]+\.)*[\w$]+(?:Exception|Error|Failure|Fault))\b"
CAUSED_BY = r"(?i)Caused\s+by:\s*(.+)"
ERROR_MARKER = r"(?:^|\s)(?:ERROR|FATAL|SEVERE)\b\s*[:\-]?\s*(.+)"
EXIT_CODE = r"(?i)(?:exit\s+code|returned\s+exit\s+code|process\s+exited\s+with)\s*[:=]?\s*(\d+)"
KIND_RANK = {"source": 5, "test": 4, "command": 3, "log": 2, "unknown": 0}
# Framework hints of the locator (no "sun.reflect." here, unlike the collapser).
LOCATOR_HINTS = ("/site-packages/", "/node_modules/", "/.m2/", "/.gradle/", "/.cargo/", "/usr/lib/",
                 "/usr/local/", "/opt/", "vendor/", "/gems/", "java.base/", "java.lang.", "sun.nio.", "jdk.internal.")
LOW_NO_ANCHOR = "no anchor lines met the minimum score threshold"
LOW_NO_ERROR = "no surviving line scored at ERROR severity or above"
LOW_BANNER = ("---\n[FILTER: LOW CONFIDENCE]\nReason: %s\n"
              "The filter could not localize the failure with confidence. Treat the\n"
              "log below as best-effort raw context — do not invent a root cause.\n---\n")
CEILING_NOTE = "\n... [hard ceiling truncated]"


def _first(rx: str, text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, P.J(rx), 1)), F.lit(""))


def primary_error(body: Column) -> Column:
    """Caused-by, else exception class, else ERROR/FATAL/SEVERE marker, else 'Unknown'."""
    return F.coalesce(_first(CAUSED_BY, body), _first(EXCEPTION_LINE, body), _first(ERROR_MARKER, body), F.lit("Unknown"))


def exit_code(text: Column) -> Column:
    """X11: the first exit code in a text, null without one. The words may lie on two lines."""
    return F.nullif(F.regexp_extract(text, P.J(EXIT_CODE), 1), F.lit(""))


def exception_names(body: Column, n: int = 4) -> Column:
    """First ``n`` distinct short exception class names in order."""
    found = F.regexp_extract_all(body, F.lit(P.J(EXCEPTION_LINE)), 1)
    short = F.transform(found, lambda x: F.element_at(F.split(x, r"\."), -1))
    return F.slice(F.array_distinct(short), 1, n)


def fingerprint(body: Column, stage: Column) -> Column:
    """Root cause / exceptions / error / stage joined by ' | '."""
    caused = _first(CAUSED_BY, body)
    exc = exception_names(body)
    err = _first(ERROR_MARKER, body)
    parts = F.array_compact(F.array(
        F.when(caused.isNotNull(), F.concat(F.lit("root_cause: "), F.substring(caused, 1, 200))),
        F.when(F.size(exc) > 0, F.concat(F.lit("exceptions: "), F.array_join(exc, ", "))),
        F.when(caused.isNull() & err.isNotNull(), F.concat(F.lit("error: "), F.substring(err, 1, 200))),
        F.concat(F.lit("stage: "), F.coalesce(stage, F.lit(""))),
    ))
    return F.array_join(parts, " | ")


def anchor_label(loc: Column) -> Column:
    """One-line label of a location struct."""
    msg = loc["message"]
    has_msg = msg != ""
    sep = F.lit(" -- ")
    src = F.concat(loc["file"], F.lit(":"), loc["line"].cast("string"),
                   F.when(loc["column"] != 0, F.concat(F.lit(":"), loc["column"].cast("string"))).otherwise(F.lit("")))
    head = F.when(loc["function"] != "", F.concat(loc["function"], F.lit(" @ "), src)).otherwise(src)

    def with_msg(h):
        return F.when(has_msg, F.concat(h, sep, msg)).otherwise(h)

    return (F.when(loc.isNull(), F.lit("unknown"))
            .when((loc["kind"] == "source") & (loc["file"] != ""), with_msg(head))
            .when((loc["kind"] == "test") & (loc["test_name"] != ""), with_msg(loc["test_name"]))
            .when((loc["kind"] == "command") & (loc["command"] != ""), with_msg(F.concat(F.lit("$ "), loc["command"])))
            .when((loc["kind"] == "log") & (loc["log_line_idx"] >= 0), with_msg(F.concat(F.lit("line "), loc["log_line_idx"].cast("string"))))
            .when(has_msg, msg).otherwise(F.lit("unknown")))


def _framework(file: Column) -> Column:
    hit = F.lit(False)
    for h in LOCATOR_HINTS:
        hit = hit | file.contains(h)
    return (file != "") & hit


def rank_locations(locs: DataFrame) -> DataFrame:
    """A12 + W19: merge same-place candidates, corroboration boost, rank per log.

    Output: one row per log with ``locations`` (ranked array of structs).
    """
    loc_struct = F.struct("kind", "file", "line", "column", "function", "test_name", "command",
                          "detector", "confidence", "log_line_idx", "message")
    key = ["kind", "file", "line", "test_name"]
    w_first = Window.partitionBy(LOG).orderBy("_ord", "_seq")
    locs = locs.withColumn("_pos", F.row_number().over(w_first))
    g = locs.groupBy(LOG, *key).agg(
        F.max_by(F.struct("column", "function", "command", "log_line_idx", "message", "confidence"),
                 F.struct(F.col("confidence"), -F.col("_pos"))).alias("_rep"),
        F.array_join(F.sort_array(F.collect_set("detector")), ",").alias("detector"),
        F.size(F.collect_set("detector")).alias("_nd"),
        F.min("_pos").alias("_pos"))
    g = g.select(LOG, *key, "_rep.column", "_rep.function", "_rep.command", "_rep.log_line_idx", "_rep.message",
                 "detector", F.least(F.lit(1.0), F.col("_rep.confidence") + 0.10 * (F.col("_nd") - 1)).alias("confidence"), "_pos")
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_RANK.items()], F.lit(0))
    fw = _framework(F.col("file"))
    g = g.withColumn("_fw", fw.cast("int")).withColumn("_krank", rank)
    g = g.withColumn("_has_proj", F.max(((~fw) & (F.col("kind") == "source")).cast("int")).over(Window.partitionBy(LOG)))
    pen = F.when((F.col("_has_proj") == 1) & (F.col("_fw") == 1), 1).otherwise(0)
    g = g.withColumn("_sk", F.struct(pen.alias("p"), (-F.col("_krank")).alias("k"), (-F.col("confidence")).alias("c"),
                                     (-F.col("log_line_idx")).alias("l"), F.col("_pos").alias("o")))
    return g.groupBy(LOG).agg(F.sort_array(F.collect_list(F.struct(F.col("_sk").alias("k"), loc_struct.alias("v")))).alias("_l")).select(
        LOG, F.transform("_l", lambda s: s["v"]).alias("locations"))


def render(lines: DataFrame, locs: DataFrame, names: DataFrame, logs_meta: DataFrame | None = None,
           body_max_chars: int | None = None, with_citation: bool = True) -> DataFrame:
    """One result row per log from selected lines, ranked locations and detector names.

    ``logs_meta`` (optional): log_id, job_name, stage_name and, of whole logs, log_chars and
    log_exit (length and exit code of the raw text). ``with_citation=False``
    gives the legacy plain body (X15): no ``L<idx>:`` prefixes.
    """
    live = ~F.col("drop") & (F.col("text") != "")
    w = Window.partitionBy(LOG).orderBy("idx")
    sel = lines.filter(F.col("selected"))
    gap = F.col("idx") - F.lag("idx").over(w) - 1
    cite = F.concat(F.lit("L"), F.col("idx").cast("string"), F.lit(": ")) if with_citation else F.lit("")
    line_txt = F.concat(cite,
                        F.when(F.col("note") != "", F.when(F.col("text") != "", F.concat(F.col("text"), F.lit("  "), F.col("note"))).otherwise(F.col("note")))
                        .otherwise(F.col("text")))
    piece = F.when(gap > 0, F.concat(F.format_string("... %d line(s) elided ...", gap), F.lit("\n"), line_txt)).otherwise(line_txt)
    bodies = sel.select(LOG, "idx", "severity", piece.alias("_p")).groupBy(LOG).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "_p"))), lambda s: s["_p"]), "\n").alias("_body"),
        F.count(F.lit(1)).alias("selected_count"),
        F.max("severity").alias("_maxsev"))
    # K3 tail excerpt (LOW fallback): lines with text; the newest within half the ceiling where one is given.
    tpiece = F.concat(F.lit("L"), F.col("idx").cast("string"), F.lit(": "), F.col("text"))
    wr = Window.partitionBy(LOG).orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tl = lines.filter(F.col("text") != "").select(LOG, "idx", tpiece.alias("_tp"))
    if body_max_chars is not None:
        tl = tl.withColumn("_run", F.sum(F.length("_tp") + 1).over(wr)).filter(F.col("_run") <= body_max_chars // 2)
    tails = tl.groupBy(LOG).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "_tp"))), lambda s: s["_tp"]), "\n").alias("_tail"))
    # Per-log facts from all lines.
    exit_hit = exit_code(F.col("raw"))
    facts = lines.groupBy(LOG).agg(
        (F.sum(F.length("raw")) + F.count(F.lit(1)) - 1).alias("raw_chars"),
        F.min_by(exit_hit, F.when(exit_hit.isNotNull(), F.col("idx"))).alias("_raw_exit"),
        F.max_by(F.struct("idx", "score", "text"), F.when(live, F.struct(F.col("score"), -F.col("idx")))).alias("_best"),
        *[F.count_if(F.col("drop") & (F.col("reason") == r)).alias(f"_cs_{i}") for i, r in enumerate(P.COLLAPSE_REASONS)],
        F.count_if(F.col("_bdrop")).alias("baseline_dropped"),
        F.count_if(F.col("_bnovel")).alias("baseline_novel"),
        F.first("baseline_version").alias("baseline_version"),
    )
    out = facts.join(bodies, LOG, "left").join(tails, LOG, "left").join(locs, LOG, "left").join(names, LOG, "left")
    if logs_meta is not None:
        out = out.join(logs_meta, LOG, "left")
    else:
        out = out.withColumn("job_name", F.lit("")).withColumn("stage_name", F.lit(""))
    if "log_chars" in out.columns:      # the raw log's own length and code: lines have lost its line ends
        out = out.withColumn("raw_chars", F.col("log_chars")).withColumn("_raw_exit", F.col("log_exit"))
    # Locator fallback (K7) when no detector located anything.
    best = F.col("_best")
    fallback = F.when(best.isNotNull(), F.struct(
        F.lit("log").alias("kind"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("column"),
        F.lit("").alias("function"), F.lit("").alias("test_name"), F.lit("").alias("command"), F.lit("core").alias("detector"),
        F.least(F.lit(0.5), F.lit(0.10) + 0.05 * best["score"]).alias("confidence"), best["idx"].cast("int").alias("log_line_idx"),
        F.substring(best["text"], 1, 140).alias("message")))
    has_locs = F.col("locations").isNotNull() & (F.size("locations") > 0)
    out = out.withColumn("primary_location", F.when(has_locs, F.element_at("locations", 1)).otherwise(fallback))
    out = out.withColumn("locations", F.when(has_locs, F.col("locations")).otherwise(F.when(fallback.isNotNull(), F.array(fallback))))
    # X9 confidence.
    pl = F.col("primary_location")
    n_sel = F.coalesce(F.col("selected_count"), F.lit(0))
    hi_src = pl.isNotNull() & pl["kind"].isin("source", "test") & (pl["confidence"] >= 0.6)
    conf = (F.when(n_sel == 0, F.lit("LOW"))
            .when((F.col("_maxsev") < P.SEV_ERROR) & ~hi_src, F.lit("LOW"))
            .when(pl.isNull() | pl["kind"].isin("unknown", "log"), F.lit("MEDIUM"))
            .when(pl["confidence"] < 0.6, F.lit("MEDIUM")).otherwise(F.lit("HIGH")))
    low_reason = F.when(n_sel == 0, F.lit(LOW_NO_ANCHOR)).when((F.col("_maxsev") < P.SEV_ERROR) & ~hi_src, F.lit(LOW_NO_ERROR)).otherwise(F.lit(""))
    out = out.withColumn("confidence", conf).withColumn("low_confidence_reason", low_reason)
    body = F.coalesce(F.col("_body"), F.lit(""))
    body = F.when(F.col("confidence") == "LOW",
                  F.concat(F.format_string(LOW_BANNER, F.col("low_confidence_reason")),
                           F.when(body != "", body).otherwise(F.coalesce(F.col("_tail"), F.lit(""))))).otherwise(body)
    if body_max_chars is not None:
        body = F.when(F.length(body) > body_max_chars, F.concat(F.substring(body, 1, body_max_chars), F.lit(CEILING_NOTE))).otherwise(body)
    out = out.withColumn("body_text", body)
    bt = F.col("body_text")
    out = (out.withColumn("primary_error", F.when(pl.isNotNull() & (pl["message"] != ""), pl["message"]).otherwise(primary_error(bt)))
           .withColumn("exit_code", F.coalesce(F.col("_raw_exit"), _first(EXIT_CODE, bt), F.lit("N/A")))
           .withColumn("body_chars", F.length(bt))
           .withColumn("body_tokens", F.greatest(F.lit(1), F.floor((F.length(bt) + 3) / 4)).cast("int"))
           .withColumn("detectors", F.coalesce(F.col("detectors"), F.array().cast("array<string>")))
           .withColumn("baseline_version", F.coalesce(F.col("baseline_version"), F.lit("empty")))
           .withColumn("collapse_stats", F.create_map(*[x for i, r in enumerate(P.COLLAPSE_REASONS) for x in (F.lit(r), F.col(f"_cs_{i}").cast("int"))])))
    coll = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"_cs_{i}") > 0, F.format_string("%s=%d", F.lit(r), F.col(f"_cs_{i}")))
        for i, r in sorted(enumerate(P.COLLAPSE_REASONS), key=lambda t: t[1])])), " ")
    ratio = F.when(F.col("raw_chars") > 0, F.round(100.0 * (1.0 - F.col("body_chars") / F.col("raw_chars")), 1)).otherwise(F.lit(0.0))
    header = F.concat(
        F.lit("---\n[METADATA]\n- Primary Error: "), F.col("primary_error"),
        F.lit("\n- Exit Code: "), F.col("exit_code"),
        F.lit("\n- Location: "), anchor_label(pl),
        F.lit("\n- Confidence: "), F.col("confidence"),
        F.lit("\n- Detectors: "), F.when(F.size("detectors") > 0, F.array_join("detectors", ", ")).otherwise(F.lit("none")),
        F.lit("\n- Baseline: "), F.col("baseline_version"),
        F.lit("\n- Collapse: "), F.when(coll != "", coll).otherwise(F.lit("none")),
        F.lit("\n- Compression: "), F.col("raw_chars").cast("string"), F.lit(" -> "), F.col("body_chars").cast("string"),
        F.lit(" chars / ~"), F.col("body_tokens").cast("string"), F.lit(" tokens (~"), F.format_string("%.1f", ratio),
        F.lit("% removed)\n---\n"))
    out = (out.withColumn("body", F.concat(header, bt, F.lit("\n---")))
           .withColumn("fingerprint", fingerprint(bt, F.col("stage_name"))))
    return out.select(
        LOG, "job_name", "stage_name", "body", "fingerprint", "primary_error", "exit_code", "confidence",
        "low_confidence_reason", "primary_location", "locations", "detectors", "baseline_version",
        "baseline_dropped", "baseline_novel", "collapse_stats", "raw_chars", "body_chars", "body_tokens",
        F.coalesce(F.col("selected_count"), F.lit(0)).alias("selected_count"),
    )
