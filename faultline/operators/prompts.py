"""Batch prompt and reply tables.

LLM calls themselves are out of scope; these helpers build the inputs of an
offline inference job and post-process its outputs, one row per session or
message. Prompt templates are data supplied by the caller (``{field}``
placeholders), not part of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reply heading and preamble-noise rules.
FIX_HEADING = r"(?im)^(?:#{1,6}\s*|\d+\.\s*\**)Step[-\s]?by[-\s]?Step\s+Fix\**"
SIMILARITY_PCT = r"similarity\s*\d+\s*%"
EXACT_MATCH_HEAD = r"(?is)^(?:#+\s*)?(?:\*\*)?\s*exact\s+match\s+found\b"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_reply(content: Column) -> Column:
    """struct(analysis, suggested_fix) split at the first Step-by-Step Fix heading."""
    c = F.coalesce(content, F.lit(""))
    pos = F.regexp_instr(c, F.lit(FIX_HEADING))
    return F.struct(
        F.when(pos > 0, _strip(F.substring(c, F.lit(1), pos - 1))).otherwise(_strip(c)).alias("analysis"),
        F.when(pos > 0, _strip(F.substring(c, pos, F.length(c)))).otherwise(F.lit("")).alias("suggested_fix"),
    )


def _is_noise(candidate: Column) -> Column:
    cl = F.lower(candidate)
    pct = cl.rlike(SIMILARITY_PCT)
    return ((cl.contains("exact match") & (cl.contains("similarity") | candidate.contains("%")))
            | cl.contains("returning previously accepted")
            | (pct & (cl.contains("match") | cl.contains("returning") | cl.contains("accepted")))
            | candidate.rlike(EXACT_MATCH_HEAD))


def strip_preamble(df: DataFrame, col: str, out: str = "stripped", rounds: int | None = None) -> DataFrame:
    """Drop the leading paragraphs that announce retrieval or match status.

    All of them, or ``rounds`` at most. Paragraphs are parted by blank lines.
    """
    parts = F.split(_strip(F.coalesce(F.col(col), F.lit(""))), "\n\n", -1)
    df = df.withColumn("_p", F.transform(parts, lambda p: F.struct(p.alias("p"), _strip(p).alias("c"))))
    noise = F.transform("_p", lambda x: (x["c"] == "") | _is_noise(x["c"]))
    # paragraphs before the first that is kept; blank ones don't count as rounds, they are the rest's white space
    if rounds is not None:
        seen = F.transform("_p", lambda x, i: F.size(F.filter(F.slice("_p", 1, i), lambda y: y["c"] != "")))
        noise = F.zip_with(noise, seen, lambda n, k: n & (k < rounds))
    first = F.array_position(F.transform(noise, lambda n: ~n), True)
    rest = F.when(first > 0, F.slice("_p", first.cast("int"), F.size("_p"))).otherwise(F.slice("_p", 1, 0))
    return df.withColumn(out, _strip(F.array_join(F.transform(rest, lambda x: x["p"]), "\n\n"))).drop("_p")


def fill_prompt(template: str, **fields: Column) -> Column:
    """Replace ``{name}`` placeholders of ``template`` with column values."""
    out = F.lit(template)
    for name, col in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col.cast("string"), F.lit("")))
    return out


def excerpt(filtered: Column, raw: Column, use_full_log: bool = False, max_chars: int | None = None) -> Column:
    """Raw log when asked for and present, else the filtered one; cut only if ``max_chars`` is given."""
    src = F.when(F.lit(use_full_log) & (F.coalesce(raw, F.lit("")) != ""), raw).otherwise(F.coalesce(filtered, F.lit("")))
    return src if max_chars is None else F.substring(src, 1, max_chars)


def chat_context(sessions: DataFrame, messages: DataFrame, system_prompt: str = "", use_full_log: bool = False) -> DataFrame:
    """Chat input rows per session: seq 0 is the system message with the session
    context, then the stored messages oldest first (roles other than assistant /
    system become user). One row per message, no per-session collection."""
    cap_excerpt = excerpt(F.col("filtered_logs"), F.col("raw_logs") if "raw_logs" in sessions.columns else F.lit(None).cast("string"), use_full_log)
    label = "Raw log excerpt" if use_full_log else "Filtered log excerpt"
    job, build, stage = F.coalesce(F.col("job_full_name"), F.lit("")), F.coalesce(F.col("build_number"), F.lit(0)), F.coalesce(F.col("stage_name"), F.lit(""))
    parts = F.array_compact(F.array(
        F.when((job != "") | (build != 0), F.format_string("Job: %s #%d  stage: %s", job, build, stage)),
        F.when(F.coalesce(F.col("analysis"), F.lit("")) != "", F.concat(F.lit("## Original Analysis\n"), F.col("analysis"))),
        F.when(F.coalesce(F.col("suggested_fix"), F.lit("")) != "", F.concat(F.lit("## Suggested Fix\n"), F.col("suggested_fix"))),
        F.when(F.coalesce(F.col("fingerprint"), F.lit("")) != "", F.concat(F.lit("Fingerprint:\n"), F.col("fingerprint"))),
        F.when(_strip(cap_excerpt) != "", F.concat(F.lit(label + ":\n"), cap_excerpt)),
    ))
    ctx = F.array_join(parts, "\n\n")
    sys_text = F.concat(F.lit(system_prompt.strip()), F.when(ctx != "", F.concat(F.lit("\n\n"), ctx)).otherwise(F.lit("")))
    sys_rows = sessions.select(F.col("id").alias("session_id"), F.lit(0).alias("seq"), F.lit("system").alias("role"), sys_text.alias("content"))
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    role = F.when(F.col("role").isin("assistant", "system"), F.col("role")).otherwise(F.lit("user"))
    msg = (messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
           .select("session_id", F.row_number().over(w).alias("seq"), role.alias("role"), F.coalesce(F.col("content"), F.lit("")).alias("content")))
    return sys_rows.unionByName(msg)


def source_counts(sessions: DataFrame) -> DataFrame:
    """0/1 flags of non-blank filtered logs, analysis and fix per session."""
    def nb(c):
        return (F.coalesce(F.col(c), F.lit("")) != "").cast("int")
    return sessions.select("id", nb("filtered_logs").alias("ci_logs"), nb("analysis").alias("analyses"), nb("suggested_fix").alias("solutions"))
