"""Batch prompt / reply queries over sessions and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prompts as PR
from ..operators import similarity as SIM
from ..sources import adapters as A
from ..sources.adapters import with_adapters
from .catalog import register

# A caller-supplied template table (our own wording; the library ships none).
TEMPLATES = {
    "fresh_analysis": "Job {job_name} #{build_number}, stage {stage_name}.\n{filtered_logs}",
    "verified_past_solution": "Job {job_name} #{build_number}, stage {stage_name}.\n{filtered_logs}\nPast: {past_fingerprint}",
}


@register("a18_chat_sources", oracle=with_adapters("""
SELECT id, CAST(coalesce(filtered_logs, '') <> '' AS INTEGER) AS ci_logs, CAST(coalesce(analysis, '') <> '' AS INTEGER) AS analyses,
       CAST(coalesce(suggested_fix, '') <> '' AS INTEGER) AS solutions FROM sessions""", "sessions"))
def a18_chat_sources(spark, sf_dir):
    return PR.source_counts(A.sessions(spark, sf_dir))


@register("j6_chat_context", oracle=with_adapters("""
SELECT session_id, seq, role, CASE WHEN ctx <> '' THEN chr(10) || chr(10) || ctx ELSE '' END AS content FROM (
SELECT id AS session_id, 0 AS seq, 'system' AS role,
       array_to_string(list_filter([
         CASE WHEN coalesce(job_full_name, '') <> '' OR coalesce(build_number, 0) <> 0 THEN printf('Job: %s #%d  stage: %s', coalesce(job_full_name, ''), coalesce(build_number, 0), coalesce(stage_name, '')) END,
         CASE WHEN coalesce(analysis, '') <> '' THEN '## Original Analysis' || chr(10) || analysis END,
         CASE WHEN coalesce(suggested_fix, '') <> '' THEN '## Suggested Fix' || chr(10) || suggested_fix END,
         CASE WHEN coalesce(fingerprint, '') <> '' THEN 'Fingerprint:' || chr(10) || fingerprint END,
         CASE WHEN trim(coalesce(filtered_logs, '')) <> '' THEN 'Filtered log excerpt:' || chr(10) || coalesce(filtered_logs, '') END
       ], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS ctx
FROM sessions WHERE id IN (SELECT session_id FROM messages))
UNION ALL
SELECT m.session_id, CAST(row_number() OVER (PARTITION BY m.session_id ORDER BY m.created_at, m.id) AS INTEGER),
       CASE WHEN m.role IN ('assistant', 'system') THEN m.role ELSE 'user' END, coalesce(m.content, '')
FROM messages m WHERE m.session_id IN (SELECT id FROM sessions)
""", "sessions", "messages"))
def j6_chat_context(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    m = A.messages(spark, sf_dir)
    with_msgs = s.join(m.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
    out = PR.chat_context(with_msgs, m)
    return out.withColumn("seq", F.col("seq").cast("int"))


@register("x24_reply_split", oracle=with_adapters(r"""
, a AS (
  SELECT conv_id, turn, text, regexp_extract(text, '(?ims)^(.*?)(?:^(?:#{1,6}\s*|\d+\.\s*\**)Step[-\s]?by[-\s]?Step\s+Fix\**)', 1) AS pre,
         regexp_matches(text, '(?im)^(?:#{1,6}\s*|\d+\.\s*\**)Step[-\s]?by[-\s]?Step\s+Fix\**') AS hit
  FROM replies
)
SELECT conv_id, turn,
       regexp_replace(CASE WHEN hit THEN pre ELSE text END, '^\s+|\s+$', '', 'g') AS analysis,
       CASE WHEN hit THEN regexp_replace(substr(text, length(pre) + 1), '^\s+|\s+$', '', 'g') ELSE '' END AS suggested_fix
FROM a""", "replies"))
def x24_reply_split(spark, sf_dir):
    cv = A.replies(spark, sf_dir)
    sp = PR.split_reply(F.col("text"))
    return cv.select("conv_id", "turn", sp["analysis"].alias("analysis"), sp["suggested_fix"].alias("suggested_fix"))


def _preamble_sql() -> str:
    strip = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    noise = ("((strpos(lower(c), 'exact match') > 0 AND (strpos(lower(c), 'similarity') > 0 OR strpos(c, '%') > 0))"
             " OR strpos(lower(c), 'returning previously accepted') > 0"
             " OR (regexp_matches(lower(c), 'similarity\\s*\\d+\\s*%') AND (strpos(lower(c), 'match') > 0 OR strpos(lower(c), 'returning') > 0 OR strpos(lower(c), 'accepted') > 0))"
             " OR regexp_matches(c, '(?is)^(?:#+\\s*)?(?:\\*\\*)?\\s*exact\\s+match\\s+found\\b'))")
    return f"""
, s AS (SELECT conv_id, turn, text, string_split({strip.format(x="coalesce(text, '')")}, chr(10) || chr(10)) AS ps
           FROM replies),
p AS (SELECT conv_id, turn, k, ps[k] AS p, {strip.format(x='ps[k]')} AS c FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM s)),
f AS (SELECT conv_id, turn, min(k) AS k FROM p WHERE NOT (c = '' OR {noise}) GROUP BY ALL)
SELECT s.conv_id, s.turn, length(text) AS chars,
       length(coalesce({strip.format(x="array_to_string(ps[f.k:], chr(10) || chr(10))")}, '')) AS kept_chars
FROM s LEFT JOIN f ON f.conv_id = s.conv_id AND f.turn = s.turn"""


@register("x25_preamble_strip", oracle=with_adapters(_preamble_sql(), "replies"))
def x25_preamble_strip(spark, sf_dir):
    cv = A.replies(spark, sf_dir)
    return PR.strip_preamble(cv, "text").select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"),
                                                F.length("stripped").cast("bigint").alias("kept_chars"))


def _fill_sql(template: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, col in (("job_name", "job_full_name"), ("build_number", "CAST(build_number AS VARCHAR)"), ("stage_name", "stage_name"),
                      ("filtered_logs", "filtered_logs"), ("past_fingerprint", "fingerprint")):
        out = f"replace({out}, '{{{name}}}', coalesce({col}, ''))"
    return out.replace(chr(10), "' || chr(10) || '")


@register("x26_prompt_fill", oracle=with_adapters(f"""
SELECT id, CASE WHEN coalesce(match_score, 0.0) >= 0.75 THEN 'verified_past_solution' ELSE 'fresh_analysis' END AS route,
       CASE WHEN coalesce(match_score, 0.0) >= 0.75 THEN {_fill_sql(TEMPLATES['verified_past_solution'])} ELSE {_fill_sql(TEMPLATES['fresh_analysis'])} END AS prompt
FROM sessions""", "sessions"))
def x26_prompt_fill(spark, sf_dir):
    s = A.sessions(spark, sf_dir)
    route = SIM.route(F.col("match_score"), 0.75)
    fields = dict(job_name=F.col("job_full_name"), build_number=F.col("build_number"), stage_name=F.col("stage_name"),
                  filtered_logs=PR.excerpt(F.col("filtered_logs"), F.lit(None).cast("string")), past_fingerprint=F.col("fingerprint"))
    prompt = F.when(route == "verified_past_solution", PR.fill_prompt(TEMPLATES["verified_past_solution"], **fields)).otherwise(
        PR.fill_prompt(TEMPLATES["fresh_analysis"], **fields))
    return s.select("id", route.alias("route"), prompt.alias("prompt"))
