"""Ingest queries over the feed / state / stages / markers / pages / documents adapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import tokenize as T
from ..sources import adapters as A
from ..sources.adapters import with_adapters
from ..sources.tables import read_table
from .catalog import register
from .oracle import q

_FEED_BUILDS_SQL = f""", fb AS (
  SELECT item_id,
         replace(trim(CASE WHEN regexp_matches(title, {q(I.FEED_TITLE)}) THEN regexp_extract(title, {q(I.FEED_TITLE)}, 1)
                      ELSE regexp_extract(trim(title), {q(I.FEED_TITLE_BARE)}, 1) END), ' » ', '/') AS job_full_name,
         CAST(CASE WHEN regexp_matches(title, {q(I.FEED_TITLE)}) THEN regexp_extract(title, {q(I.FEED_TITLE)}, 2)
                   ELSE regexp_extract(trim(title), {q(I.FEED_TITLE_BARE)}, 2) END AS INTEGER) AS build_number,
         rtrim(link, '/') || '/' AS build_url
  FROM feed
  WHERE trim(title) <> '' AND trim(link) <> ''
    AND (regexp_matches(title, {q(I.FEED_TITLE)}) OR regexp_matches(trim(title), {q(I.FEED_TITLE_BARE)}))
)
"""


def _feed_builds(spark, sf_dir):
    return I.feed_builds(A.feed(spark, sf_dir))


@register("x20_feed_titles", oracle=with_adapters(_FEED_BUILDS_SQL + "SELECT * FROM fb", "feed"))
def x20_feed_titles(spark, sf_dir):
    return _feed_builds(spark, sf_dir)


@register("a17_last_build", oracle=with_adapters("""
SELECT job_full_name, max(build_number) AS last_build FROM ingest_state GROUP BY job_full_name
""", "ingest_state"))
def a17_last_build(spark, sf_dir):
    return I.last_processed(A.ingest_state(spark, sf_dir))


_NEW_SQL = _FEED_BUILDS_SQL + """, wm AS (SELECT job_full_name, max(build_number) AS last_build FROM ingest_state GROUP BY job_full_name),
nb AS (
  SELECT item_id, job_full_name, build_number, build_url FROM (
    SELECT fb.*, row_number() OVER (PARTITION BY fb.job_full_name, fb.build_number ORDER BY item_id) AS r
    FROM fb LEFT JOIN wm USING (job_full_name)
    WHERE fb.build_number > coalesce(wm.last_build, 0)
  ) WHERE r = 1
)
"""


@register("j2_new_builds", oracle=with_adapters(_NEW_SQL + "SELECT * FROM nb", "feed", "ingest_state"))
def j2_new_builds(spark, sf_dir):
    return I.new_builds(_feed_builds(spark, sf_dir), A.ingest_state(spark, sf_dir))


@register("u1_feed_dedupe", oracle=with_adapters(_FEED_BUILDS_SQL + """
SELECT item_id, job_full_name, build_number FROM (
  SELECT *, row_number() OVER (PARTITION BY job_full_name, build_number ORDER BY item_id) AS r FROM fb) WHERE r = 1
""", "feed"))
def u1_feed_dedupe(spark, sf_dir):
    return I.first_per_build(_feed_builds(spark, sf_dir)).select("item_id", "job_full_name", "build_number")


@register("j3_claim", oracle=with_adapters("""
, cand AS (SELECT job_full_name, build_number FROM fb GROUP BY ALL)
SELECT c.job_full_name, c.build_number, 'new' AS claim FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM ingest_state s WHERE s.job_full_name = c.job_full_name AND s.build_number = c.build_number)
UNION ALL
SELECT c.job_full_name, c.build_number, 'retry' AS claim FROM cand c
WHERE EXISTS (SELECT 1 FROM ingest_state s WHERE s.job_full_name = c.job_full_name AND s.build_number = c.build_number
              AND s.status IN ('seen', 'failed'))
""".replace(", cand AS", _FEED_BUILDS_SQL.strip() + "\n, cand AS"), "feed", "ingest_state"))
def j3_claim(spark, sf_dir):
    cand = _feed_builds(spark, sf_dir).select("job_full_name", "build_number").distinct()
    return I.claimable(cand, A.ingest_state(spark, sf_dir))


_W8_SQL = """
, g AS (
  SELECT build_key, stage_id, status, start_ms, duration_ms,
         CASE WHEN max(start_ms + duration_ms) OVER (PARTITION BY build_key ORDER BY start_ms, stage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL
                OR start_ms >= max(start_ms + duration_ms) OVER (PARTITION BY build_key ORDER BY start_ms, stage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2000
              THEN 1 ELSE 0 END AS nw
  FROM stages
), grp AS (
  SELECT *, sum(nw) OVER (PARTITION BY build_key ORDER BY start_ms, stage_id ROWS UNBOUNDED PRECEDING) AS group_no FROM g
)
"""


@register("w8_parallel_groups", oracle=with_adapters(_W8_SQL + "SELECT build_key, stage_id, CAST(group_no AS BIGINT) AS group_no FROM grp", "stages"))
def w8_parallel_groups(spark, sf_dir):
    return I.overlap_groups(A.stages(spark, sf_dir)).select("build_key", "stage_id", F.col("group_no").cast("bigint").alias("group_no"))


@register("w10_root_failures", oracle=with_adapters(_W8_SQL + """
, gg AS (
  SELECT *, min(start_ms) OVER (PARTITION BY build_key, group_no) AS gstart,
            max(CASE WHEN upper(status) IN ('FAILED', 'ERROR', 'ABORTED') THEN 1 ELSE 0 END) OVER (PARTITION BY build_key, group_no) AS gfail
  FROM grp
), firstg AS (SELECT build_key, arg_min(group_no, gstart) AS g0 FROM gg WHERE gfail = 1 GROUP BY build_key)
SELECT gg.build_key, gg.stage_id FROM gg JOIN firstg ON gg.build_key = firstg.build_key AND gg.group_no = firstg.g0
WHERE upper(status) IN ('FAILED', 'ERROR', 'ABORTED')
""", "stages"))
def w10_root_failures(spark, sf_dir):
    return I.root_failures(A.stages(spark, sf_dir)).select("build_key", "stage_id")


@register("z7_event_type", oracle=with_adapters(_W8_SQL + """
, gg AS (
  SELECT *, min(start_ms) OVER (PARTITION BY build_key, group_no) AS gstart,
            max(CASE WHEN upper(status) IN ('FAILED', 'ERROR', 'ABORTED') THEN 1 ELSE 0 END) OVER (PARTITION BY build_key, group_no) AS gfail
  FROM grp
), firstg AS (SELECT build_key, arg_min(group_no, gstart) AS g0 FROM gg WHERE gfail = 1 GROUP BY build_key),
rf AS (SELECT gg.build_key, count(*) AS n FROM gg JOIN firstg ON gg.build_key = firstg.build_key AND gg.group_no = firstg.g0
       WHERE upper(status) IN ('FAILED', 'ERROR', 'ABORTED') GROUP BY gg.build_key)
SELECT b.build_key, CASE WHEN coalesce(rf.n, 0) > 0 THEN 'stage_failure' ELSE 'build_failure' END AS event_type,
       CAST(coalesce(rf.n, 0) AS BIGINT) AS failed_stages
FROM (SELECT DISTINCT build_key FROM stages) b LEFT JOIN rf USING (build_key)
""", "stages"))
def z7_event_type(spark, sf_dir):
    st = A.stages(spark, sf_dir)
    rf = I.root_failures(st).groupBy("build_key").agg(F.collect_list("name").alias("_fs"))
    builds = st.select("build_key").distinct()
    out = builds.join(rf, "build_key", "left")
    return out.select("build_key", I.event_type(F.col("_fs")).alias("event_type"),
                      F.coalesce(F.size("_fs"), F.lit(0)).cast("bigint").alias("failed_stages"))


_W9_SQL = """
, ev AS (
  SELECT build_key, stage_id AS id, 0 AS k FROM stages
  UNION ALL SELECT build_key, node_id, CASE kind WHEN 'start' THEN 1 ELSE 2 END FROM markers WHERE kind IN ('start', 'end')
), evn AS (SELECT *, row_number() OVER (PARTITION BY build_key ORDER BY id, k) AS rn FROM ev),
rec AS (
  WITH RECURSIVE r(build_key, rn, id, k, st, blk) AS (
    SELECT build_key, rn, id, k, CASE WHEN k = 1 THEN [id] ELSE CAST([] AS BIGINT[]) END, CAST(NULL AS BIGINT)
    FROM evn WHERE rn = 1
    UNION ALL
    SELECT e.build_key, e.rn, e.id, e.k,
           CASE WHEN e.k = 1 THEN list_append(r.st, e.id)
                WHEN e.k = 2 AND len(r.st) > 0 THEN r.st[1:len(r.st) - 1] ELSE r.st END,
           CASE WHEN e.k = 0 AND len(r.st) > 0 THEN r.st[len(r.st)] END
    FROM r JOIN evn e ON e.build_key = r.build_key AND e.rn = r.rn + 1
  ) SELECT * FROM r
), fin AS (SELECT build_key, arg_max(len(st), rn) = 0 AS closed FROM rec GROUP BY build_key),
ids0 AS (
  SELECT build_key, CASE WHEN stage_id <= 0 OR stage_id <= coalesce(lag(stage_id) OVER (PARTITION BY build_key ORDER BY start_ms, stage_id), 0) THEN 1 ELSE 0 END AS bad
  FROM stages
), ids AS (SELECT build_key, max(bad) = 0 AS ids_ok FROM ids0 GROUP BY build_key)
"""


@register("w9_parallel_blocks", oracle=with_adapters(_W9_SQL + """
SELECT s.build_key, s.stage_id, CASE WHEN f.closed AND i.ids_ok THEN r.blk END AS block, coalesce(f.closed AND i.ids_ok, false) AS valid
FROM stages s LEFT JOIN rec r ON r.build_key = s.build_key AND r.id = s.stage_id AND r.k = 0
LEFT JOIN fin f ON f.build_key = s.build_key LEFT JOIN ids i ON i.build_key = s.build_key
""", "stages", "markers"))
def w9_parallel_blocks(spark, sf_dir):
    return I.parallel_blocks(A.stages(spark, sf_dir), A.markers(spark, sf_dir)).select("build_key", "stage_id", "block", "valid")


@register("w10_root_failures_markers", oracle=with_adapters(_W9_SQL.rstrip() + _W8_SQL.replace("\n, g AS (", ",\ng AS (", 1) + """
, pb AS (
  SELECT s.build_key, s.stage_id, s.status, s.start_ms, grp.group_no, coalesce(f.closed AND i.ids_ok, false) AS valid, r.blk
  FROM stages s JOIN grp ON grp.build_key = s.build_key AND grp.stage_id = s.stage_id
  LEFT JOIN rec r ON r.build_key = s.build_key AND r.id = s.stage_id AND r.k = 0
  LEFT JOIN fin f ON f.build_key = s.build_key LEFT JOIN ids i ON i.build_key = s.build_key
), gk AS (
  SELECT *, CASE WHEN valid THEN coalesce('b' || CAST(blk AS VARCHAR), 's' || CAST(stage_id AS VARCHAR)) ELSE 'o' || CAST(group_no AS VARCHAR) END AS gkey FROM pb
), gg AS (
  SELECT *, min(start_ms) OVER (PARTITION BY build_key, gkey) AS gstart,
         max(CASE WHEN upper(status) IN ('FAILED', 'ERROR', 'ABORTED') THEN 1 ELSE 0 END) OVER (PARTITION BY build_key, gkey) AS gfail
  FROM gk
), firstg AS (
  SELECT build_key, gkey FROM (SELECT build_key, gkey, row_number() OVER (PARTITION BY build_key ORDER BY gstart, gkey) AS r
                               FROM (SELECT DISTINCT build_key, gkey, gstart FROM gg WHERE gfail = 1)) WHERE r = 1
)
SELECT gg.build_key, gg.stage_id FROM gg JOIN firstg ON gg.build_key = firstg.build_key AND gg.gkey = firstg.gkey
WHERE upper(gg.status) IN ('FAILED', 'ERROR', 'ABORTED')
""", "stages", "markers"))
def w10_root_failures_markers(spark, sf_dir):
    return I.root_failures(A.stages(spark, sf_dir), A.markers(spark, sf_dir)).select("build_key", "stage_id")


def _trunc_sql(col: str, max_chars: int) -> str:
    inner = max(200, max_chars - 96)
    head0 = max(80, int(inner * 0.55))
    tail0 = max(80, inner - head0)
    note = "printf(chr(10) || '... [%d characters omitted; increase MAX_STAGE_LOG_CHARS] ...' || chr(10), {om})"
    om0 = f"greatest(0, length({col}) - {head0} - {tail0})"
    spare = f"({max_chars} - ({head0} + length({note.format(om=om0)}) + {tail0}))"
    head = f"CAST({head0} + {spare} // 2 AS BIGINT)"
    tail = f"CAST({tail0} + ({spare} - {spare} // 2) AS BIGINT)"
    om = f"greatest(0, length({col}) - {head} - {tail})"
    out = f"(substr({col}, 1, CAST({head} AS BIGINT)) || {note.format(om=om)} || substr({col}, CAST(length({col}) - {tail} + 1 AS BIGINT), CAST({tail} AS BIGINT)))"
    return (f"CASE WHEN length({col}) <= {max_chars} THEN {col} WHEN length({out}) <= {max_chars} THEN {out} "
            f"ELSE substr({col}, 1, {max_chars - 3}) || '...' END")


@register("x16_truncate", oracle=f"SELECT doc_id, {_trunc_sql('text', 2000)} AS excerpt FROM documents")
def x16_truncate(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", I.truncate_chars(F.col("text"), 2000).alias("excerpt"))


# The character references that the driver's pages and logs have (the operator knows all of HTML's).
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
             ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&mdash;", "\u2014"), ("&#8217;", "\u2019"), ("&amp;", "&"))


def _strip_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    for name, char in _ENTITIES:
        out = f"replace({out}, {q(name)}, {q(char)})"
    return f"regexp_replace({out}, '(?m)^[0-9][0-9]:[0-9][0-9]:[0-9][0-9]\\s+', '', 'g')"


@register("x17_html_strip", oracle=f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def x17_html_strip(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", ["page_id", "html"])
    return p.select("page_id", I.strip_html(F.col("html")).alias("text"))


def _anchor_sql(c: str) -> str:
    raw = f"trim({c})"
    return (f"CASE WHEN length({raw}) >= 4 AND NOT regexp_matches({c}, {q(I.BOILERPLATE_ANCHOR)}) AND regexp_matches({c}, {q(I.FAILURE_SIGNAL)}) THEN "
            f"1 + CASE WHEN regexp_matches({c}, {q(I.TYPED_THROWABLE)}) THEN 4 WHEN regexp_matches({c}, {q(I.ANCHOR_STRONG_WORD)}) THEN 3 ELSE 0 END"
            f" + CASE WHEN regexp_matches({c}, {q(I.ANCHOR_EXIT)}) THEN 2 ELSE 0 END"
            f" + CASE WHEN regexp_matches({c}, {q(I.ANCHOR_SCRIPT_EXIT)}) THEN 2 ELSE 0 END"
            f" + CASE WHEN regexp_matches({c}, {q(I.ANCHOR_CONN)}) THEN 3 ELSE 0 END"
            f" + CASE WHEN regexp_matches({c}, {q(I.OPERATIONAL_HINT)}) THEN 2 ELSE 0 END"
            f" - CASE WHEN regexp_matches({raw}, {q(I.ANCHOR_URL)}) AND (length(lower({raw})) - length(replace(lower({raw}), 'error', ''))) / 5 < 2 THEN 2 ELSE 0 END"
            f" - CASE WHEN regexp_matches({raw}, {q(I.ANCHOR_FRAME)}) AND NOT regexp_matches({c}, {q(I.TYPED_THROWABLE)}) THEN 2 ELSE 0 END"
            f" END")


@register("x18_anchor_scores", oracle=with_adapters(f"SELECT log_id, idx, CAST({_anchor_sql('raw')} AS INTEGER) AS score FROM log_lines WHERE {_anchor_sql('raw')} IS NOT NULL", "log_lines"))
def x18_anchor_scores(spark, sf_dir):
    ll = A.log_lines(spark, sf_dir)
    return ll.select("log_id", "idx", I.anchor_score(F.col("raw")).cast("int").alias("score")).filter(F.col("score").isNotNull())


@register("p10_noise_lines", oracle=with_adapters(f"""
SELECT log_id, CAST(count(*) FILTER (WHERE regexp_matches(raw, {q(I.NOISE_LINE)})) AS BIGINT) AS noise, CAST(count(*) AS BIGINT) AS lines
FROM (SELECT log_id, CASE idx % 5 WHEN 0 THEN '[Pipeline] ' || raw WHEN 1 THEN 'WARNING: A Java agent ' || raw ELSE raw END AS raw FROM log_lines) GROUP BY log_id""", "log_lines"))
def p10_noise_lines(spark, sf_dir):
    """Console boilerplate put before some of the derived lines."""
    ll = A.log_lines(spark, sf_dir).withColumn("raw", F.when(F.col("idx") % 5 == 0, F.concat(F.lit("[Pipeline] "), "raw")).when(
        F.col("idx") % 5 == 1, F.concat(F.lit("WARNING: A Java agent "), "raw")).otherwise(F.col("raw")))
    return ll.groupBy("log_id").agg(F.count_if(I.noise_line(F.col("raw"))).alias("noise"), F.count(F.lit(1)).alias("lines"))


@register("p11_error_signal", oracle=with_adapters(f"""
SELECT log_id, bool_or(regexp_matches(raw, {q(I.FAILURE_SIGNAL)})) AS has_signal FROM log_lines GROUP BY log_id""", "log_lines"))
def p11_error_signal(spark, sf_dir):
    return I.error_signal(A.log_lines(spark, sf_dir))


def _snippet_sql() -> str:
    noise = f"(regexp_matches(raw, {q(I.NOISE_LINE)}) OR regexp_matches(raw, '^\\s*$'))"
    return f"""
, b AS (
  SELECT log_id, idx, raw, idx AS i, count(*) OVER (PARTITION BY log_id) AS m FROM log_lines
), sc AS (SELECT *, {_anchor_sql('raw')} AS s, {noise} AS noise FROM b),
an AS (SELECT * FROM sc WHERE s >= {I.SNIPPET_MIN_SCORE}),
an2 AS (SELECT *, i - lag(i) OVER (PARTITION BY log_id ORDER BY i) AS d FROM an),
an3 AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {I.SNIPPET_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cid FROM an2),
cl AS (SELECT log_id, cid, min(i) AS lo, max(i) AS hi, max(s) AS peak, max(m) AS m FROM an3 GROUP BY log_id, cid),
wn AS (SELECT log_id, greatest(0, lo - {I.SNIPPET_BEFORE}) AS wlo, least(m, hi + {I.SNIPPET_AFTER} + 1) AS whi FROM cl),
wn2 AS (SELECT *, max(whi) OVER (PARTITION BY log_id ORDER BY wlo, whi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pmax FROM wn),
wn3 AS (SELECT *, sum(CASE WHEN pmax IS NULL OR wlo > pmax THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY wlo, whi ROWS UNBOUNDED PRECEDING) AS wid FROM wn2),
wins AS (SELECT log_id, wid, min(wlo) AS wlo, max(whi) AS whi FROM wn3 GROUP BY log_id, wid),
pw AS (
  SELECT w.log_id, w.wid, string_agg(sc.raw, chr(10) ORDER BY sc.i) AS body
  FROM wins w JOIN sc ON sc.log_id = w.log_id AND sc.i >= w.wlo AND sc.i < w.whi WHERE NOT sc.noise GROUP BY w.log_id, w.wid
), sn AS (SELECT log_id, regexp_replace(string_agg(body, chr(10) || chr(10) ORDER BY wid), '^\\s+|\\s+$', '', 'g') AS s FROM pw GROUP BY log_id),
tl AS (SELECT * FROM log_lines WHERE NOT regexp_matches(raw, '^\\s*$')),
tl2 AS (SELECT *, regexp_matches(raw, {q(I.NOISE_LINE)}) AS nz, max(CASE WHEN NOT regexp_matches(raw, {q(I.NOISE_LINE)}) THEN 1 ELSE 0 END) OVER (PARTITION BY log_id) AS anyclean FROM tl),
tl3 AS (SELECT * FROM tl2 WHERE anyclean = 0 OR NOT nz),
fb AS (SELECT log_id, string_agg(raw, chr(10) ORDER BY idx) AS f FROM tl3 GROUP BY log_id),
txt AS (
  SELECT k.log_id, CASE WHEN length(coalesce(sn.s, '')) > 0 THEN sn.s ELSE coalesce(fb.f, '') END AS t
  FROM (SELECT DISTINCT log_id FROM log_lines) k LEFT JOIN sn ON sn.log_id = k.log_id LEFT JOIN fb ON fb.log_id = k.log_id
)
"""


@register("w13_error_snippets", oracle=with_adapters(_snippet_sql() + "SELECT log_id, t AS snippet FROM txt", "log_lines"))
def w13_error_snippets(spark, sf_dir):
    return I.error_snippets(A.log_lines(spark, sf_dir))


@register("s6_console_section", oracle=with_adapters(f"""
, c AS (SELECT log_id, max(CASE WHEN strpos(raw, '(task-7)') > 0 OR strpos(raw, 'task-7') > 0 THEN idx END) AS ctr FROM log_lines GROUP BY log_id),
t AS (
  SELECT l.log_id, string_agg(l.raw, chr(10) ORDER BY l.idx) AS t FROM log_lines l JOIN c ON c.log_id = l.log_id
  WHERE c.ctr IS NULL OR (l.idx >= c.ctr - 50 AND l.idx < c.ctr + 150) GROUP BY l.log_id
)
SELECT log_id, t AS excerpt FROM t""", "log_lines"))
def s6_console_section(spark, sf_dir):
    ll = A.log_lines(spark, sf_dir).withColumn("stage_name", F.lit("task-7"))
    return I.console_section(ll, F.col("stage_name"))


@register("s5_child_log_concat", oracle=f"""
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS log
FROM (SELECT conv_id, turn, {_strip_sql("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id
""")
def s5_child_log_concat(spark, sf_dir):
    """Child-node logs of a stage concatenated in node order (conversation turns as child logs)."""
    cv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return I.child_log_concat(cv, key=("conv_id",), order_col="turn").withColumnRenamed("child_log", "log")


@register("s1_tokenize_documents")
def s1_tokenize_documents(spark, sf_dir):
    """S1 + X1-X7 over whole documents (every line of every text)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lines = T.tokenize(d.withColumnRenamed("doc_id", "log_id").withColumnRenamed("text", "raw"))
    return lines.groupBy("log_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def _payloads(spark, sf_dir):
    """One JSON body per error or purchase event; purchase events carry a blank excerpt."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"]).filter(F.col("event_type").isin("error", "purchase"))
    stage = F.struct(F.lit("stage-error").alias("stage_name"), (F.col("event_id") * 10).cast("string").alias("stage_id"),
                     F.lit("FAILED").alias("status"),
                     F.when(F.col("event_type") == "error", A.event_log_line()).otherwise(F.lit("   ")).alias("log_excerpt"))
    event = F.struct(F.concat(F.lit("team/job-"), (F.col("user_id") % 20).cast("string")).alias("job_full_name"),
                     F.dayofmonth("ts").cast("int").alias("build_number"), F.lit("https://ci.example/b/").alias("build_url"),
                     F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("correlation_id"),
                     F.array(stage).alias("failed_stages"))
    body = F.when(F.col("event_type") == "error", F.to_json(event)).otherwise(F.to_json(F.struct(F.array(event).alias("failures"))))
    return ev.select(body.alias("body"))


@register("s3_ingest_events", oracle=with_adapters("""
SELECT 'team/job-' || CAST(user_id % 20 AS VARCHAR) AS job_full_name, CAST(day(ts) AS INTEGER) AS build_number,
       'https://ci.example/b/' AS build_url, 'c-' || CAST(event_id AS VARCHAR) AS correlation_id, 'stage-error' AS stage_name,
       CAST(event_id * 10 AS VARCHAR) AS stage_id, 'FAILED' AS status, l.raw AS raw
FROM events JOIN (
  SELECT event_id AS eid,
         CASE WHEN event_type IN ('error','purchase') THEN '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' ELSE '' END ||
         CASE WHEN event_id % 100 % 4 = 0 THEN 'script returned exit code ' || CAST(event_id % 100 % 3 + 1 AS VARCHAR)
              WHEN event_id % 100 % 4 = 1 THEN 'Caused by: com.acme.Svc' || CAST(event_id % 100 % 7 AS VARCHAR) || 'Exception: code ' || CAST(event_id % 100 AS VARCHAR)
              ELSE 'ERROR com.acme.Svc' || CAST(event_id % 100 % 7 AS VARCHAR) || 'Exception: code ' || CAST(event_id % 100 AS VARCHAR) END AS raw
  FROM events WHERE event_type = 'error') l ON events.event_id = l.eid
""", "log_lines"))
def s3_ingest_events(spark, sf_dir):
    return I.ingest_events(_payloads(spark, sf_dir))


_S4_SQL = f"""
, el AS (
  SELECT 'b' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS build_key, event_id * 10 AS stage_id, ts, event_id,
         {A.EVENT_LINE_SQL} AS raw
  FROM events
), console AS (SELECT build_key, row_number() OVER (PARTITION BY build_key ORDER BY ts, event_id) - 1 AS idx, raw FROM el),
node AS (SELECT build_key, stage_id, {_strip_sql('trim(raw)')} AS text FROM el WHERE strpos(raw, 'Caused by:') > 0),
kids AS (SELECT build_key, stage_id, string_agg({_strip_sql('trim(raw)')}, chr(10) ORDER BY event_id) AS child_log FROM el
         WHERE strpos(raw, 'exit code') > 0 AND trim(raw) <> '' GROUP BY build_key, stage_id),
gg AS (
  SELECT *, min(start_ms) OVER (PARTITION BY build_key, group_no) AS gstart,
            max(CASE WHEN upper(status) IN ('FAILED', 'ERROR', 'ABORTED') THEN 1 ELSE 0 END) OVER (PARTITION BY build_key, group_no) AS gfail
  FROM grp
), firstg AS (SELECT build_key, arg_min(group_no, gstart) AS g0 FROM gg WHERE gfail = 1 GROUP BY build_key),
failed AS (
  SELECT gg.build_key, gg.stage_id, s.name, s.status FROM gg JOIN firstg ON gg.build_key = firstg.build_key AND gg.group_no = firstg.g0
  JOIN stages s ON s.build_key = gg.build_key AND s.stage_id = gg.stage_id WHERE upper(gg.status) IN ('FAILED', 'ERROR', 'ABORTED')
), ctr AS (
  SELECT f.build_key, f.name, max(CASE WHEN strpos(c.raw, '(' || f.name || ')') > 0 OR strpos(c.raw, f.name) > 0 THEN c.idx END) AS ctr
  FROM failed f JOIN console c ON c.build_key = f.build_key GROUP BY f.build_key, f.name
), sec AS (
  SELECT x.build_key, x.name, string_agg(c.raw, chr(10) ORDER BY c.idx) AS t FROM ctr x JOIN console c ON c.build_key = x.build_key
  WHERE x.ctr IS NULL OR (c.idx >= x.ctr - 50 AND c.idx < x.ctr + 150) GROUP BY x.build_key, x.name
), full0 AS (
  SELECT build_key, regexp_replace(string_agg(raw, chr(10) ORDER BY idx), '^\\s+|\\s+$', '', 'g') AS t FROM console GROUP BY build_key
), fullx AS (SELECT build_key, CASE WHEN t <> '' THEN t END AS full FROM full0),
secx AS (SELECT build_key, name, t AS sec FROM sec)
SELECT f.build_key, f.name AS stage_name, CAST(f.stage_id AS VARCHAR) AS stage_id, upper(f.status) AS status,
       coalesce(CASE WHEN trim(coalesce(n.text, '')) <> '' THEN n.text END,
                CASE WHEN trim(coalesce(k.child_log, '')) <> '' THEN k.child_log END,
                CASE WHEN trim(coalesce(sx.sec, '')) <> '' THEN sx.sec END,
                coalesce(fx.full, '')) AS log_excerpt
FROM failed f LEFT JOIN node n ON n.build_key = f.build_key AND n.stage_id = f.stage_id
LEFT JOIN kids k ON k.build_key = f.build_key AND k.stage_id = f.stage_id
LEFT JOIN secx sx ON sx.build_key = f.build_key AND sx.name = f.name
LEFT JOIN fullx fx ON fx.build_key = f.build_key
UNION ALL
SELECT b.build_key, 'Build', CAST(NULL AS VARCHAR), 'FAILURE', fx.full
FROM (SELECT DISTINCT build_key FROM el) b JOIN fullx fx ON fx.build_key = b.build_key
WHERE fx.full IS NOT NULL AND b.build_key NOT IN (SELECT build_key FROM failed)
"""


@register("s4_stage_log_cascade", oracle=with_adapters(_W8_SQL + _S4_SQL, "stages"))
def s4_stage_log_cascade(spark, sf_dir):
    """Failed stages get node logs (Caused-by lines), child logs (exit lines) or the console of their build."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    bk = F.concat(F.lit("b"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    lines = ev.select(bk.alias("build_key"), (F.col("event_id") * 10).alias("stage_id"), "ts", "event_id", A.event_log_line().alias("raw"))
    console = lines.withColumn("idx", F.row_number().over(Window.partitionBy("build_key").orderBy("ts", "event_id")) - 1).select("build_key", "idx", "raw")
    node = lines.filter(F.col("raw").contains("Caused by:")).select("build_key", "stage_id", F.col("raw").alias("text"))
    kids = lines.filter(F.col("raw").contains("exit code")).select("build_key", "stage_id", F.col("event_id").alias("node_id"), F.col("raw").alias("text"))
    failed = I.root_failures(A.stages(spark, sf_dir)).select("build_key", "stage_id", "name", "status")
    builds = lines.select("build_key").distinct()
    return I.stage_log_cascade(failed, node, kids, console, builds)


@register("p9_failing_status", oracle=with_adapters("""
SELECT upper(status) IN ('FAILED', 'ERROR', 'ABORTED') AS failing, CAST(count(*) AS BIGINT) AS n FROM stages GROUP BY 1
""", "stages"))
def p9_failing_status(spark, sf_dir):
    st = A.stages(spark, sf_dir)
    return st.groupBy(I.failing_status(F.col("status")).alias("failing")).agg(F.count(F.lit(1)).alias("n"))


@register("s2_feed_xml", oracle=with_adapters("SELECT title, link FROM feed", "feed"))
def s2_feed_xml(spark, sf_dir):
    """The feed landed as RSS XML in the shared scratch folder, then scanned back."""
    import uuid
    from ..session import checkpoint_dir
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/feed-xml-{uuid.uuid4().hex}"
    A.feed(spark, sf_dir).select("title", "link").write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return I.read_feed(spark, path)
