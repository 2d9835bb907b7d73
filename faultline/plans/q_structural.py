"""Pass-2 queries over the derived build logs, with SQL oracles.

The oracle re-states each collapser in SQL: islands by window sums, anchored
repeat buckets by a recursive CTE over each (log, template) occurrence list.
Multi-line JSON never occurs in the derived logs (their JSON lines are
balanced), so the JSON fold is a no-op there; it is checked against the
sequential model in ``tests/test_structural.py`` and by ``w3_json_fold`` on the
payload corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import detectors as D
from ..operators import structural as ST
from ..operators import tokenize as T
from ..sources import adapters as A
from .catalog import register
from .oracle import q, tokenized_sql

_HINT_SQL = " OR ".join(f"strpos(text, {q(h)}) > 0" for h in P.PKG_MGR_HINTS)

def _collapse_sql(src: str) -> str:
    return A.ADAPTER_SQL[src].strip() + ",\n" + tokenized_sql(src) + _COLLAPSE_BODY


_COLLAPSE_BODY = f""",
c0 AS (
  SELECT *, kind = 6 AS drop0, CASE WHEN kind = 6 THEN 'banner' ELSE '' END AS reason0,
         CASE WHEN kind = 4 AND NOT coalesce(lag(kind = 4) OVER (PARTITION BY log_id ORDER BY idx), false) THEN 1 ELSE 0 END AS s_start,
         CASE WHEN kind = 5 AND NOT coalesce(lag(kind = 5) OVER (PARTITION BY log_id ORDER BY idx), false) THEN 1 ELSE 0 END AS p_start
  FROM lines
), c1 AS (
  SELECT *, CASE WHEN kind = 4 THEN sum(s_start) OVER (PARTITION BY log_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS srun,
            CASE WHEN kind = 5 THEN sum(p_start) OVER (PARTITION BY log_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS prun
  FROM c0
), c2 AS (
  SELECT *, row_number() OVER (PARTITION BY log_id, srun ORDER BY idx) - 1 AS off,
         CASE WHEN NOT ({_HINT_SQL}) THEN 1 ELSE 0 END AS isproj
  FROM c1
), c3 AS (
  SELECT *, sum(CASE WHEN isproj = 1 AND off >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, srun ORDER BY idx ROWS UNBOUNDED PRECEDING) AS prank
  FROM c2
), c4 AS (
  SELECT *, srun IS NOT NULL AND (off = 0 OR (isproj = 1 AND off >= 1 AND prank <= 3)) AS keepf FROM c3
), c5 AS (
  SELECT *, count(*) OVER (PARTITION BY log_id, srun) AS rlen,
            sum(CASE WHEN keepf THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, srun) AS nkeep,
            max(CASE WHEN keepf THEN idx END) OVER (PARTITION BY log_id, srun) AS lastkeep
  FROM c4
), c6 AS (
  SELECT log_id, idx, text, template, var_tokens, kind, severity, prun,
         drop0 OR (srun IS NOT NULL AND rlen > 4 AND NOT keepf) AS drop1,
         CASE WHEN srun IS NOT NULL AND rlen > 4 AND NOT keepf THEN 'stack-frame-elided' ELSE reason0 END AS reason1,
         CASE WHEN srun IS NOT NULL AND rlen > 4 AND rlen - nkeep > 0 AND idx = lastkeep THEN '... ' || CAST(rlen - nkeep AS VARCHAR) || ' frame(s) elided ...' ELSE '' END AS note1,
         CASE WHEN srun IS NOT NULL AND rlen > 4 AND off = 0 THEN 3 WHEN srun IS NOT NULL AND rlen > 4 AND keepf THEN 2 ELSE 0 END AS score1
  FROM c5
), c7 AS (
  SELECT *, min(CASE WHEN NOT drop1 THEN idx END) OVER (PARTITION BY log_id, prun) AS pfirst,
            max(idx) OVER (PARTITION BY log_id, prun) AS plast
  FROM c6
), c8 AS (
  SELECT log_id, idx, text, template, var_tokens, kind, severity, score1 AS score,
         drop1 OR (prun IS NOT NULL AND pfirst IS NOT NULL AND plast - pfirst + 1 >= 4 AND idx > pfirst) AS drop2,
         CASE WHEN prun IS NOT NULL AND pfirst IS NOT NULL AND plast - pfirst + 1 >= 4 AND idx > pfirst THEN 'progress-elided'
              WHEN prun IS NOT NULL AND pfirst IS NOT NULL AND plast - pfirst + 1 >= 4 AND idx = pfirst THEN 'progress-summary'
              ELSE reason1 END AS reason2,
         CASE WHEN prun IS NOT NULL AND pfirst IS NOT NULL AND plast - pfirst + 1 >= 4 AND idx = pfirst
              THEN '<progress: ' || CAST(plast - pfirst + 1 AS VARCHAR) || ' lines elided (' ||
                   coalesce(nullif(regexp_extract(text, '^(\\S+(?: \\S+)?)', 1), ''), 'progress') || ')>'
              ELSE note1 END AS note2
  FROM c7
), el AS (
  SELECT log_id, idx, template, var_tokens,
         min(idx) OVER (PARTITION BY log_id ORDER BY idx RANGE BETWEEN 51 FOLLOWING AND UNBOUNDED FOLLOWING) AS close
  FROM c8 WHERE NOT drop2 AND text <> '' AND severity < 3
), occ AS (
  SELECT *, row_number() OVER (PARTITION BY log_id, template ORDER BY idx) AS rn FROM el
), rb AS (
  WITH RECURSIVE r(log_id, template, rn, idx, head, hclose) AS (
    SELECT log_id, template, rn, idx, idx, close FROM occ WHERE rn = 1
    UNION ALL
    SELECT o.log_id, o.template, o.rn, o.idx,
           CASE WHEN r.hclose IS NOT NULL AND o.idx > r.hclose THEN o.idx ELSE r.head END,
           CASE WHEN r.hclose IS NOT NULL AND o.idx > r.hclose THEN o.close ELSE r.hclose END
    FROM r JOIN occ o ON o.log_id = r.log_id AND o.template = r.template AND o.rn = r.rn + 1
  )
  SELECT log_id, idx, head FROM r
), bk AS (
  SELECT e.log_id, e.idx, e.var_tokens, rb.head,
         count(*) OVER (PARTITION BY e.log_id, rb.head) AS cnt,
         min(e.idx) OVER (PARTITION BY e.log_id, rb.head) AS bfirst,
         max(e.idx) OVER (PARTITION BY e.log_id, rb.head) AS blast
  FROM el e JOIN rb ON e.log_id = rb.log_id AND e.idx = rb.idx
), vals AS (
  SELECT log_id, head, array_to_string(list_slice(list_distinct_ordered, 1, 3), ', ') AS v FROM (
    SELECT log_id, head, list(t ORDER BY pos) FILTER (WHERE first_pos = pos) AS list_distinct_ordered FROM (
      SELECT log_id, head, t, pos, min(pos) OVER (PARTITION BY log_id, head, t) AS first_pos FROM (
        SELECT log_id, head, CASE WHEN length(tok) <= 40 THEN tok ELSE substr(tok, 1, 37) || '...' END AS t,
               idx * 1000 + tpos AS pos
        FROM (SELECT log_id, head, idx, unnest(var_tokens) AS tok, generate_subscripts(var_tokens, 1) AS tpos FROM bk)
        WHERE tok NOT IN ('PATH', 'URL', 'UUID', 'HEX', 'SIZE', 'N')
      )
    ) GROUP BY log_id, head
  )
), marks AS (
  SELECT bk.log_id, bk.idx, bk.idx > bfirst AND bk.idx < blast AS mid, bk.idx = blast AS islast,
         '(repeated ' || CAST(cnt AS VARCHAR) || 'x over ' || CAST(blast - bfirst + 1 AS VARCHAR) || ' lines' ||
         CASE WHEN coalesce(v, '') <> '' THEN ': values=' || v ELSE '' END || ')' AS rnote
  FROM bk LEFT JOIN vals ON bk.log_id = vals.log_id AND bk.head = vals.head
  WHERE cnt >= 3
), collapsed AS (
  SELECT c8.log_id, c8.idx, c8.text, c8.kind, c8.severity, c8.score,
         drop2 OR coalesce(mid, false) AS drop,
         CASE WHEN coalesce(mid, false) THEN 'repeat-elided' WHEN coalesce(islast, false) THEN 'repeat-summary' ELSE reason2 END AS reason,
         CASE WHEN coalesce(islast, false) THEN rnote ELSE note2 END AS note
  FROM c8 LEFT JOIN marks m ON c8.log_id = m.log_id AND c8.idx = m.idx
)"""
COLLAPSE_SQL = _collapse_sql("log_lines")
STACK_COLLAPSE_SQL = _collapse_sql("stack_lines")


def collapsed_lines(spark, sf_dir, corpus=A.log_lines):
    """Annotated lines checkpointed once (the regex chain is not recomputed per branch), then collapsed."""
    from .filter import _materialize, annotated_lines
    lines = _materialize(annotated_lines(corpus(spark, sf_dir)), "checkpoint")
    return ST.collapse(lines, reuse=lambda d: _materialize(d, "persist"))


_COLS = ["log_id", "idx", "drop", "reason", "note", "score"]


@register("w1_banner_drop", oracle=f"WITH {COLLAPSE_SQL}\nSELECT log_id, CAST(count(*) AS BIGINT) AS n_banner FROM collapsed WHERE reason = 'banner' GROUP BY log_id")
def w1_banner_drop(spark, sf_dir):
    df = collapsed_lines(spark, sf_dir)
    return df.filter(F.col("reason") == "banner").groupBy("log_id").agg(F.count(F.lit(1)).alias("n_banner"))


@register("w2_stack_collapse", oracle=f"WITH {COLLAPSE_SQL}\nSELECT log_id, idx, drop, reason, note, score FROM collapsed WHERE score > 0 OR reason = 'stack-frame-elided' OR note LIKE '%frame(s) elided%'")
def w2_stack_collapse(spark, sf_dir):
    df = collapsed_lines(spark, sf_dir)
    return df.filter((F.col("score") > 0) | (F.col("reason") == "stack-frame-elided") | F.col("note").like("%frame(s) elided%")).select(*_COLS)


@register("w2_stack_corpus", oracle=f"WITH {STACK_COLLAPSE_SQL}\nSELECT log_id, idx, drop, reason, note, score FROM collapsed")
def w2_stack_corpus(spark, sf_dir):
    """All five collapsers on the stack-trace corpus (every line's final state)."""
    return collapsed_lines(spark, sf_dir, A.stack_lines).select(*_COLS)


def _java_sql() -> str:
    from ..operators import stacks as SK
    fw_prefix = " OR ".join(f"starts_with(fq, {q(x)})" for x in SK.JAVA_FRAMEWORK_PREFIXES)
    fw_mod = ", ".join(q(x) for x in SK.JAVA_FRAMEWORK_MODULES)
    return f"""WITH {STACK_COLLAPSE_SQL},
fl AS (
  SELECT l.log_id, l.idx, l.raw, c.text, regexp_matches(l.raw, {q(SK.JAVA_FRAME)}) AS isf
  FROM stack_lines l JOIN collapsed c ON c.log_id = l.log_id AND c.idx = l.idx
), r0 AS (SELECT *, sum(CASE WHEN isf THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS seg FROM fl),
cz AS (
  SELECT *, regexp_extract(text, {q(SK.JAVA_CAUSE)}, 0) AS m0, regexp_extract(text, {q(SK.JAVA_CAUSE)}, 1) AS cls0
  FROM r0
), cz2 AS (
  SELECT *, strpos(text, m0) + length(m0) AS e0 FROM cz
), cz3 AS (
  SELECT *, CASE WHEN text <> '' AND regexp_matches(text, {q(SK.JAVA_CAUSE)}) THEN
              struct_pack(i := idx, cls := cls0,
                          msg := CASE WHEN strpos(substr(text, e0), ':') > 0 THEN substr(trim(substr(text, e0 + strpos(substr(text, e0), ':'))), 1, 120) ELSE '' END)
            END AS cs FROM cz2
), fr AS (
  SELECT f.log_id, f.idx, f.seg,
         regexp_extract(f.raw, {q(SK.JAVA_FRAME)}, 1) AS md, regexp_extract(f.raw, {q(SK.JAVA_FRAME)}, 2) AS fq,
         regexp_extract(f.raw, {q(SK.JAVA_FRAME)}, 3) AS det,
         (SELECT arg_max(c.cs, c.idx) FROM cz3 c WHERE c.log_id = f.log_id AND c.cs IS NOT NULL
            AND c.idx >= t.top - {SK.JAVA_CAUSE_LOOKBACK} AND c.idx <= t.top - 1) AS cause,
         t.top
  FROM cz3 f JOIN (SELECT log_id, seg, min(idx) AS top FROM cz3 WHERE isf GROUP BY log_id, seg) t ON t.log_id = f.log_id AND t.seg = f.seg
  WHERE f.isf
), fr2 AS (
  SELECT *, NOT ((md <> '' AND (md IN ({fw_mod}) OR (starts_with(md, 'java.') AND NOT starts_with(md, 'java.user.')))) OR {fw_prefix}) AS proj,
         det NOT IN ('', 'Native Method', 'Unknown Source') AND regexp_matches(trim(det), {q(SK.JAVA_FILE_LINE)}) AS known,
         CASE WHEN strpos(fq, '.') > 0 THEN regexp_extract(fq, '^(.*)\\.([^.]*)$', 1) ELSE '' END AS cl,
         CASE WHEN strpos(fq, '.') > 0 THEN regexp_extract(fq, '^(.*)\\.([^.]*)$', 2) ELSE fq END AS meth
  FROM fr
), fr3 AS (
  SELECT *, CASE WHEN known THEN regexp_extract(trim(det), {q(SK.JAVA_FILE_LINE)}, 1) ELSE '' END AS file,
         CASE WHEN known AND regexp_extract(trim(det), {q(SK.JAVA_FILE_LINE)}, 2) <> '' THEN CAST(regexp_extract(trim(det), {q(SK.JAVA_FILE_LINE)}, 2) AS INTEGER) ELSE 0 END AS line,
         CASE WHEN md <> '' THEN md || '/' || cl ELSE cl END AS disp,
         sum(CASE WHEN proj THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, seg ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS off,
         sum(CASE WHEN proj THEN 1 ELSE 0 END) OVER (PARTITION BY log_id, seg) AS nproj,
         coalesce(cause.cls, '') AS ccls, coalesce(cause.msg, '') AS cmsg
  FROM fr2
), base AS (SELECT *, CASE WHEN off = 0 THEN 0.85 ELSE greatest(0.55, 0.85 - 0.10 * off) END AS b FROM fr3)
SELECT log_id, file, line, CASE WHEN disp <> '' THEN disp || '.' || meth ELSE meth END AS function,
       round(CAST(CASE WHEN file = '' THEN least(b, 0.50) WHEN line <= 0 THEN least(b, 0.65) ELSE b END AS DOUBLE), 4) AS confidence,
       idx AS log_line_idx,
       CASE WHEN ccls <> '' THEN rtrim(ccls || ': ' || cmsg, ': ') WHEN meth <> '' THEN meth ELSE fq END AS message
FROM base WHERE proj
UNION ALL
SELECT log_id, file, line, disp || '.' || meth, 0.45, idx, CASE WHEN ccls <> '' THEN ccls ELSE 'framework-internal stack' END
FROM base WHERE nproj = 0 AND idx = top"""


@register("e3a_java_locations", oracle=_java_sql())
def e3a_java_locations(spark, sf_dir):
    """Java detector locations on the stack-trace corpus (after structural collapse)."""
    from ..operators import stacks as SK
    from .filter import _materialize
    lines = collapsed_lines(spark, sf_dir, A.stack_lines).select("log_id", "idx", "raw", "text", "kind", "severity", "drop")
    lines = _materialize(lines, "checkpoint")
    _, locs = SK.JavaStackDetector().contribute(D.spread(lines, lines.count()))
    return locs.select("log_id", "file", "line", "function", F.round("confidence", 4).alias("confidence"), "log_line_idx", "message")


@register("w4_progress_collapse", oracle=f"WITH {COLLAPSE_SQL}\nSELECT log_id, idx, drop, reason, note FROM collapsed WHERE reason LIKE 'progress-%'")
def w4_progress_collapse(spark, sf_dir):
    df = collapsed_lines(spark, sf_dir)
    return df.filter(F.col("reason").like("progress-%")).select("log_id", "idx", "drop", "reason", "note")


@register("w6_repeat_buckets", oracle=f"WITH {COLLAPSE_SQL}\nSELECT log_id, idx, drop, reason, note FROM collapsed WHERE reason LIKE 'repeat-%'")
def w6_repeat_buckets(spark, sf_dir):
    df = collapsed_lines(spark, sf_dir)
    return df.filter(F.col("reason").like("repeat-%")).select("log_id", "idx", "drop", "reason", "note")


@register("a11_collapse_stats", oracle=f"""WITH {COLLAPSE_SQL}
SELECT log_id, {', '.join(f"CAST(count(*) FILTER (WHERE drop AND reason = '{r}') AS BIGINT) AS {r.replace('-', '_')}" for r in P.COLLAPSE_REASONS)}
FROM collapsed GROUP BY log_id""")
def a11_collapse_stats(spark, sf_dir):
    return ST.collapse_stats(collapsed_lines(spark, sf_dir))


@register("w5_value_summary", oracle=f"WITH {COLLAPSE_SQL}\nSELECT log_id, idx, note FROM collapsed WHERE note LIKE '%values=%'")
def w5_value_summary(spark, sf_dir):
    df = collapsed_lines(spark, sf_dir)
    return df.filter(F.col("note").like("%values=%")).select("log_id", "idx", "note")


_SHELL_RX = q(D.EXIT_NONZERO)


_FACTS_SQL = f"""WITH {COLLAPSE_SQL},
ex AS (SELECT log_id, max(idx) AS exit_idx FROM collapsed WHERE NOT drop AND text <> '' AND regexp_matches(text, {_SHELL_RX}) GROUP BY log_id),
ctx AS (
  SELECT ex.log_id, ex.exit_idx,
         max(CASE WHEN c.kind = 1 AND NOT c.drop AND c.idx < ex.exit_idx AND c.idx >= ex.exit_idx - 59 THEN c.idx END) AS cmd,
         max(CASE WHEN (c.kind = 4 OR c.severity >= 5) AND NOT c.drop AND c.idx < ex.exit_idx AND c.idx >= ex.exit_idx - 59 THEN c.idx END) AS bar
  FROM ex JOIN collapsed c ON c.log_id = ex.log_id GROUP BY ex.log_id, ex.exit_idx
), facts AS (
  SELECT ctx.*, coalesce(nullif(regexp_extract(e.text, {_SHELL_RX}, 1), ''), nullif(regexp_extract(e.text, {_SHELL_RX}, 2), ''),
                         nullif(regexp_extract(e.text, {_SHELL_RX}, 3), ''), '1') AS code,
         substr(trim(regexp_replace(coalesce(m.text, ''), '^[+$> ]+', '')), 1, 200) AS ctext,
         cmd IS NOT NULL AND (bar IS NULL OR cmd > bar) AS ok
  FROM ctx JOIN collapsed e ON e.log_id = ctx.log_id AND e.idx = ctx.exit_idx
  LEFT JOIN collapsed m ON m.log_id = ctx.log_id AND m.idx = ctx.cmd
)"""


def shell_facts_sql() -> str:
    """CTEs up to ``facts``: the last failing exit of each log and the command before it."""
    return _FACTS_SQL


_J11_SQL = _FACTS_SQL + """
SELECT log_id, CASE WHEN ok THEN 'command' ELSE 'log' END AS kind, CASE WHEN ok THEN ctext ELSE '' END AS command,
       CAST(CASE WHEN ok THEN CASE WHEN ctext <> '' THEN 0.55 ELSE 0.40 END ELSE 0.30 END AS DOUBLE) AS confidence,
       CAST(CASE WHEN ok THEN cmd ELSE exit_idx END AS INTEGER) AS log_line_idx,
       CASE WHEN ok THEN 'exited with code ' || code ELSE 'non-zero exit (' || code || ')' END AS message
FROM facts"""


@register("j11_shell_detector", oracle=_J11_SQL)
def j11_shell_detector(spark, sf_dir):
    _, locs = D.ShellDetector().contribute(collapsed_lines(spark, sf_dir))
    return locs.select("log_id", "kind", "command", "confidence", "log_line_idx", "message")


_HINTS_SQL = " OR ".join(f"strpos(text, {q(h)}) > 0" for h in P.PKG_MGR_HINTS)


@register("p12_project_frames", oracle=f"""WITH {A.ADAPTER_SQL["log_lines"].strip()},
{tokenized_sql("log_lines")}
SELECT log_id, CASE WHEN {_HINTS_SQL} THEN 'framework' ELSE 'project' END AS frame, CAST(count(*) AS BIGINT) AS n
FROM lines WHERE kind = 4 GROUP BY 1, 2""")
def p12_project_frames(spark, sf_dir):
    df = T.annotate(A.log_lines(spark, sf_dir)).filter(F.col("kind") == P.KIND_STACK)
    frame = F.when(ST.project_frame(F.col("text")), F.lit("project")).otherwise(F.lit("framework"))
    return df.groupBy("log_id", frame.alias("frame")).agg(F.count(F.lit(1)).alias("n"))


@register("x13_anchor_label", oracle="SELECT log_id, CASE "
          "WHEN kind = 'command' AND command <> '' THEN '$ ' || command || CASE WHEN message <> '' THEN ' -- ' || message ELSE '' END "
          "WHEN kind = 'log' AND log_line_idx >= 0 THEN 'line ' || CAST(log_line_idx AS VARCHAR) || CASE WHEN message <> '' THEN ' -- ' || message ELSE '' END "
          "WHEN message <> '' THEN message ELSE 'unknown' END AS anchor FROM (" + _J11_SQL + ")")
def x13_anchor_label(spark, sf_dir):
    """X13 labels of the shell detector's locations."""
    from ..operators import render as R
    _, locs = D.ShellDetector().contribute(collapsed_lines(spark, sf_dir))
    st = F.struct("kind", "file", "line", "column", "function", "test_name", "command", "detector", "confidence", "log_line_idx", "message")
    return locs.select("log_id", R.anchor_label(st).alias("anchor"))


_DELTA = ("CASE WHEN text = '' THEN 0 ELSE (length(text) - length(replace(text, '{', ''))) + (length(text) - length(replace(text, '[', '')))"
          " - (length(text) - length(replace(text, '}', ''))) - (length(text) - length(replace(text, ']', ''))) END")
_W3_SQL = f"""WITH {A.ADAPTER_SQL["payload_lines"].strip()},
{tokenized_sql("payload_lines")},
d AS (SELECT *, kind = 6 AS drop0, {_DELTA} AS delta FROM lines),
dd AS (SELECT *, sum(delta) OVER (PARTITION BY log_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS dsum, count(*) OVER (PARTITION BY log_id) AS n FROM d),
ops AS (SELECT log_id, idx AS i, dsum - delta AS base, n FROM dd WHERE kind = 3 AND NOT drop0 AND text <> '' AND delta > 0),
ends AS (
  SELECT o.log_id, o.i, coalesce(min(l.idx) + 1, o.n) AS e
  FROM ops o LEFT JOIN dd l ON l.log_id = o.log_id AND l.idx > o.i AND l.dsum <= o.base
  GROUP BY o.log_id, o.i, o.n
), opn AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY i) AS rn FROM ends),
chain AS (
  WITH RECURSIVE c(log_id, rn, i, e, nxt, chosen) AS (
    SELECT log_id, rn, i, e, e, true FROM opn WHERE rn = 1
    UNION ALL
    SELECT o.log_id, o.rn, o.i, o.e, CASE WHEN o.i >= c.nxt THEN o.e ELSE c.nxt END, o.i >= c.nxt
    FROM c JOIN opn o ON o.log_id = c.log_id AND o.rn = c.rn + 1
  ) SELECT * FROM c
), blocks AS (SELECT log_id, i, e FROM chain WHERE chosen AND e - i >= {P.JSON_MIN_RUN}),
inside AS (
  SELECT b.log_id, b.i, l.idx, l.text, nullif(regexp_extract(l.text, {q(P.JSON_KEY)}, 1), '') AS k
  FROM blocks b JOIN dd l ON l.log_id = b.log_id AND l.idx > b.i AND l.idx < b.e
), keys AS (
  SELECT log_id, i, string_agg(k, ',' ORDER BY idx) AS ks FROM (
    SELECT *, row_number() OVER (PARTITION BY log_id, i ORDER BY idx) AS r FROM inside WHERE text <> '' AND k IS NOT NULL) WHERE r <= 5
  GROUP BY log_id, i
)
SELECT b.log_id, b.i AS idx, 'json-summary' AS reason,
       '<json: ' || CAST(b.e - b.i AS VARCHAR) || ' lines, top-keys=[' || coalesce(keys.ks, '?') || ']>' AS note
FROM blocks b LEFT JOIN keys ON keys.log_id = b.log_id AND keys.i = b.i
UNION ALL
SELECT log_id, idx, 'json-folded', '' FROM inside"""


@register("w3_json_fold", oracle=_W3_SQL)
def w3_json_fold(spark, sf_dir):
    """W3 on the payload corpus (each event's properties pretty-printed as a JSON block); W1 runs first."""
    from .filter import _materialize, annotated_lines
    lines = _materialize(annotated_lines(A.payload_lines(spark, sf_dir)), "checkpoint")
    df = ST.fold_json(ST.drop_banners(ST.init_state(lines)), reuse=lambda d: _materialize(d, "persist"))
    return df.filter(F.col("reason").isin("json-summary", "json-folded")).select("log_id", "idx", "reason", "note")


def _trace_logs(spark, sf_dir):
    """One Python, Node or Go trace per error event: (log_id, raw)."""
    from ..sources.tables import read_table
    ev = read_table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"]).filter("event_type = 'error'")
    e, u = F.col("event_id").cast("string"), (F.col("user_id") % 9).cast("string")
    n = F.col("event_id") % 400 + 1

    def num(k: int):
        return (n + k).cast("string")

    def text(*lines):
        return F.concat_ws("\n", *[F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in line]) for line in lines])

    python = text(["INFO start"], ["Traceback (most recent call last):"], ['  File "/app/svc', u, '/api.py", line ', num(0), ", in call"],
                  ["    result = handler(req)"], ['  File "/app/svc', u, '/handler.py", line ', num(7), ", in handler"], ["    raise it"],
                  ['  File "/usr/lib/python3.11/site-packages/lib/x.py", line 5, in one'], ["    boom"], ["ValueError: bad value ", e], ["INFO done"])
    node = text(["TypeError: Cannot read ", e], ["    at Object.charge (/app/src/pay", u, ".js:", num(0), ":15)"], ["    at async Promise.all (index 0)"],
                ["    at handler (/app/src/server.js:", num(3), ":5)"], ["    at Module._compile (node:internal/modules/cjs/loader:1254:14)"])
    go = text(["panic: runtime error: index ", e], [""], ["goroutine 1 [running]:"], ["main.process", u, "(0x0)"],
              ["\t/app/cmd/handler", u, ".go:", num(0), " +0x1d"], ["main.main()"], ["\t/app/cmd/main.go:12 +0x25"],
              ["runtime.main()"], ["\t/usr/local/go/src/runtime/proc.go:250 +0x207"])
    kind = F.col("event_id") % 3
    return ev.select(F.concat(F.lit("t"), e).alias("log_id"), F.when(kind == 0, python).when(kind == 1, node).otherwise(go).alias("raw"))


@register("e3_trace_locations", oracle="""
WITH e AS (SELECT 't' || event_id AS log_id, event_id % 3 AS kind, (user_id % 9)::VARCHAR AS u, (event_id % 400 + 1)::INT AS n, event_id::VARCHAR AS id
           FROM events WHERE event_type = 'error')
SELECT log_id, 'python_traceback' AS detector, '/app/svc' || u || '/api.py' AS file, n AS line, 0 AS column, 'call' AS function,
       0.55::DOUBLE AS confidence, 2 AS log_line_idx, 'ValueError: bad value ' || id AS message FROM e WHERE kind = 0
UNION ALL SELECT log_id, 'python_traceback', '/app/svc' || u || '/handler.py', n + 7, 0, 'handler', 0.85, 4, 'ValueError: bad value ' || id FROM e WHERE kind = 0
UNION ALL SELECT log_id, 'node_stack', '/app/src/pay' || u || '.js', n, 15, 'Object.charge', 0.85, 1, 'TypeError: Cannot read ' || id FROM e WHERE kind = 1
UNION ALL SELECT log_id, 'node_stack', '/app/src/server.js', n + 3, 5, 'handler', 0.75, 3, 'TypeError: Cannot read ' || id FROM e WHERE kind = 1
UNION ALL SELECT log_id, 'go_panic', '/app/cmd/handler' || u || '.go', n, 0, 'main.process' || u, 0.85, 4, 'panic: runtime error: index ' || id FROM e WHERE kind = 2
UNION ALL SELECT log_id, 'go_panic', '/app/cmd/main.go', 12, 0, 'main.main', 0.75, 6, 'panic: runtime error: index ' || id FROM e WHERE kind = 2
""")
def e3_trace_locations(spark, sf_dir):
    """Python, Node and Go detectors (E3b to E3d, E2, J12, W17) on traces whose locations the SQL states outright."""
    from .filter import _materialize
    lines = _materialize(ST.init_state(T.tokenize(_trace_logs(spark, sf_dir))), "checkpoint")
    _, locs, _ = D.run_detectors(lines, D.load_detectors("python_traceback,node_stack,go_panic"))
    return locs.select("log_id", "detector", "file", "line", "column", "function", F.round("confidence", 4).alias("confidence"), "log_line_idx", "message")
