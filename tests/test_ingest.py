"""Listener facts (FIXTURES.md) on our own fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import ingest as I


def _stages(spark, rows):
    return spark.createDataFrame(rows, "build_key string, stage_id long, name string, status string, start_ms long, duration_ms long")


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_no, []).append(r.stage_id)
    return sorted(sorted(v) for v in out.values())


def test_overlap_slack(spark):
    base = [("b", 10, "a", "SUCCESS", 0, 1000), ("b", 20, "c", "FAILED", 2500, 1000)]
    assert _groups(I.overlap_groups(_stages(spark, base), 2000)) == [[10, 20]]
    late = [("b", 10, "a", "SUCCESS", 0, 1000), ("b", 20, "c", "FAILED", 4000, 1000)]
    assert _groups(I.overlap_groups(_stages(spark, late), 2000)) == [[10], [20]]
    touch = [("b", 10, "a", "SUCCESS", 0, 1000), ("b", 20, "c", "FAILED", 1000, 1000)]
    assert _groups(I.overlap_groups(_stages(spark, touch), 0)) == [[10], [20]]


def test_parallel_markers_and_root(spark):
    st = _stages(spark, [("b", 80, "build", "SUCCESS", 0, 100), ("b", 92, "t1", "FAILED", 200, 100),
                         ("b", 94, "t2", "FAILED", 200, 100), ("b", 96, "t3", "SUCCESS", 200, 100),
                         ("b", 165, "deploy", "FAILED", 400, 100)])
    mk = spark.createDataFrame([("b", 81, "start"), ("b", 160, "end")], "build_key string, node_id long, kind string")
    pb = {r.stage_id: (r.block, r.valid) for r in I.parallel_blocks(st, mk).collect()}
    assert pb[80] == (None, True) and pb[92] == (81, True) and pb[96] == (81, True) and pb[165] == (None, True)
    roots = sorted(r.stage_id for r in I.root_failures(st, mk).collect())
    assert roots == [92, 94]
    unclosed = spark.createDataFrame([("b", 81, "start")], "build_key string, node_id long, kind string")
    assert all(not r.valid for r in I.parallel_blocks(st, unclosed).collect())


def test_nested_and_unmatched_markers(spark):
    """W9 against a stack: nesting, an end without a start, a block that stays open."""
    import random
    rng = random.Random(6)
    stages, markers, want = [], [], {}
    for b in range(40):
        stack, inside = [], {}
        for i in range(1, rng.randint(3, 25)):
            kind = rng.choice(["stage", "start", "end", "note"])
            if kind == "stage":
                stages.append((f"b{b}", i, "s", "SUCCESS", i * 10, 5))
                inside[i] = stack[-1] if stack else None
            else:
                markers.append((f"b{b}", i, kind))
                if kind == "start":
                    stack.append(i)
                elif kind == "end" and stack:
                    stack.pop()
        want |= {(f"b{b}", i): (blk if not stack else None, not stack) for i, blk in inside.items()}
    mk = spark.createDataFrame(markers, "build_key string, node_id long, kind string")
    got = {(r.build_key, r.stage_id): (r.block, r.valid) for r in I.parallel_blocks(_stages(spark, stages), mk).collect()}
    assert got == want


def test_root_by_overlap(spark):
    st = _stages(spark, [("b", 10, "a", "SUCCESS", 0, 100), ("b", 20, "x", "FAILED", 1000, 500), ("b", 30, "y", "FAILED", 1200, 500),
                         ("b", 40, "z", "FAILED", 9000, 100)])
    assert sorted(r.stage_id for r in I.root_failures(st, slack_ms=0).collect()) == [20, 30]


def test_text_helpers(spark):
    df = spark.createDataFrame([("team » web-build #123 (Failed)", "http://ci/job/x/123"), ("demo #7", "http://ci/d/7//"),
                                ("not a build line", "http://x")], "title string, link string")
    got = [r.p for r in df.select(I.parse_feed_title(F.col("title"), F.col("link")).alias("p")).collect()]
    assert (got[0].job_full_name, got[0].build_number, got[0].build_url) == ("team/web-build", 123, "http://ci/job/x/123/")
    assert (got[1].job_full_name, got[1].build_number, got[1].build_url) == ("demo", 7, "http://ci/d/7/")
    assert got[2] is None
    h = spark.createDataFrame([("<b>12:00:01 hello</b>\n12:00:02 world&amp;done",)], "h string")
    assert h.select(I.strip_html(F.col("h"))).first()[0] == "hello\nworld&done"
    t = spark.createDataFrame([("A" * 1000 + "B" * 1000,)], "t string").select(I.truncate_chars(F.col("t"), 600).alias("x")).first().x
    assert len(t) <= 600 and t.startswith("A") and t.endswith("B") and "characters omitted" in t
    s = spark.createDataFrame([("java.lang.IllegalStateException: boom",), ("ERROR: failed",), ("all good here",)], "l string")
    sc = [r[0] for r in s.select(I.anchor_score(F.col("l"))).collect()]
    assert sc[0] > sc[1] and sc[2] is None


def test_snippets(spark):
    lines = ["INFO a"] * 5 + ["ERROR: connection refused to db"] + ["INFO b"] * 20 + ["[Pipeline] }", "java.lang.RuntimeException: x"]
    df = spark.createDataFrame([("L", i, l) for i, l in enumerate(lines)], "log_id string, idx int, raw string")
    snip = I.error_snippets(df).first().snippet
    assert "connection refused" in snip and "RuntimeException" in snip and "[Pipeline]" not in snip and "\n\n" in snip


def test_truncate_lines_matches_text(spark):
    import random
    rng = random.Random(3)
    rows = []
    for k in range(12):
        n = rng.choice([1, 5, 40, 400, 3000])
        for i in range(n):
            rows.append((f"k{k}", i, "x" * rng.randrange(0, 60) + str(i)))
    df = spark.createDataFrame(rows, "key string, idx int, raw string")
    got = {r.key: r.excerpt for r in I.truncate_lines(df, "key", 600).collect()}
    full = df.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "raw"))), lambda s: s["raw"]), "\n").alias("t"))
    want = {r.key: r.e for r in full.select("key", I.truncate_chars(F.col("t"), 600).alias("e")).collect()}
    assert got == want


def test_character_references(spark):
    raw = "12:00:01 <b>a</b> &#x27;q&#8217; &copy; &mdash; &amp;lt; &nbsp;| &notareal; &#39;\n12:00:02 <i>z</i>"
    df = spark.createDataFrame([(raw,), (None,)], "t string")
    got = [r[0] for r in df.select(I.strip_html(F.col("t"))).collect()]
    assert got == ["a 'q’ © — &lt;  | ¬areal; '\nz", None]


def test_truncation_at_any_size(spark):
    """Literal lengths and ends; the notice names what is left out."""
    text = "".join(chr(97 + i % 26) for i in range(1000))
    lines = spark.createDataFrame([("L", i, text[i * 100:(i + 1) * 100 - 1]) for i in range(10)], "log_id string, idx int, raw string")
    joined = "\n".join(text[i * 100:(i + 1) * 100 - 1] for i in range(10))
    one = spark.createDataFrame([(joined,)], "t string")
    for limit in (2000, 500, 281, 280, 270, 200, 150, 140, 100, 10, 3, 0, None):
        a = one.select(I.truncate_chars(F.col("t"), limit)).first()[0]
        b = I.truncate_lines(lines, "log_id", limit).first().excerpt
        assert a == b, limit
        if limit is None or limit >= len(joined):
            assert a == joined
        elif limit == 0:
            assert a == ""
        elif limit >= 150:
            omitted = int(a.split("... [")[1].split(" ")[0])
            notice = f"\n... [{omitted} characters omitted; increase MAX_STAGE_LOG_CHARS] ...\n"
            head, tail = a.split(notice)
            assert joined.startswith(head) and joined.endswith(tail) and len(a) <= limit
            assert len(head) + len(tail) + omitted == len(joined)
        else:
            assert a == joined[:max(0, limit - 3)] + "..."


def test_feed_links(spark, tmp_path):
    (tmp_path / "atom.xml").write_text(
        '<feed><entry><title> a #1 (x) </title><link href="http://1/a"/><link href="http://1/b" rel="self"/></entry>'
        "<entry><title>no link</title></entry></feed>")
    (tmp_path / "rss.xml").write_text(
        "<rss><channel><item><title>b #2 (x)</title><link>http://2/</link></item>"
        '<item><title>c #3 (x)</title><link href="http://3/"/></item><item><title>\t\n</title><link>http://4/</link></item></channel></rss>')
    assert sorted(map(tuple, I.read_feed(spark, str(tmp_path)).collect())) == [
        ("a #1 (x)", "http://1/a"), ("b #2 (x)", "http://2/"), ("c #3 (x)", "http://3/")]


def test_blank_excerpts_and_child_logs(spark):
    body = '{"job_full_name":"j","failed_stages":[{"stage_name":"a","log_excerpt":"\\t\\n "},{"stage_name":"b","log_excerpt":"x"}]}'
    got = I.ingest_events(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.stage_name, r.raw) for r in got] == [("b", "x")]
    kids = spark.createDataFrame([("b", 1, 2, "  <b>two</b> &gt; \n"), ("b", 1, 1, "one"), ("b", 1, 3, " \t"), ("b", 1, 4, "<br>")],
                                 "build_key string, stage_id int, node_id int, text string")
    assert I.child_log_concat(kids).first().child_log == "one\ntwo >"


def test_session_rows_have_their_own_ids(spark):
    import datetime

    from faultline.operators import state as ST
    rows = spark.createDataFrame([("e1", "j", 1, "s", "f"), ("e2", "j", 1, "s", "f")],
                                 "event string, job_full_name string, build_number int, stage_name string, fingerprint string")
    out = ST.new_session_rows(rows, datetime.datetime(2024, 1, 1), F.col("event")).collect()
    assert len({r.id for r in out}) == 2 and len(out[0]) == 18 and out[0].filter_meta == "{}" and out[0].match_score == 0.0
