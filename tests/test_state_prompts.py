"""State machine, feedback, retention, replies and the XML feed source."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from faultline.operators import ingest as I
from faultline.operators import prompts as PR
from faultline.operators import state as ST

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def test_status_fold_and_stale(spark):
    ev = spark.createDataFrame([
        ("j", 1, T0, "claim", None), ("j", 1, T0 + dt.timedelta(seconds=1), "failed", "x" * 5000),
        ("j", 1, T0 + dt.timedelta(seconds=2), "claim", None), ("j", 1, T0 + dt.timedelta(seconds=3), "processed", None),
        ("j", 1, T0 + dt.timedelta(seconds=4), "claim", None),
        ("j", 2, T0, "claim", None),
    ], "job_full_name string, build_number int, ts timestamp, action string, error string")
    st = {r.build_number: r for r in ST.status_fold(ev, now=T0 + dt.timedelta(hours=1)).collect()}
    assert (st[1].status, st[1].attempt_count, st[1].claims_granted, st[1].last_error) == ("processed", 2, 2, None)
    assert (st[2].status, st[2].last_error) == ("failed", ST.STALE_ERROR)


def test_status_fold_equals_the_state_machine(spark):
    """Random event sequences against the machine, event by event."""
    import random
    rng = random.Random(8)
    rows = []
    for b in range(80):
        for i in range(rng.randint(1, 9)):
            action = rng.choice(["claim", "claim", "processed", "failed", "other"])
            rows.append(("j", b, T0 + dt.timedelta(seconds=i), action, rng.choice([None, "late", "boom"]) if action == "failed" else None))
    want = {}
    for _, b, ts, action, error in rows:
        s = want.setdefault(b, {"status": None, "attempts": 0, "error": None, "first": None, "done": None, "claims": 0})
        if action == "claim" and s["status"] in (None, "failed"):
            s["first"] = s["first"] or ts
            s["status"], s["claims"] = "processing", s["claims"] + 1
        elif action in ("processed", "failed") and s["status"]:
            s["status"], s["attempts"] = action, s["attempts"] + 1
            s["error"] = None if action == "processed" else error or ""
            s["done"] = ts if action == "processed" else s["done"]
    df = spark.createDataFrame(rows, "job_full_name string, build_number int, ts timestamp, action string, error string").repartition(4)
    got = {r.build_number: (r.status, r.attempt_count, r.last_error, r.first_seen_at, r.processed_at, r.claims_granted)
           for r in ST.status_fold(df).collect()}
    assert got == {b: (s["status"], s["attempts"], s["error"], s["first"], s["done"], s["claims"]) for b, s in want.items() if s["status"]}


def test_feedback_idempotent(spark):
    sessions = spark.createDataFrame([("s1", "", "fix it", ""), ("s2", "accepted", "fix", ""), ("s3", "", "", "")],
                                     "id string, feedback_status string, suggested_fix string, analysis string")
    dec = spark.createDataFrame([("s1", "Accept ", T0), ("s1", "reject", T0 + dt.timedelta(minutes=1)),
                                 ("s2", "reject", T0), ("s3", "accept", T0), ("s3", "reject", T0 + dt.timedelta(minutes=1))],
                                "session_id string, decision string, ts timestamp")
    out = {r.id: r for r in ST.apply_feedback(sessions, dec).collect()}
    assert (out["s1"].feedback_status, out["s1"].store_solution) == ("accepted", True)
    assert (out["s2"].feedback_status, out["s2"].idempotent) == ("accepted", True)
    assert out["s3"].feedback_status == "rejected"  # the accept had nothing to store


def test_solution_ids_and_upsert(spark):
    df = spark.createDataFrame([("RUN-1", "j", 3, "s", "fp"), ("", "j", 3, "s", " fp ")], "sid string, job string, b int, st string, fp string")
    ids = [r[0] for r in df.select(ST.solution_doc_id(F.col("sid"), F.col("job"), F.col("b"), F.col("st"), F.col("fp"))).collect()]
    import hashlib
    assert ids[0] == "run-1" and ids[1] == hashlib.sha256(b"j|3|s|fp").hexdigest()
    old = spark.createDataFrame([("a", "old", T0)], "doc_id string, solution string, created_at timestamp")
    new = spark.createDataFrame([("a", "new", T0 - dt.timedelta(days=1)), ("b", "b1", T0)], "doc_id string, solution string, created_at timestamp")
    got = {r.doc_id: r.solution for r in ST.upsert_solutions(old, new).collect()}
    assert got == {"a": "new", "b": "b1"}


def test_retention_cascade(spark):
    s = spark.createDataFrame([("s1", T0), ("s2", T0 - dt.timedelta(days=400))], "id string, updated_at timestamp")
    m = spark.createDataFrame([("m1", "s1", T0), ("m2", "s2", T0), ("m3", "s1", T0 - dt.timedelta(days=100))],
                              "id string, session_id string, created_at timestamp")
    ks, km, counts = ST.retention(s, m, T0, 180, 90)
    assert [r.id for r in ks.collect()] == ["s1"] and [r.id for r in km.collect()] == ["m1"]
    c = counts.first()
    assert (c.sessions_deleted, c.messages_deleted) == (1, 1)


def test_reply_split_and_preamble(spark):
    text = "Exact match found (similarity 97%).\n\nThe build broke because X.\n\n## Step-by-Step Fix\n### Step 1: do y"
    df = spark.createDataFrame([(text,), ("plain answer",)], "c string")
    sp = df.select(PR.split_reply(F.col("c")).alias("s")).collect()
    assert sp[0].s.suggested_fix.startswith("## Step-by-Step Fix") and sp[1].s.suggested_fix == ""
    st = PR.strip_preamble(df.select(F.col("c")), "c").collect()
    assert st[0].stripped.startswith("The build broke because X.") and st[1].stripped == "plain answer"


def test_read_feed_xml(spark):
    d = tempfile.mkdtemp(prefix="feed-")
    with open(os.path.join(d, "atom.xml"), "w") as fh:
        fh.write('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>team » web #12 (broken)</title>'
                 '<link href="http://ci/job/web/12/"/></entry><entry><title>no link</title></entry></feed>')
    rows = I.read_feed(spark, d).collect()
    assert [(r.title, r.link) for r in rows] == [("team » web #12 (broken)", "http://ci/job/web/12/")]


def test_read_feed_rss(spark):
    d = tempfile.mkdtemp(prefix="feed-rss-")
    with open(os.path.join(d, "rss.xml"), "w") as fh:
        fh.write("<rss><channel><item><title>demo #7</title><link>http://ci/job/demo/7/</link></item>"
                 "<item><title></title><link>http://x</link></item></channel></rss>")
    rows = I.read_feed(spark, d).collect()
    assert [(r.title, r.link) for r in rows] == [("demo #7", "http://ci/job/demo/7/")]
    parsed = I.feed_builds(I.read_feed(spark, d).withColumn("item_id", F.lit(1))).first()
    assert (parsed.job_full_name, parsed.build_number, parsed.build_url) == ("demo", 7, "http://ci/job/demo/7/")
