"""Pass 1 and 2 on random logs against the SQL oracle, and on hand-made logs with literal results."""

from __future__ import annotations

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from faultline.operators import blocks as BK
from faultline.operators import structural as ST
from faultline.operators import tokenize as T
from faultline.plans.oracle import tokenized_sql
from faultline.plans.q_structural import _COLLAPSE_BODY

# no line here opens a JSON block: the SQL body leaves folds out (they have literal results below)
VOCAB = [
    "INFO step {n} ok", "INFO step 1 ok", "WARN retry {n} http://h/{n}", "ERROR Boom {n}", "+ make target{n}",
    "\tat com.acme.B.m(B.java:{n})", "\tat java.lang.Thread.run(Thread.java:1)", "\tat org.x.Y.z(Y.java:{n})",
    '  File "app.py", line {n}, in f', "Downloading {n}% ", "Pull complete", "========", "", "Caused by: x.Y: z{n}",
    "script returned exit code 2", "2024-01-01T00:00:00Z INFO hi {n}", "key{n}=value", "Status: ok", "   ",
    "13:01:02 Pulling fs layer", "user id 0a1b2c3d4e5f",
]


def rand_log(rng: random.Random) -> str:
    lines: list[str] = []
    for _ in range(rng.choice([0, 1, 5, 20, 60, 150, 260])):
        if rng.random() < 0.3 and lines:
            lines.append(lines[-1 - rng.randrange(min(len(lines), 5))])
        else:
            lines.append(rng.choice(VOCAB).format(n=rng.randrange(1, 400)))
    return "\n".join(lines)


def collapsed(spark, logs: dict[str, str], size: int = BK.BLOCK):
    df = spark.createDataFrame(list(logs.items()), "log_id string, raw string")
    return ST.collapse(T.tokenize(df).persist(), size=size)


@pytest.mark.parametrize("size", [BK.BLOCK, 8])
def test_collapse_equals_the_sql_oracle(spark, size):
    rng = random.Random(7)
    logs = {f"L{i}": rand_log(rng) for i in range(60)}
    rows = [(k, i, line) for k, raw in logs.items() if raw for i, line in enumerate(raw.split("\n"))]
    con = duckdb.connect()
    con.execute("CREATE TABLE src (log_id VARCHAR, idx INTEGER, raw VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?, ?, ?)", rows)
    names = ["log_id", "idx", "text", "kind", "severity", "score", "drop", "reason", "note"]
    want = con.execute("WITH " + tokenized_sql("src") + _COLLAPSE_BODY + f"\nSELECT {', '.join(names)} FROM collapsed").fetchall()
    got = [tuple(r) for r in collapsed(spark, logs, size).select(*names).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(rows)


def state(spark, raw: str) -> list[tuple]:
    rows = collapsed(spark, {"L": raw}).orderBy("idx").collect()
    return [(r.drop, r.reason, r.note, r.score) for r in rows]


KEPT = (False, "", "", 0)


def test_java_trace(spark):
    raw = "\n".join(["INFO starting", "2024-04-06T05:59:53.123Z ERROR Payment failed", "Caused by: java.net.ConnectException: refused"]
                    + [f"\tat java.base/sun.nio.ch.Net.connect{i}(Net.java:{i})" for i in range(5)]
                    + ["\tat org.apache.http.Client.exec(Client.java:10)", "\tat com.acme.pay.PaymentClient.charge(PaymentClient.java:84)",
                       "\tat com.acme.pay.Service.run(Service.java:20)", "\tat com.acme.pay.Main.main(Main.java:5)"])
    gone = (True, "stack-frame-elided", "", 0)
    assert state(spark, raw) == [KEPT, KEPT, KEPT, (False, "", "", 3), gone, gone, gone, gone, (False, "", "", 2), (False, "", "", 2),
                                 (False, "", "... 5 frame(s) elided ...", 2), gone]


def test_progress_banner_and_blank(spark):
    raw = "\n".join(["===========", "", *[f"Downloading layer {i}0%  " for i in range(10)], "Pull complete", "ERROR pull failed"])
    gone = (True, "progress-elided", "", 0)
    assert state(spark, raw) == [(True, "banner", "", 0), KEPT,
                                 (False, "progress-summary", "<progress: 11 lines elided (Downloading layer)>", 0), *[gone] * 10, KEPT]


def test_repeat_storm(spark):
    raw = "\n".join([f"WARN GET http://svc/{i} failed" for i in range(60)] + ["ERROR final"])
    got = state(spark, raw)
    # a bucket spans 51 lines after its first, and keeps its first and last line
    assert [i for i, x in enumerate(got) if not x[0]] == [0, 51, 52, 59, 60]
    assert got[51][1:3] == ("repeat-summary", "(repeated 52x over 52 lines: values=http://svc/0, http://svc/1, http://svc/2)")
    assert got[59][2] == "(repeated 8x over 8 lines: values=http://svc/52, http://svc/53, http://svc/54)"


def test_json_blocks_of_any_length_fold_whole(spark):
    keys = [f'  "key{i}": {i},' for i in range(300)]
    raw = "\n".join(["INFO a", "{", *keys, '  "inner": {', '    "x": 1', "  }", "}", "INFO b", '{"one": "line"}', "{", "}", "["])
    got = state(spark, raw)
    assert got[1] == (False, "json-summary", "<json: 305 lines, top-keys=[key0,key1,key2,key3,key4]>", 0)
    assert all(x[:2] == (True, "json-folded") for x in got[2:305])
    assert got[305][1] == "json-folded" and got[0] == got[306] == got[307] == KEPT


def test_unclosed_json_goes_to_the_end(spark):
    raw = "\n".join(["{", *[f'  "k{i}": 1,' for i in range(6)]])
    got = state(spark, raw)
    assert got[0][1:3] == ("json-summary", "<json: 7 lines, top-keys=[k0,k1,k2,k3,k4]>") and all(x[0] for x in got[1:])


def test_bounded_json_runs(spark):
    raw = "\n".join(["{", *[f'  "k{i}": 1,' for i in range(20)], "}"])
    df = spark.createDataFrame([("L", raw)], "log_id string, raw string")
    notes = [r.note for r in ST.fold_json(ST.init_state(T.tokenize(df)), max_run=10).orderBy("idx").collect() if r.note]
    assert notes == ["<json: 10 lines, top-keys=[k0,k1,k2,k3,k4]>"]


def test_long_lines_and_line_ends(spark):
    long = "INFO " + "x" * 5000
    rows = collapsed(spark, {"L": "﻿a\r\nb\rc\n" + long, "E": ""}).orderBy("idx").collect()
    assert [(r.idx, r.text) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (3, long)]


def test_collapse_stats(spark):
    st = ST.collapse_stats(collapsed(spark, {"L0": "\n".join(["WARN x 1"] * 10 + ["========"])})).collect()[0]
    assert st.banner == 1 and st.repeat_elided == 8


def test_json_folds_reach_over_blocks(spark):
    inner = [f'"k{i}": [' if i % 7 == 3 else "]," if i % 7 == 5 else f'"v{i}": {i},' for i in range(42)]
    raw = "\n".join(["INFO start", "{", *inner, "}", "INFO middle", '{"a": {', '"b": 1', "}", "}", "{", '"open": 1', "INFO end"])
    whole = [tuple(r) for r in collapsed(spark, {"L": raw}).orderBy("idx").select("idx", "drop", "reason", "note").collect()]
    assert [n for _, _, _, n in whole if n.startswith("<json")][0].startswith("<json: 44 lines")
    for size in (3, 16):
        assert [tuple(r) for r in collapsed(spark, {"L": raw}, size).orderBy("idx").select("idx", "drop", "reason", "note").collect()] == whole


def test_a_hot_log_is_cut_into_segments_between_runs(spark):
    rng = random.Random(3)
    hot = []
    while len(hot) < 6000:
        hot += ["\tat com.acme.B.m(B.java:1)"] * rng.randrange(12) + [f"Downloading {i}% " for i in range(rng.randrange(9))]
        hot += [f"INFO step {rng.randrange(50)}" for _ in range(rng.randrange(1, 20))]
    logs = {"hot": "\n".join(hot)} | {f"L{i}": "INFO a\nINFO b" for i in range(20)}
    lines = ST.prepared(T.tokenize(spark.createDataFrame(list(logs.items()), "log_id string, raw string")), 100)
    rows = lines.select("log_id", "_seg", "idx", "kind").orderBy("log_id", "idx").collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.log_id, r._seg] = sizes.get((r.log_id, r._seg), 0) + 1
    assert max(sizes.values()) <= 200 and len([k for k in sizes if k[0] == "hot"]) >= 59
    for a, b in zip(rows, rows[1:]):
        if a.log_id == b.log_id and a._seg != b._seg:
            assert b._seg == b.idx and b.kind not in (4, 5)       # a segment begins outside stack and progress runs


def test_scans_and_links_equal_plain_loops(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, *range(-5, 6)])) for k in ("a", "b") for i in sorted(rng.sample(range(300), 120))]
    df = BK.with_blocks(spark.createDataFrame(rows, "k string, idx int, v int"), 16)
    back = BK.scan(df, ["k"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, own=False)
    ahead = BK.scan(df, ["k"], {"f": ("first", F.col("v"))}, ahead=True)
    got = {(r.k, r.idx): (r.s, r.m, r.l) for r in back.collect()}
    nxt = {(r.k, r.idx): r.f for r in ahead.collect()}
    for k, i, v in rows:
        before = [x for q, j, x in rows if q == k and j < i and x is not None]
        s, m, last = got[k, i]
        assert (s or 0, m, last) == (sum(before), max(before, default=None), before[-1] if before else None)
        behind = [x for q, j, x in rows if q == k and j >= i and x is not None]
        assert nxt[k, i] == (behind[0] if behind else None)
    asked = df.withColumn("at", F.col("idx") + 20)
    for r in BK.next_at(df, asked, ["k"], "at", "nxt", 16).collect():
        assert r.nxt == min((j for q, j, _ in rows if q == r.k and j >= r.idx + 20), default=None)
    links = BK.next_at(df, asked, ["k"], "at", "nxt", 16)
    starts = df.groupBy("k").agg(F.min("idx").alias("idx"))
    want = set()
    for k in ("a", "b"):
        own = [j for q, j, _ in rows if q == k]
        at = own[0]
        while at is not None:
            want.add((k, at))
            at = min((j for j in own if j >= at + 20), default=None)
    assert {tuple(r) for r in BK.greedy_chain(starts, links, ["k"]).collect()} == want


@pytest.mark.parametrize("line, asked", [('{"step": 1}', 0), ("[", 1), ('{"a": [', 1), ("}", 0)])
def test_folds_are_planned_only_where_a_line_may_open_one(spark, monkeypatch, line, asked):
    """without an opening line the lines aren't kept and searched for folds."""
    calls, real = [], ST.fold_json
    monkeypatch.setattr(ST, "fold_json", lambda *a, **k: calls.append(1) or real(*a, **k))
    rows = collapsed(spark, {"L": f"INFO a\n{line}\n  \"k\": 1\n  \"l\": 2\nplain b"}).collect()
    assert len(rows) == 5 and len(calls) == asked
