"""Scans block by block: values ahead, and frames that take one step a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import blocks as BK


def test_scans_ahead_find_the_next_point_and_grow_their_frames(spark):
    points = [("a", i * 7 % 50 + (i // 7) * 50) for i in range(40)] + [("b", 3)]
    queries = [(k, i) for k in "abc" for i in range(0, 330, 5)]
    asked = spark.createDataFrame(queries, "key string, start int")
    known = spark.createDataFrame(points, "key string, idx int")
    for size in (16, 1 << 16):
        found = BK.next_at(known, asked, ["key"], "start", "nxt", size)
        assert {(r.key, r.start): r.nxt for r in found.collect()} == {
            (k, s): min((p for x, p in points if x == k and p >= s), default=None) for k, s in queries}
        plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan      # a shrinking frame is quadratic


def test_a_scan_ahead_without_own_values(spark):
    rows = BK.with_blocks(spark.createDataFrame([(1, i, i if i % 4 == 0 else None) for i in range(30)], "key int, idx int, v int"), 8)
    got = BK.scan(rows, ["key"], {"nxt": ("first", F.col("v"))}, ahead=True, own=False)
    assert {r.idx: r.nxt for r in got.collect()} == {i: (i // 4 + 1) * 4 if i < 28 else None for i in range(30)}
