"""Streaming poll: keyed build watermark across micro-batches, idempotent forwarding."""

from __future__ import annotations

import os
import tempfile

from faultline.streaming import poll as POLL

SCHEMA = "title string, link string, item_id long"


def _land(spark, d, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(d, name))


def test_watermark_across_batches(spark):
    root = tempfile.mkdtemp(prefix="poll-test-")
    feed, out, ck = (os.path.join(root, x) for x in ("feed", "out", "ck"))
    os.makedirs(feed)
    _land(spark, feed, "b1", [("team » api #5 (Failed)", "http://ci/api/5", 1), ("team » api #5 (Failed)", "http://ci/api/5", 2),
                              ("team » api #7 (Failed)", "http://ci/api/7", 3), ("web #2 (Failed)", "http://ci/web/2", 4)])
    q = POLL.poll(spark, feed + "/*", SCHEMA, ck, sink=POLL.forward_batch(out))
    q.awaitTermination()
    first = {(r.job_full_name, r.build_number) for r in spark.read.parquet(out).collect()}
    assert first == {("team/api", 5), ("team/api", 7), ("web", 2)}
    # Second poll: build 6 is below the job's watermark (7) and is dropped for good; 8 passes.
    _land(spark, feed, "b2", [("team » api #6 (Failed)", "http://ci/api/6", 5), ("team » api #8 (Failed)", "http://ci/api/8", 6),
                              ("web #2 (Failed)", "http://ci/web/2", 7)])
    q = POLL.poll(spark, feed + "/*", SCHEMA, ck, sink=POLL.forward_batch(out))
    q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert {(r.job_full_name, r.build_number) for r in rows} == first | {("team/api", 8)}
    assert len(rows) == 4
