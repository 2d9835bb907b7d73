"""Claims over several polls: late builds vanish, failures and stale claims are taken again, both forwarding modes."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from faultline.streaming import claims as C

T0 = dt.datetime(2024, 1, 1, 12, 0)


class Poll:
    def __init__(self, spark):
        root = tempfile.mkdtemp(prefix="claims-test-")
        self.spark, self.n = spark, 0
        self.feed, self.out, self.done, self.ck = (os.path.join(root, x) for x in ("feed", "claims", "outcomes", "ck"))
        for d in (self.feed, self.done):
            os.makedirs(d)

    def __call__(self, builds, minutes, send=None, send_batch=True, crash=False):
        """Land a feed, poll from the checkpoint, return the new claims (job, build, attempts)."""
        ts = T0 + dt.timedelta(minutes=minutes)
        self.n += 1
        rows = [(job, b, f"http://ci/{job}/{b}", 100 * self.n + i, ts) for i, (job, b) in enumerate(builds)]
        self.spark.createDataFrame(rows, C.FEED).coalesce(1).write.parquet(f"{self.feed}/{self.n}")
        seen = set(os.listdir(self.out)) if os.path.isdir(self.out) else set()
        done = self.done + "-lost" if crash else self.done
        sink = C.forward(self.out, done, send or (lambda d: d.withColumn("error", F.lit(None).cast("string"))), send_batch)
        C.poll_once(self.spark, self.feed, self.done, self.ck, sink)
        new = [f"{self.out}/{x}" for x in sorted(set(os.listdir(self.out)) - seen)]
        got = self.spark.read.schema(C.CLAIM).parquet(*new).collect()
        return sorted((r.job_full_name, r.build_number, r.attempts) for r in got)


def failing(*jobs):
    return lambda d: d.withColumn("error", F.when(F.col("job_full_name").isin(*jobs), F.lit("down")))


def test_polls_per_event(spark):
    poll = Poll(spark)
    first = poll([("api", 5), ("api", 7), ("api", 5), ("web", 2)], 0, failing("web"), send_batch=False)
    assert first == [("api", 5, 0), ("api", 7, 0), ("web", 2, 0)]
    # 6 is late (7 is processed), 8 is new, web 2 failed and is taken again
    assert poll([("api", 6), ("api", 8), ("web", 2), ("web", 1)], 1) == [("api", 8, 0), ("web", 1, 0), ("web", 2, 1)]
    assert poll([("api", 8), ("web", 2), ("web", 1)], 2) == []


def test_batch_mode_fails_together_and_stale_claims_return(spark):
    poll = Poll(spark)
    assert poll([("api", 1), ("web", 1)], 0, failing("web")) == [("api", 1, 0), ("web", 1, 0)]
    # one error failed both; this time the worker dies and no outcome comes
    assert poll([("api", 1), ("web", 1)], 5, crash=True) == [("api", 1, 1), ("web", 1, 1)]
    assert poll([("api", 1), ("web", 1)], 20) == []
    assert poll([("api", 1), ("web", 1)], 31) == [("api", 1, 1), ("web", 1, 1)]
    assert poll([("api", 1), ("web", 1)], 70) == []
