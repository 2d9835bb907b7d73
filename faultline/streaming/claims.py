"""Claims on failed builds as one keyed stream state: watermark, claims, attempts and stale reclaim.

Two file streams meet per job: the feed (parsed items with their poll time) and the outcomes that the forwarder wrote for
earlier claims. The state of a job is its watermark (the highest processed build, a value state) and its builds
above that (a map state); entries at or below the watermark can never pass again and go, so state is bounded by the
open builds. In every micro-batch outcomes are booked first, claims first seen more than
``stale_minutes`` before the newest poll time count as failed, and each feed build above the watermark that is new or
failed is claimed once. ``forward`` hands a batch of claims to the caller's ``send`` and writes the outcomes: for all of a
batch together, or one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import STALE_MINUTES

FEED = "job_full_name string, build_number int, build_url string, item_id long, ts timestamp"
OUTCOME = "job_full_name string, build_number int, status string, error string, ts timestamp"
CLAIM = "job_full_name string, build_number int, build_url string, item_id long, attempts int, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Claims(StatefulProcessor):
    """The builds of one job."""

    def __init__(self, stale_minutes: int):
        self.stale = pd.Timedelta(minutes=stale_minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watermark = handle.getValueState("watermark", "build int")
        self.builds = handle.getMapState("builds", "build int", "status string, attempts int, first_seen timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)        # one job's items of one micro-batch
        top = self.watermark.get()[0] if self.watermark.exists() else 0
        known = {k[0]: v for k, v in self.builds.iterator()} if self.builds.exists() else {}
        before = dict(known)
        for r in batch[batch["status"].notna()].sort_values(["ts", "build_number"]).itertuples():
            if r.build_number in known:
                _, attempts, first = known[r.build_number]
                known[r.build_number] = (r.status, attempts + 1, first)
            top = max(top, r.build_number) if r.status == "processed" else top
        feed = batch[batch["status"].isna()].sort_values(["build_number", "item_id"])
        claimed = []
        if len(feed):
            now = feed["ts"].max()
            for r in feed.drop_duplicates("build_number").itertuples():
                status, attempts, first = known.get(r.build_number, ("seen", 0, now))
                if status == "processing" and pd.Timestamp(first).tz_localize(None) < now.tz_localize(None) - self.stale:
                    status = "failed"
                if r.build_number > top and status in ("seen", "failed"):
                    known[r.build_number] = ("processing", attempts, first)
                    claimed.append((key[0], r.build_number, r.build_url, r.item_id, attempts, now))
        for build, value in known.items():
            if build > top and before.get(build) != value:
                self.builds.updateValue((build,), value)
        for build in before:
            if build <= top:
                self.builds.removeKey((build,))
        self.watermark.update((top,))
        if claimed:
            yield pd.DataFrame(claimed, columns=["job_full_name", "build_number", "build_url", "item_id", "attempts", "ts"])

    def close(self) -> None:
        pass


def claims(feed: DataFrame, outcomes: DataFrame, stale_minutes: int = STALE_MINUTES) -> DataFrame:
    """The claims (see ``CLAIM``) of two streams with the columns of ``FEED`` and ``OUTCOME``."""
    none = F.lit(None).cast
    rows = feed.select("job_full_name", "build_number", "build_url", "item_id", "ts", none("string").alias("status")).unionByName(
        outcomes.select("job_full_name", "build_number", none("string").alias("build_url"), none("long").alias("item_id"), "ts", "status"))
    return rows.groupBy("job_full_name").transformWithStateInPandas(
        statefulProcessor=Claims(stale_minutes), outputStructType=CLAIM, outputMode="Append", timeMode="None")


def forward(claims_dir: str, outcome_dir: str, send: Callable[[DataFrame], DataFrame], send_batch: bool = True):
    """A foreachBatch sink. ``send`` gives the claims with a column ``error`` (null where it worked).

    In batch mode one error fails all claims of the batch, else each has its own outcome. Claims and outcomes are written under the
    epoch, so a repeated epoch replaces its files.
    """
    def run(df: DataFrame, epoch: int) -> None:
        target = f"{claims_dir.rstrip('/')}/epoch={epoch}"
        df.write.mode("overwrite").parquet(target)
        sent = send(df.sparkSession.read.schema(CLAIM).parquet(target))
        if send_batch:
            worst = sent.agg(F.max("error")).first()[0]
            sent = sent.withColumn("error", F.lit(worst).cast("string"))
        status = F.when(F.col("error").isNull(), "processed").otherwise("failed")
        (sent.select("job_full_name", "build_number", status.alias("status"), F.concat(F.lit("worker forward: "), "error").alias("error"), "ts")
         .write.mode("overwrite").parquet(f"{outcome_dir.rstrip('/')}/epoch={epoch}"))
    return run


def poll_once(spark: SparkSession, feed_dir: str, outcome_dir: str, checkpoint: str, sink, stale_minutes: int = STALE_MINUTES) -> None:
    """One poll: everything that came since the checkpoint, feed folders ``feed_dir/*`` and outcomes ``outcome_dir/*``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    feed = spark.readStream.schema(FEED).parquet(f"{feed_dir.rstrip('/')}/*")
    outcomes = spark.readStream.schema(OUTCOME).parquet(f"{outcome_dir.rstrip('/')}/*")
    stream = claims(feed, outcomes, stale_minutes).writeStream.outputMode("append").foreachBatch(sink)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
