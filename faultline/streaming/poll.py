"""Structured Streaming poll of failed-build feeds.

The feed arrives as files (one row per feed item: ``title``, ``link``,
``item_id``). Each micro-batch parses titles (X20), keeps per job only builds
above the job's watermark (the highest build number seen so far, read once per
batch, held as keyed state), de-duplicates (job, build) and forwards the result
with ``foreachBatch``. Forwarding is idempotent: a batch is written under its
epoch id, so a retried epoch overwrites rather than duplicates.

The watermark is per-key *build-number* state, not an event-time watermark:
builds at or below it are dropped for good, exactly like the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ingest as I

OUT_SCHEMA = "job_full_name string, build_number int, build_url string, item_id long"
STATE_SCHEMA = "max_build int"


def _watermark_fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Per job, pass builds above the stored maximum; the maximum then advances."""
    wm = top = state.get[0] if state.exists else 0
    first: pd.DataFrame | None = None           # the first item of each new build, so far
    for part in pdfs:
        top = max(top, int(part["build_number"].max())) if len(part) else top
        part = part[part["build_number"] > wm]
        first = part if first is None else pd.concat([first, part], ignore_index=True)
        first = first.sort_values(["build_number", "item_id"]).drop_duplicates(subset=["build_number"], keep="first")
    state.update((top,))
    if first is not None and len(first):
        yield first[["job_full_name", "build_number", "build_url", "item_id"]]


def new_failures(feed_stream: DataFrame) -> DataFrame:
    """Z1/Z2 plan on a streaming feed DataFrame (title, link, item_id)."""
    builds = I.feed_builds(feed_stream)
    return builds.groupBy("job_full_name").applyInPandasWithState(
        _watermark_fn, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def forward_batch(out_dir: str):
    """Idempotent sink: each epoch is written to its own folder (overwritten on retry)."""
    def fn(df: DataFrame, epoch_id: int) -> None:
        df.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch_id}")
    return fn


def poll(spark: SparkSession, feed_path: str, feed_schema: str, checkpoint: str, sink,
         query_name: str = "faultline_poll", available_now: bool = True, processing_time: str = "20 seconds"):
    """Start the poll stream; ``sink`` is a foreachBatch function, such as ``forward_batch(path)``."""
    src = spark.readStream.schema(feed_schema).parquet(feed_path)
    out = new_failures(src)
    w = out.writeStream.option("checkpointLocation", checkpoint).queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.outputMode("append").foreachBatch(sink).start()
