"""The whole log filter as one DataFrame plan.

``filter_logs`` takes whole logs (``log_id, raw`` plus optional ``job_name``,
``stage_name``) or already split lines (``log_id, idx, raw``) and returns one
result row per log: rendered body, fingerprint, primary error, confidence,
ranked locations and telemetry. Passes:

tokenize -> structural collapse -> detectors -> baseline -> score -> select -> render

All per-line work is partitioned once by ``log_id``; intermediate line tables
are reliably checkpointed into ``spark.checkpoint.dir`` (default) where several
later branches read them: this cuts lineage (an executor loss recomputes from
the last checkpoint, not from the raw logs) and keeps the analysed plan small,
since every pass reads its input more than once (band joins, per-detector
branches, per-log aggregates joined back).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import baseline as B
from ..operators import blocks as BK
from ..operators import detectors as D
from ..operators import render as R
from ..operators import select as S
from ..operators import structural as ST
from ..operators import tokenize as T
from ..session import checkpoint_dir

LOG = "log_id"
Derived = Callable[[DataFrame], DataFrame]


_PERSISTED: list[DataFrame] = []


def release() -> None:
    """Unpersist every intermediate persisted by the plans (safe at any time: a
    released frame is recomputed from its lineage if it is read again)."""
    while _PERSISTED:
        _PERSISTED.pop().unpersist(blocking=False)


def _materialize(df: DataFrame, how: str | None) -> DataFrame:
    if how == "persist":
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        _PERSISTED.append(out)
        return out
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df


def annotated_lines(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Split (if needed) and annotate; hash-partition by (log, block of lines) once, so a hot log is many tasks' work."""
    lines = df if "idx" in df.columns else T.split_lines(df.select(LOG, "raw"))
    lines = BK.with_blocks(lines.select(LOG, "idx", "raw"))
    return T.annotate(lines.repartition(partitions, LOG, BK.BLK) if partitions else lines.repartition(LOG, BK.BLK))


def filter_lines(lines: DataFrame, detectors="auto", sketch: DataFrame | Derived | None = None,
                 logs_meta: DataFrame | Derived | None = None, token_budget: int = P.BODY_MAX_TOKENS,
                 body_max_chars: int | None = None, max_active: int | None = None,
                 materialize: str | None = "checkpoint", reuse: str | None = "persist",
                 with_citation: bool = True) -> tuple[DataFrame, DataFrame]:
    """Run every pass on annotated lines; returns (results per log, final lines).

    ``sketch`` and ``logs_meta`` may be functions that derive them from the checkpointed lines.

    ``materialize`` applies at pass boundaries (default: reliable checkpoint),
    ``reuse`` inside a pass where one intermediate feeds several branches.
    """
    keep = lambda d: _materialize(d, reuse)
    lines = _materialize(lines, materialize)
    sketch = keep(sketch(lines)) if callable(sketch) else sketch
    logs_meta = logs_meta(lines) if callable(logs_meta) else logs_meta
    collapsed = _materialize(ST.collapse(lines, reuse=keep).drop(BK.BLK), materialize)
    dets = D.load_detectors(detectors) if isinstance(detectors, str) or detectors is None else list(detectors)
    marked, locs, names = D.run_detectors(collapsed, dets, cap=max_active, materialize=lambda d: _materialize(d, materialize),
                                          reuse=keep)
    # Locations and names are small and already start from checkpointed tables.
    locs = _materialize(locs, reuse)
    names = _materialize(names, reuse)
    if logs_meta is not None and sketch is not None:
        marked = marked.join(logs_meta, LOG, "left")
    based = B.apply_baseline(marked, sketch) if sketch is not None else B.apply_baseline(marked)
    final = _materialize(S.select_lines(S.score_lines(based), token_budget=token_budget, reuse=keep), materialize)
    ranked = R.rank_locations(locs)
    results = R.render(final, ranked, names, logs_meta, body_max_chars=body_max_chars, with_citation=with_citation)
    return results, final


def filter_logs(logs: DataFrame, detectors="auto", sketch: DataFrame | None = None, **kw) -> DataFrame:
    """Whole logs in, one result row per log out. Empty logs give an empty LOW result."""
    meta = None
    whole = "raw" in logs.columns and "idx" not in logs.columns
    if whole or "job_name" in logs.columns or "stage_name" in logs.columns:
        meta = logs.select(LOG, F.coalesce(F.col("job_name") if "job_name" in logs.columns else F.lit(""), F.lit("")).alias("job_name"),
                           F.coalesce(F.col("stage_name") if "stage_name" in logs.columns else F.lit(""), F.lit("")).alias("stage_name"),
                           *([F.length("raw").alias("log_chars"), R.exit_code(F.col("raw")).alias("log_exit")] if whole else []))
    results, _ = filter_lines(annotated_lines(logs), detectors, sketch, meta, **kw)
    if "raw" in logs.columns and "idx" not in logs.columns:
        empty = logs.filter(F.coalesce(F.length("raw"), F.lit(0)) == 0).select(
            LOG, F.coalesce(F.length("raw"), F.lit(0)).alias("raw_chars"))
        empty_rows = empty.select(
            LOG, F.lit("").alias("job_name"), F.lit("").alias("stage_name"), F.lit("").alias("body"), F.lit("").alias("fingerprint"),
            F.lit("Unknown").alias("primary_error"), F.lit("N/A").alias("exit_code"), F.lit("LOW").alias("confidence"),
            F.lit("empty input").alias("low_confidence_reason"))
        results = results.unionByName(empty_rows, allowMissingColumns=True)
    return results
