"""Pass 3: baseline diff.

Two sketches decide whether a template is "normal" for a log:

* self-baseline: INFO templates seen at least 3 times in the first
  ``max(20, int(n * 0.30))`` lines of the same log (never "very common");
* counter sketch (A10): the fraction of successful builds of the same
  (job, stage) whose log contains the template; common >= 0.6, very common >= 0.9.

``apply_baseline`` drops common INFO lines, boosts novel INFO lines by +2 and
drops WARN lines only when very common and seen twice in this log; ERROR and
above are exempt. Logs whose (job, stage) has counter rows use them, all others
fall back to the self-baseline (E5 provider order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

LOG = "log_id"


def counter_sketch(success_lines: DataFrame, build_cols: tuple[str, ...] = ("job_name", "stage_name"),
                   build_key: str = "build_id") -> DataFrame:
    """A10: fraction of successful builds per (job, stage) that contain each template.

    ``success_lines``: annotated lines of successful builds with the build columns.
    Template presence is de-duplicated per build first (map-side), so the shuffle
    carries one row per (build, template).
    """
    present = success_lines.filter(F.col("text") != "").select(*build_cols, build_key, "template").distinct()
    total = success_lines.groupBy(*build_cols).agg(F.countDistinct(build_key).alias("_builds"))
    per = present.groupBy(*build_cols, "template").agg(F.count(F.lit(1)).alias("_with"))
    return (per.join(total, list(build_cols))
            .select(*build_cols, "template", (F.col("_with") / F.col("_builds")).alias("fraction")))


def apply_baseline(lines: DataFrame, sketch: DataFrame | None = None,
                   build_cols: tuple[str, ...] = ("job_name", "stage_name"), self_baseline: bool = True) -> DataFrame:
    """Drop common INFO / very common repeated WARN lines, boost novel INFO.

    Adds ``baseline_version`` per line (same for all lines of a log). Provider order: a counter sketch of the log's
    (job, stage), else its self-baseline, else, without ``self_baseline``, the empty one, to which every template is novel.
    """
    joined = lines
    if sketch is not None:
        keys = sketch.select(*build_cols).distinct().withColumn("_has_sketch", F.lit(True))
        joined = (lines.join(keys, list(build_cols), "left")
                  .join(sketch.withColumnRenamed("fraction", "_frac"), [*build_cols, "template"], "left"))
    # Self-baseline by windows (no join): prefix INFO count per (log, template). The ordered window stands first: its sort serves the others.
    by_template = Window.partitionBy(LOG, "template")
    df = joined.withColumn("_first", F.row_number().over(by_template.orderBy("idx")) == 1)
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(LOG)))
    cut = F.greatest(F.lit(P.SELF_BASELINE_MIN_LINES), F.floor(F.col("_n") * P.SELF_BASELINE_PREFIX))
    pre = (F.col("idx") < cut) & (F.col("text") != "") & (F.col("severity") == P.SEV_INFO) & ~F.col("drop")
    df = df.withColumn("_pre", pre.cast("int"))
    df = df.withColumn("_self_common", (F.sum("_pre").over(by_template) >= P.SELF_BASELINE_MIN_COUNT)
                       if self_baseline else F.lit(False))
    if sketch is not None:
        has = F.coalesce(F.col("_has_sketch"), F.lit(False))
        common = F.when(has, F.coalesce(F.col("_frac"), F.lit(0.0)) >= P.SKETCH_COMMON).otherwise(F.coalesce(F.col("_self_common"), F.lit(False)))
        very = F.when(has, F.coalesce(F.col("_frac"), F.lit(0.0)) >= P.SKETCH_VERY_COMMON).otherwise(F.lit(False))
    else:
        has = F.lit(False)
        common = F.coalesce(F.col("_self_common"), F.lit(False))
        very = F.lit(False)
    live = ~F.col("drop") & (F.col("text") != "")
    warn = live & (F.col("severity") == P.SEV_WARN)
    df = df.withColumn("_warn_n", F.sum(warn.cast("int")).over(by_template))
    drop_warn = warn & (F.col("_warn_n") >= 2) & very
    info = live & (F.col("severity") == P.SEV_INFO)
    drop_info = info & common
    novel = info & ~common
    df = df.withColumn("_c1", (F.coalesce(F.col("_self_common"), F.lit(False)) & F.col("_first")).cast("int"))
    n_common = F.sum("_c1").over(Window.partitionBy(LOG))
    own = F.format_string("self/%.2f/%d", F.lit(P.SELF_BASELINE_PREFIX), n_common) if self_baseline else F.lit("empty")
    version = F.when(has, F.lit("counter")).otherwise(own)
    out = (
        df.withColumn("baseline_version", version)
        .withColumn("_bdrop", drop_warn | drop_info)
        .withColumn("reason", F.when(drop_warn, F.lit("baseline-warn-common"))
                    .when(drop_info, F.lit("baseline-common")).otherwise(F.col("reason")))
        .withColumn("drop", F.col("drop") | F.col("_bdrop"))
        .withColumn("score", F.col("score") + F.when(novel, 2).otherwise(0))
        .withColumn("_bnovel", novel)
    )
    drops = [c for c in ("_first", "_n", "_pre", "_self_common", "_has_sketch", "_frac", "_warn_n", "_c1") if c in out.columns]
    return out.drop(*drops)
