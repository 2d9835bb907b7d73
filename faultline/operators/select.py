"""Pass 4: score lines and select them under a token budget.

Scoring is a pure window expression. Selection:

1. anchors (live, score >= 3) are grouped into clusters by gaps of at most 3
   lines (gaps-and-islands over the anchor rows), expanded by 2 before / 4 after;
2. every live line inside an expanded cluster becomes a candidate with its ring
   ``r = |idx - centre|``; clusters are ranked by peak score (ties: position).
   Lines are matched to clusters with a band join on (log, bucket): a line meets
   at most two expanded clusters;
3. the round-robin fill visits candidates in (ring, cluster rank, side) order
   and skips what does not fit; a ring without any pick ends the fill. That
   order-dependent budget walk is one ``aggregate`` over the log's candidates that can fit at all
   (budget x ln budget at most). Only the first visit of a line can select it, so duplicates are removed first.

Logs without anchors take the longest tail of live lines that fits (K2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import patterns as P

LOG = "log_id"
BAND = 256


def _w():
    return Window.partitionBy(LOG).orderBy("idx")


def score_lines(lines: DataFrame) -> DataFrame:
    """W7 + X8: severity weight + position bonus + carried score (-1 for plain stack frames)."""
    w = _w()
    before = F.coalesce(*[F.when(~F.lag("drop", k).over(w), F.lag("kind", k).over(w) == P.KIND_CMD) for k in (1, 2, 3)])
    after = F.coalesce(*[F.when(~F.lead("drop", k).over(w), F.lead("severity", k).over(w) == P.SEV_EXIT) for k in (1, 2, 3)])
    bonus = F.when(F.coalesce(before, F.lit(False)), 1).otherwise(0) + F.when(F.coalesce(after, F.lit(False)), 2).otherwise(0)
    weight = F.col("severity").cast("int")  # weights equal the severity levels (0, 1, 3, 4, 5)
    s = weight + bonus + F.col("score") - F.when((F.col("kind") == P.KIND_STACK) & ~F.col("note").contains("elided"), 1).otherwise(0)
    live = ~F.col("drop") & (F.col("text") != "")
    return lines.withColumn("score", F.when(live, F.greatest(F.lit(0), s)).otherwise(F.col("score")))


def select_lines(lines: DataFrame, token_budget: int = P.BODY_MAX_TOKENS, min_score: int = P.MIN_ANCHOR_SCORE,
                 reuse=lambda d: d) -> DataFrame:
    """K1/K2: adds boolean ``selected`` to every line."""
    live = ~F.col("drop") & (F.col("text") != "")
    wl = Window.partitionBy(LOG)
    df = (lines.withColumn("_cost", L.approx_tokens("text", "note")).withColumn("_n", F.count(F.lit(1)).over(wl))
          .withColumn("_has", F.max((live & (F.col("score") >= min_score)).cast("int")).over(wl) == 1))
    df = reuse(df)
    anchors = df.filter(live & (F.col("score") >= min_score)).select(LOG, "idx", "_n")
    gap = F.col("idx") - F.lag("idx").over(_w())
    anchors = anchors.withColumn("_new", F.when(gap.isNull() | (gap > P.CLUSTER_MERGE_GAP), 1).otherwise(0))
    anchors = anchors.withColumn("_cid", F.sum("_new").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    clusters = anchors.groupBy(LOG, "_cid").agg(
        F.greatest(F.lit(0), F.min("idx") - P.CONTEXT_BEFORE).alias("_lo"),
        F.least(F.max("_n") - 1, F.max("idx") + P.CONTEXT_AFTER).alias("_hi"))
    # Band join: clusters exploded over the buckets they span.
    cb = clusters.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / BAND), F.floor(F.col("_hi") / BAND))))
    lb = df.select(LOG, "idx", "score", "drop", "text", "_cost", F.floor(F.col("idx") / BAND).alias("_b"))
    inc = (lb.join(cb, [LOG, "_b"]).filter((F.col("idx") >= F.col("_lo")) & (F.col("idx") <= F.col("_hi")))
           .drop("_b"))
    # Peak and centre: over non-dropped lines of the expanded range.
    wc = Window.partitionBy(LOG, "_cid")
    inc = inc.withColumn("_peak", F.max(F.when(~F.col("drop"), F.col("score"))).over(wc))
    inc = reuse(inc.withColumn("_ctr", F.min(F.when(~F.col("drop") & (F.col("score") == F.col("_peak")), F.col("idx"))).over(wc)))
    ranks = (inc.select(LOG, "_cid", "_peak", "_lo").distinct()
             .withColumn("_rank", F.row_number().over(Window.partitionBy(LOG).orderBy(F.col("_peak").desc(), F.col("_lo"), F.col("_cid"))))
             .select(LOG, "_cid", "_rank"))
    cand = (inc.filter(~F.col("drop") & (F.col("text") != "")).join(ranks, [LOG, "_cid"])
            .select(LOG, "idx", "_cost", F.abs(F.col("idx") - F.col("_ctr")).alias("_ring"), "_rank",
                    F.when(F.col("idx") <= F.col("_ctr"), 0).otherwise(1).alias("_side")))
    first = Window.partitionBy(LOG, "idx").orderBy("_ring", "_rank", "_side")
    cand = cand.withColumn("_v", F.row_number().over(first)).filter(F.col("_v") == 1).drop("_v")
    # A line that is taken finds room for every earlier one that costs no more, so these were taken, too: of the lines of one
    # cost only the first budget / cost can be. What is left to fold is bounded by the budget, whatever the log's size.
    even = Window.partitionBy(LOG, "_cost").orderBy("_ring", "_rank", "_side", "idx")
    cand = cand.withColumn("_k", F.row_number().over(even)).filter(F.col("_k") * F.col("_cost") <= token_budget).drop("_k")
    per_log = cand.groupBy(LOG).agg(F.sort_array(F.collect_list(F.struct("_ring", "_rank", "_side", "idx", "_cost"))).alias("_c"))
    init = F.struct(F.lit(token_budget).alias("rem"), F.lit(0).alias("ring"), F.lit(False).alias("prog"),
                    F.lit(False).alias("stop"), F.array().cast("array<int>").alias("sel"))

    def step(acc, x):
        adv = x["_ring"] > acc["ring"]
        stop = acc["stop"] | (adv & ((x["_ring"] > acc["ring"] + 1) | ~acc["prog"] | (acc["rem"] <= 0)))
        prog = F.when(adv, F.lit(False)).otherwise(acc["prog"])
        take = ~stop & (x["_cost"] <= acc["rem"])
        return F.struct(
            F.when(take, acc["rem"] - x["_cost"]).otherwise(acc["rem"]).alias("rem"),
            F.when(stop, acc["ring"]).otherwise(x["_ring"]).alias("ring"),
            (prog | take).alias("prog"),
            stop.alias("stop"),
            F.when(take, F.array_append(acc["sel"], x["idx"])).otherwise(acc["sel"]).alias("sel"),
        )

    picked = per_log.select(LOG, F.explode(F.aggregate("_c", init, step)["sel"]).alias("idx")).withColumn("_pick", F.lit(True))
    df = df.join(picked, [LOG, "idx"], "left")
    # K2: no anchors -> tail of live lines while the running cost fits (stop, not skip).
    tail_cost = F.sum(F.when(live, F.col("_cost")).otherwise(0)).over(
        Window.partitionBy(LOG).orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0))
    tail = live & (tail_cost <= token_budget)
    sel = F.when(F.col("_has"), F.coalesce(F.col("_pick"), F.lit(False))).otherwise(tail)
    return df.withColumn("selected", sel).drop("_cost", "_n", "_pick", "_has")
