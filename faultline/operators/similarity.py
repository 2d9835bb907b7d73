"""Vector similarity: normalisation, exact top-K joins and kNN search over a pivot index.

``pivots`` holds the index: blocks of vectors around pivots, whose angles tell which pairs of blocks, or which blocks of a
query, can't reach the threshold. The others are compared exactly, one Arrow group per pair of blocks (a numpy
matrix product), and a window over each node takes the exact top-K with the documented tie-break. No group
grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pivots as PV
from .pivots import BLOCK_SIZE


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def l2_normalise(v: Column) -> Column:
    """Divide by the L2 norm (a zero norm counts as 1)."""
    def scaled(d: Column) -> Column:
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
        return _bound(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(d, lambda x: x / n))

    return _bound(F.transform(v, lambda x: x.cast("double")), scaled)


def top_k_neighbours(nodes: DataFrame, k: int = 6, threshold: float = 0.75, block_size: int = BLOCK_SIZE) -> DataFrame:
    """J4 + K4: per node, its top-K neighbours with cosine >= threshold.

    ``nodes``: key, v (raw vector), ord (corpus order; lower first). Ties on
    similarity go to the neighbour earlier in corpus order.
    """
    found = PV.near_pairs(PV.build(nodes.select("key", "ord", "v"), block_size), k, threshold)
    w = Window.partitionBy("i").orderBy(F.col("sim").desc(), F.col("ord"))
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("i", "j", "sim", "ord")


def similarity_edges(nodes: DataFrame, k: int = 6, threshold: float = 0.75, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Union of the directed top-K lists as undirected edges, weight rounded to 4 dp.

    ``source`` is the end earlier in corpus order.
    """
    nb = top_k_neighbours(nodes, k, threshold, block_size).withColumnRenamed("ord", "_jo")
    e = nb.join(nodes.select(F.col("key").alias("i"), F.col("ord").alias("_io")), "i")
    src = F.when(F.col("_io") <= F.col("_jo"), F.col("i")).otherwise(F.col("j"))
    dst = F.when(F.col("_io") <= F.col("_jo"), F.col("j")).otherwise(F.col("i"))
    return (e.select(src.alias("source"), dst.alias("target"), "sim")
            .groupBy("source", "target").agg(F.round(F.max("sim"), 4).alias("weight")))


def knn_search(queries: DataFrame, corpus: DataFrame, top_k: int = 3, threshold: float = 0.75,
               block_size: int = BLOCK_SIZE, index: PV.PivotIndex | None = None) -> DataFrame:
    """J5 + K5: per query, k = max(top_k, 5) nearest by cosine, score = (1 + cos) / 2 >= threshold,
    re-ranked by score x solution_score, best ``top_k`` kept.

    ``queries``: qkey, v. ``corpus``: key, v, solution_score, ord. An ``index`` of the corpus that was built (and
    perhaps stored) before is used as it is. Exact search (the candidate budget of an approximate index is not needed).
    """
    k = max(top_k, 5)
    index = index or PV.build(corpus.select("key", "ord", "v"), block_size)
    asked = queries.filter(F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col("qkey").alias("key"), "v")
    # the score is (1 + cos) / 2, so no hit has a cosine under 2 * threshold - 1
    cand, _ = PV.probe(index, asked, k, 2 * threshold - 1 - PV.SLACK)
    cand = cand.select(F.col("i").alias("qkey"), F.col("j").alias("key"), "sim", "ord")
    w1 = Window.partitionBy("qkey").orderBy(F.col("sim").desc(), F.col("ord"))
    cand = cand.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    cand = cand.join(corpus.select("key", "solution_score"), "key")
    cand = cand.withColumn("score", (F.lit(1.0) + F.col("sim")) / 2).filter(F.col("score") >= threshold)
    cand = cand.withColumn("rank_score", F.col("score") * F.coalesce(F.col("solution_score"), F.lit(1.0)))
    w2 = Window.partitionBy("qkey").orderBy(F.col("rank_score").desc(), F.col("_r1"))
    return (cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= top_k)
            .select("qkey", "key", F.round("sim", 6).alias("cosine"), F.round("score", 6).alias("score"),
                    F.round("rank_score", 6).alias("rank_score"), "rank"))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """E6 stand-in embedder: hashed lower-cased word counts, L2-normalised (not a language model)."""
    toks = F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda t: t != "")
    idx = F.transform(toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int"))
    counts = _bound(idx, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                                 lambda d: F.size(F.filter(own, lambda x: x == d)).cast("double")))
    return l2_normalise(counts)


def route(best_score: Column, threshold: float = 0.75) -> Column:
    """Reuse the past solution when the best match clears the threshold."""
    return F.when(F.coalesce(best_score, F.lit(0.0)) >= threshold, F.lit("verified_past_solution")).otherwise(F.lit("fresh_analysis"))
