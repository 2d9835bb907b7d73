"""The pivot index: exact top-K joins and search on clustered vectors, copies and ties, against all pairs."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import pivots as PV
from faultline.operators import similarity as SIM

RNG = np.random.default_rng(21)


def clustered(n: int, centres: int, spread: float, copies: int = 0) -> list[tuple[str, str, list[float]]]:
    centre = RNG.normal(size=(centres, 16))
    m = centre[RNG.integers(centres, size=n)] + spread * RNG.normal(size=(n, 16))
    m[:copies] = m[0]
    return [(f"k{i:05d}", f"{(i * 7919) % n:06d}", v.tolist()) for i, v in enumerate(m)]


def all_pairs(rows, k: int, threshold: float) -> set:
    m = PV.unit(np.array([v for _, _, v in rows]))
    sims = np.round(m @ m.T, 12)
    np.fill_diagonal(sims, -np.inf)
    out = set()
    for i in range(len(rows)):
        near = sorted((-s, rows[j][1], rows[j][0]) for j, s in enumerate(sims[i]) if s >= threshold)
        out |= {(rows[i][0], key) for _, _, key in near[:k]}
    return out


@pytest.fixture(scope="module")
def rows():
    return clustered(900, 12, 0.1, copies=90) + [("zero", "z", [0.0] * 16)]


def frame(spark, rows):
    return spark.createDataFrame([*rows, ("none", "n", None), ("blank", "b", [])], "key string, ord string, v array<double>").repartition(5)


@pytest.mark.parametrize(("k", "threshold"), [(6, 0.75), (3, -1.0)])
def test_top_neighbours_equal_all_pairs(spark, rows, k, threshold):
    got = {(r.i, r.j) for r in SIM.top_k_neighbours(frame(spark, rows), k, threshold, block_size=64).collect()}
    assert got == all_pairs(rows, k, threshold)


def test_clusters_prune_block_pairs_and_no_block_is_large(spark, rows):
    index = PV.build(frame(spark, rows), block_size=64)
    n = index.blocks.count()
    kept = PV.block_pairs(index, 0.9).count()
    assert kept < 0.5 * n * (n + 1) / 2
    assert index.blocks.agg(F.max("n")).first()[0] <= 160 and index.blocks.agg(F.sum("n")).first()[0] == len(rows)
    assert PV.block_pairs(index, -1.0).count() == n * (n + 1) // 2


def test_stored_index_answers_as_all_pairs_and_reads_few_blocks(spark, rows):
    path = os.path.join(tempfile.mkdtemp(prefix="pivots-"), "index")
    PV.build(frame(spark, rows), block_size=64).save(path)
    index = PV.PivotIndex.load(spark, path)
    asked = rows[5:300:9]
    queries = spark.createDataFrame([(k, v) for k, _, v in asked], "key string, v array<double>")
    found, probes = PV.probe(index, queries, 5)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.i, []).append((-r.sim, r.ord, r.j))
    m = PV.unit(np.array([v for _, _, v in rows]))
    for key, _, v in asked:
        sims = np.round(m @ PV.unit(np.array([v]))[0], 12)
        want = sorted((-s, o, x) for s, (x, o, _) in zip(sims, rows, strict=True))[:5]
        assert [x[2] for x in sorted(got[key])[:5]] == [x[2] for x in want]
    n = index.blocks.count()
    read = [r.probes for r in probes.collect()]
    assert len(read) == len(asked) and sum(read) < 0.6 * n * len(asked)


def test_empty_corpus_and_queries(spark):
    none = spark.createDataFrame([], "key string, ord string, v array<double>")
    assert SIM.top_k_neighbours(none, 3, 0.1).count() == 0
    found, probes = PV.probe(PV.build(none), spark.createDataFrame([("q", [1.0, 0.0])], "key string, v array<double>"), 3)
    assert found.count() == 0 and probes.count() == 0


def test_groups_of_blocks_give_the_same_pairs_and_vectors_travel_once_a_group(spark, rows):
    index = PV.build(frame(spark, rows), block_size=32)
    for k, threshold in ((6, 0.75), (3, -1.0)):
        found: dict = {}
        for r in PV.near_pairs(index, k, threshold, group_rows=150).collect():
            found.setdefault(r.i, []).append((-r.sim, r.ord, r.j))
        assert {(i, x[2]) for i, own in found.items() for x in sorted(own)[:k]} == all_pairs(rows, k, threshold)
    assert PV._groups(index, 150).agg(F.countDistinct("grp")).first()[0] >= 5
    many = PV._groups(PV.build(frame(spark, rows * 9), block_size=32)).agg(F.countDistinct("grp")).first()[0]
    assert many <= PV.GROUPS + 1          # 100 and more blocks
    queries = spark.createDataFrame([(k, v) for k, _, v in rows[5:300:9]], "key string, v array<double>")
    hits, probes = PV.probe(index, queries, 5, group_rows=150)
    best: dict = {}
    for r in hits.collect():
        best.setdefault(r.i, []).append((-r.sim, r.ord, r.j))
    m = PV.unit(np.array([v for _, _, v in rows]))
    for key, _, v in rows[5:300:9]:
        sims = np.round(m @ PV.unit(np.array([v]))[0], 12)
        assert [x[2] for x in sorted(best[key])[:5]] == [x[2] for x in sorted((-s, o, x) for s, (x, o, _) in zip(sims, rows, strict=True))[:5]]
    assert probes.count() == len(rows[5:300:9])


def test_a_vector_travels_to_as_many_groups_whatever_the_number_of_vectors(spark):
    met = []
    for n in (3000, 24000):
        few = spark.range(n).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("ord"),
                                    F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i) + F.cos(i * i * F.col("id"))).alias("v"))
        met.append(PV._groups(PV.build(few, block_size=64)).select("grp").distinct().count())
    assert all(0.75 * PV.GROUPS <= n <= PV.GROUPS + 1 for n in met)
