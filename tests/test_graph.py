"""Knowledge-graph facts (FIXTURES.md) on our own fixtures."""

from __future__ import annotations

import datetime as dt

from faultline.operators import graph as G

SCHEMA = ("doc_id string, fingerprint_text string, solution string, job_name string, stage_name string, "
          "build_number int, solution_score double, created_at timestamp, vector array<double>")


def _df(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    full = [(d, fp, sol, job, st, 1, 1.0, t0 + dt.timedelta(minutes=i), v) for i, (d, fp, sol, job, st, v) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_orthogonal_no_edges(spark):
    g = G.build_graph(_df(spark, [("a", "exceptions: NullPointerException", "fix a", "job1", "build", [1.0, 0.0]),
                                  ("b", "exceptions: IOException", "fix b", "job1", "test", [0.0, 1.0])]), threshold=0.99)
    s = g["stats"].first()
    assert (s.total_similarity_edges, s.isolated_solutions, s.total_jobs, s.total_stages) == (0, 2, 1, 2)
    kinds = {r.kind for r in g["nodes"].collect()}
    assert kinds == {"solution", "error_class", "job", "stage"}


def test_cluster_sizes_and_hub(spark):
    rows = [("a", "java.lang.OutOfMemoryError: heap", "raise heap", "j", "s", [1.0, 0.0, 0.0]),
            ("b", "java.lang.OutOfMemoryError: metaspace", "raise meta", "j", "s", [0.99, 0.05, 0.0]),
            ("c", "java.lang.OutOfMemoryError: direct", "raise direct", "j", "s", [0.98, 0.1, 0.0]),
            ("d", "TimeoutError waiting", "retry", "j", "s", [0.0, 0.0, 1.0])]
    g = G.build_graph(_df(spark, rows), threshold=0.9, max_neighbours=4)
    sizes = sorted(r.size for r in g["communities"].collect())
    assert sizes == [1, 3]
    assert g["hubs"].first().error_class == "OutOfMemoryError"


def test_missing_vectors_typed_edges_only(spark):
    g = G.build_graph(_df(spark, [("a", "ValueError x", "s", "j", "st", []), ("b", "KeyError y", "t", "j", "st", [])]))
    kinds = {r.kind for r in g["edges"].collect()}
    assert "similar" not in kinds and {"resolves", "occurs_in", "in_job"} <= kinds


def test_components_long_chain(spark):
    import random
    rng = random.Random(5)
    ids = [f"n{i:03d}" for i in range(18)]
    order = ids[:]
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(11)] + [(order[i], order[i + 1]) for i in range(12, 17)]
    nodes = spark.createDataFrame([(n, f"{i:04d}") for i, n in enumerate(ids)], "id string, ord string")
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "source string, target string, weight double")
    got = {r.id: r.community for r in G.components(nodes, e).collect()}
    parent = {n: n for n in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for n in ids:
        groups.setdefault(find(n), []).append(n)
    want = {n: min(g) for g in groups.values() for n in g}  # ord follows id order here
    assert got == want


def test_registered_graph_queries_keep_edges_from_a_quarter_on(spark, tmp_path):
    from faultline.plans import catalog
    catalog.load_all()
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [0.3, (1 - 0.09) ** 0.5, 0.0], 1), (3, [0.0, 0.0, -1.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {q: [tuple(r) for r in catalog.QUERIES[q](spark, str(tmp_path)).collect()] for q in
           ("k4_top_neighbours", "j4_similarity_edges", "g4_degree", "g3_communities", "p8_kind_filter", "g1_typed_edges")}
    assert {r[:2] for r in got["k4_top_neighbours"]} == {("sol:sol-1", "sol:sol-2"), ("sol:sol-2", "sol:sol-1")}
    assert len(got["j4_similarity_edges"]) == 1 and sorted(d for _, d in got["g4_degree"]) == [0, 1, 1]
    assert len({c for _, c in got["g3_communities"]}) == 2
    assert "similar" in {r[2] for r in got["p8_kind_filter"]}
    assert "similar" not in {r[0] for r in got["g1_typed_edges"]}        # its SQL states 0.35


def test_registered_communities_statistics_and_hubs_use_edges_under_a_third(spark, tmp_path):
    from faultline.plans import catalog
    catalog.load_all()
    up = (1 - 0.09) ** 0.5
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [0.3, up, 0.0], 1), (3, [0.3, -up, 0.0], 2), (4, [0.0, 0.0, -1.0], 3)]     # cosines 0.3, 0.3, below 0
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {q: [tuple(r) for r in catalog.QUERIES[q](spark, str(tmp_path)).collect()] for q in
           ("k4_top_neighbours", "j4_similarity_edges", "g4_degree", "g3_communities", "g5_community_labels", "k6_hub_nodes", "j8_node_neighbours")}
    stats = catalog.QUERIES["a15_graph_stats"](spark, str(tmp_path)).first()
    assert len(got["k4_top_neighbours"]) == 4 and {w for *_, w in got["j4_similarity_edges"]} == {0.3}
    assert sorted(d for _, d in got["g4_degree"]) == [0, 1, 1, 2] and len({c for _, c in got["g3_communities"]}) == 2
    assert sorted(size for _, size, _ in got["g5_community_labels"]) == [1, 3]
    assert got["k6_hub_nodes"][0] == ("sol:sol-1", 2) and {r[0] for r in got["j8_node_neighbours"]} == {"sol:sol-1"}
    assert (stats.total_similarity_edges, stats.isolated_solutions, stats.communities, stats.largest_community_size) == (2, 1, 2, 3)
