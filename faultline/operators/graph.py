"""Typed knowledge graph over stored solutions.

Node order ("first appearance") is the corpus order: newest first
(``created_at`` desc, then ``doc_id``), carried as a sortable ``ord`` key so no
global row numbering (one task) is needed. Communities are connected components
of the similarity edges: partitions contract their edges, then labels spread between the roots that
are left; every round is checkpointed into the shared checkpoint folder and the loop ends when no label
changes. A community is identified by its first member (smallest ``ord``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import similarity as SIM

# Error-class patterns of the graph variant (X21), in order.
GRAPH_ERR_TYPED = r"\b([A-Za-z_][A-Za-z0-9_]*(?:Exception|Error|Failure))\b"
GRAPH_ERR_SPECIAL = r"(?i)\b(TimeoutError|OutOfMemoryError|ConnectionRefused)\b"
SLUG_RX = r"[^A-Za-z0-9_.-]+"


def graph_error_class(text: Column) -> Column:
    """Typed class, else special tokens, else first non-blank line (60 chars), else UnknownError."""
    t = F.coalesce(text, F.lit(""))
    first_line = F.trim(F.element_at(F.split(F.trim(t), "\n"), 1))
    return F.coalesce(
        F.substring(F.nullif(F.regexp_extract(t, GRAPH_ERR_TYPED, 1), F.lit("")), 1, 80),
        F.substring(F.nullif(F.regexp_extract(t, GRAPH_ERR_SPECIAL, 1), F.lit("")), 1, 80),
        F.substring(F.nullif(first_line, F.lit("")), 1, 60),
        F.lit("UnknownError"))


def node_id(prefix: str, value: Column) -> Column:
    """``prefix:slug`` with the slug cut to 120 characters."""
    slug = F.regexp_replace(F.regexp_replace(value, SLUG_RX, "_"), r"^_+|_+$", "")
    slug = F.when(slug == "", F.lit("_")).otherwise(slug)
    return F.concat(F.lit(prefix + ":"), F.substring(slug, 1, 120))


def corpus_order(created_at: Column, doc_id: Column) -> Column:
    """Sortable key: newest first, then doc_id."""
    return F.format_string("%020d|%s", F.lit(4102444800000000) - F.unix_micros(created_at), doc_id)


def solution_nodes(solutions: DataFrame) -> DataFrame:
    """Solution nodes with error class and order key."""
    ec = graph_error_class(F.coalesce(F.nullif(F.col("fingerprint_text"), F.lit("")), F.col("solution")))
    label = F.when(F.coalesce(F.col("solution"), F.lit("")) != "",
                   F.substring(F.element_at(F.split(F.trim("solution"), "\n"), 1), 1, 80)).otherwise(ec)
    return solutions.select(
        F.concat(F.lit("sol:"), F.col("doc_id")).alias("id"), F.lit("solution").alias("kind"), label.alias("label"),
        "doc_id", "fingerprint_text", "job_name", "stage_name", "build_number", "solution_score", "created_at",
        ec.alias("error_class"), corpus_order(F.col("created_at"), F.col("doc_id")).alias("ord"), F.col("vector"))


def _entities(sol: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Solutions with their trimmed job and stage; those with a stage and its node id; the stage nodes."""
    job = F.trim(F.coalesce(F.col("job_name"), F.lit("")))
    stage = F.trim(F.coalesce(F.col("stage_name"), F.lit("")))
    base = sol.select("id", "ord", "error_class", job.alias("_job"), stage.alias("_stage"))
    st_key = F.when(F.col("_job") != "", F.concat(F.col("_job"), F.lit("__"), F.col("_stage"))).otherwise(F.col("_stage"))
    st = base.filter(F.col("_stage") != "").withColumn("_sid", node_id("stage", st_key))
    stage_nodes = st.groupBy("_sid", "_job", "_stage").agg(F.min("ord").alias("ord")).select(
        F.col("_sid").alias("id"), F.lit("stage").alias("kind"), F.col("_stage").alias("label"), "ord", F.col("_job").alias("job_name"))
    return base, st, stage_nodes


def typed_nodes(sol: DataFrame) -> DataFrame:
    """U4: solution, error-class, job and stage nodes."""
    base, _, stage_nodes = _entities(sol)
    err_nodes = base.groupBy("error_class").agg(F.min("ord").alias("ord")).select(
        node_id("err", F.col("error_class")).alias("id"), F.lit("error_class").alias("kind"), F.col("error_class").alias("label"), "ord")
    job_nodes = base.filter(F.col("_job") != "").groupBy("_job").agg(F.min("ord").alias("ord")).select(
        node_id("job", F.col("_job")).alias("id"), F.lit("job").alias("kind"), F.col("_job").alias("label"), "ord")
    return (sol.select("id", "kind", "label", "ord").unionByName(err_nodes).unionByName(job_nodes)
            .unionByName(stage_nodes.drop("job_name")))


def typed_edges(sol: DataFrame, sim_edges: DataFrame) -> DataFrame:
    """G1: the four edge kinds."""
    base, st, stage_nodes = _entities(sol)
    e_sim = sim_edges.select(F.lit("similar").alias("kind"), "source", "target", "weight")
    e_res = base.select(F.lit("resolves").alias("kind"), F.col("id").alias("source"),
                        node_id("err", F.col("error_class")).alias("target"), F.lit(None).cast("double").alias("weight"))
    e_in = stage_nodes.filter(F.col("job_name") != "").select(F.lit("in_job").alias("kind"), F.col("id").alias("source"),
                                                              node_id("job", F.col("job_name")).alias("target"), F.lit(None).cast("double").alias("weight"))
    e_occ = st.select(F.lit("occurs_in").alias("kind"), F.col("id").alias("source"), F.col("_sid").alias("target"),
                      F.lit(None).cast("double").alias("weight"))
    return e_sim.unionByName(e_res).unionByName(e_in).unionByName(e_occ)


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a partition's links: a union-find of its own, roots are the smallest nodes."""
    links = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    if not links:
        return
    nodes, at = np.unique(np.concatenate([x for pair in zip(*links, strict=True) for x in pair]), return_inverse=True)
    half = len(at) // 2
    x, y, root = at[:half], at[half:], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)          # the larger root hangs below the smaller
        while not np.array_equal(root, root[root]):
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(nodes[root], pa.string())], names=["node", "root"])


def _least_labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches, by labels and pointer jumping.

    A round takes the smallest label of the neighbours and then that label's own label; it ends when none changes.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label").checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "_near").alias("_new"))
        up = labels.select(F.col("node").alias("_new"), F.col("label").alias("_up"))
        new = new.join(up, "_new").select("node", F.least("_new", "_up").alias("label"), (F.least("_new", "_up") < F.col("label")).alias("_moved")).checkpoint()
        labels = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return labels


def components(node_ord: DataFrame, sim_edges: DataFrame) -> DataFrame:
    """Connected components; ``node_ord``: id, ord. Returns id, community (id of the first member), community_ord.

    Every partition of the edges contracts its own by a union-find, so what is left to agree on are the roots of nodes
    that several partitions saw: links between roots, far fewer than edges, whose labels spread in rounds.
    Nodes are named by their place in the corpus order, so the smallest is the first member.
    """
    checkpoint_dir(node_ord.sparkSession)
    named = node_ord.select("id", F.concat_ws("\x01", "ord", "id").alias("_node"))
    edges = (sim_edges.select(F.col("source").alias("id"), "target").join(named.withColumnRenamed("_node", "a"), "id").drop("id")
             .join(named.select(F.col("id").alias("target"), F.col("_node").alias("b")), "target").select("a", "b"))
    held = (edges.mapInArrow(_contracted, "node string, root string").groupBy("node").agg(F.collect_set("root").alias("roots"))
            .select("node", F.array_min("roots").alias("root"), "roots").checkpoint())       # a root for each partition at most
    between = held.filter("size(roots) > 1").select(F.explode("roots").alias("a"), F.col("root").alias("b")).filter("a <> b")
    own = held.select(F.col("node").alias("_node"), "root")
    if not between.isEmpty():
        labels = _least_labels(between).select(F.col("node").alias("root"), "label")
        own = own.join(labels, "root", "left").select("_node", F.coalesce("label", "root").alias("root"))
    out = named.join(own, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    return out.select("id", F.substring_index("root", "\x01", -1).alias("community"), F.substring_index("root", "\x01", 1).alias("community_ord"))


def degrees(node_ids: DataFrame, sim_edges: DataFrame) -> DataFrame:
    """Similar-edge degree per solution node (0 when isolated)."""
    ends = sim_edges.select(F.col("source").alias("id")).unionByName(sim_edges.select(F.col("target").alias("id")))
    d = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return node_ids.join(d, "id", "left").select("id", F.coalesce(F.col("degree"), F.lit(0)).alias("degree"))


def community_table(sol: DataFrame, comm: DataFrame) -> DataFrame:
    """Communities: size, first member, label = most frequent error class (ties: first appearance)."""
    m = sol.select("id", "ord", "error_class").join(comm.select("id", "community"), "id")
    size = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("ord"))
    ec = m.groupBy("community", "error_class").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    w = Window.partitionBy("community").orderBy(F.col("_n").desc(), F.col("_first"))
    lab = ec.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("community", F.col("error_class").alias("label"))
    return size.join(lab, "community")


def top_error_classes(sol: DataFrame, n: int = 8) -> DataFrame:
    """Most frequent error classes, ties by first appearance."""
    g = sol.groupBy("error_class").agg(F.count(F.lit(1)).alias("count"), F.min("ord").alias("_first"))
    return g.orderBy(F.col("count").desc(), F.col("_first")).limit(n).drop("_first")


def hub_nodes(sol: DataFrame, deg: DataFrame, n: int = 5) -> DataFrame:
    """K6: highest-degree solution nodes, ties by corpus order."""
    d = sol.select("id", "ord", "label", "error_class").join(deg, "id")
    return d.orderBy(F.col("degree").desc(), F.col("ord")).limit(n).drop("ord")


def graph_stats(sol: DataFrame, nodes: DataFrame, sim_edges: DataFrame, deg: DataFrame, comms: DataFrame) -> DataFrame:
    """One-row summary (each input reduces to partial counts; no join of large sides)."""
    z = F.lit(0).cast("bigint")
    cols = ["total_solutions", "total_error_classes", "total_jobs", "total_stages", "total_similarity_edges",
            "isolated_solutions", "communities", "largest_community_size", "degree_sum"]

    def row(**kv):
        return [F.lit(kv.get(c, 0)).cast("bigint").alias(c) if not isinstance(kv.get(c), Column) else kv[c].cast("bigint").alias(c) for c in cols]

    parts = [
        nodes.select(*row(total_solutions=(F.col("kind") == "solution").cast("int"),
                          total_error_classes=(F.col("kind") == "error_class").cast("int"),
                          total_jobs=(F.col("kind") == "job").cast("int"), total_stages=(F.col("kind") == "stage").cast("int"))),
        sim_edges.select(*row(total_similarity_edges=F.lit(1))),
        deg.select(*row(isolated_solutions=(F.col("degree") == 0).cast("int"), degree_sum=F.col("degree"))),
        comms.select(*row(communities=F.lit(1), largest_community_size=F.col("size"))),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    out = u.agg(*[F.coalesce(F.sum(c), z).alias(c) for c in cols if c != "largest_community_size"],
                F.coalesce(F.max("largest_community_size"), z).alias("_m"))
    n = F.col("total_solutions")
    return out.select(
        "total_solutions", "total_error_classes", "total_jobs", "total_stages", "total_similarity_edges",
        "isolated_solutions", "communities", F.col("_m").alias("largest_community_size"),
        F.when(n > 0, F.round(F.col("degree_sum") / n, 2)).otherwise(F.lit(0.0)).alias("avg_neighbours"))


def neighbours(edges: DataFrame, nodes: DataFrame, top: int = 25) -> DataFrame:
    """Edges touching a node of ``nodes(id)`` in either direction, heaviest first, at most ``top``."""
    def side(own: str, other: str) -> DataFrame:
        met = edges.join(nodes.select(F.col("id").alias(own)), own)
        return met.select(F.col(own).alias("node"), F.col(other).alias("neighbour"), "weight", "kind")

    return side("source", "target").unionByName(side("target", "source")).orderBy(F.coalesce(F.col("weight"), F.lit(0.0)).desc(), "neighbour").limit(top)


def kind_filter(nodes: DataFrame, edges: DataFrame, node_kinds, edge_kinds) -> tuple[DataFrame, DataFrame]:
    """Keep chosen node and edge kinds; an edge survives only if both ends do."""
    n = nodes.filter(F.col("kind").isin(*node_kinds))
    ids = n.select("id")
    e = (edges.filter(F.col("kind").isin(*edge_kinds))
         .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
         .join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    return n, e


def session_counts(sol: DataFrame, fingerprint_counts: DataFrame) -> DataFrame:
    """Sessions sharing each solution's fingerprint (0 when absent or blank)."""
    j = sol.select("id", "fingerprint_text").join(
        fingerprint_counts.withColumnRenamed("fingerprint", "fingerprint_text"), "fingerprint_text", "left")
    return j.select("id", F.when(F.coalesce(F.col("fingerprint_text"), F.lit("")) == "", F.lit(0))
                    .otherwise(F.coalesce(F.col("total"), F.lit(0))).alias("pg_session_count"))


class Graph:
    """The graph's tables, each planned when it is first asked for: ``graph["degree"]`` runs no components.

    Tables: solutions, similar, nodes, edges, membership, degree, communities, stats, hubs, top_error_classes.
    """

    def __init__(self, solutions: DataFrame, threshold: float, max_neighbours: int, block_size: int):
        self._input, self._threshold, self._block_size = solutions, threshold, block_size
        self._k = max(1, min(25, int(max_neighbours)))
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def _solutions(self) -> DataFrame:
        return solution_nodes(self._input)

    def _similar(self) -> DataFrame:
        vectors = self["solutions"].select(F.col("id").alias("key"), F.col("vector").alias("v"), "ord")
        sim = SIM.similarity_edges(vectors, self._k, self._threshold, self._block_size)
        return sim.checkpoint() if _ckpt(self._input) else sim          # several tables read it

    def _nodes(self) -> DataFrame:
        return typed_nodes(self["solutions"])

    def _edges(self) -> DataFrame:
        return typed_edges(self["solutions"], self["similar"])

    def _membership(self) -> DataFrame:
        return components(self["solutions"].select("id", "ord"), self["similar"])

    def _degree(self) -> DataFrame:
        return degrees(self["solutions"].select("id"), self["similar"])

    def _communities(self) -> DataFrame:
        return community_table(self["solutions"], self["membership"])

    def _stats(self) -> DataFrame:
        return graph_stats(self["solutions"], self["nodes"], self["similar"], self["degree"], self["communities"])

    def _hubs(self) -> DataFrame:
        return hub_nodes(self["solutions"], self["degree"])

    def _top_error_classes(self) -> DataFrame:
        return top_error_classes(self["solutions"])


def build_graph(solutions: DataFrame, threshold: float = 0.75, max_neighbours: int = 6,
                block_size: int = SIM.BLOCK_SIZE) -> Graph:
    """Whole graph as DataFrames: nodes, edges, communities, stats, hubs, top error classes."""
    return Graph(solutions, threshold, max_neighbours, block_size)


def _ckpt(df: DataFrame) -> bool:
    checkpoint_dir(df.sparkSession)
    return True
