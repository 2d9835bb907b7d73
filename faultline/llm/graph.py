"""Connected components of a table of links: contraction inside partitions, then alternating star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links(a, b)`` (bigint).

    Every partition of the links is contracted by a union-find of its own, which leaves one root
    for each of its nodes. Nodes with roots from several partitions link these roots, and only these links, far fewer as a
    rule, go through star steps: each round replaces the links by links to the smallest neighbour
    (first from the larger side, then from the smaller side) until nothing changes, so every
    component of roots ends as one star around its smallest: about log(roots) rounds. A
    round is two map-side combined minima and two joins by node; each is written to the shared
    folder. The driver sees two numbers a round. Self-links and repeated links change nothing; no links
    give no rows.
    """
    forest = links.where("a <> b").select("a", "b").mapInArrow(_contract, "node bigint, root bigint")
    # at most one root for each partition of the links
    held = written(forest.groupBy("node").agg(F.collect_set("root").alias("roots")), "components-roots")
    least = held.select("node", F.array_min("roots").alias("root"), "roots")
    # a root is a node, too: its own smallest root is in its row
    between = least.where("size(roots) > 1").select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b")
    own = least.select("node", "root")
    if between.isEmpty():
        return own.select("node", F.col("root").alias("component"))
    stars = _stars(between)
    return (own.join(stars.select(F.col("node").alias("root"), "component"), "root", "left")
            .select("node", F.coalesce("component", "root").alias("component")))


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, component) with further ``links(a, b)`` between their nodes or new ones."""
    def side(c: str) -> DataFrame:
        return comps.select(F.col("node").alias(c), F.col("component").alias("c" + c))

    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    between = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = written(components(between), "components-moved")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    # a component's name is one of its nodes, and so is a node that had none
    return (comps.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            .unionByName(moved).dropDuplicates(["node"]))


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a partition's links: the smallest node that they reach, by passes of hooking and halving over arrays."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[:len(a)], number[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)                  # hook the larger root below the smaller
        while True:                                     # every node takes its root's root, until all are roots
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at:at + (1 << 16)]), pa.array(nodes[root[at:at + (1 << 16)]])],
                                         names=["node", "root"])


def _stars(links: DataFrame) -> DataFrame:
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)), "components")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())
