"""Connected components: contraction inside partitions and star steps, against a plain union-find."""

from __future__ import annotations

import random

import pytest

from faultline.llm import graph


def plain(links) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def linked(spark, links, partitions):
    return spark.createDataFrame(links, "a bigint, b bigint").repartition(partitions)


def result(df) -> dict[int, int]:
    rows = [tuple(r) for r in df.select("node", "component").collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("partitions", [1, 7])
def test_components_equal_union_find(spark, partitions):
    rng = random.Random(partitions)
    path = [(i, i + 1) for i in range(60)]
    ring = [(1000 + i, 1000 + (i + 1) % 17) for i in range(17)]
    hub = [(2000, 2001 + i) for i in range(300)]
    loose = [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(170)]
    links = [*path, *ring, *hub, *loose, (5, 5), (9000, 9000), *path[:4]]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    assert result(graph.components(linked(spark, links, partitions))) == plain(links)


def test_no_links_give_no_components(spark):
    assert result(graph.components(linked(spark, [], 2))) == {}
    assert result(graph.components(linked(spark, [(3, 3)], 2))) == {}


def test_further_links_join_components(spark):
    rng = random.Random(9)
    first = [(rng.randrange(200), rng.randrange(200)) for _ in range(70)]
    more = [(rng.randrange(260), rng.randrange(260)) for _ in range(50)] + [(7, 7)]
    comps = graph.components(linked(spark, first, 3))
    assert result(graph.joined(comps, linked(spark, more, 3))) == plain(first + more)
