"""K1: the ring fill on a log of many lines, against a walk over all candidates."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from faultline.functions import lines as L
from faultline.functions import patterns as P
from faultline.operators import select as S
from faultline.operators import structural as ST
from faultline.operators import tokenize as T


def walk(rows, budget: int) -> set[int]:
    """Every candidate in turn. ``rows``: idx -> (score, drop, text, cost)."""
    live = [i for i, (_, drop, text, _) in enumerate(rows) if not drop and text]
    groups: list[list[int]] = []
    for i in (i for i in live if rows[i][0] >= P.MIN_ANCHOR_SCORE):
        if groups and i - groups[-1][-1] <= P.CLUSTER_MERGE_GAP:
            groups[-1].append(i)
        else:
            groups.append([i])
    clusters = []
    for n, g in enumerate(groups):
        span = range(max(0, g[0] - P.CONTEXT_BEFORE), min(len(rows) - 1, g[-1] + P.CONTEXT_AFTER) + 1)
        peak = max(rows[i][0] for i in span if not rows[i][1])
        clusters.append((-peak, span[0], n, span, min(i for i in span if not rows[i][1] and rows[i][0] == peak)))
    first: dict[int, tuple] = {}
    for rank, (_, _, _, span, centre) in enumerate(sorted(clusters, key=lambda c: c[:3])):
        for i in span:
            if not rows[i][1] and rows[i][2]:
                visit = (abs(i - centre), rank, int(i > centre), i)
                first[i] = min(first.get(i, visit), visit)
    taken, left, ring, some = set(), budget, 0, False
    for r, _, _, i in sorted(first.values()):
        if r > ring:
            if r > ring + 1 or not some or left <= 0:
                break
            ring, some = r, False
        if rows[i][3] <= left:
            taken.add(i)
            left, some = left - rows[i][3], True
    return taken


def test_fill_of_a_long_log(spark):
    rng = random.Random(12)
    texts = []
    for i in range(40_000):
        if rng.random() < 0.08:
            texts.append("ERROR failed " + "x" * rng.choice([3, 30, 300]) + f" case {i}")
        else:
            texts.append(rng.choice(["", "INFO step ok", "WARN slow " + "y" * rng.randrange(80), "plain " + "z " * rng.randrange(20)]))
    logs = spark.createDataFrame([("long", "\n".join(texts)), ("short", "INFO a\nERROR b\nINFO c")], "log_id string, raw string")
    scored = S.score_lines(ST.init_state(T.tokenize(logs))).persist()
    costs = scored.select("log_id", "idx", "score", "drop", "text", L.approx_tokens("text", "note").alias("cost")).orderBy("log_id", "idx").collect()
    for budget in (P.BODY_MAX_TOKENS, 37):
        picked = S.select_lines(scored, token_budget=budget).filter("selected").select("log_id", "idx").collect()
        for log in ("long", "short"):
            rows = [(r.score, r.drop, r.text, r.cost) for r in costs if r.log_id == log]
            assert {r.idx for r in picked if r.log_id == log} == walk(rows, budget)
    scored.unpersist()
