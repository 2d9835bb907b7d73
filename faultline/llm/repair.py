"""Operator 13: conversation structure repair over a suffix-shared word graph.

A conversation's signature has one letter a row: its role initial (``s``, ``u``, ``a``, or ``o`` for any other), upper
case if the row is truncated, or ``D`` if it must go (blank or duplicate). The cheapest edits of a
row depend on what follows only, so signatures are shared from the end: a node of the graph is a
distinct signature suffix, named by its letter and the node that follows, and holds for each of
the grammar's four states the cost to go, the first edits, the state they lead to, and the rank of its audit
among the four. Ranks make ties exact without audits being built: of two audits the first edits
decide, else the ranks at the next node.

Reversed signatures are sorted in ranges, and a task walks its range with the path to the current one on a stack:
conversations with a common end find its nodes there, so every node is computed once in a range,
however many conversations share it, and memory is one path. Ranges are cut inside equal signatures,
too, so a signature that a third of all conversations have is no hot key. One conversation's
rows meet in one row, as its repaired text does.

Grammar: role initials ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or
assistant row 2; a truncated row that stays adds 1; ties take the ASCII-least audit.

Defined cases: null roles and texts are one space; an empty or unknown role is no initial of the grammar;
rows come by turn (nulls first), then role, then text; a null conversation id is a conversation;
repeated rows are duplicates; a conversation without rows has zeros, an empty audit and no repaired
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1     # costs
# the grammar's states: 0 nothing yet, 1 after s, 2 after u, 3 after a
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INSERTED = {0: ((0, 0), (2, 1), (3, 2)), 1: ((1, 0), (2, 1), (3, 2)), 2: ((2, 0), (3, 1)), 3: ((3, 0), (2, 1))}
ROLES = {"u": "user", "a": "assistant"}


class Node:
    """One signature suffix: per grammar state the cost to go, the first edits, the next state and the audit's rank."""

    __slots__ = ("cost", "edits", "goes", "rank")

    def __init__(self, cost: list[int], edits: list[str], goes: list[int], rank: list[int]):
        self.cost, self.edits, self.goes, self.rank = cost, edits, goes, rank


#: Behind the last row: a user row still needs its answer, a system row both.
LAST = Node([0, 2 * INSERT, INSERT, 0], ["", "II", "I", ""], [0, 3, 3, 3], [0, 2, 1, 0])


def before(letter: str, after: Node) -> Node:
    """The node of a row with ``letter`` in front of the suffix ``after``."""
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    cost, edits, goes = [], [], []
    for state in range(4):
        found = []
        for at, inserts in INSERTED[state]:
            moves = [("D", DELETE, at)]
            if letter != "D":
                if (at, role) in STEP:
                    moves.append(("K", KEEP + extra, STEP[at, role]))
                moves += [("R", REROLE + extra, STEP[at, r]) for r in ROLES if (at, r) in STEP]
            found += [(INSERT * inserts + price + after.cost[to], "I" * inserts + name, after.rank[to], to)
                      for name, price, to in moves]
        best = min(found)
        cost.append(best[0])
        edits.append(best[1])
        goes.append(best[3])
    order = [(edits[g], after.rank[goes[g]]) for g in range(4)]
    dense = {x: i for i, x in enumerate(sorted(set(order)))}
    return Node(cost, edits, goes, [dense[x] for x in order])


def follow(path: list[Node]) -> tuple[str, list[int], list[str | None]]:
    """The audit from the grammar's start along a path (last row first), and per remaining row its number (-1 if
    inserted) and its new role (null if kept)."""
    state, audit, rows, roles = 0, [], [], []
    last = "a"
    n = len(path) - 1
    for i, node in enumerate(reversed(path)):
        for name in node.edits[state]:
            audit.append(name)
            if name == "D":
                continue
            rows.append(-1 if name == "I" else i)
            if name == "K":
                roles.append(None)
                to = node.goes[state]       # a kept row is its edits' last
                last = {1: "s", 2: "u", 3: "a"}[to]
            else:
                last = "a" if last == "u" else "u"
                roles.append(ROLES[last])
        if i < n:
            state = node.goes[state]
    return "".join(audit), rows, roles


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, letters, result = [LAST], "", None
    for batch in batches:
        cost, audits, rows, roles = [], [], [], []
        for signature in batch.column("reversed").to_pylist():
            if result is None or signature != letters:
                shared = _common(letters, signature)
                del path[shared + 1:]
                for letter in signature[shared:]:
                    path.append(before(letter, path[-1]))
                letters = signature
                result = (path[-1].cost[0], *follow(path))
            for column, value in zip((cost, audits, rows, roles), result, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(cost, pa.int64()), pa.array(audits, pa.string()),
             pa.array(rows, pa.list_(pa.int32())), pa.array(roles, pa.list_(pa.string()))],
            names=["key", "cost", "audit", "at", "as"])


def _common(x: str, y: str) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n                    # x[:low] is common, x[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if x[:mid] == y[:mid] else (low, mid)
    return low


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", present: Column | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): one row per conversation.

    ``present`` (a boolean column, if given) tells which rows of ``turns`` exist; a conversation none of whose rows does
    has a row, too. ``repaired`` holds (role, text) of the rows after the cheapest edits.
    """
    conv = F.col(conv_col)
    rows = turns.select(
        F.coalesce(F.concat(F.lit("+"), conv.cast("string")), F.lit("-")).alias("key"), conv.alias("conv"),
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("there"))
    ends = F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "there", "role", "text").orderBy("turn")))
    again = F.col("nth") > 1
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))
    rows = rows.withColumn("fault", F.when(ends == "", "blank").when(again, "duplicate")
                           .when(~F.substring(ends, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    rows = rows.withColumn("initial", initial)
    letter = (F.when(F.col("fault").isin("blank", "duplicate"), F.lit("D"))
              .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
    row = F.when(F.col("there"), F.struct("turn", "role", "text", "nth", letter.alias("letter"), "initial"))
    convs = (rows.groupBy("key").agg(
        F.first("conv").alias("conv"), F.sort_array(F.collect_list(row)).alias("rows"),
        *[F.count_if(F.col("there") & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")])
        .withColumn("turns", F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())))
        .withColumn("initials", F.transform("rows", lambda r: r["initial"])))
    ordered = (convs.select("key", F.reverse(F.array_join(F.transform("rows", lambda r: r["letter"]), "")).alias("reversed"))
               .repartitionByRange("reversed", "key").sortWithinPartitions("reversed"))
    edits = ordered.mapInArrow(_walk, "key string, cost bigint, audit string, at array<int>, as array<string>")
    legal = F.filter(F.transform("initials", lambda x, i: F.concat(x, F.get("initials", i + 1))),
                     lambda p: p.isin("su", "ua", "au"))
    gaps = F.coalesce(F.array_max("turns") - F.array_min("turns") + 1 - F.size("turns"), F.lit(0))
    made = F.transform("at", lambda i, k: F.struct(
        F.coalesce(F.get("as", k), F.get("rows", i)["role"]).alias("role"),
        F.coalesce(F.get("rows", i)["text"], F.lit("")).alias("text")))
    return convs.join(edits, "key").select(
        "conv", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated",
        F.greatest(F.size("initials") - 1 - F.size(legal), F.lit(0)).cast("bigint").alias("illegal"),
        "cost", "audit", made.alias("repaired"))
