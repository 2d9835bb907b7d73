"""Exact cosine search over a pivot index.

Every vector belongs to its nearest pivot, one of the vectors farthest apart in a bounded sample, and knows its angle to it. A block holds
the vectors of one pivot whose angles lie in a range, ``block_size`` or so; equal angles are dealt by key, so
copies don't fill a block. On the unit sphere angles obey the triangle inequality, so for two blocks, or
for a query and a block, the angles to the pivots bound the angle between any two members from below.
Whatever that bound puts under the threshold is never compared, and nothing else is left out: results are exact.

Only pivots (``max_pivots`` vectors, with the reach of their members) are collected and broadcast. Blocks meet by joins on their
pivots. They travel in about ``GROUPS`` groups, two of which make one Arrow group, so what is shuffled grows as the corpus does, and
a group's comparisons run in tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK_SIZE = 1024
MAX_PIVOTS = 512
SAMPLE = 16             # vectors read for each pivot that is chosen
RING = 0.02             # radians; a block's angles are a run of rings
SLACK = 1e-9            # angles are rounded
PAIRS = "i string, j string, sim double, ord string"
FOUND = {"i": pa.string(), "j": pa.string(), "sim": pa.float64(), "ord": pa.string(), "probes": pa.int32()}
GROUPS = 8              # a vector meets the corpus in so many groups of blocks, however large it is
GROUP_LEAST, GROUP_ROWS = 512, 1 << 17
ROW_CUT, COLUMN_CUT = 1024, 4096
DENSE = 64              # finds a row from which on whole rows are ranked


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of a matrix."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows divided by their norms (a zero norm counts as 1)."""
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm == 0, 1.0, norm)[:, None]


def lists(m: np.ndarray) -> pa.Array:
    width = m.shape[1] if m.size else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * width), pa.array(m.ravel()))


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _spread(m: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``m``, each the farthest from those before it, so that every cluster gets a pivot."""
    some = m[np.any(m != 0, axis=1)]
    m = some if len(some) else m
    chosen, far = [0], _angles(m, m[:1])[:, 0]
    while len(chosen) < min(n, len(m)):
        at = int(far.argmax())
        if far[at] <= 1e-6:             # only copies are left
            break
        chosen.append(at)
        far = np.minimum(far, _angles(m, m[at:at + 1])[:, 0])
    return m[chosen]


@dataclass
class PivotIndex:
    """``members`` (key, ord, v, pivot, angle, block), ``blocks`` (block, pivot, lo, hi, n) and the pivots' vectors.

    ``lo`` and ``hi`` are the least and greatest angle of a block's members to its pivot.
    """

    members: DataFrame
    blocks: DataFrame
    pivots: np.ndarray

    def save(self, path: str) -> None:
        """Write the index; members are dealt by block, so a block is read from one file."""
        spark = self.members.sparkSession
        self.members.repartition("pivot").sortWithinPartitions("block").write.mode("overwrite").partitionBy("pivot").parquet(f"{path}/members")
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        rows = [(i, v.tolist()) for i, v in enumerate(self.pivots)]
        spark.createDataFrame(rows, "pivot int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PivotIndex:
        pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()      # max_pivots rows
        members = spark.read.parquet(f"{path}/members").select(
            "key", "ord", "v", F.col("pivot").cast("int").alias("pivot"), "angle", "block")
        return cls(members, spark.read.parquet(f"{path}/blocks"), np.array([r["v"] for r in pivots], np.float64))


def build(vectors: DataFrame, block_size: int = BLOCK_SIZE, max_pivots: int = MAX_PIVOTS) -> PivotIndex:
    """The index of ``vectors`` (key, ord, v); null and empty vectors stay out. Equal cosines rank by ``ord``."""
    checkpoint_dir(vectors.sparkSession)
    vectors = vectors.filter(F.col("v").isNotNull() & (F.size("v") > 0)).select(
        F.col("key").cast("string").alias("key"), F.col("ord").cast("string").alias("ord"), F.col("v").cast("array<double>").alias("v"))
    wanted = max(1, min(max_pivots, math.ceil(vectors.count() / block_size)))
    sample = vectors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE * wanted).collect()       # a bounded sample
    pivots = _spread(unit(np.array([r["v"] for r in sample], np.float64)), wanted) if sample else np.zeros((1, 1))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = unit(matrix(batch.column("v")))
            angles = _angles(m, pivots)
            own = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ord"), lists(m), pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(m)), own])],
                names=["key", "ord", "v", "pivot", "angle"])

    assigned = vectors.mapInArrow(assign, "key string, ord string, v array<double>, pivot int, angle double").checkpoint()
    ring = F.floor(F.col("angle") / RING).cast("int").alias("_ring")
    # at most max_pivots * (pi / RING) rows: a proven bound
    rings = assigned.groupBy("pivot", ring).agg(F.count(F.lit(1)).alias("_n"))
    seen = F.coalesce(F.sum("_n").over(Window.partitionBy("pivot").orderBy("_ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rings = rings.select("pivot", "_ring", F.floor(seen / block_size).alias("_part"), F.ceil(F.col("_n") / block_size).alias("_deal"))
    block = F.concat_ws("/", "pivot", "_part", F.pmod(F.xxhash64("key"), F.col("_deal")))
    members = (assigned.withColumn("_ring", ring).join(F.broadcast(rings), ["pivot", "_ring"])
               .select("key", "ord", "v", "pivot", "angle", block.alias("block")))
    blocks = members.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
                                          F.count(F.lit(1)).alias("n"))
    return PivotIndex(members, blocks, pivots)


def _reach(index: PivotIndex) -> list:
    """One row per pivot that has members: the range of their angles."""
    return index.blocks.groupBy("pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()


def _limit(threshold: float) -> float:
    """The greatest angle that still counts."""
    return math.acos(min(1.0, max(-1.0, threshold - SLACK))) + SLACK


def block_pairs(index: PivotIndex, threshold: float) -> DataFrame:
    """(a, b): the pairs of blocks, each once, that may hold two vectors with a cosine of ``threshold`` or more."""
    limit = _limit(threshold)
    between = _angles(index.pivots, index.pivots)
    own = sorted(_reach(index), key=lambda r: r["pivot"])
    pairs = [(x["pivot"], y["pivot"], 0.0 if x["pivot"] == y["pivot"] else float(between[x["pivot"], y["pivot"]]))
             for i, x in enumerate(own) for y in own[i:] if between[x["pivot"], y["pivot"]] - x["hi"] - y["hi"] <= limit or x is y]
    spark = index.blocks.sparkSession
    met = spark.createDataFrame(pairs, "pa int, pb int, t double")         # max_pivots ** 2 / 2 rows at most
    sides = [index.blocks.select(F.col("pivot").alias("p" + x), F.col("block").alias(x), F.col("lo").alias("lo" + x), F.col("hi").alias("hi" + x))
             for x in "ab"]
    both = met.join(sides[0], "pa").join(sides[1], "pb").filter("pa < pb or a <= b")
    far = F.greatest(F.lit(0.0), *[F.expr(e) for e in (
        "t - hia - hib", "loa - t - hib", "lob - t - hia")])
    return both.filter((far <= limit) | (F.col("a") == F.col("b"))).select("a", "b")


def _groups(index: PivotIndex, least: int = 0) -> DataFrame:
    """(block, pivot, lo, hi, grp): the blocks in runs by pivot, each a group of ``least`` rows or more.

    There are about ``GROUPS`` of them, so that a vector travels to that many groups however many blocks there
    are; more only when a group would pass ``GROUP_ROWS`` rows.
    """
    totals = sorted(index.blocks.groupBy("pivot").agg(F.sum("n").alias("n")).collect())        # max_pivots rows
    size = max(1, min(GROUP_ROWS, max(least or GROUP_LEAST, math.ceil(sum(n for _, n in totals) / GROUPS))))
    before, at = [], 0
    for pivot, n in totals:
        before.append((pivot, at))
        at += n
    before = index.blocks.sparkSession.createDataFrame(before, "pivot int, _before bigint")
    own = F.sum("n").over(Window.partitionBy("pivot").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return (index.blocks.withColumn("_own", own).join(F.broadcast(before), "pivot")
            .select("block", "pivot", "lo", "hi", F.floor((F.col("_before") + F.col("_own")) / size).cast("int").alias("grp")))


def _best(sims: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's best ``k`` entries that reach its ``least``; of equal ones the first columns."""
    k = min(k, sims.shape[1])
    kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1:k]
    above, even = sims > kth, sims == kth
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero((above | even & (np.cumsum(even, axis=1) <= room)) & (sims >= least[:, None]))


class _Top:
    """The best ``k`` members of each of some rows so far; equal cosines go by the members' places.

    A product in single precision, whose error is bounded, tells which pairs may come in; their cosines are computed
    in double precision and rounded, so that copies of a vector tie wherever they stand.
    """

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least, k
        self.sim = np.full((len(least), k), -np.inf)
        self.at = np.full((len(least), k), np.iinfo(np.int64).max)

    def need(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.sim[rows, -1], self.least[rows])

    def add(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, rough: np.ndarray, own: bool = False) -> None:
        """``rough``: x[rows] by y[cols] in single precision. ``own``: both are places of one table, none meets itself."""
        need = self.need(rows)
        slack = (x.shape[1] + 8) * 1.2e-7
        r, c = np.nonzero(rough >= (need - slack)[:, None].astype(np.float32))
        if len(r) > DENSE * len(rows):
            exact = np.round(x[rows] @ y[cols].T, 12)
            if own:
                exact[rows[:, None] == cols[None, :]] = -np.inf
            r, c = _best(exact, self.k, need)
            sim = exact[r, c]
        else:
            sim = np.round(np.einsum("ij,ij->i", x[rows[r]], y[cols[c]]), 12)
        ok = sim >= need[r]
        if own:
            ok &= rows[r] != cols[c]
        if not ok.any():
            return
        met, r = np.unique(r[ok], return_inverse=True)
        mine = rows[met]
        r = np.concatenate((r, np.repeat(np.arange(len(met)), self.k)))
        sim = np.concatenate((sim[ok], self.sim[mine].ravel()))
        at = np.concatenate((cols[c[ok]], self.at[mine].ravel()))
        order = np.lexsort((at, -sim, r))
        r = r[order]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(met)))[r]
        kept = place < self.k
        self.sim[mine[r[kept]], place[kept]] = sim[order][kept]
        self.at[mine[r[kept]], place[kept]] = at[order][kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, place = np.nonzero(self.sim > -np.inf)
        return rows, self.at[rows, place], self.sim[rows, place]


def _places(names: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The places of each value, ascending."""
    values, code = np.unique(names.to_numpy(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    return dict(zip(values.tolist(), np.split(order, np.searchsorted(code[order], np.arange(1, len(values)))), strict=True))


def _cut(places: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for at in range(0, len(places), size):
        yield places[at:at + size]


def _pick(x: pa.Table, y: pa.Table, top: _Top) -> list:
    rows, cols, sims = top.found()
    at = pa.array(cols)
    return [x.column("key").combine_chunks().take(pa.array(rows)), y.column("key").combine_chunks().take(at), pa.array(sims),
            y.column("ord").combine_chunks().take(at)]


def _compare(k: int, threshold: float):
    def run(table: pa.Table, pairs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], FOUND[n]) for n in ("i", "j", "sim", "ord")})
        table = table.sort_by("ord")
        x = matrix(table.column("v"))
        rough = x.astype(np.float32)
        at = _places(table.column("block"))
        top = _Top(np.full(len(x), threshold), k)
        met: dict[str, list[str]] = {}
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            met.setdefault(a, []).append(b)
        for a, others in sorted(met.items()):
            rest = [at[b] for b in others if b != a]
            cols = np.sort(np.concatenate(rest)) if rest else np.zeros(0, np.int64)
            for r in _cut(at[a], ROW_CUT):
                for c in _cut(at[a] if a in others else cols[:0], COLUMN_CUT):     # a block with itself
                    top.add(r, c, x, x, rough[r] @ rough[c].T, own=True)
                for c in _cut(cols, COLUMN_CUT):                                  # with others, both ways
                    sims = rough[r] @ rough[c].T
                    top.add(r, c, x, x, sims)
                    top.add(c, r, x, x, sims.T)
        return pa.table(dict(zip(("i", "j", "sim", "ord"), _pick(table, table, top), strict=True)))
    return run


def near_pairs(index: PivotIndex, k: int, threshold: float, group_rows: int = 0) -> DataFrame:
    """(i, j, sim, ord), both ways: a superset of every member's ``k`` best others with a cosine of ``threshold`` or more.

    Two groups of blocks meet in one Arrow group, which compares the pairs of their blocks that are not too far apart and
    keeps the ``k`` best of each row: a vector and its finds travel once for each group, not for each block.
    """
    checkpoint_dir(index.members.sparkSession)
    groups = _groups(index, group_rows)
    pairs = block_pairs(index, threshold)
    for x in "ab":
        pairs = pairs.join(groups.select(F.col("block").alias(x), F.col("grp").alias("g" + x)), x)
    pairs = pairs.select("a", "b", F.least("ga", "gb").alias("ta"), F.greatest("ga", "gb").alias("tb")).checkpoint()
    met = pairs.select(F.col("a").alias("block"), "ta", "tb").union(pairs.select("b", "ta", "tb")).distinct()
    own = index.members.join(met, "block").select("key", "ord", "v", "block", F.col("ta").alias("ua"), F.col("tb").alias("ub"))
    return own.groupBy("ua", "ub").cogroup(pairs.groupBy("ta", "tb")).applyInArrow(_compare(k, threshold), PAIRS)


def _answer(k: int, floor: float, pivots: np.ndarray, nearest: bool):
    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        if not members.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], kind) for n, kind in FOUND.items()})
        members = members.sort_by("ord")
        q, y = matrix(asked.column("v")), matrix(members.column("v"))
        rough_q, rough_y = q.astype(np.float32), y.astype(np.float32)
        first = asked.column("first").to_numpy()
        top = _Top(np.maximum(asked.column("least").to_numpy(), floor) - SLACK, k)
        angle, pivot = members.column("angle").to_numpy(), members.column("pivot").to_numpy()
        probes, every = np.zeros(len(q), np.int32), np.arange(len(q))
        for _, own in sorted(_places(members.column("block")).items()):
            p, lo, hi = int(pivot[own[0]]), angle[own].min(), angle[own].max()
            for r in _cut(every[(first == p) == nearest], ROW_CUT):
                far = _angles(q[r], pivots[p:p + 1])[:, 0]
                far = np.maximum(0.0, np.maximum(far - hi, lo - far))
                r = r[far <= np.arccos(np.clip(top.need(r) - SLACK, -1, 1)) + SLACK]
                probes[r] += 1
                for c in _cut(own, COLUMN_CUT) if len(r) else ():
                    top.add(r, c, q, y, rough_q[r] @ rough_y[c].T)
        found = _pick(asked, members, top)
        read = np.flatnonzero(probes)
        found = [*found, pa.nulls(len(found[0]), pa.int32())]
        told = [asked.column("key").combine_chunks().take(pa.array(read)), pa.nulls(len(read), pa.string()), pa.nulls(len(read), pa.float64()),
                pa.nulls(len(read), pa.string()), pa.array(probes[read])]
        return pa.table({n: pa.concat_arrays([a, b]) for n, a, b in zip(FOUND, found, told, strict=True)})
    return run


def probe(index: PivotIndex, queries: DataFrame, k: int, floor: float = -1.0, group_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best members of each of ``queries`` (key, v), best blocks first: (i, j, sim, ord) and (key, probes).

    Each query first reads the blocks of its nearest pivot. Its k-th best cosine there (or ``floor``, if greater) is what
    others have to reach, so of the other blocks it reads those whose bound allows that. The pairs are a superset
    of the k best with a cosine of ``floor`` or more. ``probes`` counts the blocks read. Queries travel to groups of
    blocks, members to as many chunks of the queries.
    """
    checkpoint_dir(queries.sparkSession)
    pivots = index.pivots
    groups = _groups(index, group_rows)
    reach = sorted(groups.groupBy("pivot", "grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())    # pivots + groups
    live = np.array(sorted({r["pivot"] for r in reach}), np.int64)
    place = np.searchsorted(live, [r["pivot"] for r in reach])
    lo, hi = (np.array([r[x] for r in reach]) for x in ("lo", "hi"))
    grp = np.array([r["grp"] for r in reach], np.int64)

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(live):
                m = unit(matrix(batch.column("v")))
                first = live[_angles(m, pivots[live]).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists(m), pa.array(first.astype(np.int32))], names=["key", "v", "first"])

    def route(nearest: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m, first = matrix(batch.column("v")), batch.column("first").to_numpy()
                least = np.maximum(batch.column("least").to_numpy(), floor)
                goes = first[:, None] == live[place][None, :]
                if not nearest:
                    angles = _angles(m, pivots[live])[:, place]
                    far = np.maximum(0.0, np.maximum(angles - hi, lo - angles))
                    goes = ~goes & (far <= np.arccos(np.clip(least - SLACK, -1, 1))[:, None] + SLACK)
                to = np.zeros((len(m), int(grp.max()) + 1), bool)
                for i, g in enumerate(grp):
                    to[:, g] |= goes[:, i]
                rows, cols = np.nonzero(to)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(rows)), lists(m[rows]), pa.array(least[rows]), pa.array(first[rows]),
                         pa.array(cols.astype(np.int32))], names=["key", "v", "least", "first", "grp"])
        return run

    asked = queries.select(F.col("key").cast("string").alias("key"), F.col("v").cast("array<double>").alias("v"))
    asked = asked.mapInArrow(home, "key string, v array<double>, first int").checkpoint()
    n = asked.count()

    def ask(rows: DataFrame, nearest: bool) -> DataFrame:
        wide = GROUPS // 4 if nearest else GROUPS          # a query meets few groups at first
        chunks = max(1, min(wide, math.ceil(n / GROUP_LEAST)), math.ceil(n / GROUP_ROWS))
        told = rows.mapInArrow(route(nearest), "key string, v array<double>, least double, first int, grp int")
        told = told.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))
        wanted = groups.select("block", "grp").join(told.select("grp", "chunk").distinct(), "grp")
        members = index.members.join(wanted, "block").select("key", "ord", "v", "pivot", "angle", "block", F.col("grp").alias("to"), F.col("chunk").alias("of"))
        met = members.groupBy("to", "of").cogroup(told.groupBy("grp", "chunk"))
        return met.applyInArrow(_answer(k, floor, pivots, nearest), PAIRS + ", probes int")

    near = ask(asked.withColumn("least", F.lit(floor)), True).checkpoint()
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("sim").desc()))
    best = near.filter("probes is null").withColumn("_r", rank).filter(F.col("_r") == k).select(F.col("i").alias("key"), F.col("sim").alias("least"))
    both = near.unionByName(ask(asked.join(best, "key", "left").withColumn("least", F.coalesce("least", F.lit(floor))), False))
    return both.filter("probes is null").drop("probes"), both.filter("probes > 0").groupBy(F.col("i").alias("key")).agg(F.sum("probes").alias("probes"))
