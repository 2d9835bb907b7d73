"""Order-dependent passes over logs of any length: scans block by block.

A log's lines are cut into blocks of ``BLOCK`` line numbers. A scan runs inside (key, block) windows, so no task
holds more than a block of one log at a time, however large the log is; what a block takes from
the blocks before it (or behind it) comes from one summary row per block: the summaries of a
key are scanned in turn, one row per block, and joined back by (key, block). Summaries of single-block keys are
filtered out, so an input of short logs joins an empty table, which adaptive execution drops.

``scan`` carries sums, maxima and last or first values; ``next_at`` finds the first point at or behind a
place; ``greedy_chain`` follows links (place to next place) from given starts by doubling them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK = 4096        # line numbers of one block
BLK = "_b"


def several(lines: DataFrame) -> bool:
    """Whether any log has a second block (one number to the driver)."""
    return (lines.agg(F.max(BLK)).first()[0] or 0) > 0


def block_of(idx: Column | str, size: int = BLOCK) -> Column:
    return F.floor((F.col(idx) if isinstance(idx, str) else idx) / size).cast("int")


def with_blocks(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """``lines`` with their block number (kept if they have one)."""
    return lines if BLK in lines.columns else lines.withColumn(BLK, block_of("idx", size))


def _joint(kind: str, a: Column, b: Column) -> Column:
    """What the carried value ``a`` and the block's own value ``b`` give together."""
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if kind == "max":
        return F.greatest(a, b)
    return F.coalesce(b, a)             # last and first: the nearer one


def scan(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, Column]], order: tuple[str, ...] = ("idx",),
         ahead: bool = False, own: bool = True, spans: bool = True) -> DataFrame:
    """Running values over all rows of a key.

    ``specs`` names new columns with (kind, value): ``sum``, ``max``, ``last`` (the last value that is
    not null) for scans from the start; ``first`` for scans ``ahead`` from the end. ``own`` tells whether a
    row's own value counts. ``df`` must hold ``_b``; rows of a key are ordered by ``order``, of which the first
    column follows the blocks. ``spans`` false says that no key has a second block: nothing is carried then.
    """
    # Scans ahead run from the end, too: a frame that grows takes one step a row, one that shrinks is summed up anew for each row.
    turned = (lambda c: F.col(c).desc()) if ahead else F.col
    local = Window.partitionBy(*keys, BLK).orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    between = Window.partitionBy(*keys).orderBy(turned(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda c: F.last(c, ignorenulls=True)
    run = {"sum": F.sum, "max": F.max, "last": nearest, "first": nearest}

    def whole(kind: str, c: Column) -> Column:
        at = F.when(c.isNotNull(), F.struct(*order))
        return {"sum": F.sum, "max": F.max, "last": lambda x: F.max_by(x, at), "first": lambda x: F.min_by(x, at)}[kind](c)

    if not spans:
        return df.select("*", *[_joint(k, F.lit(None), run[k](c).over(local)).alias(n) for n, (k, c) in specs.items()])
    summary = df.groupBy(*keys, BLK).agg(*[whole(k, c).alias(f"_w{i}") for i, (k, c) in enumerate(specs.values())])
    carried = summary.select(*keys, BLK, *[run[k](F.col(f"_w{i}")).over(between).alias(f"_c{i}") for i, (k, _) in enumerate(specs.values())])
    carried = carried.filter(" or ".join(f"_c{i} is not null" for i in range(len(specs))))
    out = df.select("*", *[run[k](c).over(local).alias(f"_l{i}") for i, (k, c) in enumerate(specs.values())])
    out = out.join(carried, [*keys, BLK], "left")
    return out.select(*df.columns, *[_joint(k, F.col(f"_c{i}"), F.col(f"_l{i}")).alias(n) for i, (n, (k, _)) in enumerate(specs.items())])


def next_at(points: DataFrame, queries: DataFrame, keys: list[str], at: str, into: str, size: int = BLOCK,
            spans: bool = True) -> DataFrame:
    """``queries`` with ``into``: the smallest ``idx`` of ``points`` of the same key that is ``at`` or more (else null)."""
    asked = queries.withColumnRenamed(BLK, "_own")
    rest = [c for c in asked.columns if c not in keys]
    empty = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest]
    place = F.col("idx").cast("bigint")
    rows = (points.select(*keys, *empty, place.alias("_pos"), F.lit(1).alias("_asks"), place.alias("_point"))
            .unionByName(asked.select(*keys, *rest, F.col(at).cast("bigint").alias("_pos"), F.lit(0).alias("_asks"),
                                      F.lit(None).cast("bigint").alias("_point"))))
    rows = rows.withColumn(BLK, block_of("_pos", size))
    found = scan(rows, keys, {into: ("first", F.col("_point"))}, order=("_pos", "_asks"), ahead=True, spans=spans)
    return found.filter("_asks = 0").select(*keys, *rest, into).withColumnRenamed("_own", BLK)


def greedy_chain(starts: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx): all places that ``links`` (keys, idx, nxt) reach from ``starts`` (keys, idx), these included.

    Links lead to later places. Every round marks what the current links reach from the marked places and
    doubles the links, so a chain of n places takes log2(n) rounds; no round holds a chain in one row.
    """
    checkpoint_dir(starts.sparkSession)
    marked = starts.select(*keys, "idx").checkpoint()
    links = links.filter("nxt is not null").select(*keys, "idx", "nxt").checkpoint()
    known = marked.count()
    while True:
        reached = marked.join(links, [*keys, "idx"]).select(*keys, F.col("nxt").alias("idx"))
        marked = marked.unionByName(reached).distinct().checkpoint()
        now = marked.count()
        if now == known:
            return marked
        known = now
        further = links.select(*keys, F.col("idx").alias("nxt"), F.col("nxt").alias("_to"))
        links = links.join(further, [*keys, "nxt"]).select(*keys, "idx", F.col("_to").alias("nxt")).checkpoint()
