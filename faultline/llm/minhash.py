"""Operator 8: MinHash near-duplicates by tensored banding, verified on full sets.

A document is the set of its distinct word shingles. ``HALVES`` small hash
collections of ``ROWS`` minhashes give as many half keys, and every pair of
half keys is one table key: 32 * 4 = 128 minhashes serve 496 tables of eight
rows each, against 3,968 minhashes without the tensoring. A pair of sets
with similarity 0.8 shares at least two half keys, hence a table, but for
about one time in a million. A half key that a single set has cannot be part of a
shared table key, so such keys go before the tables are formed; the rest of the tables
lose nothing.

Inside a table nothing is expanded into all pairs at once. Sets link to the
smallest member of their tables, checked on the full shingle sets; then the members
that no link has joined to their tables' smallest members are checked against each of those;
last, and only across components that still differ, every remaining pair with a common half key.
Pairs that can't reach the similarity go unchecked by an exact bound, from counts and bitmaps of
what a set can share with others in question. No candidate is capped or sampled.

Equal sets are one node from the start (copies are not expanded). Defined
cases: a null, empty or blank text has an empty set, links with nothing and is its
own component; shorter texts are one shingle; repeated rows, and rows with equal or null ids but
different texts, are nodes by their sets, and a component's id is the smallest id in
it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import fresh, row_key_of, slices, written
from .graph import components, joined

HALVES = 32
ROWS = 4
WORDS = 16                      # 64-bit words in the bitmap that bounds what two sets share
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80

_RNG = np.random.default_rng(812)
_A = (_RNG.integers(0, 1 << 31, HALVES * ROWS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, HALVES * ROWS, dtype=np.int64).astype(np.uint32)[:, None]
_ORDER = [H.U64(x) for x in _RNG.integers(1, 1 << 62, 64, dtype=np.int64) * 2 + 1]
_KEY = H.mix(np.arange(1, HALVES + 1, dtype=H.U64) * H.U64(H.BASE))


def shingle_set(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased)."""
    codes = H.word_codes(H.utf8(text).translate(H.LOWER))
    if not len(codes):
        return codes
    n = min(n_words, len(codes))
    total = np.full(len(codes) - n + 1, H.U64(n * H.BASE % (1 << 64)))
    for j in range(n):
        total = total + codes[j:len(codes) - n + 1 + j] * (_ORDER[j] if j < 64 else H.U64(H.BASE + 2 * j))
    return np.unique(H.mix(total))


def half_keys(items: np.ndarray) -> np.ndarray:
    """One key for each small hash collection: its minhashes, hashed together."""
    x = (items >> H.U64(32)).astype(np.uint32)
    least = np.full(HALVES * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[None, at:at + 2048] * _A + _B).min(axis=1), out=least)
    keys = _KEY.copy()
    for column in least.reshape(HALVES, ROWS).T:
        keys = H.mix(keys ^ column.astype(H.U64))
    return keys.view(np.int64)


def _set_key(items: np.ndarray) -> bytes:
    import hashlib
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _signer(n_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            size, key, halves = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_set(text, n_words)
                size.append(len(items))
                key.append(_set_key(items) if len(items) else None)
                halves.append(half_keys(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row_key"), pa.array(size, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(halves, pa.list_(pa.int64()))], names=["id", "row_key", "size", "set_key", "halves"])
    return run


def _fetcher(n_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            node, blob = [], []
            for n, key, text in zip(*(batch.column(c).to_pylist() for c in ("node", "set_key", "text")), strict=True):
                items = shingle_set(text, n_words)
                if len(items) and _set_key(items) == key:
                    node.append(n)
                    blob.append(items.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], names=["node", "items"])
    return run


def _verifier(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                x, y = np.frombuffer(x, H.U64), np.frombuffer(y, H.U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT,
                    row_key: Column | None = None) -> DataFrame:
    """(id, row_key, size, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id of the rows joined by links of
    ``100 * |A & B| >= percent * |A | B|``; ``row_key`` is a binary column of the caller's, if any.
    """
    key = F.lit(None).cast("binary") if row_key is None else row_key
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("row_key"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = written(rows.mapInArrow(
        _signer(n_words), f"id {id_type}, row_key binary, size bigint, set_key binary, halves array<bigint>"), "minhash-sets")
    nodes = (signed.where("size > 0").groupBy("set_key")
             .agg(F.min("id").alias("id"), F.max("size").alias("size"), F.min("halves").alias("halves"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = written(nodes, "minhash-nodes")       # written once: the node numbers stay what they are

    tables = _tables(nodes)
    leaders = written(_leaders(tables), "minhash-leaders")
    sets = _sets(leaders.select(F.col("a").alias("node")).unionByName(leaders.select(F.col("b").alias("node"))).distinct(),
                 rows, nodes, n_words)
    sizes = nodes.select("node", "size")

    done = written(_sized(leaders.groupBy("a").agg(F.min("b").alias("b")), sizes, percent), "minhash-pairs")
    comps = written(components(_checked(done, sets, percent)), "minhash-components")
    crowd = _mixed(_with_component(tables, comps, "node", "c")).select("node").distinct()
    bounds = _bounds(written(crowd, "minhash-crowd"), sets, sizes)
    halves = bounds.select("node").join(nodes, "node").select("node", F.explode("halves").alias("table"))
    for candidates in (lambda c: _across(leaders, c, bounds, percent), lambda c: _all_across(halves, c, bounds, percent)):
        pairs = written(candidates(comps).join(done, ["a", "b"], "left_anti"), "minhash-pairs")
        if pairs.isEmpty():
            continue
        done = done.unionByName(pairs)
        links = _checked(pairs, sets, percent)
        if not links.isEmpty():
            comps = written(joined(comps, links), "minhash-components")
    return _labelled(signed, nodes, comps)


def _tables(nodes: DataFrame) -> DataFrame:
    """(table, node): every pair of half keys that are not a node's alone is a table key."""
    halves = nodes.select("node", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    kept = halves.join(shared, "half").groupBy("node").agg(F.sort_array(F.collect_list("half")).alias("ks")).where("size(ks) > 1")
    return written(
        kept.select("node", "ks", F.explode("ks").alias("x")).select("node", "x", F.explode("ks").alias("y"))
        .where("x < y").select(F.xxhash64("x", "y").alias("table"), "node"), "minhash-tables")


def _leaders(tables: DataFrame) -> DataFrame:
    """Distinct (a, b): ``b`` is the smallest node of a table of ``a``."""
    least = tables.groupBy("table").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return tables.join(least, "table").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Keep the pairs whose sizes allow the similarity (exact: |A & B| <= the smaller size)."""
    out = (pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a")
           .join(sizes.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b"))
    return out.where(f"100 * least(sa, sb) >= {percent} * greatest(sa, sb)").select("a", "b")


def _with_component(df: DataFrame, comps: DataFrame, node: str, into: str) -> DataFrame:
    side = comps.select(F.col("node").alias(node), F.col("component").alias(into))
    return df.join(side, node, "left").withColumn(into, F.coalesce(into, node))


def _mixed(own: DataFrame) -> DataFrame:
    """The rows (table, node, c) of tables whose members lie in several components."""
    mixed = own.groupBy("table").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("table")
    return own.join(mixed, "table")


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "items"):
        items = [np.frombuffer(x, np.int64) for x in batch.column("items").to_pylist()]
        node = np.repeat(np.array(batch.column("node").to_pylist(), np.int64), [len(x) for x in items])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), pa.array(node)], names=["item", "node"])


def _sketcher(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "items"):
        common, words = [], []
        for items, lone in zip(batch.column("items").to_pylist(), batch.column("lone").to_pylist(), strict=True):
            own = np.frombuffer(items, H.U64)
            if lone:
                own = np.setdiff1d(own, np.array(lone, np.int64).view(H.U64), assume_unique=True)
            bits = np.zeros(64 * WORDS, np.uint8)
            bits[((own >> H.U64(20)) % H.U64(64 * WORDS)).astype(np.int64)] = 1
            common.append(len(own))
            words.append(np.packbits(bits).view(np.int64))
        words = np.array(words, np.int64).reshape(-1, WORDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("size"), pa.array(common, pa.int64()), *[pa.array(w) for w in words.T]],
            names=["node", "size", "common", *[f"w{k}" for k in range(WORDS)]])


def _bounds(crowd: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, size, common, w0...): what a node of the crowd can share with others of it, at most.

    ``common`` counts its shingles that some other node has too; the words are a bitmap of these. A bit of one
    bitmap that another lacks is a shingle that both can't share, so the two bound a similarity exactly.
    """
    own = sets.join(crowd, "node")
    lone = (own.mapInArrow(_spread, "item bigint, node bigint")
            .groupBy("item").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
            .groupBy("node").agg(F.collect_list("item").alias("lone")))
    rows = own.join(sizes, "node").join(lone, "node", "left").select("node", "size", "items", "lone")
    return written(rows.mapInArrow(_sketcher, "node bigint, size bigint, common bigint, "
                                   + ", ".join(f"w{k} bigint" for k in range(WORDS))), "minhash-bounds")


def _possible(percent: int) -> str:
    """Whether nodes a and b, with their bounds, can reach the similarity."""
    def most(x: str, y: str) -> str:
        lacking = " + ".join(f"bit_count(w{k}{x} & ~w{k}{y})" for k in range(WORDS))
        return f"e{x} - ({lacking})"

    quick, close = (f"100 * {m} >= {percent} * (sa + sb - {m})" for m in
                    ("least(ea, eb)", f"least({most('a', 'b')}, {most('b', 'a')})"))
    return f"{quick} and {close}"


def _side(bounds: DataFrame, x: str, *more: str) -> DataFrame:
    return bounds.select(*more, F.col("node").alias(x), F.col("size").alias("s" + x), F.col("common").alias("e" + x),
                         *[F.col(f"w{k}").alias(f"w{k}{x}") for k in range(WORDS)])


def _across(leaders: DataFrame, comps: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """Pairs with a table's smallest node in another component, where the bounds allow the similarity."""
    both = _with_component(_with_component(leaders, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").drop("ca", "cb")
    left, right = both.join(_side(bounds, "a"), "a"), _side(bounds, "b")
    return (left.withColumnRenamed("b", "other").join(right, F.expr(f"other = b and {_possible(percent)}"))
            .select("a", "b"))


def _all_across(halves: DataFrame, comps: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """Pairs with a common half key whose components differ, where the bounds allow the similarity.

    That covers every table. Nodes that no member of their group can reach go first, and with
    them the groups that lie in one component, so a large group of far copies doesn't pair up.
    """
    own = _mixed(_with_component(halves.join(bounds.select("node", "size", "common"), "node"), comps, "node", "c"))
    least = own.groupBy("table").agg(F.min("size").alias("least"))
    near = own.join(least, "table").where(
        f"100 * common >= {percent} * (size + greatest(least, common) - common)").select("table", "node", "c")
    own = written(_mixed(near).join(bounds, "node"), "minhash-mixed")
    left, right = (_side(own.withColumnsRenamed({"table": "t" + x, "c": "c" + x}), x, "t" + x, "c" + x) for x in ("a", "b"))
    return left.join(right, F.expr(f"ta = tb and a > b and ca <> cb and {_possible(percent)}")).select("a", "b").distinct()


def _sets(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, n_words: int) -> DataFrame:
    """(node, items): the full shingle sets of the wanted nodes."""
    wanted = wanted.join(nodes.select("node", "id", "set_key"), "node")
    texts = (rows.withColumnRenamed("id", "row_id").join(wanted, F.col("row_id").eqNullSafe(F.col("id")))
             .select("node", "set_key", "text"))
    return written(texts.mapInArrow(_fetcher(n_words), "node bigint, items binary").dropDuplicates(["node"]), "minhash-items")


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("left")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("items").alias("right")), "b"))
    return written(joined.mapInArrow(_verifier(percent), "a bigint, b bigint"), "minhash-links")


def _labelled(signed: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    own = _with_component(nodes.select("node", "set_key", "id"), comps, "node", "c")
    least = own.groupBy("c").agg(F.min("id").alias("component_id"))
    label = own.join(least, "c").select(F.col("set_key").alias("key"), "component_id")
    out = signed.select("id", "row_key", "size", "set_key").join(label, F.col("set_key") == F.col("key"), "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "row_key", "size", component.alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               n_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One document of each group, that with the smallest id; the columns of ``docs``.

    Rows with the same id and text are one document. Where rows of the smallest id have different
    texts in one group, that with the smallest key stays. Empty texts stay.
    """
    name = fresh(docs, "row_key")
    key = row_key_of(id_col, text_col)
    found = near_duplicates(docs, id_col, text_col, n_words, percent, key)
    own = F.when(F.col("size") > 0, F.lit(None)).otherwise(F.col("row_key"))
    firsts = (found.where(F.col("id").eqNullSafe(F.col("component_id")))
              .groupBy("component_id", own.alias("own")).agg(F.min("row_key").alias(name)).select(name))
    firsts = written(firsts, "minhash-kept")
    return docs.withColumn(name, key).join(firsts, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
