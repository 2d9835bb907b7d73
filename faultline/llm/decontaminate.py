"""Operator 1: benchmark decontamination over a positional inverted index.

``build_index`` stores the training tokens' postings: each row of the index is a
segment of some documents with its term dictionary, the postings of each
term (delta-coded word positions) and the documents' ids and lengths. Partitioning by
document keeps the postings of very common words spread over all segments.

``search`` takes the test items in blocks of bounded size, each broadcast, and reads the
index once a block. For a window of an item it intersects offset-adjusted postings
from the window's rarest term up, and stops when no position is left; a window
with a term that the segment lacks costs nothing. With ``slop`` 0 the matches are exact
phrases; with ``slop`` k they are proximity matches: every word of the window occurs
within k words of its place.

Defined cases: null and empty texts have no words, match nothing and are kept; an item without
words is no item; an item shorter than a window is one window; items with a null id hit words but are
not listed; repeated items count once an id; repeated documents are searched each; empty tables
give no matches; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hashing as H
from .common import fresh, row_key_of, slices, text_bytes, written

WINDOW_WORDS = 13
HIT_SHARE = 20                  # contaminated: HIT_SHARE * hit words >= words
BLOCK_BYTES = 8 << 20           # item text in one broadcast

#: lower-cases A-Z and blanks the ASCII bytes that are neither letters nor digits
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, in UTF-8."""
    return H.utf8(text).translate(_FOLD).split()


def _indexer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        tokens: list[bytes] = []
        lengths = []
        for text in batch.column("text").to_pylist():
            own = item_words(text)
            tokens += own
            lengths.append(len(own))
        n_words = np.array(lengths, np.int64)
        first = np.concatenate(([0], np.cumsum(n_words + 1)[:-1]))      # a gap after each document
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        positions = np.arange(len(tokens), dtype=np.int64) + np.repeat(np.arange(len(n_words)), n_words)
        ordered = np.sort((codes << 40) | positions)
        counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.uint32)
        postings = ordered & ((1 << 40) - 1)
        starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[:-1]
        deltas = np.diff(postings, prepend=0)
        if len(starts):
            deltas[starts] = postings[starts]
        yield pa.RecordBatch.from_arrays([
            pa.array([batch.column("id").to_pylist()], pa.list_(batch.column("id").type)),
            pa.array([batch.column("row_key").to_pylist()], pa.list_(pa.binary())),
            pa.array([n_words], pa.list_(pa.int64())), pa.array([first], pa.list_(pa.int64())),
            pa.array([b" ".join(coded.dictionary.to_pylist())], pa.binary()),
            pa.array([counts.tobytes()], pa.binary()), pa.array([deltas.astype(np.uint32).tobytes()], pa.binary()),
        ], names=["ids", "row_keys", "n_words", "first", "terms", "counts", "postings"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: Column | None = None) -> DataFrame:
    """The positional index of ``docs``, written to the shared folder: one row a segment."""
    key = F.lit(None).cast("binary") if row_key is None else row_key
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("row_key"))
    kind = rows.schema["id"].dataType.simpleString()
    segments = rows.mapInArrow(_indexer, f"ids array<{kind}>, row_keys array<binary>, n_words array<bigint>, "
                                         "first array<bigint>, terms binary, counts binary, postings binary")
    return written(segments.withColumn("segment", F.monotonically_increasing_id()), "postings")


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, ord, id, row_key, n_words): the documents that the index holds."""
    zipped = F.explode(F.arrays_zip("ids", "row_keys", "n_words", F.expr("sequence(0, size(ids) - 1)").alias("ord")))
    return index.where("size(ids) > 0").select("segment", zipped.alias("d")).select(
        "segment", F.col("d.ord").alias("ord"), F.col("d.ids").alias("id"), F.col("d.row_keys").alias("row_key"),
        F.col("d.n_words").alias("n_words"))


class Block:
    """Some test items: their words as numbers of the block's own vocabulary, and their windows."""

    def __init__(self, items: list[tuple], window: int, id_type: pa.DataType):
        self.id_type = id_type
        self.vocab: dict[bytes, int] = {}
        self.ids, self.at, self.windows, numbers = [], [], [], []
        for item_id, text in items:
            words = item_words(text)
            if not words:
                continue
            start, width = len(numbers), min(window, len(words))
            numbers += [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            self.windows += [(len(self.ids), k, width) for k in range(len(words) - width + 1)]
            self.ids.append(item_id)
            self.at.append(start)
        self.words = np.array(numbers, np.int64)
        self.windows = np.array(self.windows, np.int64).reshape(-1, 3)


def _near(sorted_positions: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which ``wanted`` positions have a posting within ``slop`` words."""
    at = np.searchsorted(sorted_positions, wanted - slop)
    found = sorted_positions[np.minimum(at, len(sorted_positions) - 1)]
    return (found >= wanted - slop) & (found <= wanted + slop)


def _window_starts(numbers: np.ndarray, counts: np.ndarray, postings, slop: int) -> np.ndarray:
    """Positions where a window's words stand, from its rarest term up."""
    order = np.argsort(counts[numbers], kind="stable")
    starts = postings(numbers[order[0]]) - order[0]
    if slop:
        starts = np.unique((starts[:, None] + np.arange(-slop, slop + 1)).ravel())
    for offset in order[1:]:
        if not len(starts):
            break
        starts = starts[_near(postings(numbers[offset]), starts + offset, slop)]
    return starts


def _runs(item: np.ndarray, k: np.ndarray, at: np.ndarray, width: np.ndarray):
    """Join the windows that follow each other in item and text alike: (item, k, at, length)."""
    order = np.lexsort((at, at - k, item))
    item, k, at, width = item[order], k[order], at[order], width[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | ((at - k)[1:] != (at - k)[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return item[first], k[first], at[first], at[last] - at[first] + width[last]


def _searcher(broadcast, slop: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = broadcast.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment, first, terms, counts, deltas = (batch.column(c)[row].as_py() for c in
                                                         ("segment", "first", "terms", "counts", "postings"))
                found = _search_segment(block, np.array(first, np.int64), terms.split(b" ") if terms else [],
                                        np.frombuffer(counts, np.uint32), np.frombuffer(deltas, np.uint32), slop)
                if found is None:
                    continue
                ords, item, k, at, length = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * len(ords), pa.int64()), pa.array(ords, pa.int32()),
                     pa.array([block.ids[i] for i in item], block.id_type), pa.array(k, pa.int64()),
                     pa.array(at, pa.int64()), pa.array(length, pa.int64())],
                    names=["segment", "ord", "item_id", "item_at", "doc_at", "length"])
    return run


def _search_segment(block: Block, first: np.ndarray, terms: list[bytes], counts: np.ndarray, deltas: np.ndarray, slop: int):
    place = np.full(len(block.vocab), -1, np.int64)
    for n, term in enumerate(terms):
        number = block.vocab.get(term)
        if number is not None:
            place[number] = n
    here = np.where(place >= 0, counts[place] if len(counts) else 0, 0).astype(np.int64)
    missing = np.concatenate(([0], np.cumsum(here[block.words] == 0)))
    if not len(block.windows):
        return None
    at = np.array(block.at, np.int64)[block.windows[:, 0]] + block.windows[:, 1]
    possible = np.flatnonzero(missing[at + block.windows[:, 2]] == missing[at])
    starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    decoded: dict[int, np.ndarray] = {}

    def postings(number: int) -> np.ndarray:
        if number not in decoded:
            n = place[number]
            decoded[number] = np.cumsum(deltas[starts[n]:starts[n + 1]], dtype=np.int64)
        return decoded[number]

    parts = []
    for w in possible:
        item, k, width = block.windows[w]
        hits = _window_starts(block.words[at[w]:at[w] + width], here, postings, slop)
        if slop:        # a place near a document's start may lie before it
            hits = hits[(hits >= 0) & (np.searchsorted(first, hits, "right") == np.searchsorted(first, hits + width - 1, "right"))] if len(hits) else hits
        if len(hits):
            parts.append((np.full(len(hits), item), np.full(len(hits), k), hits, np.full(len(hits), width)))
    if not parts:
        return None
    item, k, hit, length = _runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    ords = np.searchsorted(first, hit, "right") - 1
    return ords, item, k, hit - first[ords], length


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW_WORDS, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(segment, ord, item_id, item_at, doc_at, length): runs of matching windows, in words."""
    spark = index.sparkSession
    asked = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    kind = asked.schema["id"].dataType
    blocks = max(1, math.ceil(text_bytes(asked) / block_bytes))
    out = None
    for b in range(blocks):      # a pass over the index for each block of items
        own = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        block = Block([tuple(r) for r in own], window, to_arrow_type(kind))
        found = index.select("segment", "first", "terms", "counts", "postings").mapInArrow(
            _searcher(spark.sparkContext.broadcast(block), slop),
            f"segment bigint, ord int, item_id {kind.simpleString()}, item_at bigint, doc_at bigint, length bigint")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(index: DataFrame, matches: DataFrame, share: int = HIT_SHARE) -> DataFrame:
    """(id, row_key, n_words, n_hit, items, contaminated): one row a document of the index.

    ``items`` are the ids, as sorted strings, of the items with matches.
    """
    ends = matches.withColumn("end", F.col("doc_at") + F.col("length"))
    seen = F.expr("max(end) over (partition by segment, ord order by doc_at, end "
                  "rows between unbounded preceding and 1 preceding)")
    fresh_words = F.greatest(F.lit(0), F.col("end") - F.greatest("doc_at", F.coalesce("seen", F.lit(0))))
    per_doc = (ends.withColumn("seen", seen).withColumn("add", fresh_words).groupBy("segment", "ord")
               .agg(F.sum("add").alias("n_hit"),
                    F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    out = documents_of(index).join(per_doc, ["segment", "ord"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("id", "row_key", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = fresh(docs, "row_key")
    index = build_index(docs, id_col, text_col, row_key_of(id_col, text_col))
    found = contamination(index, search(index, items, item_id_col, item_text_col))
    dirty = written(found.where("contaminated").select(F.col("row_key").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, row_key_of(id_col, text_col)).join(dirty, name, "left_anti").select(*docs.columns)
