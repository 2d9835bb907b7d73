"""Passages that repeat across documents: the shared frame of operators 2 and 3.

A window is ``window`` units (words or bytes) of one document. Every window has an owner, the
smallest-hashed of its ``gram``-unit runs, which depends on the window's content alone,
so equal windows have equal owners wherever they stand. The frame

1. deals the documents out in segments and gathers the hashes of the owners, packed, a
   few bytes each and once a segment, to find owners that two documents share;
2. cuts a piece around each shared owner (the windows that it owns) and gathers the pieces' hashes by
   owner, so that copies of a piece become one piece with its first document. An owner that very
   many documents share is split: each of its windows is a piece of its own, gathered by its content,
   so no group grows with the corpus;
3. lets one segment of each distinct piece send its text to the owner's shard, where the
   operator finds the first document of every window by comparing the pieces. An owner
   with one distinct piece is a shard of one: all its windows have the piece's first document;
4. sends the first documents back to the segments, where each document drops the units that are covered by a
   window whose first document comes before it.

Documents are compared by an integer id; a null id comes after all others. Copies of pieces are told by
64-bit hashes of their content, distinct pieces are compared by the operators unit by unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import text_bytes

SEGMENT_BYTES = 4 << 20
PART_BYTES = 64 << 20
_GAP = b"\xff"                  # no UTF-8 text has this byte
LAST = np.iinfo(np.int64).max           # the place of null ids
_POS = H.U64((1 << 28) - 1)


@dataclass(frozen=True)
class Frame:
    """What a window is made of, and the sizes of the parts."""

    words: bool                 # units are words, else bytes
    window: int
    gram: int
    hot: int                    # documents that may share an owner before its windows travel singly
    segments: int = 1
    buckets: int = 1
    shards: int = 1


def _owners(codes: np.ndarray, frame: Frame):
    """(sums, first window, end of windows, owner hash) of each run of windows with one owner."""
    n = len(codes)
    m = n - frame.window + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return None, none, none, np.zeros(0, H.U64)
    sums = H.prefix(codes)
    if n <= int(_POS):
        return (sums, *_owned(sums, 0, m, frame))
    step = int(_POS) - frame.window         # longer texts: the same, in runs of windows
    parts = [_owned(sums, at, min(m, at + step), frame) for at in range(0, m, step)]
    return (sums, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _owned(sums: np.ndarray, lo: int, hi: int, frame: Frame):
    m, w, g = hi - lo, frame.window - frame.gram + 1, frame.gram
    count = m + w - 1
    hashes = H.mix((sums[lo + g:lo + g + count] - sums[lo:lo + count]) * H._powers(lo + count)[1][lo:])
    least = (hashes & ~_POS) | np.arange(count, dtype=H.U64)
    k = 1
    while 2 * k <= w:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    owner = (np.minimum(least[:m], least[w - k:w - k + m]) & _POS).astype(np.int64)
    edge = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    first = np.concatenate(([0], edge))
    end = np.concatenate((edge, [m]))
    return lo + first, lo + end, H.mix(hashes[owner[first]] + H.U64(7))


def _codes(raw: bytes, frame: Frame) -> np.ndarray:
    return H.word_codes(raw) if frame.words else H.byte_codes(raw)


def _texts(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    for i, text in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True):
        yield LAST if i is None else i, H.utf8(text)


def _split(owner: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name (within its bucket) of owner hashes."""
    return ((owner >> H.U64(32)) % H.U64(frame.buckets)).astype(np.int64), (owner & H.U64(0xFFFFFFFF)).astype(np.uint32)


def _name(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (np.asarray(bucket).astype(H.U64) << H.U64(32)) | np.asarray(low).astype(H.U64)


def _gather(frame: Frame):
    """Segment -> one row a bucket: the segment's owners and how many of its documents have each."""
    def run(table: pa.Table) -> pa.Table:
        found = [np.unique(o) for _, raw in _texts(table) if len(o := _owners(_codes(raw, frame), frame)[3])]
        names, n = np.unique(np.concatenate(found) if found else np.zeros(0, H.U64), return_counts=True)
        bucket, low = _split(names, frame)
        order = np.argsort(bucket, kind="stable")
        bucket, low, n = bucket[order], low[order], np.minimum(n[order], 65535).astype(np.uint16)
        at = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1)) if len(bucket) else []
        ends = np.append(at[1:], len(bucket)).astype(np.int64) if len(bucket) else []
        segment = table.column("segment")[0].as_py()
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a in at], pa.int64()), "segment": pa.array([segment] * len(at), pa.int64()),
            "low": pa.array([low[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
            "n": pa.array([n[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})
    return run


def _shared(frame: Frame):
    """Bucket -> for each segment, its owners that other documents have too, and which are hot."""
    def run(table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        low = np.concatenate(lows)
        n = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("n").to_pylist()])
        _, back = np.unique(low, return_inverse=True)
        total = np.bincount(back, weights=n)[back]
        out = {"segment": [], "bucket": [], "low": [], "hot": []}
        at = 0
        for segment, own in zip(table.column("segment").to_pylist(), lows, strict=True):
            t = total[at:at + len(own)]
            at += len(own)
            if (t > 1).any():
                out["segment"].append(segment)
                out["bucket"].append(table.column("bucket")[0].as_py())
                out["low"].append(own[t > 1].tobytes())
                out["hot"].append((t[t > 1] > frame.hot).tobytes())
        return pa.table({"segment": pa.array(out["segment"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int64()),
                         "low": pa.array(out["low"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})
    return run


def _windows(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some owners: their starts, and the index of the owner."""
    n = end - first
    which = np.repeat(np.arange(len(first)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[which], which


def _pieces(docs: pa.Table, names: np.ndarray, hot: np.ndarray, frame: Frame):
    """The pieces around the owners in ``names`` (sorted): (piece, id, owner, single, document, start, end), and the texts."""
    rows, raws = [], []
    for i, raw in _texts(docs) if len(names) else ():
        sums, first, end, owner = _owners(_codes(raw, frame), frame)
        if not len(first):
            continue
        own = _name(*_split(owner, frame))
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        found = names[at] == own
        if not found.any():
            continue
        single = found & hot[at]
        whole = found & ~single
        s, which = _windows(first[single], end[single])
        start = np.concatenate((first[whole], s))
        stop = np.concatenate((end[whole] - 1 + frame.window, s + frame.window))
        rows.append((H.spans(sums, start, stop), np.full(len(start), i), np.concatenate((own[whole], own[single][which])),
                     np.arange(len(start)) >= whole.sum(), np.full(len(start), len(raws)), start, stop))
        raws.append(raw)
    return [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else None, raws


def _known(shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of a segment's shared owners, and which of them are hot."""
    if not shared.num_rows:
        return np.zeros(0, H.U64), np.zeros(0, bool)
    parts = [(_name(np.full(len(x) // 4, b), np.frombuffer(x, np.uint32)), np.frombuffer(h, bool)) for b, x, h in
             zip(*(shared.column(c).to_pylist() for c in ("bucket", "low", "hot")), strict=True)]
    names, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(names)
    return names[order], hot[order]


def _binary(columns: dict[str, list], **numbers: list) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int64()) for k, v in numbers.items()} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})


def _parts(key: np.ndarray):
    """(value, slice) of each run of a sorted array."""
    if len(key):
        at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(key)]):
            yield int(key[a]), slice(a, b)


def _cards(frame: Frame):
    """Segment and its shared owners -> a packed row a bucket: the segment's distinct pieces, with smallest and largest id."""
    def run(key, docs: pa.Table, shared: pa.Table) -> pa.Table:
        rows, _ = _pieces(docs, *_known(shared), frame)
        out = {k: [] for k in ("group", "piece", "lo", "over", "single")}
        buckets = []
        if rows:
            piece, ids, own, single, *_ = rows
            order = np.lexsort((ids, single, piece))
            piece, ids, own, single = (x[order] for x in (piece, ids, own, single))
            at = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (single[1:] != single[:-1]))))
            lo, hi = ids[at], ids[np.append(at[1:], len(piece)) - 1]
            piece, own, single = piece[at], own[at], single[at]
            bucket = np.where(single, (piece >> H.U64(32)) % H.U64(frame.buckets), own >> H.U64(32)).astype(np.int64)
            order = np.lexsort((own, bucket))
            packed = {"group": own, "piece": piece, "lo": lo, "over": hi - lo, "single": single}
            packed = {k: v[order] for k, v in packed.items()}
            for b, part in _parts(bucket[order]):
                buckets.append(b)
                for k, v in packed.items():
                    out[k].append(v[part].tobytes())
        return _binary(out, bucket=buckets, segment=[key[0].as_py()] * len(buckets))
    return run


def _meet(frame: Frame):
    """Bucket -> for each segment, the first documents of pieces that are alone with their owner, and the pieces to send.

    A piece to send names all segments that have it, with their largest ids.
    """
    def run(table: pa.Table) -> pa.Table:
        kinds = {"group": H.U64, "piece": H.U64, "lo": np.int64, "over": np.int64, "single": bool}
        group, piece, lo, over, single = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in kinds.items())
        n = [len(x) for x in table.column("single").to_pylist()]
        segment = np.repeat(table.column("segment").to_numpy(), n)
        hi = lo + over
        order = np.lexsort((lo, piece, group, single))
        group, piece, lo, hi, single, segment = (x[order] for x in (group, piece, lo, hi, single, segment))
        new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (group[1:] != group[:-1]) | (single[1:] != single[:-1])))
        at = np.flatnonzero(new)
        which = np.cumsum(new) - 1                              # the distinct piece of each row
        owner = np.concatenate(([True], (group[at][1:] != group[at][:-1]) | (single[at][1:] != single[at][:-1])))
        count = np.bincount(np.cumsum(owner) - 1)[np.cumsum(owner) - 1]     # distinct pieces of each one's owner
        alone = (count == 1) | single[at]
        out = {k: [] for k in ("piece", "owner", "single", "runs", "segs")}
        segments = []
        tell = np.flatnonzero(alone[which] & (lo[at][which] < hi))
        tell = tell[np.argsort(segment[tell], kind="stable")]
        for s, part in _parts(segment[tell]):
            own = tell[part]
            first = lo[at][which[own]]
            segments.append(s)
            for k, v in zip(out, (piece[own], group[own], single[own], np.stack((np.zeros_like(first), np.zeros_like(first), first), 1))):
                out[k].append(v.tobytes())
            out["segs"].append(None)
        ends = np.append(at[1:], len(piece))
        ask = np.flatnonzero(~alone)
        ask = ask[np.argsort(segment[at[ask]], kind="stable")]  # the segment of the first document sends
        for s, part in _parts(segment[at[ask]]):
            own = ask[part]
            rows, of = _windows(at[own], ends[own])
            segments.append(s)
            for k, v in zip(out, (piece[at[own]], group[at[own]], single[at[own]], lo[at[own]],
                                  np.stack((of, segment[rows], hi[rows]), 1))):
                out[k].append(v.astype(np.int64).tobytes() if k in ("runs", "segs") else v.tobytes())
        return _binary(out, segment=segments)
    return run


def _send(frame: Frame):
    """Segment and the pieces that are asked of it -> a packed row a shard: their texts, for the owners' shards."""
    def run(key, docs: pa.Table, met: pa.Table) -> pa.Table:
        out = {k: [] for k in ("piece", "owner", "first", "holders", "segs", "bodies")}
        shards = []
        if met.num_rows:
            piece, owner = (np.concatenate([np.frombuffer(x, H.U64) for x in met.column(c).to_pylist()]) for c in ("piece", "owner"))
            first = np.concatenate([np.frombuffer(x, np.int64) for x in met.column("runs").to_pylist()])
            holders = []
            for x in met.column("segs").to_pylist():
                part = np.frombuffer(x, np.int64).reshape(-1, 3)
                holders += np.split(part[:, 1:], np.flatnonzero(np.diff(part[:, 0])) + 1)
            names = np.unique(owner)
            rows, raws = _pieces(docs, names, np.zeros(len(names), bool), frame)
            found, _, _, _, doc, start, stop = rows
            order = np.argsort(found, kind="stable")
            at = order[np.searchsorted(found[order], piece)]
            cut: dict[int, list[bytes]] = {}
            bodies = []
            for d, s, e in zip(doc[at].tolist(), start[at].tolist(), stop[at].tolist(), strict=True):
                if frame.words and d not in cut:
                    cut[d] = H.words(raws[d])
                bodies.append(b" ".join(cut[d][s:e]) if frame.words else raws[d][s:e])
            shard = (H.mix(owner + H.U64(3)) % H.U64(frame.shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            count = np.array([len(x) for x in holders])
            for value, part in _parts(shard[order]):
                own = order[part]
                shards.append(value)
                for k, v in (("piece", piece), ("owner", owner), ("first", first), ("holders", count)):
                    out[k].append(v[own].tobytes())
                out["segs"].append(np.concatenate([holders[k] for k in own]).tobytes())
                out["bodies"].append(_GAP.join([bodies[k] for k in own]))
        return _binary(out, shard=shards)
    return run


#: Finds, for distinct pieces and their first documents, the first document of each window: (all windows' in a row, windows of each piece).
Solver = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]


def _solve(solver: Solver):
    """Shard -> a packed row for each segment that has pieces of it: runs of windows with a first document before the segment's last."""
    def run(table: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])

        bodies = [x for blob in table.column("bodies").to_pylist() for x in blob.split(_GAP)]
        piece, owner, holders = column("piece", H.U64), column("owner", H.U64), column("holders", np.int64)
        segs = column("segs", np.int64).reshape(-1, 2)
        first, n = solver(bodies, column("first", np.int64))
        own = np.repeat(np.arange(len(n)), n)                       # the piece of each window
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (own[1:] != own[:-1])))
        at = np.flatnonzero(new)
        begin = np.cumsum(n) - n
        runs = np.stack((at, np.append(at[1:], len(first)), first[at]), axis=1).astype(np.int64)
        runs[:, :2] -= begin[own[at]][:, None]
        per = np.bincount(own[at], minlength=len(n))                # runs of each piece
        of = np.repeat(np.arange(len(n)), holders)                  # the piece of each holder
        to = np.cumsum(per)
        which, holder = _windows((to - per)[of], to[of])            # each holder with each run of its piece
        keep = runs[which, 2] < segs[holder, 1]
        which, holder = which[keep], holder[keep]
        order = np.argsort(segs[holder, 0], kind="stable")
        which, holder = which[order], holder[order]
        out = {k: [] for k in ("piece", "owner", "single", "runs", "segs")}
        segments = []
        for segment, part in _parts(segs[holder, 0]):
            p = of[holder[part]]
            segments.append(segment)
            for k, v in zip(out, (piece[p].tobytes(), owner[p].tobytes(), bytes(len(p)), runs[which[part]].tobytes(), None)):
                out[k].append(v)
        return _binary(out, segment=segments)
    return run


def _mark(cover: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)


def _drop(frame: Frame):
    """Segment and its pieces' runs -> each document's removed spans and what is kept."""
    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        piece, owner, single, runs = (np.concatenate([np.zeros(0, t), *[np.frombuffer(x, t) for x in found.column(c).to_pylist()]])
                                      for c, t in (("piece", H.U64), ("owner", H.U64), ("single", bool), ("runs", np.int64)))
        runs = runs.reshape(-1, 3)
        wholes, singles = _table(piece, runs, ~single), _table(piece, runs, single)
        hot = np.unique(owner[single])
        size, removed, spans, kept = [], [], [], []
        for i, raw in _texts(docs):
            codes = _codes(raw, frame)
            sums, first, end, names = _owners(codes, frame) if len(piece) else (None, [], [], [])
            cover = np.zeros(len(codes) + 1, np.int64)
            if len(first):
                _look(cover, wholes, H.spans(sums, first, end - 1 + frame.window), first, end, i, frame)
                if len(hot):
                    own = _name(*_split(names, frame))
                    at = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
                    s, _ = _windows(first[at], end[at])
                    _look(cover, singles, H.spans(sums, s, s + frame.window), s, s + 1, i, frame)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            size.append(len(codes))
            removed.append(int(gone.sum()))
            spans.append([{"start": a, "end": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())])
            kept.append(_kept(raw, gone, edge, frame))
        return pa.table({"id": docs.column("id"), "size": pa.array(size, pa.int64()), "removed": pa.array(removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         "kept": pa.array(kept, pa.binary())})
    return run


def _table(piece: np.ndarray, runs: np.ndarray, own: np.ndarray):
    """Sorted piece hashes with their runs, one or more each."""
    at = np.flatnonzero(own)
    at = at[np.argsort(piece[at], kind="stable")]
    return piece[at], runs[at]


def _look(cover: np.ndarray, table, piece: np.ndarray, first: np.ndarray, end: np.ndarray, i: int, frame: Frame) -> None:
    names, runs = table
    if not len(names):
        return
    lo = np.searchsorted(names, piece)
    hit = np.flatnonzero(names[np.minimum(lo, len(names) - 1)] == piece)
    if not len(hit):
        return
    k, which = _windows(lo[hit], np.searchsorted(names, piece[hit], "right"))
    base, stop, own = first[hit][which], end[hit][which], runs[k]
    stop = np.where(own[:, 1] > 0, base + own[:, 1], stop)      # an open run goes over the whole piece
    before = own[:, 2] < i
    _mark(cover, (base + own[:, 0])[before], stop[before] - 1 + frame.window)


def _kept(raw: bytes, gone: np.ndarray, edge: np.ndarray, frame: Frame) -> bytes:
    if frame.words:
        own = H.words(raw)
        return b" ".join(own if not len(edge) else [w for w, g in zip(own, gone.tolist(), strict=True) if not g])
    return raw if not len(edge) else np.frombuffer(raw, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, frame: Frame, solver: Solver, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = 1 << 20) -> DataFrame:
    """(id, size, removed, spans, kept): one row a row of ``docs``; ``kept`` in UTF-8."""
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    frame = Frame(frame.words, frame.window, frame.gram, frame.hot, max(1, math.ceil(total / SEGMENT_BYTES)),
                  parts, max(parts, math.ceil(total / shard_bytes)))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(frame.segments)).alias("segment"))
    rows = rows.repartition(parts, "segment")           # one shuffle of the texts; the three passes below reuse it
    owners = rows.groupBy("segment").applyInArrow(_gather(frame), "bucket bigint, segment bigint, low binary, n binary")
    shared = owners.groupBy("bucket").applyInArrow(_shared(frame), "segment bigint, bucket bigint, low binary, hot binary")
    cards = rows.groupBy("segment").cogroup(shared.repartition(parts, "segment").groupBy("segment")).applyInArrow(
        _cards(frame), "bucket bigint, segment bigint, group binary, piece binary, lo binary, over binary, single binary")
    answer = "segment bigint, piece binary, owner binary, single binary, runs binary, segs binary"
    met = cards.groupBy("bucket").applyInArrow(_meet(frame), answer)
    sent = rows.groupBy("segment").cogroup(met.where("segs is not null").repartition(parts, "segment").groupBy("segment")).applyInArrow(
        _send(frame), "shard bigint, piece binary, owner binary, first binary, holders binary, segs binary, bodies binary")
    runs = sent.groupBy("shard").applyInArrow(_solve(solver), answer)
    told = met.where("segs is null").unionByName(runs)
    return rows.groupBy("segment").cogroup(told.repartition(parts, "segment").groupBy("segment")).applyInArrow(
        _drop(frame), "id bigint, size bigint, removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
