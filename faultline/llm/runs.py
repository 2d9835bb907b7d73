"""Operator 11: periodic runs of words, by the branching-tandem test on an enhanced suffix array.

Many texts share one suffix array: the first symbol of a suffix is (text, word), so no suffix of one text ever
ties with one of another, and an end mark closes each text. The enhanced array is the suffix array,
its inverse and the common prefixes of neighbours; no tree node is made:

1. ranks double from round to round, tied groups only, and every round's ranks are kept. A neighbour pair
   separated in round k shares 2**k to 2**(k+1) - 1 words, and the kept ranks give the rest bit by bit;
2. an interval of depth d is what lies between the next smaller prefixes on both sides (range minima by
   powers of two). Its children are cut at the prefixes equal to d;
3. the suffixes of every child but the largest look for i + d and i - d in the interval by the inverse
   array. Such a pair whose words after the common prefix differ is a branching tandem: a square that
   can't be moved to the right;
4. a square rotates to the left as far as its words repeat, again by the kept ranks. Squares with the same end
   whose period is a multiple of a shorter one inside its stretch are the same run; what is left is a maximal run with its smallest
   period.

Defined cases: a null, empty or blank text has no words and no runs; rows are judged one by one, so null ids, ids
with several texts and repeated rows each give their row; texts of any length are taken whole (a long
one is a batch of its own); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MIN_LENGTH = 6
MIN_REPEATS = 4
BATCH_BYTES = 1 << 20       # texts of one suffix array
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of some texts: their bytes without white space, and for every word its text and number."""

    def __init__(self, texts: list[str | None]):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        joined = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        solid = ~_WHITE[joined]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        self.size = end - start
        self.bytes = joined[solid]
        bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.text = np.searchsorted(bounds, start, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.size, out=offsets[1:])
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes)])
        self.code = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        size = self.size[keep] + 1
        n = int(size.sum())
        out = np.full(n, 0x20, np.uint8)
        solid = np.ones(n, bool)
        solid[np.cumsum(size) - 1] = False
        out[solid] = self.bytes[np.repeat(keep, self.size)]
        kept = np.bincount(self.text[keep], weights=size, minlength=len(self.counts)).astype(np.int64)
        # the space after a text's last word goes
        last = np.cumsum(kept)[kept > 0] - 1
        solid[:] = True
        solid[last] = False
        offsets = np.zeros(len(kept) + 1, np.int64)
        np.cumsum(np.maximum(kept - 1, 0), out=offsets[1:])
        return pa.Array.from_buffers(pa.large_string(), len(kept), [None, pa.py_buffer(offsets), pa.py_buffer(out[solid])])


def _sorted_by(major: np.ndarray, minor: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order of (major, minor, place): packed into one integer where they fit."""
    widths = [max(1, int(x.max(initial=0)).bit_length()) for x in (major, minor, place)]
    if sum(widths) > 63:
        return np.lexsort((place, minor, major))
    packed = (major << (widths[1] + widths[2])) | (minor << widths[2]) | place
    return np.argsort(packed)


class EnhancedArray:
    """Suffix array, inverse, common prefixes and the ranks by 1, 2, 4, ... words."""

    def __init__(self, text: np.ndarray, code: np.ndarray):
        """``text`` and ``code`` (0 for end marks) by place; every text closes with its end mark."""
        n = self.n = len(code)
        place = np.arange(n)
        self.symbol = text * (int(code.max(initial=0)) + 1) + code
        sa = _sorted_by(text, code, place)
        new = np.ones(n, bool)
        new[1:] = self.symbol[sa[1:]] != self.symbol[sa[:-1]]
        cut = np.where(new, 0, -1)          # the round in which a suffix parted from the one before it
        rank = np.empty(n, np.int64)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        group = np.repeat(start, size)
        rank[sa] = group
        self.ranks = [rank.astype(np.int32 if n < 1 << 31 else np.int64)]
        h = 1
        while True:
            tied = np.repeat(size > 1, size)
            at = np.flatnonzero(tied)
            if not len(at):
                break
            own = sa[at]
            order = _sorted_by(group[at], rank[own + h], own)
            own = own[order]
            lead, after = group[at], rank[own + h]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (lead[1:] != lead[:-1]) | (after[1:] != after[:-1])
            sa[at] = own
            parted = at[fresh]
            cut[parted] = np.where(cut[parted] < 0, len(self.ranks), cut[parted])
            new = ~tied
            new[at] = fresh
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, n))
            group = np.repeat(start, size)
            rank[own] = group[at]
            self.ranks.append(rank.astype(self.ranks[0].dtype))
            h *= 2
        self.sa, self.isa = sa, rank
        self.lcp = self._prefixes(cut)

    def _prefixes(self, cut: np.ndarray) -> np.ndarray:
        lcp = np.where(cut > 0, 1 << np.maximum(cut - 1, 0), 0)
        for k in range(len(self.ranks) - 2, -1, -1):        # the rest of a prefix, from its highest bit down
            at = np.flatnonzero(cut > k + 1)
            x, y = self.sa[at - 1] + lcp[at], self.sa[at] + lcp[at]
            same = self.ranks[k][x] == self.ranks[k][y]
            lcp[at[same]] += 1 << k
        return lcp

    def leftwards(self, t: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The first place from which every word up to ``t`` equals the word ``d`` places later."""
        at = t.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            to = at - (1 << k)
            safe = np.maximum(to, 0)
            ok = (to >= 0) & (self.ranks[k][safe] == self.ranks[k][safe + d])
            at = np.where(ok, to, at)
        return at


def _minima(values: np.ndarray, reach: int) -> list[np.ndarray]:
    """Minima of the 1, 2, 4, ... values from each place on."""
    out, size = [values], 1
    while size <= reach and 2 * size <= len(values):
        out.append(np.minimum(out[-1][:-size], out[-1][size:]))
        size *= 2
    return out


def _before(minima: list[np.ndarray], at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The last place before ``at`` whose value is under ``limit``."""
    pos = at.copy()
    for k in range(len(minima) - 1, -1, -1):
        to = pos - (1 << k)
        ok = (to >= 0) & (minima[k][np.maximum(to, 0)] >= limit)
        pos = np.where(ok, to, pos)
    return pos - 1


def _after(minima: list[np.ndarray], at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The first place after ``at`` whose value is under ``limit``."""
    pos = at + 1
    for k in range(len(minima) - 1, -1, -1):
        ok = (pos + (1 << k) <= len(minima[0])) & (minima[k][np.minimum(pos, len(minima[k]) - 1)] >= limit)
        pos = np.where(ok, pos + (1 << k), pos)
    return pos


def branching_tandems(esa: EnhancedArray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every square that can't move to the right; periods up to ``longest`` (by place)."""
    lcp = np.append(esa.lcp, 0)                             # prefixes of 0 on both sides
    zero = np.flatnonzero(lcp == 0)
    minima = _minima(lcp, int(np.diff(zero).max(initial=1)))
    cut = np.flatnonzero(lcp > 0)
    cut = cut[lcp[cut] <= longest[esa.sa[cut]]]
    d = lcp[cut]
    lo, hi = _before(minima, cut, d), _after(minima, cut, d)            # the interval: suffixes lo to hi - 1
    left, right = _before(minima, cut, d + 1), _after(minima, cut, d + 1)   # the children on both sides of the cut
    opens = left == lo                                      # the interval's first cut: its left child counts, too
    child = np.concatenate([cut, lo[opens]])
    size = np.concatenate([right - cut, (cut - lo)[opens]])
    whose = np.concatenate([np.arange(len(cut)), np.flatnonzero(opens)])
    # all children but the largest of each interval
    order = np.lexsort((child, -size, d[whose], lo[whose]))
    a, b = lo[whose][order], d[whose][order]
    largest = np.ones(len(order), bool)
    largest[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    small = order[~largest]
    n = size[small]
    which = np.repeat(whose[small], n)
    at = np.arange(int(n.sum())) + np.repeat(child[small] - (np.cumsum(n) - n), n)
    i, depth, lo, hi = esa.sa[at], d[which], lo[which], hi[which]
    found_t, found_d = [], []
    for there, t in ((i + depth, i), (i - depth, i - depth)):
        ok = (there >= 0) & (there < esa.n)
        rank = esa.isa[np.where(ok, there, 0)]
        ok &= (rank >= lo) & (rank < hi)
        t, p = t[ok], depth[ok]
        ok = esa.symbol[t + p] != esa.symbol[t + 2 * p]
        found_t.append(t[ok])
        found_d.append(p[ok])
    t, p = np.concatenate(found_t), np.concatenate(found_d)
    order = np.lexsort((p, t))
    t, p = t[order], p[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    return t[fresh], p[fresh]


def maximal_runs(esa: EnhancedArray, t: np.ndarray, p: np.ndarray, min_length: int, min_repeats: int):
    """(start, end, period) of the runs that the squares merge into, by start and period."""
    end = t + 2 * p
    order = np.lexsort((p, end))
    t, p, end = t[order], p[order], end[order]
    runs = []
    while len(t):
        first = np.ones(len(t), bool)
        first[1:] = end[1:] != end[:-1]
        group = np.cumsum(first) - 1
        q = p[first]
        start = esa.leftwards(t[first], q)
        runs.append(np.stack([start, end[first], q]))
        rest = ~first & ~((p % q[group] == 0) & (end - 2 * p >= start[group]))     # multiples inside the stretch are the same run
        t, p, end = t[rest], p[rest], end[rest]
    start, end, q = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
    keep = end - start >= np.maximum(min_length, min_repeats * q)
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _finder(min_length: int, min_repeats: int, batch_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", batch_bytes):
            words = Words(batch.column("text").to_pylist())
            counts = words.counts
            close = np.cumsum(counts + 1) - 1               # the end marks' places
            n = int(counts.sum()) + len(counts)
            code, text = np.zeros(n, np.int64), np.repeat(np.arange(len(counts)), counts + 1)
            solid = np.ones(n, bool)
            solid[close] = False
            code[solid] = words.code + 1
            esa = EnhancedArray(text, code)
            t, p = branching_tandems(esa, (counts // min_repeats)[text])
            start, end, period = maximal_runs(esa, t, p, min_length, min_repeats)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, end, -1)
            keep = np.cumsum(step)[:n][solid] == 0
            owner = text[start]
            local = start - (close - counts)[owner]
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=len(counts)), out=offsets[1:])
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (local, end - start, period)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), runs, words.joined(keep).cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              min_repeats: int = MIN_REPEATS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_words, runs, collapsed): the maximal runs of words of each text, and the text with each run cut to one period.

    ``runs`` holds (start, length, period) by start and period: maximal stretches with their smallest period, at
    least ``min_length`` words long and ``min_repeats`` (2 or more) periods. ``collapsed`` joins by one space the
    words that no run contains after its first period.
    """
    if min_repeats < 2:
        raise ValueError("a run holds two periods at least")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_finder(min_length, min_repeats, batch_bytes),
                           f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
