"""Operator 3: byte-exact dedup with suffix arrays.

Each shard (see ``passages``) holds pieces of documents that may share windows. Blocks of a shard get a
suffix array by Larsson-Sadakane refinement: suffixes sorted by their first symbols, then only the
groups that still tie are sorted again by the rank of what follows, twice as far each
round. Common prefixes of neighbours come by Kasai's rule in its permuted form:
along the text they fall by one at most, so only the suffixes whose preceding symbols differ are compared, and
the rest follows. Neighbours that share a window form one group with its first document.
Groups of different blocks are merged by binary search of their sorted windows.

Defined cases: texts are UTF-8 bytes, a null text is empty; texts shorter than a window stay whole; a null
id comes after all others; rows with one id are never earlier than each other; what is
kept may split a character and is therefore binary; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .passages import Frame, remove_repeats

WINDOW_BYTES = 50
GRAM_BYTES = 24
HOT = 10_000            # documents that may share a 24-byte run before its windows travel singly
BLOCK_BYTES = 1 << 20   # text of one suffix array


class Pieces:
    """Texts joined by zeros, with the first symbols of every suffix packed in one integer.

    Symbols are 1 to 255. The zeros count as different symbols, ordered by place, so no comparison goes
    beyond a piece. Ranks and places are packed together too, hence at most 2**20 symbols.
    """

    def __init__(self, bodies: list[bytes]):
        raw = b"\xff".join(bodies) + b"\xff"                    # no UTF-8 text has this byte
        self.symbols = np.frombuffer(raw, np.uint8) + np.uint8(1)      # 255 wraps to zero
        n = self.n = len(raw)
        sizes = np.array([len(b) + 1 for b in bodies])
        self.piece = np.repeat(np.arange(len(bodies)), sizes)
        self.left = (np.cumsum(sizes) - 1)[self.piece] - np.arange(n)  # symbols before the piece's end
        self.bits = max(1, n.bit_length())
        used = np.zeros(256, bool)
        used[self.symbols] = True
        used[0] = True
        self.width = max(1, int(used.sum() - 1).bit_length())
        self.depth = 1
        key = (np.cumsum(used) - 1)[self.symbols]               # dense numbers, zero stays zero
        while 2 * self.depth * self.width <= min(52, 62 - self.bits) and 2 * self.depth <= n:
            shift = np.zeros(n, np.int64)
            shift[:n - self.depth] = key[self.depth:]
            key = (key << (self.depth * self.width)) | shift
            self.depth *= 2
        whole = (1 << (self.depth * self.width)) - 1
        ends = [whole & ~((1 << ((self.depth - k) * self.width)) - 1) for k in range(self.depth)] + [whole]
        self.key = key & np.array(ends, np.int64)[np.minimum(self.left, self.depth)]


def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's group (named by its first place), and the sizes of the groups."""
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(new)))
    return np.repeat(start, size), size


def suffix_array(text: Pieces) -> np.ndarray:
    """Places of the suffixes in sorted order."""
    n, bits, h = text.n, text.bits, text.depth
    packed = np.sort((text.key << bits) | np.arange(n))
    sa = packed & ((1 << bits) - 1)
    lead = packed >> bits
    new = np.ones(n, bool)
    new[1:] = (lead[1:] != lead[:-1]) | (text.left[sa[1:]] < h)     # ties that reach an end lie in place order
    group, size = _groups(new)
    rank = np.empty(n, np.int64)
    rank[sa] = group
    while True:
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        own = sa[at]
        packed = np.sort((((group[at] << bits) | rank[own + h]) << bits) | own)
        own = packed & ((1 << bits) - 1)
        lead = packed >> bits
        sa[at] = own
        fresh = np.ones(len(at), bool)
        fresh[1:] = lead[1:] != lead[:-1]
        new = ~tied
        new[at] = fresh
        group, size = _groups(new)
        rank[own] = group[at]
        h *= 2


def common_prefixes(text: Pieces, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``sa``."""
    n, codes = text.n, text.symbols
    before = np.full(n, -1, np.int64)               # the suffix before, by place
    before[sa[1:]] = sa[:-1]
    falls = before > 0                              # the symbols before both are equal: one less than there
    falls[0] = False
    at = np.flatnonzero(falls)
    falls[at] = (codes[at - 1] == codes[before[at] - 1]) & (codes[at - 1] > 0)
    todo = np.flatnonzero((before >= 0) & ~falls)
    other = before[todo]
    most = np.minimum(text.left[todo], text.left[other])
    length = np.zeros(len(todo), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):                                # a packed run of symbols at a time
        differ = text.key[todo[live] + length[live]] ^ text.key[other[live] + length[live]]
        bits = np.frexp(differ.astype(np.float64))[1]       # 53 bits and fewer are exact
        length[live] += text.depth - (bits + text.width - 1) // text.width
        live = live[(differ == 0) & (length[live] < most[live])]
    out = np.zeros(n, np.int64)
    out[todo] = np.minimum(length, most)
    place = np.arange(n)
    source = np.maximum.accumulate(np.where(falls, 0, place))      # where the fall begins
    return (out[source] + source - place)[sa]


def _block(bodies: list[bytes], ids: np.ndarray, window: int):
    """Sorted distinct windows of a block: (windows, first documents, place of each window's group, offsets)."""
    text = Pieces(bodies)
    sa = suffix_array(text)
    shared = common_prefixes(text, sa)
    has = text.left >= window
    picked = has[sa]                                # suffixes that begin with a whole window
    own = sa[picked]
    # the prefix shared with the picked suffix before: the smallest of those between
    low = np.where(shared >= window, 0, 1)
    fresh = np.diff(np.cumsum(low)[picked], prepend=-1) > 0
    start = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    first = np.minimum.reduceat(ids[text.piece[own]], start) if len(start) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(text.symbols, window) if len(start) else None
    windows = views[own[start]].view(f"S{window}").ravel() if len(start) else np.zeros(0, f"S{window}")
    at = np.full(text.n, -1, np.int64)
    at[own] = group
    return windows, first, at[has], np.array([max(0, len(b) - window + 1) for b in bodies])


def first_documents(window: int, block_bytes: int = BLOCK_BYTES):
    """For the pieces of a shard: the first document of each of their windows."""
    def solver(bodies: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blocks, at, size = [], 0, 0
        for k, body in enumerate(bodies):
            if k > at and size + len(body) + 1 > block_bytes:
                blocks.append(_block(bodies[at:k], ids[at:k], window))
                at, size = k, 0
            size += len(body) + 1
        blocks.append(_block(bodies[at:], ids[at:], window))
        if len(blocks) > 1:
            names, least = blocks[0][0], blocks[0][1].copy()
            for windows, first, _, _ in blocks[1:]:         # merge by binary search
                k = np.searchsorted(names, windows)
                same = names[np.minimum(k, len(names) - 1)] == windows
                least[k[same]] = np.minimum(least[k[same]], first[same])
                names, least = np.insert(names, k[~same], windows[~same]), np.insert(least, k[~same], first[~same])
            blocks = [(w, least[np.searchsorted(names, w)], g, n) for w, _, g, n in blocks]
        return np.concatenate([first[group] for _, first, group, _ in blocks]), np.concatenate([counts for *_, counts in blocks])
    return solver


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_BYTES,
                 gram: int = GRAM_BYTES, hot: int = HOT) -> DataFrame:
    """(id, size, removed, spans, kept): bytes of each document, removed byte spans and the kept bytes."""
    frame = Frame(words=False, window=window, gram=min(gram, window), hot=hot)
    return remove_repeats(docs, frame, first_documents(window), id_col, text_col)
