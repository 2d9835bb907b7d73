"""Operator 7: secret scans with a character convolutional network over candidates.

Base rules (assignments, access keys, long hex runs) always count. Every other
candidate, a run of 16 or more token characters that is not a plain word, goes with its
surrounding context through a small convolutional network in numpy. The network is fitted
here, on all labelled findings of all documents: base findings and
re-lettered variants of them are secrets, long words and joined ones are not; other candidates,
which nobody has judged, have no label.
Held-out findings calibrate its scores (Platt scaling) and set the threshold: the highest
one that keeps the wanted recall, with no floor. Long candidates are scored in overlapping tiles,
whole, in the calibration as in the scan.

The fit reads every labelled finding. Shards of a few thousand rows, dealt by hash, take an epoch each from the same
weights; the mean of what they reach, by rows, opens the next epoch. A shard is one row of one task, and only
weights, counts and histograms of bounded size reach the driver.

Defined cases: a null or empty text has no findings; offsets count code points, the end is
exclusive; findings are ordered by start, then kind; documents with too few labelled rows
(an empty table, say) fit no model, and the base rules stand alone; repeated rows are
scanned each; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import slices, written

KINDS = ("assign", "access", "hex", "model")
SHARD_ROWS = 8_192              # labelled rows that one network learns from in an epoch, about
EPOCHS = 8
BIN, FINE = 1e-3, 1e-6          # steps of logits in histograms; logits count as at most 1,000 there
MIN_ROWS = 40                   # labelled rows of either class that a fit needs
RECALL = 0.95                   # share of held-out secrets that the threshold must keep
MIN_RUN = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PLAIN = re.compile(r"[A-Z]?[a-z]+(?:[.-][A-Z]?[a-z]+)*|[A-Z]+")

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True


def _runs(codes: np.ndarray, kind: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte runs [start, end) of the characters of ``kind``, ``least`` long or longer."""
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = kind[codes]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def _char_at(codes: np.ndarray, raw_len: int, text_len: int):
    """Byte offset to code point offset."""
    if raw_len == text_len:
        return lambda b: b
    before = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
    return lambda b: int(before[b])


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    raw = H.utf8(text)
    codes = np.frombuffer(raw, np.uint8)
    if hexes := _runs(codes, _HEX, MIN_RUN):
        at = _char_at(codes, len(raw), len(text))
        found += [(at(s), at(e), "hex") for s, e in hexes]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Token runs that are no plain words and touch no base finding."""
    raw = H.utf8(text)
    codes = np.frombuffer(raw, np.uint8)
    runs = _runs(codes, _TOKEN, MIN_RUN)
    if not runs:
        return []
    at = _char_at(codes, len(raw), len(text))
    out = []
    for s, e in runs:
        own = raw[s:e].decode().rstrip(".-")
        start = at(s)
        end = start + len(own)
        if len(own) >= MIN_RUN and not _PLAIN.fullmatch(own) and not any(a < end and start < b for a, b, _ in taken):
            out.append((start, end))
    return out


# --- the network -------------------------------------------------------------

BEFORE, INSIDE, AFTER = 16, 40, 8
LENGTH = BEFORE + INSIDE + AFTER
WIDTH, FILTERS = 5, 16
_SPECIAL = "=:\"'_-./+ \n"
_PAD, _OTHER, _WIDE, _UPPER, _DIGIT = range(5)
_CLASSES = 2 * (5 + 26 + len(_SPECIAL))         # outside the candidate, then inside
_CELLS = np.arange(_CLASSES * FILTERS).reshape(_CLASSES, FILTERS)
_ASCII = np.full(128, _OTHER, np.int16)
for _c in range(26):
    _ASCII[97 + _c] = 5 + _c
    _ASCII[65 + _c] = _UPPER
_ASCII[48:58] = _DIGIT
for _k, _c in enumerate(_SPECIAL):
    _ASCII[ord(_c)] = 31 + _k


_FILL = "\udfff"                # in no text


def _tile_rows(places: list[tuple[str, int, int]]) -> np.ndarray:
    """Class numbers around each (text, start, end): the context and the first ``INSIDE`` characters of the candidate."""
    parts = []
    for text, start, end in places:
        stop = min(end, start + INSIDE)
        parts += [text[max(0, start - BEFORE):start].rjust(BEFORE, _FILL), text[start:stop].ljust(INSIDE, _FILL),
                  text[stop:stop + AFTER].ljust(AFTER, _FILL)]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(places), LENGTH)
    rows = np.where(points < 128, _ASCII[np.minimum(points, 127)], np.where(points == ord(_FILL), _PAD, _WIDE)).astype(np.uint8)
    inside = rows[:, BEFORE:BEFORE + INSIDE]
    inside[inside > _PAD] += _CLASSES // 2
    return rows


def _starts(start: int, end: int) -> range:
    """Where the tiles of a candidate begin; a long one has several."""
    step = INSIDE // 2
    return range(start, max(start + 1, end - step if end - start > INSIDE else start + 1), step)


def tiles(text: str, start: int, end: int) -> list[np.ndarray]:
    """Class numbers of the context and the candidate; a long candidate gives several tiles."""
    return list(_tile_rows([(text, at, end) for at in _starts(start, end)]))


class Network:
    """One convolution over one-hot classes, maximum and mean over time, one output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {"conv": rng.normal(0, 0.1, (WIDTH, _CLASSES, FILTERS)), "bias": np.zeros(FILTERS),
                  "out": rng.normal(0, 0.1, 2 * FILTERS), "off": np.zeros(1)}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        self.steps = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        n = LENGTH - WIDTH + 1
        z = np.take(self.w["conv"][0] + self.w["bias"], x[:, :n], axis=0)
        for j in range(1, WIDTH):
            z += np.take(self.w["conv"][j], x[:, j:j + n], axis=0)
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(a, top[:, None, :], 1)[:, 0], np.einsum("rpf->rf", a) / n), axis=1)
        return z, top, pooled, pooled @ self.w["out"] + self.w["off"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i:i + 128])[3] for i in range(0, len(x), 128)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def scaled(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(x))

    def best(self, spans: list[tuple[str, int, int]]) -> np.ndarray:
        """The greatest logit over the tiles of each span (text, start, end), as the scan judges it."""
        owner, places, out = [], [], np.full(len(spans), -np.inf)
        for i, (text, start, end) in enumerate(spans):
            own = [(text, at, end) for at in _starts(start, end)]
            places += own
            owner += [i] * len(own)
        for at in range(0, len(places), 4096):
            np.maximum.at(out, np.array(owner[at:at + 4096]), self.logits(_tile_rows(places[at:at + 4096])))
        return out

    def _parts(self) -> list[np.ndarray]:
        return [part[k] for part in (self.w, self.first, self.second) for k in sorted(part)]

    def state(self) -> np.ndarray:
        """All that an epoch changes, in one vector: weights, their moments, the number of steps."""
        return np.concatenate([np.array([self.steps]), *(x.ravel() for x in self._parts())])

    def restore(self, state: np.ndarray) -> None:
        self.steps, at = float(state[0]), 1
        for x in self._parts():
            x[...] = state[at:at + x.size].reshape(x.shape)
            at += x.size

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float = 0.01, batch: int = 128) -> None:
        """One epoch of gradient steps (Adam) over the rows ``x`` with labels ``y``."""
        n, order = LENGTH - WIDTH + 1, rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at:at + batch]
            xb, yb = x[own].astype(np.int64), y[own]
            z, top, pooled, logit = self._forward(xb)
            d = weight[own] * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - yb) / len(own)
            up = d[:, None] * self.w["out"][None, :]
            da = np.repeat(up[:, None, FILTERS:] / n, n, axis=1)
            np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + up[:, None, :FILTERS], 1)
            dz = np.where(z > 0, da, 0).reshape(-1, FILTERS)
            total = np.einsum("pf->f", dz)
            grad = {"out": pooled.T @ d, "off": np.array([d.sum()]), "bias": total, "conv": np.zeros_like(self.w["conv"])}
            seen = np.flatnonzero(np.logical_or.reduce([xb[:, j:j + n] != _PAD for j in range(WIDTH)]))
            dz = dz.take(seen, axis=0)
            blank, flat = total - np.einsum("pf->f", dz), dz.ravel()        # windows of padding alone give one class their sum
            for j in range(WIDTH):
                at = _CELLS.take(xb[:, j:j + n].ravel().take(seen), axis=0)
                grad["conv"][j] = np.bincount(at.ravel(), flat, _CLASSES * FILTERS).reshape(_CLASSES, FILTERS)
                grad["conv"][j][_PAD] += blank
            self.steps += 1
            for k, g in grad.items():
                self.first[k] = 0.9 * self.first[k] + 0.1 * g
                self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (self.first[k] / (1 - 0.9 ** self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999 ** self.steps)) + 1e-8)

    def calibrate(self, logit: np.ndarray, y: np.ndarray, recall: float, n: np.ndarray | None = None, cut: float | None = None) -> None:
        """Platt scaling of whole candidates' scores, then the highest threshold with the wanted recall, however low.

        ``n`` counts the candidates of each logit and label; ``cut`` is the logit of the threshold, where it is known.
        """
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
            a, b = a - 0.1 * np.average((p - y) * logit, weights=n) / (1 + np.average(logit ** 2, weights=n)), b - 0.5 * np.average(p - y, weights=n)
        self.scale, self.shift = max(a, 1e-3), b
        if cut is None:
            kept = np.sort(logit[y > 0])[::-1]
            cut = kept[int(np.ceil(recall * len(kept))) - 1]
        self.threshold = self.scaled(cut) * (1 - 1e-9)       # scores vary in their last bits


_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


_WORD = re.compile(r"[^\W\d_]{8,}")


@cache
def _letters() -> np.ndarray:
    """Which of the first 65,536 code points are letters to ``_WORD``."""
    out = np.zeros(1 << 16, bool)
    for m in _WORD.finditer("".join(chr(c) * 8 + " " for c in range(1 << 16))):
        out[m.start() // 9] = True
    return out


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of ``_WORD``, as runs of letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() >= 1 << 16:
        return tuple(np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2).T)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _letters()[points]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= 8
    return start[long], end[long]


def labelled_spans(text: str, rng: np.random.Generator) -> list[tuple[str, int, int, int]]:
    """Labelled findings of one text: the finding with its context, start and end therein, 1 (secret) or 0."""
    out = []

    def add(head: str, value: str, tail: str, label: int) -> None:
        head = head[max(0, len(head) - BEFORE):]
        out.append((head + value + tail[:AFTER], len(head), len(head) + len(value), label))

    base = base_findings(text)
    for start, end, kind in base:
        m = _ASSIGN.match(text, start) if kind == "assign" else None
        s, e = m.span(2) if m else (start, end)
        head, tail = text[max(0, s - BEFORE):s], text[e:e + AFTER]
        add(head, text[s:e], tail, 1)
        letters = _ALPHABETS[int(rng.integers(len(_ALPHABETS)))]        # the same place, other letters
        size = int(rng.integers(MIN_RUN, INSIDE + 1))
        value = "".join(letters[i] for i in rng.integers(0, len(letters), size))
        if rng.random() < 0.5:                                          # without its keyword
            head = text[max(0, start - BEFORE):start]
        add(head, value, tail, 1)
    starts, ends = _words(text)
    for i in rng.permutation(len(starts))[:4]:
        s, e = int(starts[i]), int(ends[i])
        head, tail = text[max(0, s - BEFORE):s], text[e:e + AFTER]
        add(head, text[s:e], tail, 0)
        if i + 1 < len(starts) and starts[i + 1] - s < 200:              # joined words, as in names and paths
            glue = "._-/="[int(rng.integers(5))]
            after = text[starts[i + 1]:ends[i + 1]]
            joined = text[s:e] + glue + after
            if rng.random() < 0.5:
                joined = text[s:e] + after.title() + str(int(rng.integers(10)))
            add(head, joined, tail, 0)
    return out


def labelled(text: str, rng: np.random.Generator) -> list[tuple[np.ndarray, int]]:
    """First tile and label of each labelled finding of one text."""
    return [(tiles(span, s, min(e, s + INSIDE))[0], y) for span, s, e, y in labelled_spans(text, rng)]


LABELS = "rank bigint, label int, span string, start int, stop int"


def _labeller(most: int | None):
    """Each task's labelled findings; with ``most`` the so many distinct ones of either class with the smallest hashes."""
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rng = np.random.default_rng(key & ((1 << 63) - 1))
                rows += [(int(rng.integers(1 << 62)), y, span, s, e) for span, s, e, y in labelled_spans(text or "", rng)]
            yield _label_batch(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[set, set] = (set(), set())
        bound = [1 << 62, 1 << 62]
        for batch in slices(batches, "text"):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rng = np.random.default_rng(key & ((1 << 63) - 1))
                for span, s, e, y in labelled_spans(text or "", rng):
                    if (rank := int(rng.integers(1 << 62))) <= bound[y]:
                        rows[y].add((rank, y, span, s, e))
                for y, own in enumerate(rows):
                    if len(own) > 2 * most:
                        for row in sorted(own)[most:]:
                            own.discard(row)
                        bound[y] = max(own)[0]
        for own in rows:
            yield _label_batch(sorted(own)[:most])

    return whole if most is None else run


def _label_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rank", "label", "span", "start", "stop"])


SHARD = "shard int, x binary, y binary"


def _pack(table: pa.Table) -> pa.Table:
    """A shard's first tiles and labels, in order, in one row."""
    table = table.sort_by([(c, "ascending") for c in ("rank", "label", "span", "start", "stop")])
    x = _tile_rows(list(zip(*(table.column(c).to_pylist() for c in ("span", "start", "stop")), strict=True)))
    y = table.column("label").to_numpy().astype(np.uint8)
    return pa.table([table.column("shard")[:1], pa.array([x.tobytes()]), pa.array([y.tobytes()])], names=["shard", "x", "y"])


def _epoch(packed: DataFrame, state: np.ndarray, share: np.ndarray, number: int) -> np.ndarray:
    """The mean, by rows, of the states that the shards reach from ``state`` in one epoch; ``share`` weighs the classes."""
    shared = packed.sparkSession.sparkContext.broadcast((state, share))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, share = shared.value
        total, rows = np.zeros(len(start)), 0
        for batch in batches:
            for shard, x, y in zip(*(batch.column(c).to_pylist() for c in ("shard", "x", "y")), strict=True):
                net, y = Network(), np.frombuffer(y, np.uint8)
                net.restore(start)
                net.learn(np.frombuffer(x, np.uint8).reshape(len(y), LENGTH), y, share[y], np.random.default_rng((number, shard)))
                total += len(y) * net.state()
                rows += len(y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), rows))],
                                             names=["pos", "total", "n"])

    got = packed.mapInArrow(run, "pos int, total double, n bigint").groupBy("pos").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    out = np.zeros(len(state))          # as long as the network has weights
    for r in got:
        out[r.pos] = r["mean"]
    shared.unpersist()
    return np.round(out, 12)            # sums vary in their last bits


def _scores(rows: DataFrame, net: Network) -> DataFrame:
    """(label, score): greatest logit over all tiles of each row, computed where the spans are."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "span"):
            spans = list(zip(*(batch.column(c).to_pylist() for c in ("span", "start", "stop")), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(shared.value.best(spans), pa.float64())], names=["label", "score"])

    return rows.mapInArrow(run, "label int, score double")


def _histogram(scores: DataFrame, step: float) -> dict[tuple[int, int], int]:
    """How many scores of each label lie in each bin of ``step``; scores count as 1,000 at most, either way."""
    at = F.floor(F.greatest(F.lit(-1000.0), F.least("score", F.lit(1000.0))) / step).cast("bigint")
    return {(r.label, r["at"]): r["n"] for r in scores.groupBy("label", at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _lowest(counts: dict[tuple[int, int], int], wanted: int) -> tuple[int, int]:
    """The bin that holds the ``wanted``-th best secret, and how many are above it."""
    above = 0
    for (_, at), n in sorted((c for c in counts.items() if c[0][0]), reverse=True):
        if above + n >= wanted:
            return at, above
        above += n
    raise ValueError("fewer secrets than wanted")


def _calibrate(net: Network, scores: DataFrame, recall: float) -> None:
    """Platt scaling on a histogram of all held-out scores; the recall's quantile is searched in a finer one of its bin."""
    counts = _histogram(scores, BIN)
    wanted = int(np.ceil(recall * sum(n for (y, _), n in counts.items() if y)))
    at, above = _lowest(counts, wanted)
    inside = scores.where((F.col("label") == 1) & (F.floor(F.greatest(F.lit(-1000.0), F.least("score", F.lit(1000.0))) / BIN) == at))
    fine, _ = _lowest(_histogram(inside, FINE), wanted - above)
    y, at, n = (np.array(c, float) for c in zip(*sorted((y, at, n) for (y, at), n in counts.items()), strict=True))
    net.calibrate((at + 0.5) * BIN, y, recall, n, fine * FINE)


def fit(docs: DataFrame, text_col: str = "text", sample_rows: int | None = None, recall: float = RECALL, shard_rows: int = SHARD_ROWS) -> Network | None:
    """Fit the network on the labelled findings of all documents; None where there are too few.

    A caller may ask for ``sample_rows`` of them, half of either class, those with the smallest hashes.
    """
    keyed = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    most = None if sample_rows is None else sample_rows // 2
    found = keyed.mapInArrow(_labeller(most), LABELS).dropDuplicates()
    if most is not None:
        found = written(found, "secret-findings")
        first = [found.where(F.col("label") == y).orderBy("rank", "span").limit(most) for y in (0, 1)]
        found = first[0].unionAll(first[1])
    rows = written(found, "secret-labels")
    held = F.col("rank") % 4 == 0
    kept = {(r.held, r.label): r["count"] for r in rows.groupBy(held.alias("held"), "label").count().collect()}
    if any(kept.get((part, y), 0) < MIN_ROWS // 4 for part in (False, True) for y in (0, 1)):
        return None
    own = np.array([kept[False, 0], kept[False, 1]], float)
    shards = math.ceil(own.sum() / shard_rows)
    dealt = rows.where(~held).withColumn("shard", F.pmod(F.xxhash64("rank", "span"), F.lit(shards)).cast("int"))
    packed = written(dealt.groupBy("shard").applyInArrow(_pack, SHARD).repartition(shards, "shard"), "secret-shards")
    net = Network()
    state = net.state()
    for number in range(EPOCHS):
        state = _epoch(packed, state, 0.5 * own.sum() / own, number)
    net.restore(state)
    _calibrate(net, written(_scores(rows.where(held), net), "secret-scores"), recall)
    return net


def _found(texts: list[str | None], net: Network | None) -> list[list[tuple[int, int, str]]]:
    """Base and model findings of each text; the network sees all candidates at once."""
    found = [base_findings(t) if t else [] for t in texts]
    if net is None:
        return found
    spans = [(i, s, e) for i, t in enumerate(texts) for s, e in (candidates(t, found[i]) if t else [])]
    scores = net.scaled(net.best([(texts[i], s, e) for i, s, e in spans]))
    for (i, s, e), p in zip(spans, scores, strict=True):
        if p >= net.threshold:
            found[i].append((s, e, "model"))
    return [sorted(f, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) for f in found]


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, net: Network | None, text_col: str = "text", into: str = "findings") -> DataFrame:
    """``docs`` with the column ``into`` (replacing one of that name): array of kind, start, end."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.drop(into)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = _found(batch.column(text_col).to_pylist(), shared.value)
            rows = [[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, _schema(kept, into, FINDINGS))


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each finding (overlapping ones together) replaced by ``[secret]``."""
    out, at = [], 0
    for s, e, _ in found:
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network | None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every finding masked in the text; ``length_col``, if named, follows the new length."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            new = [masked(t, f) if f else t for t, f in zip(texts, _found(texts, shared.value), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col and length_col in docs.columns:
        same = F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(same))
    return out


def joined(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the findings of ``kinds``, comma-joined."""
    own = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def number(found: Column, kind: str) -> Column:
    """How many findings are of ``kind``."""
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("bigint")
