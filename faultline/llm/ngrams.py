"""Operator 12: language-model scores by a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing, learned from the training texts:
``P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))`` and ``P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m)``, where h' is h
without its first token and m a weight for each order. It needs counts only, sums to one, and is exactly an automaton:
every known context is a state, a known n-gram an arc with its log-probability, and the failure arc of a
state leads to h' with weight ``m / (c(h) + m)``. The root has an arc for every token.

Nothing of the model is broadcast or collected; it grows with the texts:

1. texts are dealt to shards of bounded size. A shard counts its n-grams (64-bit hashes, sorted) and sends
   each hash range to its bucket, delta-coded;
2. a bucket adds up what all shards say of its n-grams (one entry a shard, so a frequent word is no hot key) and answers every shard
   with the totals, in the order of its message;
3. a shard builds the part of the automaton that its own texts can reach and reads all its texts in
   lockstep, one token a step: each text carries its state, takes failure arcs until an arc has the
   token, and adds up the weights.

The texts are shuffled once, compressed (the second use is the same exchange). Defined cases: a null or empty text is its end
token alone; a null training mark counts as held out; rows are scored one by one, so null ids and
repeated rows each give (and, in training, count) their row; with no training text all
probabilities are 1; an empty table gives an empty result; other columns are not read.
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
from .common import slices, text_bytes

ORDER = 2
WEIGHTS = (256.0, 32.0)         # m of the second, third, ... order
UNSEEN = 0.1                    # what every token's count is raised by
SHARD_BYTES = 12 << 20
HOLD_BYTES = 32 << 20           # text that a task holds before it deals it to the shards
CHUNK_BYTES = 1 << 18           # text hashed at once
BEGIN, END = H.mix(np.array([0x9D3F, 0x51C7], H.U64))
_STEP = np.random.default_rng(1207).integers(1, 1 << 62, (16, 1), dtype=np.int64).astype(H.U64) * H.U64(2) + H.U64(1)
_BEGIN_GRAM = H.mix(BEGIN * _STEP[0])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and every value's number among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], number


class Shard:
    """The tokens of a shard's texts, each text between a begin and an end mark, and the n-grams that end at each."""

    def __init__(self, texts: list[str | None], order: int):
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        at = 0
        raw = [H.utf8(t).translate(H.LOWER) for t in texts]
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= CHUNK_BYTES):
                size += len(raw[to]) + 1
                to += 1
            joined = b"\n".join(raw[at:to])
            start, end = H.word_bounds(joined)
            parts.append(H.spans(H.prefix(H.byte_codes(joined)), start, end) if len(start) else np.zeros(0, H.U64))
            bounds = np.cumsum([0] + [len(x) + 1 for x in raw[at:to]])
            counts.append(np.diff(np.searchsorted(start, bounds)))
            at = to
        self.words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        n = int(self.words.sum()) + 2 * len(texts)
        self.stop = np.cumsum(self.words + 2) - 1           # the end marks' places
        self.start = self.stop - self.words - 1             # the begin marks' places
        codes = np.zeros(n, H.U64)
        plain = np.ones(n, bool)
        plain[self.start] = plain[self.stop] = False
        codes[plain] = np.concatenate(parts) if parts else np.zeros(0, H.U64)
        codes[self.start], codes[self.stop] = BEGIN, END
        # place in its text, so that no n-gram begins before a text does
        self.depth = np.arange(n) - np.repeat(self.start, self.words + 2)
        self.grams: list[np.ndarray] = []       # per order: sorted distinct hashes
        self.number: list[np.ndarray] = []      # per order: the n-gram that ends at each token, -1 if none
        self.sample: list[np.ndarray] = []      # per order: a token at which each n-gram ends
        total = codes * _STEP[0]
        for k in range(order):
            if k:
                total[k:] += codes[:-k] * _STEP[k]
            has = self.depth >= k
            at = np.flatnonzero(has)
            grams, order_of, number = _distinct(H.mix(total[at] + H.U64(k)))
            whole = np.full(n, -1, np.int32)
            whole[at] = number
            self.grams.append(grams)
            self.number.append(whole)
            self.sample.append(at[order_of])

    def counted(self, train: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram ends in a training text."""
        token = np.repeat(train, self.words + 2)
        return [np.bincount(x[token & (x >= 0)], minlength=len(g)) for x, g in zip(self.number, self.grams, strict=True)]


def _cuts(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets' hash ranges begin in the sorted hashes."""
    edges = [(b << 64) // buckets for b in range(buckets)]
    return np.append(np.searchsorted(grams, np.array(edges, H.U64)), len(grams))


def _packed(grams: np.ndarray) -> bytes:
    """Sorted hashes as differences of the fewest bytes that hold them all (the first one whole)."""
    steps = np.diff(grams)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + grams[:1].astype("<u8").tobytes() + planes.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    width, first = blob[0], np.frombuffer(blob[1:9], "<u8")
    planes = np.frombuffer(blob, np.uint8, offset=9 if len(first) else 1).reshape(-1, width)
    wide = np.zeros((len(planes), 8), np.uint8)
    wide[:, :width] = planes
    return np.cumsum(np.concatenate([first, wide.view("<u8").ravel()]), dtype=H.U64)


def _small(counts: np.ndarray) -> bytes:
    """Counts of 0 to 2 in two bits each; the others, in the fewest bytes that hold them all, behind."""
    n = len(counts)
    low = np.zeros((n + 3) // 4 * 4, np.uint8)
    low[:n] = np.minimum(counts, 3)
    quads = low[0::4] | low[1::4] << 2 | low[2::4] << 4 | low[3::4] << 6
    more = counts[counts > 2]
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if more.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + n.to_bytes(8, "little") + quads.tobytes() + more.astype(kind).tobytes()


def _counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[1:9], "little")
    quads = np.frombuffer(blob, np.uint8, (n + 3) // 4, 9)
    out = ((quads[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[:n].astype(np.int64)
    out[out > 2] = np.frombuffer(blob, f"<u{blob[0]}", offset=9 + len(quads))
    return out


def _dealt(schema: pa.Schema, hold: int):
    """Rows as compressed Arrow streams, one a shard and about ``hold`` bytes of texts: (shard, rows)."""
    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        numbers = table.column("shard").to_numpy()
        order = np.argsort(numbers, kind="stable")
        names, start = np.unique(numbers[order], return_index=True)
        table = table.drop_columns("shard")
        for name, rows in zip(names.tolist(), np.split(order, start[1:]), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.take(rows).cast(schema))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["shard", "rows"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            if held and size + batch.nbytes > hold:
                yield from flush(held)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from flush(held)
    return run


def _opened(table: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows"))


ASK = "bucket int, shard int, tokens bigint, grams array<binary>, counts array<binary>"
ANSWER = "shard int, bucket int, tokens bigint, types bigint, counts array<binary>"
SCORED = "train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _asker(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        docs = _opened(table)
        shard = Shard(docs.column("text").to_pylist(), order)
        train = np.array(docs.column("train").to_pylist(), bool)
        counts = shard.counted(train)
        cuts = [_cuts(g, buckets) for g in shard.grams]
        tokens = int((shard.words + 1)[train].sum())
        rows = [[_packed(g[c[b]:c[b + 1]]) for g, c in zip(shard.grams, cuts, strict=True)] for b in range(buckets)]
        numbers = [[_small(n[c[b]:c[b + 1]]) for n, c in zip(counts, cuts, strict=True)] for b in range(buckets)]
        own = table.column("shard")[0].as_py()
        return pa.table({"bucket": pa.array(range(buckets), pa.int32()), "shard": pa.array([own] * buckets, pa.int32()),
                         "tokens": pa.array([tokens] + [0] * (buckets - 1), pa.int64()),
                         "grams": pa.array(rows, pa.list_(pa.binary())), "counts": pa.array(numbers, pa.list_(pa.binary()))})
    return run


def _adder(order: int):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        answers: list[list[bytes]] = [[] for _ in range(n)]
        types = 0
        for k in range(order):
            asked = [_unpacked(x[k].as_py()) for x in table.column("grams")]
            sizes = np.array([len(x) for x in asked])
            grams, _, number = _distinct(np.concatenate(asked))
            said = np.concatenate([_counts(x[k].as_py()) for x in table.column("counts")])
            total = np.bincount(number, weights=said, minlength=len(grams)).astype(np.int64)
            if not k:
                types = int(((total > 0) & (grams != _BEGIN_GRAM)).sum())
            stop = np.cumsum(sizes)
            for i in range(n):
                answers[i].append(_small(total[number[stop[i] - sizes[i]:stop[i]]]))
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "tokens": table.column("tokens"),
                         "types": pa.array([types] + [0] * (n - 1), pa.int64()), "counts": pa.array(answers, pa.list_(pa.binary()))})
    return run


class Automaton:
    """States, arcs and failure arcs of the model's part that a shard's texts can reach.

    State 0 is the root; the others are the contexts (n-grams of all but the highest order). An arc is an n-gram: it
    leaves the state of all but its last token, reads that, and has a ``weight`` and a ``target``. N-grams are numbered
    through all orders, ``known`` tells which have an arc; all single tokens have one from the root. ``level``
    is a state's number of tokens, ``fail`` and ``fall`` are its failure arc's target and weight.
    """

    def __init__(self, shard: Shard, counts: list[np.ndarray], tokens: int, types: int, weights: tuple[float, ...]):
        sizes = [len(c) for c in counts]
        self.first = np.cumsum([0, *sizes])             # an order's first n-gram; its state is one higher
        self.known = np.concatenate(counts) > 0
        self.known[:sizes[0]] = True
        self.weight = np.zeros(len(self.known))
        self.target = np.zeros(len(self.known), np.int64)
        self.level = np.repeat(np.arange(len(counts)), [1, *sizes[:-1]])
        self.fail = np.zeros(len(self.level), np.int64)
        self.fall = np.zeros(len(self.level))
        p = (counts[0] + UNSEEN) / (tokens + UNSEEN * (types + 1))
        for k, at in enumerate(shard.sample):
            own = self.first[k] + np.arange(sizes[k])
            after = shard.number[k - 1][at] if k else None      # the n-gram without its first token
            if k:
                m, before = weights[k - 1], shard.number[k - 1][at - 1]
                p = (counts[k] + m * p[after]) / (counts[k - 1][before] + m)
            shorter = self.first[k - 1] + after + 1 if k else 0
            self.weight[own] = np.log10(p)
            self.target[own] = shorter                          # a known n-gram's shorter ends are known, too
            if k < len(counts) - 1:
                self.target[own] = np.where(counts[k] > 0, own + 1, shorter)
                self.fail[own + 1] = shorter
                self.fall[own + 1] = np.log10(weights[k] / (counts[k] + weights[k]))
        self.entry = int(self.target[np.searchsorted(shard.grams[0], _BEGIN_GRAM)[0]])

    def read(self, shard: Shard) -> np.ndarray:
        """The weights of the shard's texts, all read in lockstep from the state behind the begin mark."""
        length = shard.words + 1
        order = np.argsort(-length, kind="stable")
        at, length = shard.start[order], length[order]
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")      # texts longer than the step
        numbers = [x.astype(np.int64) + f for x, f in zip(shard.number, self.first, strict=False)]
        ends = np.stack(numbers, axis=1)                # the n-grams of every order that end at a token
        state, total = np.full(len(at), self.entry), np.zeros(len(at))
        for step, n in enumerate(live, 1):
            now, end = state[:n], ends[at[:n] + step]
            arc = end[np.arange(n), self.level[now]]
            lost = np.flatnonzero(~self.known[arc])
            while len(lost):                            # no arc: fall to the shorter context and try again
                total[lost] += self.fall[now[lost]]
                now[lost] = self.fail[now[lost]]
                arc[lost] = end[lost, self.level[now[lost]]]
                lost = lost[~self.known[arc[lost]]]
            total[:n] += self.weight[arc]
            now[:] = self.target[arc]
        out = np.empty(len(total))
        out[order] = total
        return out


def _scorer(order: int, weights: tuple[float, ...]):
    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _opened(dealt)
        shard = Shard(docs.column("text").to_pylist(), order)
        by_bucket = np.argsort(answers.column("bucket").to_numpy())
        blobs = answers.column("counts")
        counts = [np.concatenate([_counts(blobs[int(i)][k].as_py()) for i in by_bucket]) for k in range(order)]
        tokens, types = answers.column("tokens")[0].as_py(), answers.column("types")[0].as_py()
        model = Automaton(shard, counts, tokens, types, weights)
        words = shard.number[0]
        score = model.read(shard)
        known = np.cumsum(np.append(0, counts[0][words] > 0))
        single = model.weight[words].tolist()
        base = [math.fsum(single[a + 1:b + 1]) for a, b in zip(shard.start.tolist(), shard.stop.tolist(), strict=True)]
        n = docs.num_rows
        return pa.table({"id": docs.column("id"), "train": docs.column("train"), "n_tokens": pa.array(shard.words + 1, pa.int64()),
                         "n_known": pa.array(known[shard.stop + 1] - known[shard.start + 1], pa.int64()),
                         "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(score, pa.float64())})
    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                weights: tuple[float, ...] = WEIGHTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of each text.

    ``train`` marks the rows to learn from; all rows are scored. Tokens are words without white space (A-Z lower-cased)
    and one end. ``base_score`` is the unigram model's, ``score`` the model's of ``order`` 2 or more.
    ``weights`` has one m for each order from the second on. N-grams are told apart by 64-bit hashes.
    """
    if order < 2 or len(weights) < order - 1:
        raise ValueError("an order of 2 or more and a weight for each order from the second on")
    weights = tuple(weights[:order - 1])
    shards = max(1, math.ceil(text_bytes(docs, text_col) / shard_bytes))
    buckets = 2 * shards
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"),
                       F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)).cast("int").alias("shard"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.schema if f.name != "shard"])
    rows = rows.mapInArrow(_dealt(schema, HOLD_BYTES), "shard int, rows binary")
    asked = rows.groupBy("shard").applyInArrow(_asker(order, buckets), ASK)
    answers = asked.groupBy("bucket").applyInArrow(_adder(order), ANSWER)
    totals = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))    # one row
    answers = answers.select("shard", "bucket", "counts").join(F.broadcast(totals))
    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_scorer(order, weights), f"id {kind}, {SCORED}")
