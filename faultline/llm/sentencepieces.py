"""Operator 4: exact encoding and decoding with merge-type SentencePiece models.

The encoding of a text is the only segmentation into pieces in which each
two neighbours are compatible: merging their joined characters anew gives back these
two pieces. ``Coder.encode`` finds it without merging the text: Aho-Corasick gives
the pieces that start at each position, the longest is tried first, a piece that
is not compatible with the one before gives way to a shorter one, and a bitfield
remembers the positions from which no segmentation goes on. Compatibility is decided by
re-merging the two pieces' few characters and kept in a table.

No piece has a word mark after another character, or a line feed, so a text is cut there
first; encodings of cut parts are kept in a cache of bounded size. Models without
that property are encoded whole. Characters that no piece covers become byte pieces.

Supported: BPE models with identity normalisation, escaped white space and
prefix word marks, of normal, byte, control and unknown pieces. Others raise ValueError.

Defined cases: null and empty texts have no pieces but the wanted end or start ids; any length is
encoded whole; other columns pass through; repeated rows are encoded each; an empty
table gives an empty table with the new columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

MARK = "▁"
CACHE_PARTS = 400_000           # encodings of cut parts kept while a task runs
CACHE_CHARS = 48                # longer parts are not kept
CACHE_PAIRS = 500_000           # compatibility verdicts kept by a worker

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Coder(dict):
    """Encoder and decoder of one model; as a dict, the cache of encoded parts."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if (train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("only plain BPE models with identity normalisation are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.number = {p.piece: n for n, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = [n for _, n in sorted((int(p.piece[3:5], 16), n) for n, p in enumerate(proto.pieces) if p.type == BYTE)]
        self.unknown = next(n for n, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bos = next((n for n, p in enumerate(proto.pieces) if p.piece == "<s>"), None)
        self.eos = next((n for n, p in enumerate(proto.pieces) if p.piece == "</s>"), None)
        self.text = dict(enumerate(self.pieces))          # of pieces, and of lone characters below zero
        self.compatible: dict[tuple[int, int], bool] = {}
        self.trie = ahocorasick.Automaton()
        for piece, n in self.number.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:       # others can never be a result
                self.trie.add_word(piece, (len(piece), n))
        self.trie.make_automaton()
        inner = {(a, b) for p in self.number for a, b in zip(p, p[1:])}
        cut_marks = not any(b == MARK and a != MARK for a, b in inner)
        cut_lines = not any("\n" in pair for pair in inner)
        stop = (MARK if cut_marks else "") + ("\n" if cut_lines else "")
        lead = f"{MARK}*" if cut_marks else ""
        self.parts = re.compile(f"{lead}[^{stop}]+|{MARK}+|\n" if stop else r"(?s:.+)").findall
        self.out = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else
                    " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
                    for p, k in zip(self.pieces, self.kinds)]

    def merge(self, chars: str) -> list[str]:
        """The plain definition: merge the best-scored neighbours, leftmost first, to the end."""
        parts, score = list(chars), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: int, b: int) -> bool:
        if len(self.compatible) >= CACHE_PAIRS:
            self.compatible.clear()
        x, y = self.text[a], self.text[b]
        ok = self.compatible[a, b] = self.merge(x + y) == [x, y]
        return ok

    def _segment(self, part: str) -> list[int]:
        n = len(part)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, hit in self.trie.iter(part):
            starts[end - hit[0] + 1].append(hit)           # by end, so the longest comes last
        for at, hits in enumerate(starts):
            if not hits or hits[0][0] > 1:                  # a lone character that is no piece
                lone = -1 - ord(part[at])
                self.text[lone] = part[at]
                hits.insert(0, (1, lone))
        failed = bytearray(n + 1)
        taken: list[int] = []
        tries: list[int] = [len(starts[0])]
        widths: list[int] = []
        at, known = 0, self.compatible
        while at < n:
            hits, k = starts[at], tries[-1]
            last = taken[-1] if taken else None
            while k:
                k -= 1
                width, token = hits[k]
                if failed[at + width]:
                    continue
                if last is not None:
                    ok = known.get((last, token))
                    if ok is None:
                        ok = self._fits(last, token)
                    if not ok:
                        continue
                tries[-1] = k
                taken.append(token)
                widths.append(width)
                at += width
                tries.append(len(starts[at]) if at < n else 0)
                break
            else:
                failed[at] = 1
                tries.pop()
                taken.pop()
                at -= widths.pop()
        return taken

    def __missing__(self, part: str) -> bytes:
        ids: list[int] = []
        for token in self._segment(part):
            if token >= 0:
                ids.append(token)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in chr(-1 - token).encode()]
            else:
                ids.append(self.unknown)
        packed = np.array(ids, np.int32).tobytes()
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids, packed as int32."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.parts(self.prefix + text.replace(" ", MARK))))

    def forget(self) -> None:
        """Drop the encoded parts; the verdicts are few and serve every text."""
        self.clear()

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.out.__getitem__, ids.tolist()))
        if self.prefix and out.startswith(b" "):
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace")


_CODERS: dict[bytes, Coder] = {}


def coder(model: bytes) -> Coder:
    key = hashlib.sha256(model).digest()
    if key not in _CODERS:
        _CODERS[key] = Coder(model)
    return _CODERS[key]


def _broadcast(spark, model_path: str):
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _list(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in packed]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None, bos: bool = False, eos: bool = True) -> DataFrame:
    """``docs`` with the column ``ids_col`` (array<int>) and, if named, the text decoded from it.

    The model (bounded by its file) is read by the driver and broadcast.
    """
    model = _broadcast(docs.sparkSession, model_path)
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    if decoded_col:
        new.append(T.StructField(decoded_col, T.StringType()))
    added = {f.name for f in new}
    kept = docs.select(*[c for c in docs.columns if c not in added or c == text_col])
    if text_col in added:
        raise ValueError("the text column can't be an output")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        head = np.array([own.bos] if bos else [], np.int32).tobytes()
        tail = np.array([own.eos] if eos else [], np.int32).tobytes()
        for batch in slices(batches, text_col):
            packed = [head + own.encode(x or "") + tail for x in batch.column(text_col).to_pylist()]
            columns = [*batch.columns, _list(packed)]
            if decoded_col:
                columns.append(pa.array([own.decode(np.frombuffer(x, np.int32)) for x in packed], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[f.name for f in new]])
        own.forget()                                # a worker that waits for other tasks holds no large cache

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *new]))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the column ``into``: the text of the ids (null: empty)."""
    model = _broadcast(df.sparkSession, model_path)
    kept = df.drop(into)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int32)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())]))
