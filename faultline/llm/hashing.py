"""Vectorised hashes of words, word runs and byte runs (numpy, inside tasks)."""

from __future__ import annotations

import re

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept and grown by doubling)."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 14)
        ones = np.full(size, U64(BASE))
        ones[0] = 1
        back = np.full(size, U64(BASE_INV))
        back[0] = 1
        _pow, _inv = np.cumprod(ones, dtype=U64), np.cumprod(back, dtype=U64)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums for ``spans``: polynomial hashes of any run in constant time."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * _powers(len(codes))[0], out=out[1:], dtype=U64)
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end); equal runs have equal hashes."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + U64(0x632BE59BD9B4E019) * (end - start).astype(U64))


def byte_codes(raw: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(raw, np.uint8)]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    if not raw:
        none = np.zeros(0, np.int64)
        return none, none
    white = _IS_WHITE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate(([0], edge))
    if not white[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    return edge[0::2], edge[1::2]


def word_codes(raw: bytes) -> np.ndarray:
    """One 64-bit hash a word."""
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, U64)
    return spans(prefix(byte_codes(raw)), start, end)


def words(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
