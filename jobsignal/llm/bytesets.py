"""Word and shingle hashes of Arrow text columns, computed with numpy over whole slices of the byte buffer.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``; hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; keeps temporary arrays near 5 MB each whatever the batch holds.
SLICE_BYTES = 1 << 19
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (multiply and shift)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _P)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Table of separators that leaves runs of ASCII letters and non-ASCII bytes.
LETTERS_APART = np.ones(256, bool)
LETTERS_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, _U), "q": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        m = max(n, 2 * SLICE_BYTES)
        one = np.ones(1, _U)
        _POWERS["p"] = np.concatenate([one, np.cumprod(np.full(m - 1, _P, _U))])
        _POWERS["q"] = np.concatenate([one, np.cumprod(np.full(m - 1, _P_INV, _U))])
    return _POWERS["p"][:n], _POWERS["q"][:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive row ranges of about SLICE_BYTES; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, off: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of the slice, in order; ``apart`` marks the bytes between words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = apart[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    ns = ~space
    before = np.concatenate([[True], space[:-1]]) | cut[:-1]
    after = np.concatenate([space[1:], [True]]) | cut[1:]
    s = np.flatnonzero(ns & before)
    e = np.flatnonzero(ns & after) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span data[s:e]."""
    p, q = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, _U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[:-1], out=c[1:])
    return mix((c[e] - c[s]) * q[s] + (e - s).astype(_U) * _U(0xA24BAED4963EE407))


def shingle_rows(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text: k-word shingles, or all words as one if there are fewer."""
    mul = mix(np.arange(1, k + 1, dtype=_U) * _U(0x8CB92BA72F3D8DD7)) | _U(1)
    for first, data, off in slices(texts):
        s, e, row = words(data, off)
        h = span_hashes(data, s, e) if len(s) else np.zeros(0, _U)
        m = max(0, len(h) - k + 1)
        sh = np.zeros(m, _U)
        for j in range(k):
            sh += h[j : j + m] * mul[j]
        sh = mix(sh)
        at = np.searchsorted(row, np.arange(len(off)))
        for r in range(len(off) - 1):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= k:
                yield first + r, np.unique(sh[a : b - k + 1])
            elif b > a:
                x = (h[a:b] * mul[: b - a]).sum(dtype=_U) + _U(b - a)
                yield first + r, mix(np.array([x], _U) ^ _U(0x5851F42D4C957F2D))
            else:
                yield first + r, np.zeros(0, _U)
