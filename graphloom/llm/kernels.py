"""Vectorised byte, gram and word hashing over many texts at once.

All kernels take one ``uint8`` buffer of concatenated texts with their bounds, so that the cost
is a few numpy passes per byte and not a Python call per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 18


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=U64) | U64(1)


BYTE = np.stack([_odd(11, 256), _odd(12, 256)])
STEP = np.stack([_odd(13, 64), _odd(14, 64)])
WORD_BASE = _odd(15, 1)[0]
LANES = _odd(16, 256)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and ``n + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def batches(offsets: np.ndarray, size: int = CHUNK) -> list[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text is a range of its own."""
    out, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        out.append((first, min(last, n)))
        first = out[-1][1]
    return out


def gram_hashes(data: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """64-bit hashes of every ``width``-byte gram (a power of two), by doubling."""
    h, size = BYTE[family][data], 1
    while size < width and len(h) > size:
        g = h[:-size] * STEP[family][size.bit_length()]
        g += h[size:]
        g ^= g >> U64(31)
        h, size = g, size * 2
    return mix(h) if size >= width else np.zeros(0, U64)


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width``-byte gram, any width, from powers of two that overlap."""
    size = 1 << (width.bit_length() - 1)
    h = gram_hashes(data, size)
    if size == width or not len(h):
        return h
    over = width - size
    return mix(h[:-over] * LANES[0] + h[over:] * LANES[1] + U64(width)) if len(h) > over else np.zeros(0, U64)


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Index of the least hash in every ``width``-long window, the rightmost of ties."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    last = U64((1 << 24) - 1)
    m = (hashes & ~last) | (last - np.arange(len(hashes), dtype=U64))
    size = 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        over = width - size
        m = np.minimum(m[:-over], m[over:])
    return (last - (m & last)).astype(np.int64)


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK + 1)
        inverse = U64(pow(int(WORD_BASE), -1, 1 << 64))
        for k, base in enumerate((WORD_BASE, inverse)):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=U64)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes outside ``breaks``) and the words' bounds for each text.

    ``data`` is lower-cased by the caller where wanted; ``offsets`` start at 0.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    gap = breaks[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE[0][data] * power[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h + (end - start).astype(U64) * LANES[2]), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Distinct, sorted hashes of each text's ``width``-word shingles; a shorter text is one shingle."""
    total = max(0, len(words) - width + 1)
    h = np.zeros(total, U64)
    for j in range(width):
        h += words[j : j + total] * LANES[8 + j]
    h = mix(h)
    out = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if last - first >= width:
            out.append(np.unique(h[first : last - width + 1]))
        elif last > first:
            own = words[first:last]
            out.append(mix((own * LANES[8 : 8 + len(own)]).sum(keepdims=True, dtype=U64) + U64(len(own) * int(LANES[3]) % (1 << 64))))
        else:
            out.append(h[:0])
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of one length as one value."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(values, kinds: tuple) -> list[np.ndarray]:
    """The columns of many packed values, in order."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for v in values:
        n, at = int.from_bytes(v[:8], "little"), 8
        for p, kind in zip(parts, kinds):
            p.append(np.frombuffer(v, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds)]
