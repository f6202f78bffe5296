"""Many small records as one compressed binary value, so that a shuffle moves bytes and not rows."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers or bytes. Integers are stored from their least value, in as few bytes as the span needs."""
    out = [struct.pack("<B", len(columns))]
    for column in columns:
        n = len(column)
        if column.dtype == np.uint8:
            out += [struct.pack("<BqI", 0, 0, n), column.tobytes()]
            continue
        least = column.min() if n else column.dtype.type(0)
        offset = (column - least).astype(np.uint64)
        width = max(1, (int(offset.max()).bit_length() + 7) // 8) if n else 1
        code, base = (width, int(least)) if column.dtype != np.uint64 else (width + 8, int(np.uint64(least).view(np.int64)))
        planes = np.ascontiguousarray(offset.view(np.uint8).reshape(n, 8)[:, :width].T)
        out += [struct.pack("<BqI", code, base, n), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, out = 1, []
    for _ in range(raw[0]):
        code, base, n = struct.unpack_from("<BqI", raw, at)
        at += 13
        if code == 0:
            out.append(np.frombuffer(raw, np.uint8, n, at))
            at += n
            continue
        width = code - 8 if code > 8 else code
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        value64 = wide.view(np.uint64).ravel() + np.int64(base).view(np.uint64)
        out.append(value64 if code > 8 else value64.view(np.int64))
    return out


def deltas(column: np.ndarray) -> np.ndarray:
    """First value, then differences (wrapping): small where the column ascends."""
    return np.diff(column, prepend=column.dtype.type(0))
