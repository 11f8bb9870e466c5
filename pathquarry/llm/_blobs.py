"""Columns of numbers, packed for a shuffle: a row for each task, batch and bucket instead of one for each number."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

#: Odd multipliers and a finaliser of well-mixed 64-bit hashes (public splitmix64 constants, fixed values).
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x + GOLDEN) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def pack(*columns: np.ndarray) -> bytes:
    parts = [c.tobytes() for c in columns]
    head = struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    sizes = struct.unpack_from(f"<{n}Q", raw, 4)
    out, at = [], 4 + 8 * n
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indexes start .. start + size - 1, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
