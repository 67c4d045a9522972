"""Arrays as compact byte strings, for rows that carry a block of values."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers below 2**32, byte plane by byte plane, compressed:
    small values leave whole planes of zeros."""
    data = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def squeezed(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def integers(values: np.ndarray, level: int = 3) -> bytes:
    """Unsigned integers below 2**32 in two or four bytes each, compressed:
    keeps repeated sequences together."""
    wide = bool(len(values)) and int(values.max()) > 0xFFFF
    return bytes([wide]) + squeezed(values.astype("<u4" if wide else "<u2").tobytes(), level)


def from_integers(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueezed(data[1:]), dtype="<u4" if data[0] else "<u2").astype("<u4")


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)) + b"".join(parts)


def unbundle(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<Q", data)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}Q", data, 8):
        out.append(data[at : at + size])
        at += size
    return out


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + length), one after another."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(int(lengths.sum()))
