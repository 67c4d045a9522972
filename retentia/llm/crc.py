"""CRC-32 of a part of a byte string from the CRCs of its prefixes.

``zlib.crc32`` of A followed by B is the CRC of A, carried over len(B) zero
bytes, xor the CRC of B. Carrying over one zero bit is a linear map on 32 bit
vectors; its powers give any length.
"""

from __future__ import annotations

import functools

import numpy as np

#: CRC-32 polynomial, bit-reversed (fixed value).
POLYNOMIAL = 0xEDB88320


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@functools.cache
def _zero_bytes(power: int) -> np.ndarray:
    """The map over 2**power zero bytes: the image of each of the 32 bits."""
    if power == -3:  # one bit
        return np.array([POLYNOMIAL] + [1 << (i - 1) for i in range(1, 32)], dtype=np.uint32)
    half = _zero_bytes(power - 1)
    return _apply(half, half)


def carried(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC carried over so many zero bytes."""
    crc, n_bytes, power = crc.astype(np.uint32), n_bytes.astype(np.int64), 0
    while n_bytes.any():
        crc = np.where(n_bytes & 1, _apply(_zero_bytes(power), crc), crc)
        n_bytes, power = n_bytes >> 1, power + 1
    return crc


def crc_after(whole: np.ndarray, prefix: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC of the last n_bytes of a string from its CRC and that of the rest."""
    return whole.astype(np.uint32) ^ carried(prefix, n_bytes)
