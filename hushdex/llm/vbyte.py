"""Byte-aligned variable-length integers with separate control bytes.

Each control byte holds the byte lengths (1 to 4, two bits each, first value in
the low bits) of four values; the data bytes follow in a stream of their own,
little-endian. Decoding looks the four lengths up in a 256-row table and gathers.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

#: LENGTHS[c] are the four byte lengths that control byte c stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of uint32 ``values``."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    wide = int(size.max(initial=1))
    keep = np.arange(wide, dtype=np.uint8) < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[:, :wide][keep].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values back, as uint32."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    wide = int(size.max(initial=1))
    ends = np.cumsum(size, dtype=np.int64)
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)))
    out = np.zeros(n, np.uint32)
    for k in range(wide):
        byte = raw[ends - size + k].astype(np.uint32) << np.uint32(8 * k)
        out |= np.where(size > k, byte, np.uint32(0)) if k else byte
    return out


def pack(values: np.ndarray, squeeze: Callable[[bytes], bytes]) -> bytes:
    """One blob: count, two lengths, both streams put through ``squeeze``."""
    c, d = (squeeze(x) for x in encode(values))
    return struct.pack("<QQ", len(values), len(c)) + c + d


def unpack(blob: bytes, unsqueeze: Callable[[bytes], bytes]) -> np.ndarray:
    n, size = struct.unpack_from("<QQ", blob)
    return decode(unsqueeze(blob[16 : 16 + size]), unsqueeze(blob[16 + size :]), n)
