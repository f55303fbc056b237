"""Blocked Bloom filters over 64-bit hashes: 512-bit blocks, one bit in each of a block's eight words."""
from __future__ import annotations

import numpy as np

BITS = 16                      # a value; about one false positive in 1 500


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E6C63D0876A9A47)
    return h ^ (h >> np.uint64(28))


def _bit(m: np.ndarray, k: int) -> np.ndarray:
    return np.uint64(1) << ((m >> np.uint64(6 * k)) & np.uint64(63))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h & np.uint64(0xFFFFFFFF)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def build(h: np.ndarray) -> bytes:
    h = h.view(np.uint64)
    table = np.zeros((max(1, -(-len(h) * BITS // 512)), 8), dtype=np.uint64)
    block, m = _block(h, len(table)), _mixed(h)
    for k in range(8):
        np.bitwise_or.at(table[:, k], block, _bit(m, k))
    return table.tobytes()


def holds(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Whether each value may be in the filter; never false for one that is."""
    h = h.view(np.uint64)
    table = np.frombuffer(bits, dtype=np.uint64).reshape(-1, 8)
    block, m, out = _block(h, len(table)), _mixed(h), np.ones(len(h), dtype=bool)
    for k in range(8):
        out &= table[block, k] & _bit(m, k) != 0
    return out
