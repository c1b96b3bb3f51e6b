"""Whole numbers of a group of rows as one binary value, for use in tasks."""

import numpy as np


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on: first the low bytes of all, then the next, up to the widest that any needs."""
    v = np.ascontiguousarray(values).astype("<u8")
    width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    return v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and blob:
        out[:, :len(blob) // n] = np.frombuffer(blob, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def packed_steps(values: np.ndarray, low: int = 0) -> bytes:
    """Ascending numbers from low on, by their differences."""
    v = values.astype(np.uint64)
    return packed(np.diff(v, prepend=np.uint64(low)))


def unpacked_steps(blob: bytes, n: int, low: int = 0) -> np.ndarray:
    return np.cumsum(unpacked(blob, n), dtype=np.uint64) + np.uint64(low)


class Scramble:
    """A permutation of the numbers of `2 * bits` bits, which spreads them evenly, and its inverse; and equal ranges of
    them, in `parts`."""

    UP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self, bits: int, parts: int):
        if not 0 < bits <= 32:
            raise ValueError(f"numbers of {bits} bits cannot be paired in 64")
        self.bits, self.mask = np.uint64(bits), np.uint64((1 << 2 * bits) - 1)
        self.low = [-(-(p << 2 * bits) // parts) for p in range(parts)]

    def there(self, x: np.ndarray) -> np.ndarray:
        for a in self.UP:
            x = (x * np.uint64(a)) & self.mask
            x = x ^ (x >> self.bits)
        return x

    def back(self, x: np.ndarray) -> np.ndarray:
        for a in reversed(self.UP):
            x = x ^ (x >> self.bits)
            x = (x * np.uint64(pow(a, -1, 1 << 64))) & self.mask
        return x

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each part begins in ascending keys, and the end."""
        inner = np.array([x for x in self.low[1:]], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]]).astype(np.int64)
