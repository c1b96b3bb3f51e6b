"""Word shingles of many texts at once, as 64-bit hashes, for use in tasks."""

from hashlib import blake2b

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _NEXT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes words by a sum over their bytes, each times a power of an odd base; powers are kept for the longest input."""

    def __init__(self):
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int):
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lower-cased words of the texts, one after the other, and how many words each text has."""
        value, _, _, count, _ = self.found(texts)
        return value, count

    def found(self, texts: list[bytes]):
        """The same, and where the words lie: (hashes, begins, ends, words of each text, lower-cased texts, each with a
        line feed)."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        up, down = self.powers(len(data))
        space, low = _SPACE[data], _LOWER[data]
        edge = np.flatnonzero(np.append(~space[:1], space[1:] != space[:-1]))
        begin, end = edge[::2], edge[1::2]
        part = np.append(np.uint64(0), np.cumsum(self.byte[low] * up[: len(data)], dtype=np.uint64))
        value = mixed((part[end] - part[begin]) * down[begin] + (end - begin).astype(np.uint64))
        bound = np.cumsum([len(t) + 1 for t in texts])
        return value, begin, end, np.diff(np.searchsorted(begin, bound), prepend=0), low

    def shingles(self, texts: list[bytes], width: int = 5) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's runs of `width` words; of fewer words, the whole; of none, nothing."""
        value, count = self.words(texts)
        run = np.zeros(max(0, len(value) - width + 1), np.uint64)
        for j in range(width):
            run += value[j:j + len(run)] * np.uint64(pow(_NEXT, j + 1, 1 << 64))
        run = mixed(run)
        out, at = [], 0
        for n in count.tolist():
            if n >= width:
                out.append(np.unique(run[at:at + n - width + 1]))
            elif n:
                whole = n + sum(int(value[at + j]) * pow(_NEXT, j + 1, 1 << 64) for j in range(n))
                out.append(mixed(np.array([whole % (1 << 64)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
        return out


def digest(tokens: np.ndarray) -> np.ndarray:
    """128 bits of a set of shingles as two signed longs."""
    return np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64)


def text_parts(batches, limit: int = 1 << 20):
    """Batches with the columns id and text -> (ids, texts as bytes) of about `limit` bytes."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        part, begin, size = [], 0, 0
        for i in range(len(ids)):
            part.append((texts[i].as_py() or "").encode())
            size += len(part[-1])
            if size > limit:
                yield ids[begin:i + 1], part
                part, begin, size = [], i + 1, 0
        if part:
            yield ids[begin:], part
