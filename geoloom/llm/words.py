"""Words, word hashes and shingles of byte strings as numpy operations over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that end a word in the classes used here: x20 and x09-x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII bytes but digits and small letters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(1 << 16, 1 << (n - 1).bit_length())
            self.up, self.down = (self._run(x, size) for x in (_BASE, _BACK))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_powers = _Powers()


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array, each followed by one line end; and each text's first place."""
    import pyarrow.compute as pc

    from geoloom.llm.arrow import claim

    claim("words")
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = ("\n".join(column.to_pylist()) + "\n").encode()
    start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    return np.frombuffer(data, np.uint8), start


def word_bounds(data: np.ndarray, ends: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside `ends`. The last byte must be in `ends`."""
    inside = ~ends[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate([[0], change])
    return change[0::2], change[1::2]


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over hashed bytes; long texts go block by block."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + block, side="right")))
        low, high = int(first[at]), int(last[to - 1])
        up, down = _powers.to(high - low + 1)
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data[low:high]] * up[:-1], out=total[1:])
        f, t = first[at:to] - low, last[at:to] - low
        out[at:to] = mix((total[t] - total[f]) * down[f] + (t - f).astype(np.uint64))
        at = to
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; with fewer words, of the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = words[: n - width + 1].copy()
    for k in range(1, width):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[k : n - width + 1 + k]
    return mix(out + np.uint64(width))
