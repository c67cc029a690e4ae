"""Rolling hashes and content-defined anchors over byte strings, in numpy."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_P))  # a random word for each byte value
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        full = np.full(size, _U(_P))
        full[0] = 1
        back = np.full(size, _U(_P_INV))
        back[0] = 1
        _powers, _inverse = np.multiply.accumulate(full), np.multiply.accumulate(back)


class Windows:
    """Hash of any slice of one byte string in constant time: the prefix sums
    of table[byte] * p^i, taken apart and divided by p^start."""

    def __init__(self, data: bytes):
        self.n = len(data)
        _grow(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_TABLE[np.frombuffer(data, np.uint8)] * _powers[: self.n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _inverse[start])

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all q-byte slices."""
        m = self.n - q + 1
        return _mix((self.sums[q:] - self.sums[:m]) * _inverse[:m])


def _sliding(values: np.ndarray, span: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over every ``span`` values in a row, by block prefixes and suffixes."""
    m = len(values) - span + 1
    blocks = -(-len(values) // span)
    grid = np.full(blocks * span, fill, np.uint64)
    grid[: len(values)] = values
    grid = grid.reshape(blocks, span)
    ahead = ufunc.accumulate(grid, axis=1).ravel()
    behind = ufunc.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:m], ahead[span - 1 : span - 1 + m])


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the least value of some ``span`` values in a row,
    all holders on a tie. Equal windows choose equal positions."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    least = _sliding(grams, span, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum, 0) == grams)
