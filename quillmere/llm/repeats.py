"""Rolling hashes of symbol sequences, and triggers: places that are chosen by what stands around them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import BLANKS, U64, mix64

_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_B, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=U64)
    return _POWERS[0], _POWERS[1]


class Rolling:
    """Hashes of any run of a sequence of 64-bit symbol codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))

    def raw(self, length: int) -> np.ndarray:
        """Of every run of a length, a hash whose upper bits are good."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]

    def all(self, length: int) -> np.ndarray:
        return mix64(self.raw(length) + U64(length))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=U64))
_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))


def word_codes(data: bytes) -> np.ndarray:
    """Hashes of the words of UTF-8 text, in order."""
    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(~_BLANK[b], prepend=False, append=False))
    return Rolling(_BYTE_CODES[b]).hash(edges[::2], edges[1::2])


def _sliding(x: np.ndarray, width: int, f: Callable) -> np.ndarray:
    """f over every width neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def triggers(grams: np.ndarray, width: int) -> np.ndarray:
    least = _sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, U64)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == grams)


def phrases(codes: np.ndarray, length: int, width: int, gram: int):
    """(core, context, first, last) of the phrases of a text: hashes, and the first and last window start of each."""
    n = len(codes)
    none = np.zeros(0, U64)
    if n < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    roll = Rolling(codes)
    at = triggers(roll.all(gram), width)
    last = np.minimum(at - width, n - length)
    first = np.maximum(np.concatenate([[0], at[:-1] - width + 1]), 0)
    fine = (first <= last) & (last >= 0)
    at, first, last = at[fine], first[fine], last[fine]
    core = roll.hash(at - width, at + length - 2 * width)
    context = mix64(roll.hash(first, last + length) + (at - first).astype(U64))
    return core, context, first, last


def runs(mask: np.ndarray) -> int:
    return int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()) if len(mask) else 0


def pieces(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
