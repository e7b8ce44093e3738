"""Words of whole Arrow batches of texts, hashed where they lie in the bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
BLOCK = 1 << 20

#: Odd multipliers, and the inverse of the first modulo 2**64; bytes that are white space.
_BY, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BACK = pow(_BY, -1, 1 << 64)
_GAPS = np.zeros(256, bool)
_GAPS[[*range(9, 14), *range(28, 33)]] = True

#: Letters of scripts without spaces are words of their own.
_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
WORD = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")


def words_of(text: str) -> list[str]:
    """What :data:`WORD` finds."""
    return WORD.findall(text)


class Powers:
    """Powers of the multiplier and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(2 * n, by, np.uint64))) for by in (_BY, _BACK))
        return self.up[:n], self.down[:n]


powers = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits, for values whose low bits depend on few others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def summed(x: np.ndarray) -> np.ndarray:
    """Sums from which :func:`runs` takes the hash of any part."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x))[0], out=out[1:])
    return out


def runs(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of what lies between two places each, equal for equal values wherever they stand."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def parts(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of parts given by start and length, one after the other."""
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


def plain_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The UTF-8 bytes of all texts, where each begins, and which were changed.

    Texts with letters of scripts without spaces, or with white space that is not ASCII, are
    changed: their lines stay and have one space between their words. Texts are not null.
    """
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    lead = np.flatnonzero(data >= 0xC2)
    kind, after = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    odd = (kind == 0xE0) | (kind == 0xE1) | (kind > 0xE2) | (kind == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (kind == 0xE2) & (after < 0x82)
    changed = np.unique(np.searchsorted(at, lead[odd], side="right") - 1).tolist()
    if not changed:
        return data, at, changed
    pieces = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for k in changed:
        lines = pieces[k].tobytes().decode("utf-8", "surrogatepass").split("\n")
        pieces[k] = np.frombuffer("\n".join(" ".join(WORD.findall(line)) for line in lines).encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate(pieces), np.cumsum([0, *map(len, pieces)]), changed


class Words:
    """``hashes`` of all words of some texts; ``first``: the number of the first word of each text, and of all."""

    def __init__(self, column: pa.Array):
        self.data, self.at, self.changed = plain_bytes(column)
        data, at = self.data, self.at
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_GAPS[data]
        begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        first, last = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
        begins[first], ends[last] = solid[first + 1], solid[last + 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.hashes = np.empty(len(self.start), np.uint64)
        k = 0
        while k < len(self.start):
            low = self.start[k]
            upto = max(k + 1, int(np.searchsorted(self.end, low + BLOCK, side="right")))
            sums = summed(data[low : self.end[upto - 1]].astype(np.uint64) + np.uint64(1))
            self.hashes[k:upto] = runs(sums, self.start[k:upto] - low, self.end[k:upto] - low)
            k = upto
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
