"""Words of many texts at once: spans and fingerprints in numpy arrays.

Texts arrive as Arrow batches. A batch is cut into slices of about ``SLICE``
bytes (a longer text is a slice of its own), so memory follows the slice and the
longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(ratio: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done, step = 1, ratio
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done += more
        step = step * step & _MASK
    return out


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers[base] = _geometric(base, size), _geometric(pow(base, -1, 1 << 64), size)
    up, down = _powers[base]
    return up[:n], down[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Fingerprints of ``values[start:end]`` for every span; equal content, equal fingerprint."""
    up, down = _pow(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def unspaced(data: np.ndarray) -> np.ndarray:
    """Bytes at which a character of a script without spaces (Thai to Tibetan, Burmese, Khmer, Chinese, Japanese) begins, and where it ends."""
    at = np.flatnonzero((data >= 0xE0) & (data < 0xF1))
    lead, two, three = data[at], data[at + 1], data[at + 2]
    burmese = (lead == 0xE1) & ((two == 0x80) | (two == 0x81) | ((two == 0x82) & (three < 0xA0)))
    khmer = (lead == 0xE1) & ((two == 0x9E) | (two == 0x9F))
    forms = (lead == 0xEF) & (((two >= 0xA4) & (two <= 0xAB)) | ((two >= 0xBC) & (two <= 0xBE)))
    rare = (lead == 0xF0) & (two >= 0xA0) & (two <= 0xB3)
    at = at[((lead == 0xE0) & (two >= 0xB8)) | burmese | khmer | ((lead >= 0xE3) & (lead <= 0xE9)) | forms | rare]
    return np.concatenate([at, at + np.where(data[at] == 0xF0, 4, 3)])


class Slice:
    """Words of consecutive rows: ``row`` (per word), byte ``start``/``end``, ``code``; ``first[i]:first[i + 1]`` are row i's words."""

    def __init__(self, offset: int, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, lower: bool, characters: bool = False):
        self.offset, self.data, self.bounds, self.n_rows = offset, data, bounds, len(bounds) - 1
        inside = ~separators[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = False
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
            # two texts may touch without a separator between them
            cut = bounds[1:-1]
            if characters:
                cut = np.concatenate([cut, unspaced(data)])
            cut = cut[(cut > 0) & (cut < len(data))]
            touching = np.unique(cut[inside[cut - 1] & inside[cut]])
        else:
            touching = np.zeros(0, np.int64)
        marks = np.flatnonzero(edge)
        self.start = np.sort(np.concatenate([marks[0::2], touching]), kind="stable")  # two sorted runs
        self.end = np.sort(np.concatenate([marks[1::2], touching]), kind="stable")
        self.first = np.searchsorted(self.start, bounds)
        self.row = np.repeat(np.arange(self.n_rows), np.diff(self.first))
        self.n_words = np.diff(self.first)
        self._bytes = LOWER[data] if lower else data
        self._code = None

    @property
    def code(self) -> np.ndarray:
        if self._code is None:
            self._code = spans_hash(_VALUES[self._bytes], self.start, self.end)
        return self._code

    def grams(self, n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, fingerprint) of every run of n words inside one row."""
        at = np.flatnonzero(self.row[n - 1 :] == self.row[: len(self.row) - n + 1]) if len(self.row) >= n else np.zeros(0, np.int64)
        return at, spans_hash(self.code, at, at + n, base)

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def slices(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False, characters: bool = False, size: int = SLICE):
    """Slices of a string array, of about ``size`` bytes; null counts as empty. With ``characters``, those of scripts without spaces are words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        to = min(to, len(texts))
        yield Slice(at, raw[off[at] : off[to]], off[at : to + 1] - off[at], separators, lower, characters)
        at = to
