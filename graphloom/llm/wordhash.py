"""Word hashing over whole Arrow batches with numpy.

All texts of a batch are laid end to end as UTF-8 bytes, lower-cased in A-Z
only, and split at ``[\\x20\\x09-\\x0D]``.  A word's 64-bit hash is a mixed
polynomial over its bytes, got from one running sum, so that the cost is a
handful of array passes and no Python loop over words.

Null texts count as empty.  A text without words gives no hashes.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_POW: dict[str, np.ndarray] = {}
#: Bytes of text that are hashed at once: some fifty bytes of memory go to each.
SLICE = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POW.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                have[done : done + step] = have[:step] * (have[done - 1] * base)
                done += step
        _POW[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and its offsets; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``hashes``, the row of each (``row``), and where its bytes lie (``start``, ``end`` in ``low``)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        # one separator byte after each text keeps words of neighbours apart
        self.low, self.rows = np.full(len(raw) + rows, 32, dtype=np.uint8), rows
        for i in range(rows):
            self.low[offsets[i] + i : offsets[i + 1] + i] = _LOWER[raw[offsets[i] : offsets[i + 1]]]
        parts = [self._hashed(a, b) for a, b in self._segments()]
        self.start, self.end, self.hashes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        self.row = np.searchsorted(offsets[1:] + np.arange(1, rows + 1), self.start, side="right")

    def _segments(self):
        """Bounds of runs of about SLICE bytes that end after a space."""
        a = 0
        while a < len(self.low):
            b = min(a + SLICE, len(self.low))
            while b < len(self.low):
                space = np.flatnonzero(_SPACE[self.low[b : b + SLICE]])
                if len(space):
                    b += int(space[0]) + 1
                    break
                b = min(b + SLICE, len(self.low))
            yield a, b
            a = b

    def _hashed(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = self.low[a:b]
        inside = ~_SPACE[low]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(low) + 1, dtype=np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(low)), out=sums[1:])
            poly = (sums[end] - sums[start]) * _powers(BASE_INV, len(low) + 1)[start]
            return start + a, end + a, mix(poly ^ mix((end - start).astype(np.uint64)))

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def slices(batch, column: str = "text"):
    """Runs of a record batch's rows with about SLICE bytes of text each, one row at least."""
    _, offsets = arrow_bytes(batch[column])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def words_of(column) -> Words:
    return Words(*arrow_bytes(column))


def word_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size``-word shingles by row, ascending within a row, and the offsets of the rows.

    A text with fewer words, one at least, gives its whole sequence as its one shingle; none gives an empty set.
    """
    h, row = words.hashes, words.row
    count = np.bincount(row, minlength=words.rows)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        full = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.empty(0, np.int64)
        pairs = h[full]
        for i in range(1, size):
            pairs = mix(pairs * np.uint64(3) + mix(h[full + i]))
        short = np.flatnonzero((count > 0) & (count < size))
        whole = h[first[short]]
        for i in range(1, size - 1):
            longer = count[short] > i
            whole[longer] = mix(whole[longer] * np.uint64(3) + mix(h[first[short[longer]] + i]))
        pairs = np.concatenate((pairs, mix(whole ^ np.uint64(0x5851F42D4C957F2D))))
        prow = np.concatenate((row[full], short))
    order = np.lexsort((pairs, prow))
    pairs, prow = pairs[order], prow[order]
    if len(pairs):
        new = np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (prow[1:] != prow[:-1])))
        pairs, prow = pairs[new], prow[new]
    return pairs, np.concatenate(([0], np.cumsum(np.bincount(prow, minlength=words.rows))))
