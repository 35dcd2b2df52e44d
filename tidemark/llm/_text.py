"""NumPy helpers over Arrow string columns: byte slices, words, word shingles.

Everything works on the UTF-8 bytes of whole texts, in slices of about ``SLICE_BYTES`` so that a task's memory does not
depend on the size of an Arrow batch; one text is never cut, so the longest text sets the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = ~(np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(65, 91)]) | (np.arange(256) >= 128))
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)  # a random word of 64 bits for each byte


def string_column(batch: pa.RecordBatch, name: str) -> pa.LargeStringArray:
    """The named column as large strings, null as the empty text."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def slices(column: pa.LargeStringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()  # idle workers keep nothing of the batches before


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the maximal runs of true places; runs never reach across texts."""
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(inside))]
    begin[edges], stop[edges - 1] = inside[edges], inside[edges - 1]
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(stop) - first + 1


def cut_out(data: np.ndarray, first: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The pieces data[first : first + size] as one large string or binary column; pieces may overlap."""
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    body = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
    return pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(ends), pa.py_buffer(body.tobytes())])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.ones(max(n, 1), dtype=np.uint64)
        have = 1
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * (out[have - 1] * BASE)
            have += take
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, in order; words never reach across texts. A-Z are lower-cased.

    The hash is a polynomial of the word's bytes modulo 2**64, each byte replaced by a random 64-bit word, finalised with
    the length. It tells ordinary words apart; only texts built against it (over 1,000 equal-pattern bytes in one word) collide.
    """
    texts = len(offsets) - 1
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return empty
    gap = separators[data]
    begin = ~gap
    begin[1:] &= gap[:-1]
    stop = ~gap
    stop[:-1] &= gap[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a text's first byte begins a word, its last one ends it
    begin[edges] = ~gap[edges]
    stop[edges - 1] = ~gap[edges - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
    if not len(first):
        return empty
    length = last - first + 1
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(first, np.diff(np.append(first, len(data)))) if first[0] == 0 else np.concatenate(
        [np.arange(first[0]), np.repeat(first, np.diff(np.append(first, len(data))))])
    with np.errstate(over="ignore"):
        value = _CODES[_LOWER[data]]
        value[gap] = 0
        place[gap] = 0
        value *= _powers(int(length.max()))[place]
        sums = np.add.reduceat(value, first)
        out = mix(sums + length.astype(np.uint64) * BASE)
    return out, np.searchsorted(offsets, first, side="right") - 1 if texts > 1 else np.zeros(len(first), np.int64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (hashes, bounds); text i has hashes[bounds[i]:bounds[i + 1]], ascending.

    A text of fewer than ``size`` words has one shingle, its whole word sequence; a text without words has none.
    """
    texts = len(offsets) - 1
    word, text = words(data, offsets)
    count = np.bincount(text, minlength=texts)
    start = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(word) >= size:
            rolled = np.zeros(len(word) - size + 1, np.uint64)
            for k in range(size):
                rolled = mix(rolled * BASE + word[k : len(word) - size + 1 + k])
            whole = text[: len(rolled)] == text[size - 1 :]
            grams, owner = rolled[whole], text[: len(rolled)][whole]
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            value = np.full(len(short), np.uint64(size), np.uint64)
            for k in range(size - 1):
                here = count[short] > k
                value[here] = mix(value[here] * BASE + word[start[short[here]] + k] + np.uint64(1))
            grams, owner = np.concatenate([grams, mix(value)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[keep], owner[keep]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))])


def marked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``words``, but every ASCII byte other than a letter or digit separates words."""
    return words(data, offsets, _MARKS)


class Memo:
    """A table of at most about ``2 * limit`` results: when the young half is full it becomes the old one, and what is asked for again moves over."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """The keys without a result yet; all others are in ``young`` afterwards."""
        if len(self.young) + len(keys) > self.limit:
            self.old, self.young = self.young, {}
        known = keys & self.old.keys()
        self.young.update({k: self.old[k] for k in known})
        return keys - self.young.keys()
