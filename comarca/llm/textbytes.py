"""Words and pre-tokens of whole Arrow batches, found with numpy on the texts' UTF-8 bytes.

A text is never cut: batches are split between rows only. A slice of rows holds about
`SLICE_BYTES` or one longer text, which bounds the memory of a worker by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer spans are hashed by the library's blake2b, shorter ones word by word with numpy.
LONG = 64
#: A span of up to 8 bytes is one word; its size goes into a byte that UTF-8 never has.
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_SIZE = np.array([(0xF8 + n) << 56 for n in range(8)] + [0], np.uint64)
_KEYS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(LONG // 8)], np.uint64)


class Hasher:
    """64-bit hashes of any spans of one byte array, equal for equal bytes in any array."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        padded = np.append(data, np.zeros(8, np.uint8))
        two = padded[:-1] | padded[1:].astype(np.uint16) << np.uint16(8)
        four = two[:-2] | two[2:].astype(np.uint32) << np.uint32(16)
        #: The eight bytes from each position on, as one number.
        self.words = four[:-4] | four[4:].astype(np.uint64) << np.uint64(32)

    def _word(self, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        left = np.minimum(sizes - 8 * k, 8)
        return (self.words[starts + 8 * k] & _TAIL[left]) ^ _SIZE[left]

    def _bytes(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in self._bytes(starts, ends))
        return np.frombuffer(found, np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fast hashes. Spans of up to 8 bytes never collide with each other; for longer ones see `strong`."""
        sizes = ends - starts
        value = mix(self._word(starts, sizes, 0))
        k, left = 1, np.flatnonzero(sizes > 8)
        long = left[sizes[left] > LONG]
        left = left[sizes[left] <= LONG]
        while len(left):
            value[left] = mix((value[left] + _KEYS[k]) ^ self._word(starts[left], sizes[left], k))
            k += 1
            left = left[sizes[left] > 8 * k]
        if len(long):
            value[long] = self._digests(starts[long], ends[long])
        return value

    def groups(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, back): the first span of each group of spans with equal bytes, and each span's group.

        Spans are grouped by hash and then compared with the first of their group, so spans that
        differ are never taken for one, whatever their hashes."""
        _, where, back = np.unique(self.of(starts, ends), return_index=True, return_inverse=True)
        sizes, first = ends - starts, where[back]
        same = (sizes == sizes[first]).all()
        k, left = 0, np.flatnonzero((sizes <= LONG) & (first != np.arange(len(first))))
        while same and len(left):
            at = first[left]
            same = (self._word(starts[left], sizes[left], k) == self._word(starts[at], sizes[at], k)).all()
            k += 1
            left = left[sizes[left] > 8 * k]
        long = np.flatnonzero(sizes > LONG)
        if same and len(long):
            at = first[long]
            same = self._bytes(starts[long], ends[long]) == self._bytes(starts[at], ends[at])
        if same:
            return where, back
        seen: dict[bytes, int] = {}
        back = np.array([seen.setdefault(x, len(seen)) for x in self._bytes(starts, ends)], np.int64)
        return np.unique(back, return_index=True)[1], back

    def strong(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes for which no two spans are known to collide: one to one up to 8 bytes, beyond it
        blake2b, once for each distinct span."""
        sizes = ends - starts
        value = mix(self._word(starts, sizes, 0))
        wide = np.flatnonzero(sizes > 8)
        if len(wide):
            where, back = self.groups(starts[wide], ends[wide])
            value[wide] = self._digests(starts[wide][where], ends[wide][where])[back]
        return value


def span_hash(data: bytes) -> int:
    """Hash of one span, as `Hasher` gives it."""
    array = np.frombuffer(data, np.uint8)
    return int(Hasher(array).of(np.array([0]), np.array([len(array)]))[0])


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, each of at least one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each slice of a column, of about `most` bytes."""
    data, offsets = text_column(column)
    for first, end in slices(offsets, most):
        at = offsets[first : end + 1]
        yield first, end, data[at[0] : at[-1]], at - at[0]


def _row_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    begins = np.zeros(size + 1, bool)
    begins[offsets[:-1]] = True
    begins[size] = True
    return begins


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each position."""
    return np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs without ASCII white space."""
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, none
    word, row = ~WHITE[data], _row_starts(offsets, size)
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | row[1:size]
    end[:-1] &= ~word[1:] | row[1:size]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, rows_of(starts, offsets)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that begin with a run of spaces (or with the row); they cover each row gaplessly."""
    size = len(data)
    space, row = data == 32, _row_starts(offsets, size)
    begin = row[:size] | space
    begin[1:] &= ~space[:-1] | row[1:size]
    return _covering(begin, offsets, size)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a word with the one white-space character before it, or of the white space
    before that character; they cover each row gaplessly."""
    size = len(data)
    white, row = WHITE[data], _row_starts(offsets, size)
    last = white.copy()
    last[:-1] &= ~white[1:] & ~row[1:size]
    last[size - 1 :] = False
    first = white.copy()
    first[1:] &= ~white[:-1]
    return _covering(row[:size] | last | first, offsets, size)


def _covering(begin, offsets, size):
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], size)
    return starts, ends.astype(np.int64), rows_of(starts, offsets)


class HashTable:
    """Index of known 64-bit hashes, looked up for whole arrays; -1 stands for unknown."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.levels, left = [], np.arange(len(keys))
        for level in range(64):
            if not len(left):
                break
            shift = np.uint64(64 - bits - (level * 5) % (64 - bits))
            slots = self._slots(self.keys[left], bits, shift)
            table = np.full(1 << bits, len(keys), np.int64)
            table[slots[::-1]] = left[::-1]
            self.levels.append((bits, shift, table))
            left = left[table[slots] != left]
        if len(left):
            raise ValueError("keys repeat")

    @staticmethod
    def _slots(hashes: np.ndarray, bits: int, shift: np.uint64) -> np.ndarray:
        return ((hashes >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for bits, shift, table in self.levels:
            if not len(left):
                break
            at = table[self._slots(hashes[left], bits, shift)]
            hit = (self.keys[at] == hashes[left]) & (at < len(self.keys) - 1)
            found[left[hit]] = at[hit]
            left = left[~hit & (at < len(self.keys) - 1)]
        return found
