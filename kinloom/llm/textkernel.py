"""Vectorised text primitives shared by the corpus operators.

Everything works on a block of UTF-8 rows laid end to end in one byte buffer.
Word classes are byte classes, so any character beyond ASCII is a word
character; that is exactly what the operators' word patterns ask for.  A block
holds about ``BLOCK_BYTES`` of text or one longer row, which bounds the memory
of a Python worker whatever the Arrow batch size.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SPACE = [0x20, *range(0x09, 0x0E)]
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACE] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes that a lane of each size from 0 to 8 keeps.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_GOLDEN, _LENGTH = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes end to end and their n + 1 offsets; a null row is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if len(column) else pa.array([], pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with at most ``limit`` bytes of text (or one row), their bytes and offsets."""
    for batch in batches:
        data, ends = blob(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < len(batch):
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield batch.slice(row, last - row), data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
            row = last


def spans(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a row: starts, stops, and where each row's runs begin."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(inside))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers; zeros follow the end."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))


def _placed(j: np.ndarray | int, salt: int) -> np.ndarray:
    """What is added to the lane at place j, so that a lane counts by its place."""
    return mix((np.atleast_1d(np.asarray(j, np.uint64)) + np.uint64(1)) * np.uint64(_GOLDEN) + np.uint64(salt))


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand.

    A range is cut into lanes of eight bytes; each is mixed with its place, and
    their sum is mixed with the length.  No power of a base is in it, so texts
    of two balanced words, which cancel each other out in a polynomial modulo
    2^64, are nothing special.  Who knows the salt can build ranges of one hash;
    jobs that take hashes for texts therefore draw a salt of their own (``salted``).
    """
    size = stops - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    lanes = _lanes(data)
    total = mix((lanes[starts] & _KEEP[np.minimum(size, 8)]) + _placed(0, salt))
    long = np.flatnonzero(size > 8)
    if len(long):
        count = (size[long] - 1) >> 3
        head = np.cumsum(count) - count
        j = np.arange(int(count.sum())) - np.repeat(head, count) + 1
        left = np.repeat(size[long], count) - 8 * j
        more = mix((lanes[np.repeat(starts[long], count) + 8 * j] & _KEEP[np.minimum(left, 8)]) + _placed(j, salt))
        total[long] += np.add.reduceat(more, head)
    return mix(total + size.astype(np.uint64) * _LENGTH)


def salted(salt: int | None = None) -> int:
    """The salt, or one drawn at random that is never 0."""
    return secrets.randbits(63) | 1 if salt is None else salt


#: The salt of a process's own second hash; it never leaves the process.
_OWN = salted()


def exact(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Two numbers a range that tell ranges of one hash apart, in this process.

    Up to 16 bytes they are the bytes themselves.  Beyond, they are the length
    and a second hash of a salt of its own, so that with the first 128 bits and
    the length agree.
    """
    size, lanes = stops - starts, _lanes(data)
    out = np.empty((len(size), 2), np.uint64)
    out[:, 0] = lanes[starts] & _KEEP[np.minimum(size, 8)]
    out[:, 1] = lanes[starts + np.minimum(size, 8)] & _KEEP[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > 16)
    if len(long):
        out[long, 0] = size[long].astype(np.uint64)
        out[long, 1] = hashes(data, starts[long], stops[long], _OWN)
    return out


def hash_of(text: bytes) -> int:
    """The hash that ``hashes`` gives to these bytes."""
    data = np.frombuffer(text, np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def grams(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, in order, and where each row's runs begin."""
    counts = np.maximum(np.diff(at) - (k - 1), 0)
    ptr = np.concatenate(([0], np.cumsum(counts)))
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), ptr
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
    whole = np.ones(n, bool)
    for j in range(1, k):
        cut = at[1:] - j
        whole[cut[(cut >= at[:-1]) & (cut < n)]] = False
    return mix(h[whole]), ptr


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """The array, or one longer by a quarter with its rows, so that it has room for n rows."""
    if n <= len(held):
        return held
    out = np.empty((max(n, len(held) * 5 // 4), *held.shape[1:]), held.dtype)
    out[: len(held)] = held
    return out


class Ids:
    """A worker's memory of the ids of chunks that it has met: a hash table with open addresses.

    A hit counts only where ``exact`` agrees as well; a chunk that shares its
    hash with another is encoded each time.  It holds up to ``limit`` chunks and
    ``most`` ids and starts anew beyond, which changes no result.
    """

    def __init__(self, limit: int = 1_000_000, most: int = 8_000_000):
        self.limit, self.most = limit, most
        self._clear()

    def _clear(self) -> None:
        self.n, self.used = 0, 0
        self.keys, self.told = np.empty(1 << 14, np.uint64), np.empty((1 << 14, 2), np.uint64)
        self.at, self.size = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)
        self.pool = np.empty(1 << 16, np.int32)
        self._table(16)

    def _table(self, bits: int) -> None:
        self.bits, self.table = bits, np.full(1 << bits, -1, np.int32)
        self._put(np.arange(self.n, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, which: np.ndarray) -> None:
        """Give each of these keys, which are not in the table, the next free slot."""
        slot = self._slots(self.keys[which])
        while len(which):
            free = self.table[slot] < 0
            self.table[slot[free]] = which[free]
            left = self.table[slot] != which
            which, slot = which[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is held, or -1."""
        slot = self._slots(keys)
        found = self.table[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.table[slot]
            found[open_] = got
            more = (got >= 0) & (self.keys[got] != keys[open_])
            open_, slot = open_[more], slot[more]
        return found

    def encode(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, and how many each has.

        ``encode`` takes indices of chunks and gives their ids end to end and
        their counts; it is called for chunks not met before.
        """
        keys, told = hashes(data, starts, stops), exact(data, starts, stops)
        if self.n > self.limit or self.used > self.most:
            self._clear()
        where = self._find(keys)
        miss = np.flatnonzero(where < 0)
        if len(miss):
            _, first, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
            first = miss[first]
            flat, sizes = encode(first)
            n, m = self.n, self.n + len(first)
            for name, values in (("keys", keys[first]), ("told", told[first]), ("at", self.used + np.cumsum(sizes) - sizes), ("size", sizes)):
                held = _room(getattr(self, name), m)
                held[n:m] = values
                setattr(self, name, held)
            self.pool = _room(self.pool, self.used + len(flat))
            self.pool[self.used : self.used + len(flat)] = flat
            self.n, self.used = m, self.used + len(flat)
            if 2 * m > 1 << self.bits:
                self._table((4 * m).bit_length())
            else:
                self._put(np.arange(n, m, dtype=np.int32))
            where[miss] = n + inverse
        at, size, pool = self.at[where].astype(np.int64), self.size[where].astype(np.int64), self.pool
        other = np.flatnonzero((self.told[where] != told).any(1))
        if len(other):
            flat, sizes = encode(other)
            pool = np.concatenate((pool[: self.used], flat.astype(np.int32)))
            at[other], size[other] = self.used + np.cumsum(sizes) - sizes, sizes
        shift = at - (np.cumsum(size) - size)
        return pool[np.repeat(shift, size) + np.arange(int(size.sum()))], size


def per_row(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of rows among items, from the items' counts by chunk and the rows' first chunks."""
    return np.concatenate(([0], np.cumsum(sizes)))[at]
