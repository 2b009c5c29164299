"""String similarity on 0 to 100: InDel ratio, token-sort ratio, partial ratio.

Pairs are worked by whole Arrow batches.  A string of up to 64 characters is a
word of bits; the common subsequence advances by one character of the other
string for all pairs at once.  The partial ratio sweeps once over the longer
string with a word for each stretch that is open.  Longer strings are worked
one by one, with Python's long numbers as words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
#: Words that a step holds at most: pairs times letters, and pairs times open stretches.
_HELD = 1 << 21


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """Twice the common subsequence over both lengths, in percent, rounded half to even."""
    total = len(a) + len(b)
    return round(200 * lcs(a, b) / total) if total else 0


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter string against stretches of the longer one.

    Stretches are as long as the shorter string; at either end of the longer
    one they may be cut short.  Strings of equal length are tried both ways.
    """

    def best(short, long):
        n, m = len(short), len(long)
        return max((ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, m)), default=0)

    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    return max(best(short, long), best(long, short)) if len(short) == len(long) else best(short, long)


class Strings:
    """Strings as rows of letter numbers, which several such tables may share."""

    def __init__(self, *columns: list[str]):
        texts = [t for column in columns for t in column]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if points.max(initial=0) < 1 << 16:  # letters are numbered by a table, without a sort
            known = np.bincount(points, minlength=1) > 0
            self.letters, codes = np.flatnonzero(known), (np.cumsum(known, dtype=np.int32) - 1)[points]
        else:
            self.letters, codes = np.unique(points, return_inverse=True)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(sizes.max(initial=0))
        table = np.full((len(texts), max(width, 1)), len(self.letters), np.int32)
        table[np.arange(max(width, 1)) < sizes[:, None]] = codes
        cut = np.cumsum([len(c) for c in columns])[:-1]
        self.codes, self.sizes, self.texts = np.split(table, cut), np.split(sizes, cut), columns


def _masks(codes: np.ndarray, sizes: np.ndarray, letters: int) -> np.ndarray:
    """For each string and letter a word with a bit at each of the letter's places."""
    out = np.zeros((len(codes), letters + 1), np.uint64)
    rows = np.arange(len(codes))
    for i in range(int(sizes.max(initial=0))):
        out[rows, codes[:, i]] |= np.uint64(1 << i)
    out[:, letters] = 0
    return out


def _percent(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, np.rint(200 * common / np.maximum(total, 1)), 0).astype(np.int32)


def _ratios(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, letters: int) -> np.ndarray:
    masks, rows = _masks(a, n, letters), np.arange(len(a))
    full = np.where(n >= WORD, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, WORD - 1).astype(np.uint64)) - np.uint64(1))
    row = full.copy()
    for j in range(int(m.max(initial=0))):
        hit = row & masks[rows, b[:, j]]  # behind a string's end no letter hits
        row = (row + hit) | (row - hit)
    return _percent(n - np.bitwise_count(row & full).astype(np.int64), n + m)


def _partials(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, letters: int) -> np.ndarray:
    """``a`` against the stretches of ``b``, which isn't shorter; stretch i covers the places from i - n + 1 to i."""
    masks, rows = _masks(a, n, letters), np.arange(len(a))
    full = np.where(n >= WORD, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, WORD - 1).astype(np.uint64)) - np.uint64(1))
    longest, width = int(m.max(initial=0)), int(n.max(initial=0))
    open_ = np.repeat(full[:, None], width, 1)  # stretches by when they end, modulo the width
    best = np.zeros(len(a), np.int32)
    for j in range(longest + width):
        hit = open_ & masks[rows, b[:, j]][:, None] if j < longest else None
        if hit is not None:
            open_ = (open_ + hit) | (open_ - hit)
        # The stretch that ends at place e is over after e; a pair's own width is n, so it is the one opened n - 1 places before.
        start = j - n + 1
        ends = (start < m) & (n > 0)
        size = np.minimum(j + 1, m) - np.maximum(start, 0)
        word = open_[rows, start % width]
        common = n - np.bitwise_count(word & full).astype(np.int64)
        best = np.where(ends & (size > 0), np.maximum(best, _percent(common, n + size)), best)
        open_[:, (j + 1) % width] = full
    return best


def _batched(work, a: list[str | None], b: list[str | None]) -> np.ndarray:
    """``work`` over equal lists, strings that are too long one by one; -1 where a string is null."""
    out = np.full(len(a), -1, np.int32)
    plain = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    fits = [i for i in plain if len(a[i]) <= WORD and len(b[i]) <= WORD]
    alone = ratio if work is _ratio_work else partial_ratio
    if len(fits) < len(plain):
        for i in set(plain) - set(fits):
            out[i] = alone(a[i], b[i])
    if fits:
        out[fits] = work([a[i] for i in fits], [b[i] for i in fits])
    return out


def _ratio_work(a: list[str], b: list[str]) -> np.ndarray:
    table = Strings(a, b)
    return ratios(table, np.arange(len(a)), np.arange(len(b)))


def _partial_work(a: list[str], b: list[str]) -> np.ndarray:
    table = Strings(a, b)
    return partials(table, np.arange(len(a)), np.arange(len(b)))


def ratios(table: Strings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ratios of pairs of rows of the table's two columns."""
    (a, b), (n, m), letters = table.codes, table.sizes, len(table.letters)
    step = max(1, _HELD // (letters + 1))
    return np.concatenate([np.zeros(0, np.int32), *(_ratios(a[x[i : i + step]], n[x[i : i + step]], b[y[i : i + step]], m[y[i : i + step]], letters) for i in range(0, len(x), step))])


def partials(table: Strings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Partial ratios of pairs of rows of the table's two columns; equal lengths are tried both ways."""
    (a, b), (n, m), letters = table.codes, table.sizes, len(table.letters)
    out = np.zeros(len(x), np.int32)
    step = max(1, _HELD // (letters + 1 + int(max(n.max(initial=0), m.max(initial=0)))))
    for which, s, t, own, ls, lt in ((n[x] <= m[y], a, b, (x, y), n, m), (n[x] >= m[y], b, a, (y, x), m, n)):
        at = np.flatnonzero(which)
        for i in range(0, len(at), step):
            part = at[i : i + step]
            p, q = own[0][part], own[1][part]
            out[part] = np.maximum(out[part], _partials(s[p], ls[p], t[q], lt[q], letters))
    return out


def _answer(work, a: pa.Array, b: pa.Array) -> pa.Array:
    found = _batched(work, a.to_pylist(), b.to_pylist())
    return pa.array(found, pa.int32(), mask=found < 0)


@F.arrow_udf(T.IntegerType())
def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return _answer(_ratio_work, a, b)


@F.arrow_udf(T.IntegerType())
def _partial(a: pa.Array, b: pa.Array) -> pa.Array:
    return _answer(_partial_work, a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def in_order(name: Column) -> Column:
    """The words in order, with single blanks."""
    return F.array_join(F.array_sort(F.split(name, " +")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The ratio of both strings with their words in order."""
    return _ratio(in_order(a), in_order(b))


def partial_indel_ratio(a: Column, b: Column) -> Column:
    return _partial(a, b)
