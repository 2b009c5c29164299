"""Byte-level BPE encoding and decoding by segment trees over byte positions.

A text is cut into pieces by the vocabulary's pattern.  Each piece has a segment
tree over its byte positions; a leaf holds the rank of the pair that starts
there together with its position, so that the root is the leftmost pair of
minimum rank.  A merge changes three leaves (the pair's own, that of the token
that goes, and that of the live neighbour on the left) and their ancestors.
Trees of one width are worked side by side, one merge each a round; pieces that
are few and long have a tree each in plain Python.

Ranks are ids.  A piece that is a token as it stands gets that token even where
merging would end elsewhere; those tokens are found once, when the vocabulary
is loaded.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from kinloom.llm import textkernel as K

#: Bytes of text encoded and of ids decoded at once, and leaves of the trees that are built side by side.
BLOCK, DECODED, LEAVES = 1 << 20, 1 << 20, 1 << 18
#: Trees of one width from which they are worked side by side, if they are wider than ``NARROW``.
FEW, NARROW = 8, 64
_NONE = 1 << 40

#: The white space of the pattern's ``\s`` (Unicode's White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _WHITE = range(4)


@lru_cache(1)
def kinds() -> np.ndarray:
    """The class of each code point (letter, number, white space or other), as the tiktoken library's own tables have it."""
    import tiktoken

    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bytes_alone = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=bytes_alone, special_tokens={})
        out[[ord(c) for c in bytes(asked.encode_ordinary(every)).decode()]] = kind
    out[WHITE] = _WHITE
    return out


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character in valid UTF-8."""
    table = kinds()
    kind = table[data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        long = np.zeros(len(data) + 3, np.int64)
        long[: len(data)] = data
        first = long[wide]
        b, c, d = long[wide + 1] & 0x3F, long[wide + 2] & 0x3F, long[wide + 3] & 0x3F
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | b, np.where(first < 0xF0, (first & 0x0F) << 12 | b << 6 | c, (first & 0x07) << 18 | b << 12 | c << 6 | d))
        own = table[np.minimum(point, 0x10FFFF)]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        for k in range(4):
            kind[wide[size > k] + k] = own[size > k]
    return kind


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of a block of valid UTF-8 rows begin.

    This is what ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    matches from left to right: runs of one class; a run of white space before
    something else leaves its last character apart, and a blank there goes to
    the run behind it; an apostrophe that no blank stands before takes one of
    the seven endings.
    """
    n = len(data)
    lead = (data & 0xC0) != 0x80
    kind = classes(data)
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    row = np.zeros(n + 1, bool)
    row[ends] = True
    cut |= row
    white = kind == _WHITE
    stop = np.flatnonzero(cut[1:] & white & ~row[1:]) + 1  # ends of white space with something behind it in the row
    heads = np.flatnonzero(lead)
    last = heads[np.searchsorted(heads, stop) - 1]
    cut[last] = True
    blank = data[last] == 0x20
    cut[stop[blank]] = False
    mark = np.flatnonzero((data == 0x27) & cut[:-1])
    if len(mark):
        wide = np.zeros(n + 2, np.uint8)
        wide[:n] = data
        one, two = wide[mark + 1], wide[mark + 2]
        one = np.where(row[mark + 1], 0, one)
        two = np.where(row[np.minimum(mark + 2, n)], 0, two)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        for which, size in ((mark[short], 2), (mark[pair], 3)):
            cut[which + 1] = False
            cut[which + size] = True
        cut[ends] = True
    return np.flatnonzero(cut[:n])


class Vocabulary:
    """Ranks of byte strings, and what merging needs of them."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        known = np.array(pairs, np.int64).reshape(-1, 3)
        keys = known[:, 0] << 32 | known[:, 1]
        order = np.argsort(keys)
        self.keys, self.joined = np.append(keys[order], np.iinfo(np.int64).max), np.append(known[order, 2], _NONE)
        self.pair = dict(zip(keys.tolist(), known[:, 2].tolist(), strict=True))
        size = max(ranks.values()) + 1
        raw = [b""] * size
        for t, i in ranks.items():
            raw[i] = t
        self.at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.whole: dict[bytes, int] = {}
        tokens = [t for t in ranks if len(t) > 1]
        ids, counts = self.merge(tokens)
        first = ids[np.cumsum(counts) - counts]
        self.whole = {t: ranks[t] for k, t in enumerate(tokens) if counts[k] != 1 or first[k] != ranks[t]}
        self.memory = K.Ids()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs, or a rank beyond all."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end and their counts; no piece is empty."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        level = np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        groups = []
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            width = 1 << int(k)
            if width > NARROW and len(own) < FEW:
                for i in own:
                    ids = self._alone(pieces[i], width)
                    groups.append((own[own == i], ids, np.array([len(ids)])))
                continue
            step = max(1, LEAVES // width)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                groups.append((part, *self._together([pieces[i] for i in part], sizes[part], width)))
        counts = np.zeros(len(pieces), np.int64)
        for own, _, n in groups:
            counts[own] = n
        flat, at = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for own, ids, n in groups:
            flat[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        if odd := [i for i, piece in enumerate(pieces) if piece in self.whole] if self.whole else []:
            drop = np.zeros(len(flat), bool)
            for i in odd:
                drop[at[i] + 1 : at[i] + counts[i]] = True
                flat[at[i]], counts[i] = self.whole[pieces[i]], 1
            flat = flat[~drop]
        return flat, counts

    def _together(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Trees of one width side by side, one merge each a round: ids end to end and counts."""
        m = len(pieces)
        data = np.zeros((m, width), np.uint8)
        place = np.arange(width)
        data[place < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        token = np.zeros((m, width + 1), np.int64)
        token[:, :width] = self.byte[data]
        after = np.broadcast_to(np.arange(1, width + 2), (m, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (m, width + 1)).copy()
        rank = np.full((m, width), _NONE, np.int64)
        rank[:, :-1] = self.rank(token[:, : width - 1], token[:, 1:width])
        rank[place >= (sizes - 1)[:, None]] = _NONE
        tree = np.empty((m, 2 * width), np.int64)
        tree[:, width:] = rank * width + place
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        gone = place >= sizes[:, None]
        live = np.flatnonzero(tree[:, 1] < _NONE * width)
        while len(live):
            best = tree[live, 1]
            at = best % width
            right = after[live, at]
            token[live, at] = best // width
            gone[live, right] = True
            end = after[live, right]
            after[live, at], before[live, end] = end, at
            left = before[live, at]
            own = np.where(end < sizes[live], self.rank(token[live, at], token[live, end]), _NONE)
            prior = np.where(left >= 0, self.rank(token[live, np.maximum(left, 0)], token[live, at]), _NONE)
            rows = np.concatenate((live, live, live[left >= 0]))
            leaf = np.concatenate((right, at, left[left >= 0]))
            tree[rows, width + leaf] = np.concatenate((np.full(len(live), _NONE), own, prior[left >= 0])) * width + leaf
            node = (width + leaf) // 2
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node //= 2
            live = live[tree[live, 1] < _NONE * width]
        keep = ~gone
        return token[:, :width][keep], keep.sum(1)

    def _alone(self, piece: bytes, width: int) -> np.ndarray:
        """One long piece: the same tree in a list; a climb ends where nothing changes."""
        n, pair = len(piece), self.pair
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = _NONE * width
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (r := pair.get(token[i] << 32 | token[i + 1])) is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i, value):
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    return
                tree[i] = least

        def ranked(i, j):
            r = pair.get(token[i] << 32 | token[j])
            return none if r is None else r * width + i

        while (best := tree[1]) < none:
            at = best % width
            right = after[at]
            token[at], token[right] = best // width, -1
            put(right, none)
            end, left = after[right], before[at]
            after[at] = end
            if end < n:
                before[end] = at
            put(at, ranked(at, end) if end < n else none)
            if left >= 0:
                put(left, ranked(left, at))
        return np.array([t for t in token if t >= 0], np.int64)

    def encode(self, data: np.ndarray, ends: np.ndarray, pattern: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's rows of valid UTF-8 end to end and the rows' offsets; without a pattern, ``cuts`` makes the pieces."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        whole = data.tobytes()
        if pattern is None:
            starts = cuts(data, ends)
            stops = np.append(starts[1:], len(data))
        else:
            starts, stops = _matches(pattern, whole, ends)

        def new(which):
            return self.merge([whole[a:b] for a, b in zip(starts[which].tolist(), stops[which].tolist(), strict=True)])

        ids, sizes = self.memory.encode(data, starts, stops, new)
        return ids, K.per_row(sizes, np.searchsorted(starts, ends))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids end to end and the rows' offsets; ids that are none give nothing."""
        good = (ids >= 0) & (ids < len(self.at) - 1)
        ids = np.where(good, ids, 0)
        size = np.where(good, self.at[ids + 1] - self.at[ids], 0)
        to = np.concatenate(([0], np.cumsum(size)))
        return self.raw[np.repeat(self.at[ids] - to[:-1], size) + np.arange(int(to[-1]))], to[ends]


def _matches(pattern: str, whole: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a pattern's matches in each row; what no match covers is left out."""
    import regex

    found, compiled = [], regex.compile(pattern)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        text = whole[a:b].decode()
        place = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))) + a
        found += [(place[m.start()], place[m.end()]) for m in compiled.finditer(text) if m.end() > m.start()]
    spots = np.array(found, np.int64).reshape(-1, 2)
    return spots[:, 0].copy(), spots[:, 1].copy()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """A worker loads a file of ranks once."""
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _valid(column: pa.Array) -> pa.Array:
    """The texts with bytes that are no UTF-8 as U+FFFD; null is empty."""
    data, ends = K.blob(column)
    whole = data.tobytes()
    try:
        whole.decode()
        return column
    except UnicodeDecodeError:
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.large_string())


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", pattern: str | None = None) -> DataFrame:
    """The rows with their ids added, as a binary of little-endian unsigned 32-bit integers; a column of that name is replaced.

    Equal to the tiktoken library's ``encode_ordinary`` with the ranks in
    ``path`` and the pattern that ``cuts`` describes, or another ``pattern``.
    Null and empty texts give an empty binary, bytes that are no UTF-8 count as
    U+FFFD, repeated rows are encoded each, other columns stay as they are, and
    an empty table gives an empty result.  A piece of any length is one tree.
    """
    path = path or default_ranks()
    docs = docs.drop(ids)

    def run(batches):
        model = vocabulary(path)
        for part, _, _ in K.blocks(batches, text, BLOCK):
            data, ends = K.blob(_valid(part.column(part.schema.get_field_index(text))))
            flat, at = model.encode(data, ends, pattern)
            packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([*part.columns, packed], [*part.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids added as a binary; a column of that name is replaced.

    Null and empty ids give an empty binary; ids that the ranks don't have, and
    bytes behind the last whole id, give nothing.
    """
    path = path or default_ranks()
    rows = rows.drop(out)

    def run(batches):
        model = vocabulary(path)
        for part, data, ends in K.blocks(batches, ids, DECODED):
            size = np.diff(ends) // 4
            to = np.concatenate(([0], np.cumsum(size)))
            if (np.diff(ends) % 4).any():
                data = np.concatenate([data[a : a + 4 * n] for a, n in zip(ends[:-1], size, strict=True)])
            raw, at = model.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), to)
            held = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
            yield pa.RecordBatch.from_arrays([*part.columns, held], [*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))
