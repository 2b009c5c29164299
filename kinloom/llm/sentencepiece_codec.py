"""SentencePiece encoding and decoding by suffix-array matching.

A batch's chunks that are new to a worker are laid end to end, each behind a
separator, and all suffixes are sorted by as many characters as the longest
piece has.  A binary search of every piece gives the range of its occurrences;
these are the edges of the segmentation graph, sorted by position.

The model here is a BPE model, whose encoding isn't the path of highest score.
Relaxing the edges therefore goes by BPE's own order: of all edges that join two
neighbouring symbols of a chunk, the one of the best score (leftmost if equal) is
taken until none is left.  Short chunks are relaxed side by side, one edge of
each a round; long ones one by one with a heap.  The result equals that of the
sentencepiece library.

No piece crosses from a character to a following blank, so a chunk is a run of
blanks and the characters up to the next; that is verified for each model.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from kinloom.llm import textkernel as K

BLANK = "\u2581"
#: Characters of a chunk up to which chunks are relaxed side by side, and characters indexed at once.
SHORT, INDEXED = 48, 125_000
#: Bytes of text encoded and ids decoded at once.
BLOCK, DECODED = 512 << 10, 250_000


class Pieces:
    """A model's pieces, packed for searching."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        text = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.byte = np.full(256, model.unk_id(), np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(text[i][1:-1], 16)] = i
        self.split = not any(BLANK in text[i].lstrip(BLANK) for i in normal)
        self.single = {text[i]: i for i in normal if len(text[i]) == 1}
        long = [i for i in normal if len(text[i]) > 1]
        self.depth = max([2, *(len(text[i]) for i in long)])
        letters = sorted({c for i in normal for c in text[i]})
        if len(letters) >= 65_000:
            raise ValueError("the pieces have too many characters")
        self.code = {c: k + 2 for k, c in enumerate(letters)}  # 0: separator, 1: any other character
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.lanes = -(-self.depth // 4)
        self.ids = np.array(long, np.int64)
        self.sizes = np.array([len(text[i]) for i in long], np.int64)
        codes = np.zeros((len(long), self.lanes * 4), np.uint64)
        for row, i in enumerate(long):
            codes[row, : len(text[i])] = [self.code[c] for c in text[i]]
        self.low = self._pack(codes)
        codes[np.arange(codes.shape[1]) >= self.sizes[:, None]] = 0xFFFF
        self.high = self._pack(codes)
        order = np.unique([-model.get_score(i) for i in long], return_inverse=True)[1] if long else np.zeros(0, np.int64)
        self.rank = np.full(n + 1, 1 << 30, np.int64)
        self.rank[self.ids + 1] = order
        raw = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(text[i][1:-1], 16)]) if model.is_byte(i) else text[i].replace(BLANK, " ").encode() for i in range(n)]
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.memory = K.Ids(500_000, 4_000_000)

    def _pack(self, codes: np.ndarray) -> np.ndarray:
        """Rows of codes as lanes of four."""
        c = codes.reshape(len(codes), self.lanes, 4)
        return (c[..., 0] << np.uint64(48)) | (c[..., 1] << np.uint64(32)) | (c[..., 2] << np.uint64(16)) | c[..., 3]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all pieces of two or more characters, by position: positions, sizes, ids."""
        n = len(codes)
        wide = np.concatenate((codes, np.zeros(self.lanes * 4, np.uint64)))
        lanes = [(wide[i : i + n] << np.uint64(48)) | (wide[i + 1 : i + 1 + n] << np.uint64(32)) | (wide[i + 2 : i + 2 + n] << np.uint64(16)) | wide[i + 3 : i + 3 + n] for i in range(0, self.lanes * 4, 4)]
        suffixes = np.lexsort(lanes[::-1])
        lanes = [x[suffixes] for x in lanes]

        def compared(at, wanted):
            """Whether the suffixes at these places are below the wanted lanes, and whether they equal them."""
            less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
            for k, lane in enumerate(lanes):
                have, want = lane[at], wanted[:, k]
                less |= equal & (have < want)
                equal &= have == want
            return less, equal

        def search(wanted, lo, after):
            """The first suffix, from lo on, that isn't below the wanted lanes (or that is above them)."""
            lo, hi = lo.copy(), np.full(len(wanted), n)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                less, equal = compared(mid, wanted[open_])
                if after:
                    less |= equal
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            return lo

        first = search(self.low, np.zeros(len(self.low), np.int64), False)
        last = first.copy()
        inside = np.flatnonzero(first < n)
        held = inside[np.logical_or(*compared(first[inside], self.high[inside]))]  # pieces that occur at all
        last[held] = search(self.high[held], first[held], True)
        count = last - first
        shift = first - (np.cumsum(count) - count)
        at = suffixes[np.repeat(shift, count) + np.arange(int(count.sum()))]
        piece = np.repeat(np.arange(len(count)), count)
        order = np.argsort(at, kind="stable")
        return at[order], self.sizes[piece[order]], self.ids[piece[order]]

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end and their counts."""
        flat, counts, i = [], [], 0
        while i < len(chunks):
            j, size = i, 0
            while j < len(chunks) and (j == i or size + len(chunks[j]) < INDEXED):
                size += len(chunks[j]) + 1
                j += 1
            f, c = self._some(chunks[i:j])
            flat.append(f), counts.append(c)
            i = j
        return np.concatenate([np.zeros(0, np.int32), *flat]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _some(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\0".join(chunks) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        spot = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        codes = np.where(self.letters[spot] == points, spot + 2, 1).astype(np.uint64)
        lengths = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(lengths + 1) - lengths - 1
        codes[begin + lengths] = 0
        at, size, ids = self.edges(codes)
        table = np.zeros(len(codes) * (self.depth + 1), np.int32)
        table[at * (self.depth + 1) + size] = ids + 1

        starts, sizes = [], []
        small = np.flatnonzero(lengths <= SHORT)
        n = lengths[small]
        word = np.repeat(np.arange(len(small)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[small], n)
        width = np.ones(len(start), np.int64)
        while len(start):
            joined = width[:-1] + width[1:]
            fits = (word[:-1] == word[1:]) & (joined <= self.depth)
            rank = np.full(len(start), 1 << 30, np.int64)
            rank[:-1][fits] = self.rank[table[start[:-1][fits] * (self.depth + 1) + joined[fits]]]
            new = np.concatenate(([True], word[1:] != word[:-1]))
            heads = np.flatnonzero(new)
            best = np.minimum.reduceat((rank << 31) | np.arange(len(start)), heads)
            live = (best >> 31) < 1 << 30
            take = best[live] & 0x7FFFFFFF
            width[take] += width[take + 1]
            keep = np.ones(len(start), bool)
            keep[take + 1] = False
            done = ~np.repeat(live, np.diff(np.append(heads, len(start))))
            starts.append(start[done]), sizes.append(width[done])
            keep &= ~done
            start, width, word = start[keep], width[keep], word[keep]
        for k in np.flatnonzero(lengths > SHORT):
            s, w = self._heap(table, int(begin[k]), int(lengths[k]))
            starts.append(s), sizes.append(w)
        start, width = np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *sizes])
        order = np.argsort(start)
        start, width = start[order], width[order]
        out = table[start * (self.depth + 1) + np.minimum(width, self.depth)] - 1
        count = np.ones(len(start), np.int64)
        lone = np.flatnonzero(width == 1)
        kinds, inverse = np.unique(points[start[lone]], return_inverse=True)
        known = np.array([self.single.get(chr(p), -1) for p in kinds], np.int64)
        out[lone] = known[inverse]
        odd = np.flatnonzero(out < 0)
        spelled = [self.byte[np.frombuffer(chr(points[start[i]]).encode("utf-8", "surrogatepass"), np.uint8)] for i in odd]
        count[odd] = [len(b) for b in spelled]
        flat = np.repeat(out, count)
        head = np.cumsum(count) - count
        for i, b in zip(odd, spelled, strict=True):
            flat[head[i] : head[i] + len(b)] = b
        return flat, np.add.reduceat(count, np.searchsorted(start, begin)) if len(count) else np.zeros(len(chunks), np.int64)

    def _heap(self, table: np.ndarray, begin: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        width, left, right = [1] * n, list(range(-1, n - 1)), [*range(1, n), -1]
        span, rank, queue = self.depth + 1, self.rank, []
        own = table[begin * span : (begin + n) * span]

        def offer(i):
            j = right[i] if i >= 0 else -1
            if j >= 0 and (w := width[i] + width[j]) < span and (p := own[i * span + w]):
                heapq.heappush(queue, (int(rank[p]), i, w))

        for i in range(n):
            offer(i)
        while queue:
            _, i, w = heapq.heappop(queue)
            j = right[i]
            if not width[i] or j < 0 or width[i] + width[j] != w:
                continue
            width[i], width[j], right[i] = w, 0, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i]), offer(i)
        start = np.array([i for i in range(n) if width[i]], np.int64)
        return start + begin, np.array([w for w in width if w], np.int64)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's rows end to end and the rows' offsets; each row is empty or starts with a blank."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        blank = data == 0x20
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        if not self.split:
            head[:] = False
        head[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(head)
        stops = np.append(starts[1:], len(data))
        whole = data.tobytes()

        def new(which):
            return self.segment([whole[a:b].decode("utf-8", "replace").replace(" ", BLANK) for a, b in zip(starts[which].tolist(), stops[which].tolist(), strict=True)])

        ids, sizes = self.memory.encode(data, starts, stops, new)
        return ids, K.per_row(sizes, np.searchsorted(starts, ends))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Texts of rows of ids, without the blank put before them."""
        ids = np.where((ids >= 0) & (ids < len(self.raw_at) - 1), ids, 0)
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        at = np.concatenate(([0], np.cumsum(size)))
        data = self.raw[np.repeat(self.raw_at[ids] - at[:-1], size) + np.arange(int(at[-1]))].tobytes()
        cut = at[ends].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """A worker loads a model once."""
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with an array of piece ids added; a column of that name is replaced.

    Equal to the library's encoding without start and end ids.  Null and empty
    texts give an empty array.  Repeated rows are encoded each; other columns
    stay as they are; an empty table gives an empty result.
    """
    path = path or default_model()
    docs = docs.drop(ids)

    def run(batches):
        model = pieces(path)
        at_text = None
        for part, _, _ in K.blocks(batches, text, BLOCK):  # small slices, so that no copy of a whole batch is made
            at_text = part.schema.get_field_index(text) if at_text is None else at_text
            column = pc.replace_substring(part.column(at_text).fill_null(""), BLANK, " ")
            data, ends = K.blob(pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, "")))
            flat, at = model.encode(data, ends)
            arrays = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns, arrays], [*part.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of their ids added; a column of that name is replaced.

    Null and empty arrays give an empty text, null ids and ids out of range
    nothing, and bytes that are no UTF-8 U+FFFD.
    """
    path = path or default_model()
    rows = rows.drop(text)

    def run(batches):
        model = pieces(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            row = 0
            while row < len(batch):  # rows of about DECODED ids at a time
                last = max(row + 1, int(np.searchsorted(ends, ends[row] + DECODED, "right")) - 1)
                part = column.slice(row, last - row)
                got = model.decode(part.flatten().fill_null(0).to_numpy(zero_copy_only=False), ends[row : last + 1] - ends[row])
                yield pa.RecordBatch.from_arrays([*batch.slice(row, last - row).columns, pa.array([t.decode("utf-8", "replace") for t in got], pa.string())], [*batch.schema.names, text])
                row = last

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
