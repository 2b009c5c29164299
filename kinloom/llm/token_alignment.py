"""Alignment of two tokenizers' tokens of the same texts, by relational steps.

Where neither tokenizer has a token across a place, whatever stands around it, a
text is cut: before a blank or line break that follows no white space, around a line
break that ends white space, and between letters and marks of ASCII.  What lies between two cuts, a unit,
is aligned alone, and a text's alignment is its units' alignments end to end.  A
first pass deals documents to parts and finds each part's distinct units; what is
distinct among all parts goes through both tokenizers once.  Then:

1. lengths in bytes, taken from the vocabulary, are summed up over a batch of units: each token's
   end; both sides of a batch are the same bytes, and each unit's end is a cut;
2. an equi-join of the sorted ends finds the cuts, where tokens of both end, and with them the
   links between the tokens that end there, and the groups of tokens between cuts;
3. links are counted over the corpus, and counts are joined back to the links;
4. aligned units go to the parts that have them, and each part's documents, kept as
   unit numbers, are put together from them.

Nothing is written by document: the groups of a text are many times longer than its
share of distinct units, so they are made as the result is read.

A pair of tokenizers that isn't known to keep such places apart is aligned by whole texts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import byte_bpe
from kinloom.llm import textkernel as K
from kinloom.llm.repair_store import Encoder
from kinloom.llm.scratch import Scratch
from kinloom.llm.sentencepiece_codec import BLANK, Pieces, default_model

#: Bytes of text in a part, bytes encoded at once, rows of a batch, pairs up to which their counts are broadcast, and words aligned at once.
PART, BLOCK, ROWS, BROADCAST, WORDS = 24 << 20, 512 << 10, 50_000, 1_000_000, 20_000
#: Chunks and ids that a worker remembers of each tokenizer; it has two, so less of each.
MEMORY = 200_000, 1_600_000
#: B's sign for a blank, which it doesn't give back.
_BLANK = BLANK.encode()
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[0x21:0x30] = _MARK[0x3A:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = True


class ByteLevel(Encoder):
    """A byte-level BPE of the tokenizers library that reads special tokens' strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model.encode_special_tokens = True
        self.added = []
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from U+0100 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        raw = [b""] * self.first
        for token, i in self.model.get_vocab().items():
            raw[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else b""
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.memory = K.Ids(*MEMORY)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """A worker loads a model once."""
    model = Pieces(path)
    model.memory = K.Ids(*MEMORY)
    return model


@lru_cache(2)
def byte_level(path: str) -> ByteLevel:
    """A worker loads a tokenizer once."""
    return ByteLevel(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokens(model, words: pa.Array) -> pa.Array:
    """Ids of each word's tokens; null where they don't join to the word's bytes."""
    ids, counts, good = [], [], []
    for _, data, ends in K.blocks([pa.RecordBatch.from_arrays([words], ["text"])], limit=BLOCK):
        flat, at = model.encode(data, ends)
        size = model.raw_at[flat + 1] - model.raw_at[flat]
        to = np.concatenate(([0], np.cumsum(size)))
        raw = model.raw[np.repeat(model.raw_at[flat] - to[:-1], size) + np.arange(int(to[-1]))]
        same = to[at] == ends if len(to) else np.zeros(len(ends), bool)
        if len(raw) == len(data) and same.all():
            differ = np.flatnonzero(raw != data)
            fits = np.ones(len(ends) - 1, bool)
            fits[np.searchsorted(ends, differ, "right") - 1] = False
        else:
            raw, data = raw.tobytes(), data.tobytes()
            fits = np.array([raw[to[a] : to[b]] == data[c:d] for a, b, c, d in zip(at[:-1], at[1:], ends[:-1], ends[1:], strict=True)], bool)
        ids.append(flat), counts.append(np.diff(at)), good.append(fits)
    at = pa.array(np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts])))).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)), mask=pa.array(~np.concatenate([np.zeros(0, bool), *good])))


@lru_cache(2)
def rules(a_path: str, b_path: str) -> tuple[bool, bool, bool]:
    """Whether texts may be cut at all, at line breaks, and between letters and marks."""
    b = pieces(b_path)
    raw = b.raw.tobytes()
    long = [np.frombuffer(raw[x:y], np.uint8) for x, y in zip(b.raw_at[:-1].tolist(), b.raw_at[1:].tolist(), strict=True) if y - x > 1]
    lines = not any((p == 0x0A).any() for p in long)
    marks = not any(((_LETTER[p[:-1]] & _MARK[p[1:]]) | (_MARK[p[:-1]] & _LETTER[p[1:]])).any() for p in long)
    return byte_level(a_path).cut and b.split, lines, marks


def heads(data: np.ndarray, ends: np.ndarray, may: tuple[bool, bool, bool]) -> np.ndarray:
    """Where the units of a block of valid UTF-8 rows begin."""
    head = np.zeros(len(data), bool)
    if may[0] and len(data) > 1:
        white = byte_bpe.classes(data) == byte_bpe._WHITE
        gap = data == 0x20
        if may[1]:
            line = data == 0x0A
            gap |= line
            lone = line[:-1] & ~white[1:]  # a break that ends white space is a token of its own, if something follows in the row
            lone[ends[(ends > 0) & (ends < len(data))] - 1] = False
            head[1:] |= lone
            head[:-1] |= lone
        head[1:] |= gap[1:] & ~white[:-1]
        if may[2]:
            letter, mark = _LETTER[data], _MARK[data]
            head[1:] |= (letter[:-1] & mark[1:]) | (mark[:-1] & (data[:-1] != 0x27) & letter[1:])
    head[ends[:-1][np.diff(ends) > 0]] = True
    return np.flatnonzero(head)


def complete(a_path: str, b_path: str) -> bool:
    """Whether both tokenizers have a token for each byte, so that they render any text but what stands for a blank in B."""
    a, b = byte_level(a_path), pieces(b_path)
    alone = {a.raw[x] for x, y in zip(a.raw_at[:-1].tolist(), a.raw_at[1:].tolist(), strict=True) if y - x == 1}
    return len(alone) == 256 and len(set(b.byte.tolist())) == 256


_PARTS = "part long, unit int, n long, word binary, row int, doc_ids array<long>, sizes array<int>, units binary"
_ARROW = pa.schema([
    ("part", pa.int64()), ("unit", pa.int32()), ("n", pa.int64()), ("word", pa.binary()), ("row", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("units", pa.binary()),
])


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, compressed."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True) if len(numbers) else b""


def unpack(packed: bytes, size: int) -> np.ndarray:
    """What ``pack`` was given: ``size`` numbers."""
    if not size:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * size), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _ARROW], schema=_ARROW)


def _part(number: int, docs: list, may: tuple[bool, bool, bool]):
    """Batches of a part's units, and blocks of its documents as unit numbers; those that aren't rendered byte for byte have none."""
    ids, arrays, sizes, sound = [], [], [], []
    for doc_id, data, ends, valid in docs:
        starts = heads(data, ends, may)
        offsets = np.append(starts, len(data)).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]))
        sizes.append(np.diff(np.searchsorted(starts, ends)))
        ids.append(doc_id), sound.append(valid)
    coded = pa.chunked_array(arrays, pa.binary()).combine_chunks().dictionary_encode()
    words, place = coded.dictionary, coded.indices.to_numpy()
    size, sound = np.concatenate(sizes), np.concatenate(sound)
    sound = sound & (size > 0)
    counts = np.bincount(place[np.repeat(sound, size)], minlength=len(words))
    order = np.argsort(-counts, kind="stable")  # small numbers are frequent, which packs well
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words))
    place, used = rank[place], int((counts > 0).sum())  # units of documents without tokens are left out
    for i in range(0, used, ROWS):
        part = order[i : min(i + ROWS, used)]
        yield _batch(len(part), part=pa.array(np.full(len(part), number)), unit=pa.array(np.arange(i, i + len(part), dtype=np.int32)), n=pa.array(counts[part]), word=words.take(pa.array(part)))
    names, at, row = pa.chunked_array(ids).combine_chunks(), np.concatenate(([0], np.cumsum(size))), 0
    while row < len(size):
        last = max(row + 1, int(np.searchsorted(at, at[row] + 5 * ROWS, "right")) - 1)
        own, kept = size[row:last] * sound[row:last], np.repeat(sound[row:last], size[row:last])
        whole = [pa.ListArray.from_arrays(pa.array([0, last - row], pa.int32()), x) for x in (names.slice(row, last - row), pa.array(own.astype(np.int32)))]
        units = pa.array([pack(place[at[row] : at[last]][kept])], pa.binary())
        yield _batch(1, part=pa.array([number]), row=pa.array([row], pa.int32()), doc_ids=whole[0], sizes=whole[1], units=units)
        row = last


def parted(docs: DataFrame, may: tuple[bool, bool, bool], part_bytes: int) -> DataFrame:
    """Rows of two kinds: a part's distinct units, the most frequent first, and blocks of its documents as unit numbers."""

    def run(batches):
        task, made, held, room = TaskContext.get().partitionId(), 0, [], 0
        for block, data, ends in K.blocks(batches, "text", BLOCK):
            whole = data.tobytes()
            rows = [whole[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            valid = np.array([_BLANK not in r for r in rows]) if _BLANK in whole else np.ones(len(rows), bool)
            try:
                whole.decode()
            except UnicodeDecodeError:
                valid &= np.array([r.decode("utf-8", "ignore").encode() == r for r in rows])
            if not valid.all():  # documents without tokens are empty here
                rows = [r if v else b"" for r, v in zip(rows, valid, strict=True)]
                data, ends = np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            full = np.diff(ends) > 0  # a blank before each text that isn't empty
            spaced = np.insert(data, ends[:-1][full], 0x20)
            held.append((block.column(0), spaced, ends + np.concatenate(([0], np.cumsum(full))), valid))
            room += len(spaced)
            if room >= part_bytes:
                yield from _part(task << 20 | made, held, may)
                made, held, room = made + 1, [], 0
        if held:
            yield from _part(task << 20 | made, held, may)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _PARTS)


def _lists(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def _aligned(words: pa.Array, a_path: str, b_path: str) -> list[pa.Array]:
    """Words' numbers of tokens, groups and links, of both tokenizers' tokens laid end to end."""
    ends, ids, at, sides = [], [], [], []
    for model in (byte_level(a_path), pieces(b_path)):
        found = _tokens(model, words)
        if found.null_count:
            raise ValueError("a tokenizer doesn't render a word byte for byte")
        ids.append(found.flatten().to_numpy()), at.append(np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy()))))
        ends.append(np.cumsum(model.raw_at[ids[-1] + 1] - model.raw_at[ids[-1]]))
    met = np.searchsorted(ends[1], ends[0])  # where B's first token ends that doesn't end before A's
    cut = np.flatnonzero(ends[1][met] == ends[0])
    cuts = [cut, met[cut]]
    for i, c in zip(ids, cuts, strict=True):
        sides.append(pc.binary_join(_lists(np.concatenate(([0], c + 1)), pa.array(i).cast(pa.string())), ","))
    of = np.searchsorted(cut, at[0])  # each word's first cut
    groups = pc.binary_join(_lists(of, pc.binary_join_element_wise(*sides, "|")), ";")
    links = _lists(of, pa.array(ids[0][cuts[0]].astype(np.int64) << 32 | ids[1][cuts[1]]))
    return [*(pa.array(np.diff(x).astype(np.int64)) for x in at), groups, links]


def aligned(units: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Distinct units ``word, n, places`` with their alignment instead of the word.

    ``n_a``, ``n_b`` tokens, ``groups`` (ids of A, comma-joined, a bar, ids of B; groups joined by
    semicolons) and ``links``, an array of id pairs as A * 2^32 + B.  A word that one of the
    tokenizers doesn't render byte for byte ends the job.
    """

    def run(batches):
        for batch in batches:
            for row in range(0, len(batch), WORDS):
                part = batch.slice(row, WORDS)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *_aligned(part.column(0), a_path, b_path)], ["n", "places", "n_a", "n_b", "groups", "links"])

    return units.select("word", "n", "places").mapInArrow(run, "n long, places array<struct<part: long, unit: int>>, n_a long, n_b long, groups string, links array<long>")


_SUMS = ["n_a", "n_b", "n_links", "n_best", "count_sum"]


def together(rows: DataFrame) -> DataFrame:
    """Documents from their parts' aligned units; of each part, units come first, by number, then blocks of documents."""

    def documents(units: list[pa.RecordBatch], block: dict) -> pa.RecordBatch:
        table = units[0]
        at = np.concatenate(([0], np.cumsum(np.array(block["sizes"], np.int64))))
        place = unpack(block["units"], int(at[-1]))
        sums = [np.concatenate(([0], np.cumsum(table.column(c).to_numpy()[place])))[at] for c in _SUMS]
        groups = pc.binary_join(_lists(at, table.column("groups").take(pa.array(place))), ";")
        return pa.RecordBatch.from_arrays([pa.array(block["doc_ids"], pa.int64()), *(pa.array(np.diff(x)) for x in sums), groups], ["doc_id", *_SUMS, "groups"])

    def run(batches):
        part, units = None, []
        for batch in batches:
            number = batch.column("part").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(number)]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if a == b:
                    continue
                if number[a] != part:
                    part, units = number[a], []
                own = batch.slice(a, b - a)
                many = len(own) - own.column("unit").null_count
                if many:
                    units.append(own.slice(0, many).select([*_SUMS, "groups"]))
                for block in own.slice(many).select(["doc_ids", "sizes", "units"]).to_pylist():
                    if len(units) != 1:
                        none = own.slice(0, 0).select([*_SUMS, "groups"])
                        units = pa.Table.from_batches([none, *units]).combine_chunks().to_batches() or [none]
                    yield documents(units, block)

    dealt = rows.repartition("part").sortWithinPartitions("part", F.col("unit").asc_nulls_last(), "row")
    return dealt.mapInArrow(run, "doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups string")


def align_documents(docs: DataFrame, scratch: Scratch, a_path: str | None = None, b_path: str | None = None, part_bytes: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    The tokens are those of a blank and the text, by a byte-level BPE (A) and by
    a SentencePiece model that adds the blank itself (B).  A link joins tokens that end at the
    same byte; its count is how often its id pair is linked in all documents;
    ``n_best`` counts a document's links whose count is the highest of their B id.
    Texts that are null, empty, no UTF-8, or not rendered byte for byte by both have
    zeros and an empty ``groups``, and their links don't count.  Repeated rows and ids are
    documents of their own; other columns are ignored; an empty table gives an empty result.
    Both tokenizers must have a token for each byte; B then renders all texts but those
    with its own sign for a blank.
    """
    a_path, b_path = a_path or default_tokenizer(), b_path or default_model()
    if not complete(a_path, b_path):
        raise ValueError("a tokenizer has no token for some bytes")
    parts = scratch.cut(parted(docs, rules(a_path, b_path), part_bytes or PART), "parts")
    held = parts.where("unit IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("part", "unit")).alias("places"))
    known = scratch.cut(aligned(held, a_path, b_path).withColumn("number", F.monotonically_increasing_id()), "aligned")
    pairs = known.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    pairs = scratch.cut(pairs.withColumn("b", F.col("link").bitwiseAND(0xFFFFFFFF)), "pairs")
    best = pairs.groupBy("b").agg(F.max("count").alias("most"))
    pairs = pairs.join(best, "b").select("link", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    if pairs.count() <= BROADCAST:
        pairs = F.broadcast(pairs)
    scored = known.select("number", F.explode("links").alias("link")).join(pairs, "link")
    scored = scored.groupBy("number").agg(F.count("link").alias("n_links"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    units = known.select("number", "places", "n_a", "n_b", "groups").join(scored, "number").select(F.explode("places").alias("place"), *_SUMS, "groups").select("place.*", *_SUMS, "groups")
    blocks = parts.where("unit IS NULL").select("part", "row", "doc_ids", "sizes", "units")
    out = together(units.unionByName(blocks, allowMissingColumns=True))
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups")
