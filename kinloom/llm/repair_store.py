"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are dealt to shards by ranges of their key.  A shard's ids are
compressed by replacing frequent pairs of neighbours by nonterminals, over and
over, until no pair has ``LEAST`` places.  A round counts the pairs and ranks
those with that many places by their number; a place is replaced if its pair
ranks above those that overlap it.  Only places whose pair was frequent, or that
stand beside a nonterminal that got places, can hold a frequent pair in the next
round, so each round looks at fewer places.  The end id takes part in no pair, so a
document is a run of symbols of its own, and with the stored length of each
symbol's expansion any stretch of ids is decoded without the rest of the shard.

A shard file, all numbers little-endian:

==================  =======================================================
``RPG1``            4 bytes
counts              5 uint64: documents, rules, symbols, ids, first nonterminal
rules               uint32 pairs: left and right symbol of each nonterminal
lengths             uint32: ids that each nonterminal expands to
keys                int64: documents' keys, and a byte each: 1 where it is null
symbol offsets      uint64: documents' first symbols, and the end
id offsets          uint64: documents' first ids in the shard, and the end
symbols             uint16 if all are below 65536, else uint32
==================  =======================================================

Files are written under names of their own by each attempt of a task; only the
manifest, which Spark's own commit protects, says which of them count.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import textkernel as K
from kinloom.llm.scratch import Scratch

#: Id behind each document, bytes of text aimed at in a shard.
END, SHARD_BYTES = 2, 8 << 20
#: Fewest places that a pair must have to be replaced, and fewest that it must win in a round (but for the first in rank).
LEAST, WON = 64, 16
#: Bits of the largest table of pairs.
_BITS = 20


def _winners(spot: np.ndarray, rank: np.ndarray, twin: np.ndarray, nxt: np.ndarray, prv: np.ndarray, board: np.ndarray) -> np.ndarray:
    """Indices of the places that rank above both neighbours; in a run of one symbol every second place stands for the rest."""
    own = rank
    if len(twin):
        where = spot[twin]
        begin = np.ones(len(twin), bool)
        begin[1:] = nxt[where[:-1]] != where[1:]
        start = np.flatnonzero(begin)
        step = np.arange(len(twin)) - np.repeat(start, np.diff(np.append(start, len(twin))))
        own = rank.copy()
        own[twin[step % 2 == 1]] = 0
    board[spot] = own
    found = np.flatnonzero((board[prv[spot]] < own) & (board[nxt[spot]] < own))
    board[spot] = 0
    return found


def compress(ids: np.ndarray, first: int, barrier: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and the rules' lengths; nonterminals count from ``first``."""
    n = len(ids)
    seq = np.append(ids, barrier).astype(np.uint32)  # the barrier behind the end spares checks of bounds
    nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    nxt[n], prv[0] = n, n
    board, gone = np.zeros(n + 1, np.int32), np.zeros(n + 1, bool)
    rules, lengths, made = [], np.zeros(0, np.uint32), 0
    known, names = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    free = seq != barrier
    live, salt = np.flatnonzero(free[:-1] & free[1:]).astype(np.int32), 0
    while len(live):
        # Pairs are told apart by slots: one of the pairs that share a slot owns it, the others wait for the next deal.
        half = np.uint32(16) if first + made <= 1 << 16 else np.uint64(32)
        pair = (seq[live].astype(half.dtype) << half) | seq[nxt[live]].astype(half.dtype)
        bits = min(_BITS, max(8, len(live).bit_length()))
        odd = 0x9E3779B97F4A7C15 + 2 * salt * 0x61C8864680B583EB & (1 << 64) - 1
        mixed = pair * np.uint32(odd & 0xFFFFFFFF) if half == 16 else ((pair * np.uint64(odd)) >> np.uint64(32)).astype(np.uint32)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        slot = (mixed >> np.uint32(32 - bits)).astype(np.int64)
        salt += 1
        tally = np.bincount(slot, minlength=1 << bits)
        at = np.flatnonzero((tally >= LEAST).take(slot))
        live, slot, pair = live[at], slot[at], pair[at]
        if not len(live):
            break
        owner = np.zeros(1 << bits, pair.dtype)
        owner[slot] = pair
        mine = owner.take(slot) == pair
        spot = live
        if not mine.all():
            tally -= np.bincount(slot[~mine], minlength=1 << bits)
            at = np.flatnonzero(mine)
            spot, slot, pair = live[at], slot[at], pair[at]
        able = np.flatnonzero(tally >= LEAST)
        if not len(able):
            if len(spot) == len(live):
                break
            continue
        by = able[np.argsort((tally[able] << 20) | (able * 0x9E3779B1 & 0xFFFFF), kind="stable")]
        table = np.zeros(1 << bits, np.int32)
        table[by] = np.arange(1, len(by) + 1)
        rank = table.take(slot)
        at = np.flatnonzero(rank)
        if len(at) < len(spot):
            spot, rank = spot[at], rank[at]
        pairs = owner[by]
        left, right = (pairs >> half).astype(np.int64), (pairs & ((half.dtype.type(1) << half) - half.dtype.type(1))).astype(np.int64)
        twins = left == right
        twin = np.flatnonzero(np.append(False, twins)[rank]) if twins.any() else np.zeros(0, np.int64)
        at = _winners(spot, rank, twin, nxt, prv, board)
        spot, rank = spot[at], rank[at]
        good = np.bincount(rank, minlength=len(by) + 1)[1:] >= WON
        good[-1] = True
        whole = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        number = np.zeros(len(by), np.int64)
        if made:  # a pair that has a rule keeps it
            i = np.minimum(np.searchsorted(known, whole), made - 1)
            old = known[i] == whole
            number[old], good = names[i[old]], good | old
            fresh = np.flatnonzero(good & ~old)
        else:
            fresh = np.flatnonzero(good)
        number[fresh] = first + made + np.arange(len(fresh))
        sizes = np.append(lengths, np.uint32(1))
        size = [np.where(x < first, np.uint32(1), sizes[np.maximum(x - first, -1)]) for x in (left[fresh], right[fresh])]
        lengths = np.concatenate((lengths, size[0] + size[1]))
        rules.append(whole[fresh])
        order = np.argsort(whole[fresh])
        place = np.searchsorted(known, whole[fresh][order])
        known, names = np.insert(known, place, whole[fresh][order]), np.insert(names, place, number[fresh][order])
        made += len(fresh)
        at = np.flatnonzero(good[rank - 1])
        spot, rank = spot[at], rank[at]
        dead = nxt[spot]
        seq[spot], gone[dead] = number[rank - 1], True
        nxt[spot] = nxt[dead]
        prv[nxt[spot]] = spot
        prv[0] = n
        again = np.unique(number[rank - 1])
        again = again[again < first + made - len(fresh)]
        if len(again):  # pairs of a nonterminal that got more places may be frequent now, wherever they stand
            grown = np.zeros(first + made, bool)
            grown[again] = True
            spot = np.concatenate((spot, np.flatnonzero(grown.take(seq) & ~gone).astype(np.int32)))
        if 8 * len(live) > n:
            look = np.zeros(n + 1, bool)
            look[live] = look[spot] = look[prv[spot]] = True
            look &= ~gone
            live = np.flatnonzero(look).astype(np.int32)
        else:
            live = np.unique(np.concatenate((live, spot, prv[spot])))
            live = live[~gone[live]]
        live = live[(seq[live] != barrier) & (seq[nxt[live]] != barrier)]
    made = np.concatenate([np.zeros(0, np.uint64), *rules])
    return seq[:-1][~gone[:-1]], np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), lengths


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    seq = symbols.astype(np.uint32)
    while len(rules) and len(which := np.flatnonzero(seq >= first)):
        pair = rules[seq[which] - first]
        out = np.repeat(seq, np.where(seq >= first, 2, 1))
        at = which + np.arange(len(which))
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


class Shard:
    """A shard file.  Rules and offsets are read at once, symbols only where they are asked for."""

    def __init__(self, read):
        """``read`` gives so many bytes of the file from a place on: ``read(n, at)``."""
        if read(4, 0) != b"RPG1":
            raise ValueError("not a shard file")
        docs, n_rules, self.n_symbols, self.n_ids, self.first = (int(x) for x in np.frombuffer(read(40, 4), "<u8"))
        at = 44

        def take(kind, n):
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return np.frombuffer(read(size, at - size), kind)

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.keys, self.null = take("<i8", docs), take("u1", docs)
        self.symbol_at, self.id_at = take("<u8", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        self._kind, self._at, self._read = np.dtype("<u2" if self.first + n_rules < 65_536 else "<u4"), at, read

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda n, at: data[at : at + n])

    def symbols(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_symbols if stop is None else stop
        return np.frombuffer(self._read((stop - start) * self._kind.itemsize, self._at + start * self._kind.itemsize), self._kind)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols(int(self.symbol_at[i]), int(self.symbol_at[i + 1])), self.rules, self.first)

    def stretch(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the shard's id ``start`` on, reading its documents' symbols and expanding only those that hold the ids."""
        if not 0 <= start <= start + n <= self.n_ids:
            raise IndexError("outside the shard")
        d = int(np.searchsorted(self.id_at, start, "right")) - 1
        e = int(np.searchsorted(self.id_at, start + n, "left"))
        own = self.symbols(int(self.symbol_at[d]), int(self.symbol_at[e])).astype(np.int64)
        size = np.where(own < self.first, 1, np.append(self.lengths, 1)[np.maximum(own - self.first, -1)].astype(np.int64))
        ends = np.cumsum(size)
        skip = start - int(self.id_at[d])
        a, b = int(np.searchsorted(ends, skip, "right")), int(np.searchsorted(ends, skip + n, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return expand(own[a:b], self.rules, self.first)[skip - before : skip - before + n]


def read_stretch(file: str, start: int, n: int) -> np.ndarray:
    """``n`` ids of a shard file from its id ``start`` on, by seeking in the file."""
    system, path = _store(file)
    with system.open_input_file(path) as held:
        return Shard(held.read_at).stretch(start, n)


def pack(keys: pa.Array, ids: np.ndarray, at: np.ndarray, first: int) -> bytes:
    """A shard file of documents whose ids, with the end id each, lie end to end."""
    symbols, rules, lengths = compress(ids, first)
    ends = np.flatnonzero(symbols == END)  # a document ends with this symbol, which no rule takes in
    own = np.flatnonzero(ids == END)
    symbol_at = np.concatenate(([0], ends[np.searchsorted(own, at[1:] - 1)] + 1)) if len(at) > 1 else np.zeros(1, np.int64)
    out = io.BytesIO()
    out.write(b"RPG1")
    for values, kind in (
        ([len(keys), len(rules), len(symbols), len(ids), first], "<u8"),
        (rules, "<u4"),
        (lengths, "<u4"),
        (keys.fill_null(0).to_numpy(zero_copy_only=False), "<i8"),
        (keys.is_null().to_numpy(zero_copy_only=False), "u1"),
        (symbol_at, "<u8"),
        (at, "<u8"),
        (symbols, "<u2" if first + len(rules) < 65_536 else "<u4"),
    ):
        out.write(np.asarray(values).astype(kind).tobytes())
    return out.getvalue()


#: Bytes that the chunks of joined texts may have: ASCII that is printed, and letters of two bytes from U+00C0 to U+024F.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = _PLAIN[0x80:0xC0] = _PLAIN[0xC3:0xCA] = True
_WORD, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _LEAD[0xC3:0xCA] = True
_MARK = _PLAIN & ~_WORD
_MARK[0x80:] = False


class Encoder:
    """The tokenizers library behind a memory of chunks.

    With the byte-level pre-tokenizer and its own pattern, a token begins at each
    blank that stands between two characters other than white space, and
    wherever a run of letters or digits and a run of marks meet, but behind an
    apostrophe.  A text is cut there, and the chunks' ids laid end to end are the
    text's.  Added tokens are left whole.  With any other pre-tokenizer a text
    is one chunk.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.first = self.model.get_vocab_size()
        self.memory = K.Ids()
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        before, added = own.get("pre_tokenizer") or {}, own.get("added_tokens") or []
        self.cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not own.get("normalizer")
        self.cut &= not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added) and len(added) <= 64
        self.added = [t["content"].encode() for t in added]
        line = self.model.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.cut and len(line) == 1 else None

    def _heads(self, data: np.ndarray, ends: np.ndarray, whole: bytes) -> np.ndarray:
        head = np.zeros(len(data), bool)
        if self.cut and len(data) > 2:
            word, mark = _WORD[data], _MARK[data]
            # Characters beyond ASCII may be white space or marks; letters of two bytes are neither, but for two signs among them.
            tail, lead = np.zeros(len(data), bool), _LEAD[data]
            tail[1:] = lead[:-1] & (data[1:] >= 0x80)
            sign = tail & ((data == 0x97) | (data == 0xB7))
            sign[1:] &= data[:-1] == 0xC3
            left, right = word | mark | tail, word | mark | lead
            head[1:-1] = (data[1:-1] == 0x20) & left[:-2] & right[2:]
            head[1:] |= mark[1:] & (word | (tail & ~sign))[:-1]
            head[1:] |= word[1:] & mark[:-1] & (data[:-1] != 0x27)
            for token in self.added:
                at = whole.find(token)
                while at >= 0:
                    head[at + 1 : at + len(token)] = False
                    at = whole.find(token, at + 1)
        head[ends[:-1][np.diff(ends) > 0]] = True
        return head

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of chunks, many of them encoded as the lines of one text; None where lines and chunks don't agree."""
        pages = ["\n".join(texts[i : i + 200]) + "\n" for i in range(0, len(texts), 200)]
        flat = np.concatenate([np.array(e.ids, np.int32) for e in self.model.encode_batch_fast(pages, add_special_tokens=False)])
        edge = np.flatnonzero(flat == self.line)
        if len(edge) != len(texts):
            return None
        keep = np.ones(len(flat), bool)
        keep[edge] = False
        return flat[keep], np.diff(edge, prepend=-1) - 1

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for i in range(0, len(texts), 20_000) for e in self.model.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
        return np.fromiter((x for g in got for x in g), np.int32), np.array([len(g) for g in got], np.int64)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's rows end to end and the rows' offsets."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        whole = data.tobytes()
        starts = np.flatnonzero(self._heads(data, ends, whole))
        stops = np.append(starts[1:], len(data))
        odd = np.concatenate(([0], np.cumsum(~_PLAIN[data], dtype=np.int32)))

        def new(which):
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[which].tolist(), stops[which].tolist(), strict=True)]
            easy = (odd[stops[which]] == odd[starts[which] + (data[starts[which]] == 0x20)]) & (self.line is not None)
            if easy.all() and (got := self._joined(texts)):
                return got
            if not easy.any() or not (got := self._joined([texts[i] for i in np.flatnonzero(easy)])):
                return self._apart(texts)
            size = np.zeros(len(texts), np.int64)
            flat, size[easy] = got
            rest, size[~easy] = self._apart([texts[i] for i in np.flatnonzero(~easy)])
            out, mine = np.empty(int(size.sum()), np.int32), np.repeat(easy, size)
            out[mine], out[~mine] = flat, rest
            return out, size

        ids, sizes = self.memory.encode(data, starts, stops, new)
        return ids, K.per_row(sizes, np.searchsorted(starts, ends))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker loads a tokenizer once."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _store(folder: str):
    """The file system and path of a folder's address, for workers and driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, scratch: Scratch, path: str | None = None, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shard files in ascending order of the key; returns the manifest ``shard, file, n_docs, n_ids, start``.

    Each document is its ids and the end id.  Null and empty texts are the end
    id alone; null keys come first; documents that share a key stand by a hash
    of their texts; repeated rows are documents of their own.  Other columns are
    ignored; an empty table has no shards.
    """
    path, folder = path or default_tokenizer(), scratch.path("shards")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    count = max(1, -(-total // shard_bytes))
    dealt = source.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(count, F.col("doc_id").asc_nulls_first(), "tie", "row")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").drop("tie", "row")

    def write(batches):
        model, part, made = encoder(path), TaskContext.get().partitionId(), 0
        keys, ids, sizes, room = [], [], [], 0
        for block, data, ends in K.blocks(batches, limit=2 << 20):
            flat, at = model.encode(data, ends)
            n = np.diff(at)
            own = np.full(len(flat) + len(n), END, np.int32)
            own[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
            keys.append(block.column(0)), ids.append(own), sizes.append(n + 1)
            room += len(data) + 16 * len(block)
            if room >= 2 * shard_bytes:  # ranges aren't quite even; only a task with far more than its share has several shards
                yield shard(model, part << 20 | made, keys, ids, sizes)
                made, keys, ids, sizes, room = made + 1, [], [], [], 0
        if keys:
            yield shard(model, part << 20 | made, keys, ids, sizes)

    def shard(model, number, keys, ids, sizes):
        flat, at = np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        packed = pack(pa.chunked_array(keys).combine_chunks(), flat, at, model.first)
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        name = f"{number:016d}-{uuid.uuid4().hex}.rpg"
        with system.open_output_stream(posixpath.join(root, name)) as out:
            out.write(packed)
        return pa.RecordBatch.from_pydict({"shard": [number], "file": [f"{folder}/{name}"], "n_docs": [len(at) - 1], "n_ids": [len(flat)]}, pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = scratch.cut(dealt.mapInArrow(write, "shard long, file string, n_docs long, n_ids long"), "manifest")
    # Ids before a shard: those before its thousand of tasks, and those before it in its thousand.
    thousand = F.floor(F.shiftright("shard", 20) / 1000)
    earlier = Window.orderBy("thousand").rowsBetween(Window.unboundedPreceding, -1)  # one number for a thousand tasks
    above = manifest.groupBy(thousand.alias("thousand")).agg(F.sum("n_ids").alias("n")).select("thousand", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("above"))
    own = Window.partitionBy("thousand").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("thousand", thousand).withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(above, "thousand")
    return placed.select("shard", "file", "n_docs", "n_ids", (F.col("own") + F.col("above")).alias("start"))


def spread(files: DataFrame, by: str) -> DataFrame:
    """A manifest's rows dealt to as many tasks as there are files, or 16 a core; a count keeps small rows from being put together again."""
    tasks = min(files.count(), 16 * files.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(max(1, tasks), F.col(by))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _store(name)
                with system.open_input_stream(path) as file:
                    shard = Shard.of(file.read())
                ids = expand(shard.symbols(), shard.rules, shard.first).astype("<u4")
                at = shard.id_at
                whole = memoryview(ids.tobytes())
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys.astype(np.int64), mask=shard.null.astype(bool)), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("file", "start", "shard")
    return spread(files, "shard").select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
