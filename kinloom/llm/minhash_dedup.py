"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds the hashes of its distinct runs of ``k`` words.  Exact
set copies fall into one class first.  Each class gets a signature of one byte
a hash function; bands of the full minima give buckets.  Within buckets,
signatures are compared batch by batch and a pair goes as soon as the posterior
probability that its similarity reaches the threshold, under a uniform prior,
is below ``miss``.  Survivors are confirmed on full sets.

Large buckets neither meet in one task nor give all their pairs:

* a bucket of more than ``BLOCK`` classes is dealt into blocks, and each pair of
  blocks is a task of its own;
* buckets up to ``SMALL`` classes give all their surviving pairs, larger ones a
  forest of the most similar pairs, which is linear in their size;
* where a large bucket still spans several components after those pairs are
  confirmed, its blocks are compared again with their full sets at hand, and
  only confirmed links between components leave the task; blocks are smaller
  there, so that a task holds about twice ``SET_BYTES`` of sets.

So each pair of a bucket is either pruned by the posterior bound, confirmed or
refuted on full sets, or already joined by confirmed links.

Bands follow the threshold: a true pair at it misses all of them with a
probability of at most ``BANDED`` (25 bands of 5 at 0.85, 37 at 0.8).  Sets hold
64-bit hashes of shingles; that two shingles of a compared pair share one, or
that two classes share the 128 bits of theirs, isn't to be expected at any size.

A class with so many copies, or a bucket with so many classes, that it would stand
out among the tasks is joined by broadcast.  There are at most ``EVEN`` of either
a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm import textkernel as K
from kinloom.llm.graph import components
from kinloom.llm.scratch import Scratch

#: Probability that bands miss a pair at the threshold; most rows of a band, and most bands before a band gets fewer rows.
BANDED, ROWS, BANDS = 5e-7, 5, 48
#: Classes of a bucket that gives all its pairs, classes of a block, bytes of a block's sets, hash functions of a batch.
SMALL, BLOCK, SET_BYTES, STEP = 64, 1024, 32 << 20, 25
#: The part of a task's even share of rows from which a class or a bucket counts as large is one in so many.
EVEN = 8


class Plan:
    """Bands and rows for a threshold, and their hash functions."""

    def __init__(self, threshold: float):
        for rows in range(ROWS, 0, -1):
            hit = threshold**rows
            self.rows, self.bands = rows, 1 if hit >= 1 else math.ceil(math.log(BANDED) / math.log1p(-hit))
            if self.bands <= BANDS:
                break
        self.hashes = self.rows * self.bands
        rng = np.random.default_rng(5)
        self.mul = rng.integers(1, 1 << 63, self.hashes, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(1, 1 << 63, self.hashes, dtype=np.uint64)


def shingle_sets(batches: Iterator[pa.RecordBatch], column: str, k: int, salt: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Blocks of rows and each row's sorted distinct shingle hashes."""
    for block, data, ends in K.blocks(batches, column):
        data = K.LOWER[data]
        starts, stops, at = K.spans(K.NOT_SPACE[data], ends)
        words = K.hashes(data, starts, stops, salt)
        hashed, ptr = K.grams(words, at, k)
        sets = [np.unique(hashed[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        for row in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k)):
            own = words[at[row] : at[row + 1]]
            sets[row] = K.grams(own, np.array([0, len(own)]), len(own))[0]
        yield block, sets


def minima(values: np.ndarray, plan: Plan) -> np.ndarray:
    """The smallest value under each hash function."""
    out = np.full(plan.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(values), 512):
        np.minimum(out, (values[i : i + 512, None] * plan.mul + plan.add).min(0), out=out)
    return out


def _sketch(column: str, k: int, plan: Plan, salt: int):
    def run(batches):
        for block, sets in shingle_sets(batches, column, k, salt):
            size = np.array([len(s) for s in sets], np.int64)
            low = np.stack([minima(s, plan) for s in sets])
            bands = K.grams(low.ravel(), np.arange(0, low.size + 1, plan.rows), plan.rows)[0].reshape(-1, plan.bands)
            bands = K.mix(bands + np.arange(plan.bands, dtype=np.uint64))
            one = [np.bitwise_xor.reduce(K.mix(s)) if len(s) else np.uint64(0) for s in sets]
            two = [np.add.reduce(K.mix(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else np.uint64(0) for s in sets]
            sig = (K.mix(low) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array(size),
                    pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * plan.bands), pa.array(bands.view(np.int64).ravel())),
                ],
                ["doc_id", "n_shingles", "one", "two", "sig", "bands"],
            )

    return run


def _marks(keys: np.ndarray, size: int) -> np.ndarray:
    """Three bit numbers below ``size`` (a power of two) for each key, one after another."""
    keys = keys.astype(np.int64).view(np.uint64)
    return np.concatenate([(K.mix(keys + np.uint64(s)) & np.uint64(size - 1)).astype(np.int64) for s in (1, 2, 3)])


def bloom(keys: DataFrame, most: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of a column of longs, 16 bits a key and ``most`` bits (8 MB) at most.

    The bits are gathered by word before they come to the driver, so what comes
    is bounded; beyond the bound the filter lets more keys through, no fewer.
    """
    size = 1 << min(most.bit_length() - 1, max(10, (16 * keys.count()).bit_length()))

    def run(batches):
        for batch in batches:
            bits = np.unique(_marks(batch.column(0).to_numpy(), size))
            word, start = np.unique(bits >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    got = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mark = _marks(keys, len(bits) << 6)
    return ((bits[mark >> 6] >> (mark & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).reshape(3, -1).all(0)


def _full(column: str, k: int, sent, salt: int):
    def some(batches):
        for batch in batches:
            keys = batch.column(0)
            yield batch.filter(pa.array(_passes(sent.value, keys.fill_null(0).to_numpy(zero_copy_only=False)) & keys.is_valid().to_numpy(zero_copy_only=False)))

    def run(batches):
        for block, sets in shingle_sets(some(batches), column, k, salt):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "set"])

    return run


@lru_cache(8)
def bounds(threshold: float, miss: float, hashes: int) -> tuple[tuple[int, int], ...]:
    """Hash functions seen after each batch of ``STEP``, and the fewest equal bytes with a posterior of the threshold of at least ``miss``.

    Equal bytes come with probability J + (1 - J) / 256.  The posterior is
    summed over a fine grid of J.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    hit = grid + (1 - grid) / 256
    out = []
    for n in [*range(STEP, hashes, STEP), hashes]:
        for m in range(n + 1):
            log = m * np.log(hit) + (n - m) * np.log1p(-hit)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= miss * weight.sum():
                out.append((n, m))
                break
    return tuple(out)


def surviving(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs outlive all batches, and their equal bytes."""
    alive, equal, seen = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for upto, need in least:
        cut, seen = slice(seen, upto), upto
        equal[alive] += (sigs[a[alive], cut] == sigs[b[alive], cut]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= need]
    return alive, equal[alive]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], limit: int) -> Iterator[pa.Table]:
    """Runs of whole groups of the sorted rows: tables of about ``limit`` rows, or one larger group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(len(table) - 1, bool)
        for key in keys:
            values = table[key].to_numpy()
            change |= values[1:] != values[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            yield table.slice(0, cuts[-1] + 1)
            held = table.slice(cuts[-1] + 1).combine_chunks().to_batches()
            rows = sum(map(len, held))
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of each group (across its two blocks if they differ) and whether the bucket is small; in chunks."""
    key, lo, hi = (table[c].to_numpy() for c in ("key", "lo", "hi"))
    blk, size = table["blk"].to_numpy(), table["size"].to_numpy()
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(key))
    group = np.cumsum(new) - 1
    later = stop[group] - np.arange(len(key)) - 1
    done, total = 0, np.concatenate(([0], np.cumsum(later)))
    while done < len(key):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + 500_000, "right")) - 1)
        counts = later[done:upto]
        a = np.repeat(np.arange(done, upto), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[done:upto] - total[done], counts)
        keep = (lo[a] == hi[a]) | (blk[a] != blk[b])
        yield a[keep], b[keep], size[a[keep]] <= SMALL
        done = upto


def forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of a spanning forest of heaviest pairs, round by round."""
    root, chosen = np.arange(n), []
    order = np.lexsort((np.arange(len(a)), -weight))
    a, b = a[order], b[order]
    live = np.arange(len(a))
    while len(live):
        x, y = root[a[live]], root[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        took = np.unique(best[best < len(a)])
        chosen.append(took)
        ra, rb = root[a[took]], root[b[took]]
        while True:  # join the chosen pairs' trees under their smallest root
            low = np.minimum(ra, rb)
            nxt = np.arange(n)
            np.minimum.at(nxt, ra, low)
            np.minimum.at(nxt, rb, low)
            root = nxt[root]
            ra, rb = nxt[ra], nxt[rb]
            if (ra == rb).all():
                break
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(K.blob(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))[0], np.uint8).reshape(len(column), -1)


def _compare(threshold: float, miss: float, hashes: int):
    def run(batches):
        least = bounds(threshold, miss, hashes)
        for table in _groups(batches, ("key", "lo", "hi"), 4 * BLOCK):
            cid, sigs = table["cid"].to_numpy(), _signatures(table["sig"])
            kept, large = [], []
            for a, b, small in _pairs(table):
                alive, equal = surviving(sigs, a, b, least)
                a, b, small = a[alive], b[alive], small[alive]
                kept.append((a[small], b[small]))
                large.append((a[~small], b[~small], equal[~small]))
            a, b, w = (np.concatenate(x) for x in zip(*large, strict=True))
            names, index = np.unique(cid, return_inverse=True)
            pick = forest(len(names), index[a], index[b], w)
            kept.append((a[pick], b[pick]))
            a, b = (cid[np.concatenate(x)] for x in zip(*kept, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y|, for sorted distinct hashes."""
    small, big = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(big):
        return False
    at = np.searchsorted(big, small)
    common = int((big[np.minimum(at, len(big) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            sets = [batch.column(batch.schema.get_field_index(c)) for c in ("set_a", "set_b")]
            keep = [similar(*(np.frombuffer(s[i].as_buffer(), np.uint64) for s in sets), percent) for i in range(len(batch))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _finish(threshold: float, miss: float, percent: int, hashes: int):
    """Links between the components that meet in a block pair of a large bucket."""

    def run(batches):
        least = bounds(threshold, miss, hashes)
        for table in _groups(batches, ("key", "lo", "hi"), 1):
            cid, sigs, comp = table["cid"].to_numpy(), _signatures(table["sig"]), table["comp"].to_numpy()
            sets, root = table["set"].combine_chunks(), {int(c): int(c) for c in comp}
            found = []

            def top(x, root=root):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for a, b, _ in _pairs(table):
                cross = comp[a] != comp[b]
                a, b = a[cross], b[cross]
                alive, equal = surviving(sigs, a, b, least)
                for i in alive[np.argsort(-equal, kind="stable")]:
                    x, y = top(int(comp[a[i]])), top(int(comp[b[i]]))
                    if x != y and similar(*(np.frombuffer(sets[int(j)].as_buffer(), np.uint64) for j in (a[i], b[i])), percent):
                        root[max(x, y)] = min(x, y)
                        found.append((cid[a[i]], cid[b[i]]))
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _dealt(bucket: DataFrame, blocks: Column) -> DataFrame:
    """Rows of buckets, each for every pair of blocks that its block takes part in, sorted by that pair."""
    own = F.pmod(F.xxhash64("cid"), F.col("n")).cast("int")
    rows = bucket.withColumn("n", blocks.cast("int")).withColumn("blk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other", "n")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")


def evenly(rows: DataFrame, table: DataFrame, on: str | list[str], large: DataFrame, how: str = "inner") -> DataFrame:
    """The join of rows with a table that has each key once; the keys of ``large``, a short list, meet it by broadcast."""
    many = rows.join(F.broadcast(large), on, "left_semi").join(F.broadcast(table.join(F.broadcast(large), on, "left_semi")), on, how)
    return many.unionByName(rows.join(F.broadcast(large), on, "left_anti").join(table, on, how))


def near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80, miss: float = 1e-6, salt: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets
    of k-word shingles (A-Z lower-cased, words split at ASCII blanks); a text of
    fewer words is one shingle.  Null, empty and blank texts have an empty set
    and link with nothing.  Each repeated row of a doc_id is a row of the
    result; different texts under one id count as one document, linked if any of
    its texts is.  A null key keeps its row, unlinked
    (null component, kept).  Other columns are ignored.  An empty table gives an
    empty result.

    Words and shingles are known by 64-bit hashes under ``salt``, which is drawn
    anew for each call if none is given, so that no text can be built to share one.
    """
    salt = K.salted(salt)
    threshold = percent / 100
    plan = Plan(threshold)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = scratch.cut(
        source.mapInArrow(_sketch("text", k, plan, salt), "doc_id long, n_shingles long, one long, two long, sig binary, bands array<long>"), "sketch"
    )
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.cut(full.groupBy("one", "two").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies")), "classes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = classes.where(F.col("copies") > max(1.0, sketch.count() / (EVEN * tasks)))
    member = evenly(full, classes.drop("copies"), ["one", "two"], common.select("one", "two"))
    reps = member.where("doc_id = cid").select("cid", "one", "two", "sig", "bands").dropDuplicates(["cid", "one", "two"])
    reps = scratch.cut(reps.drop("one", "two"), "reps")
    member = scratch.cut(member.select("doc_id", "n_shingles", F.col("cid").alias("node")), "member")
    keys = reps.select("cid", F.explode("bands").alias("key")).distinct()
    sizes = scratch.cut(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    crowded = sizes.where(F.col("size") > max(1.0, reps.count() * plan.bands / (EVEN * tasks))).select("key")
    bucket = scratch.cut(evenly(keys, sizes, "key", crowded), "bucket")
    signed = bucket.join(reps.select("cid", "sig"), "cid")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK))
    pairs = _dealt(signed, blocks).mapInArrow(_compare(threshold, miss, plan.hashes), "a long, b long").distinct()
    pairs = scratch.cut(pairs, "pairs")

    def sets(of: DataFrame) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(bloom(of))  # 8 MB at most; so no text is shuffled
        return source.mapInArrow(_full("text", k, sent, salt), "cid long, set binary").join(of, "cid", "left_semi").distinct()

    named = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "named")
    held = scratch.cut(sets(named), "sets")
    both = pairs.join(held.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a").join(
        held.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b"
    )
    links = scratch.cut(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long"), "links")
    scratch.drop(pairs, held)
    first = scratch.cut(components(links, scratch), "first")

    large = bucket.where(F.col("size") > SMALL)
    busy = sizes.where((F.col("size") > SMALL) & (F.col("size") > large.count() / (EVEN * tasks))).select("key")
    large = large.join(first, F.col("cid") == F.col("node"), "left")
    large = large.select("key", "size", "cid", F.coalesce("root", "cid").alias("comp"))
    mixed = large.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    open_ = scratch.cut(evenly(large, mixed, "key", busy, "left_semi"), "open")
    if not open_.isEmpty():
        wanted = scratch.cut(open_.select("cid").distinct(), "wanted")
        held = scratch.cut(sets(wanted).join(reps.select("cid", "sig"), "cid"), "open-sets")
        weight = open_.join(held.select("cid", F.octet_length("set").alias("bytes")), "cid").groupBy("key").agg(F.sum("bytes").alias("bytes"))
        blocks = F.greatest(blocks, F.ceil(F.col("bytes") / F.lit(SET_BYTES)))
        rows = _dealt(evenly(open_, weight, "key", busy).join(held, "cid"), blocks)
        more = rows.mapInArrow(_finish(threshold, miss, percent, plan.hashes), "a long, b long").distinct()
        more = scratch.cut(more, "more")
        first = scratch.cut(components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch), "second")
        scratch.drop(held)
    scratch.drop(bucket, open_)

    placed = evenly(member, first, "node", common.select(F.col("cid").alias("node")).distinct(), "left").withColumn("component_id", F.coalesce("root", "node"))
    alone = sketch.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    rows = placed.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
