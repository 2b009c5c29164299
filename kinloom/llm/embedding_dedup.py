"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Each vector is at home in the cell of its nearest centre.  A pair at the
threshold can lie on either side of a border between cells, so a vector is also
compared with each cell of a lower number whose border is no further away than
the threshold's angle: with unit centres c (home) and e, the distance of x to
their border is x.(c - e) / |c - e|, and no vector within the angle t of x is at
home beyond it if that exceeds sin(t).  The cells therefore find every link, with
any centres; centres are fitted on a bounded sample only to make cells small.

Exact copies are one class with a multiplicity.  Classes are sorted by cell and
written as files of unit vectors, each once; a block is ``BLOCK`` classes of a
cell, and a table of blocks, with the cells that any of a block's vectors
reaches, is all that is shuffled after that.  Each pair of blocks to compare is a
row, whose task reads the blocks' files, multiplies, and returns a count of links
a class and a forest of links, both linear in its rows.  Products are taken in
single precision first; what could reach the threshold is taken in double.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import textkernel as K
from kinloom.llm.graph import components
from kinloom.llm.minhash_dedup import EVEN, evenly
from kinloom.llm.repair_store import _store
from kinloom.llm.scratch import Scratch

#: Rows that centres are fitted on, vectors aimed at in a cell, most centres, classes in a block.
SAMPLE, CELL, CENTRES, BLOCK = 20_000, 1_500, 1_024, 1_024


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values end to end as doubles (null: NaN), offsets, and which rows are not null."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)))).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values, offsets, there


def _prepare(batches):
    for batch in batches:
        values, at, _ = _parts(batch.column(1))
        bits = np.append(K.mix((values + 0.0).view(np.uint64)), np.uint64(0))
        place = np.arange(len(values), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
        deep = [np.append(K.mix(bits[:-1] + K.mix(place + np.uint64(s))), np.uint64(0)) for s in (1, 1 << 40)]
        sums = [np.concatenate(([0], np.cumsum(d[:-1], dtype=np.uint64))).astype(np.uint64) for d in deep]
        square = np.concatenate(([0.0], np.cumsum(np.where(np.isfinite(values), values != 0, 0))))
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        good = (np.diff(bad[at]) == 0) & (np.diff(square[at]) > 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(good), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums), batch.column(1).cast(pa.list_(pa.float64()))],
            ["vec_id", "good", "one", "two", "vec"],
        )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision; scaled by the largest component first, so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows."""
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, 1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-300), centres)
    return np.unique(centres, axis=0)


def _home(centres: np.ndarray):
    """The rows with their home cells; an odd dimension is a cell of its own."""

    def run(batches):
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            dims = vec.value_lengths().to_numpy(zero_copy_only=False)
            cell = -dims.astype(np.int64)
            own = np.flatnonzero(dims == centres.shape[1]) if len(centres) else np.zeros(0, np.int64)
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                cell[part] = np.argmax(_matrix(vec.take(pa.array(part)), centres.shape[1]) @ centres.T, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def _reached(x: np.ndarray, home: int, centres: np.ndarray, threshold: float) -> np.ndarray:
    """Cells of a lower number than the home cell whose border any of the vectors is near."""
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    lower = centres[:home]
    gap = np.sqrt(np.maximum(((centres[home] - lower) ** 2).sum(1), 1e-30))
    return np.flatnonzero((x @ centres[home][:, None] - x @ lower.T <= reach * gap).any(0))


_BLOCKS = "file string, cell long, dim long, size long, reached array<long>"


def _write_blocks(folder: str, centres: np.ndarray, threshold: float, most: int):
    """Files of a cell's classes each, ``most`` at most: class ids, multiplicities, unit vectors."""

    def run(batches):
        system = root = None
        held: list[pa.RecordBatch] = []
        rows, cell = 0, None

        def write():
            table = pa.Table.from_batches(held).combine_chunks()
            dim = len(table["vec"][0])
            x = _matrix(table["vec"].combine_chunks(), dim)
            name = f"{uuid.uuid4().hex}.vec"
            with system.open_output_stream(posixpath.join(root, name)) as out:
                for part in (np.array([len(x), dim], "<i8"), table["cid"].to_numpy().astype("<i8"), table["times"].to_numpy().astype("<i8"), x.astype("<f8")):
                    out.write(part.tobytes())
            reached = _reached(x, cell, centres, threshold) if cell >= 0 else np.zeros(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([cell], pa.int64()), pa.array([dim]), pa.array([len(x)]), pa.array([reached.tolist()], pa.list_(pa.int64()))], ["file", "cell", "dim", "size", "reached"])

        for batch in batches:
            if system is None:
                system, root = _store(folder)
                system.create_dir(root, recursive=True)
            cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            edge = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                while a < b:
                    if held and (cells[a] != cell or rows == most):
                        yield write()
                        rows = 0
                    take = min(b - a, most - rows)
                    held.append(batch.slice(a, take))
                    cell, rows, a = int(cells[a]), rows + take, a + take
        if held:
            yield write()

    return run


@lru_cache(64)
def _file(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    system, path = _store(name)
    with system.open_input_stream(path) as file:
        data = file.read()
    n, dim = (int(v) for v in np.frombuffer(data, "<i8", 2))
    return np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<i8", n, 16 + 8 * n), np.frombuffer(data, "<f8", n * dim, 16 + 16 * n).reshape(n, dim)


def _block(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_file(n) for n in names]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a product of at least ``threshold`` in double precision."""
    near = x.astype(np.float32) @ y.astype(np.float32).T >= threshold - 2.4e-7 * (x.shape[1] + 8)
    if near.sum() > near.size // 16:
        return np.nonzero(x @ y.T >= threshold)
    a, b = np.nonzero(near)
    good = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return a[good], b[good]


def _links(threshold: float):
    def run(batches):
        for batch in batches:
            for one, other in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                cid, times, x = _block(one)
                if one == other:
                    a, b = linked(x, x, threshold)
                    a, b = a[a != b], b[a != b]
                else:
                    more, weight, y = _block(other)
                    a, b = linked(x, y, threshold)
                    a, b = np.concatenate((a, b + len(cid))), np.concatenate((b + len(cid), a))
                    cid, times = np.concatenate((cid, more)), np.concatenate((times, weight))
                if not len(a):
                    continue
                count = np.zeros(len(cid), np.int64)
                np.add.at(count, a, times[b])
                label = np.arange(len(cid))
                while True:
                    best = label.copy()
                    np.minimum.at(best, a, label[b])
                    best = best[best]
                    if (best == label).all():
                        break
                    label = best
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(count[some]), pa.array(cid[label[some]])], ["cid", "links", "other"])

    return run


def near_vectors(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", column: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Links are pairs with a double-precision cosine of at least ``threshold``.
    A vector that is null, empty, zero, or holds a null or non-finite component
    links with nothing, and so do vectors of different dimensions among each
    other.  Repeated rows of a key are rows of the result and count as links of
    each other if their vectors are near.  A null key keeps its row, unlinked.
    Other columns are ignored; an empty table gives an empty result.
    """
    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    rows = scratch.cut(source.mapInArrow(_prepare, "vec_id long, good boolean, one long, two long, vec array<double>"), "vectors")
    good = rows.where("good and vec_id is not null")
    classes = scratch.cut(good.groupBy("one", "two").agg(F.min("vec_id").alias("cid"), F.count("*").alias("times")), "sizes")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = classes.where(F.col("times") > max(1.0, rows.count() / (EVEN * tasks))).select("one", "two")  # at most EVEN for each task
    member = evenly(good, classes, ["one", "two"], common)
    first = member.where("vec_id = cid").select("cid", "one", "two", "times", "vec").dropDuplicates(["cid", "one", "two"])
    reps = scratch.cut(first.withColumn("class", F.xxhash64("one", "two")).drop("one", "two"), "classes")
    member = scratch.cut(member.select("vec_id", "cid", "times", F.xxhash64("one", "two").alias("class")), "members")
    hot = scratch.cut(common.join(classes, ["one", "two"]).select(F.xxhash64("one", "two").alias("class"), F.col("cid").alias("node")), "common")

    total = reps.count()
    dim = reps.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dim[0]["dim"] if dim else 0
    some = reps.where((F.size("vec") == dim) & (F.pmod(F.xxhash64("class"), F.lit(1 << 20)) <= (1 << 20) * min(1.0, SAMPLE / max(total, 1))))
    sample = some.select("vec").toArrow()["vec"].combine_chunks() if total else None
    k = min(CENTRES, max(1, round(total / CELL)))
    centres = fit_centres(_matrix(sample, dim), min(k, len(sample))) if sample is not None and len(sample) else np.zeros((0, 0))

    folder = scratch.path("blocks")
    placed = reps.select(F.col("class").alias("cid"), "times", "vec").mapInArrow(_home(centres), "cid long, times long, vec array<double>, cell long")
    placed = placed.repartitionByRange(max(1, -(-total // (8 * BLOCK))), "cell", "cid").sortWithinPartitions("cell", "cid")
    files = scratch.cut(placed.mapInArrow(_write_blocks(folder, centres, threshold, BLOCK), _BLOCKS), "blocks")
    # Files of a cell are put together to blocks; a row a file, so that even a cell that holds most vectors is soon numbered.
    before = F.sum("size").over(Window.partitionBy("cell").orderBy("file")) - F.col("size")
    named = F.array_sort(F.collect_list("file"))
    blocks = files.withColumn("block", F.floor(before / BLOCK)).groupBy("cell", "block").agg(named.alias("files"), F.array_distinct(F.flatten(F.collect_list("reached"))).alias("reached"))
    blocks = scratch.cut(blocks, "numbered")
    reach = blocks.select(F.col("cell").alias("home"), F.col("block").alias("own"), F.col("files").alias("one"), F.explode(F.concat(F.array("cell"), "reached")).alias("cell"))
    pairs = reach.join(blocks.select("cell", "block", F.col("files").alias("other")), "cell").where("home <> cell or own <= block").select("one", "other")
    pairs = scratch.cut(pairs, "pairs")
    n = max(1, min(pairs.count(), 16 * vectors.sparkSession.sparkContext.defaultParallelism))
    found = scratch.cut(pairs.repartition(n, F.xxhash64("one", "other")).mapInArrow(_links(threshold), "cid long, links long, other long"), "found")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    name = reps.select("class", "cid")
    pairs = found.select("cid", "other").distinct().withColumnRenamed("cid", "class").join(name, "class").select(F.col("cid").alias("a"), "other")
    pairs = pairs.join(name.select(F.col("class").alias("other"), F.col("cid").alias("b")), "other").select("a", "b")
    joined = components(pairs, scratch)

    roots = evenly(member.withColumnRenamed("cid", "node"), joined, "node", hot.select("node").distinct(), "left")
    placed_rows = evenly(roots.withColumnRenamed("node", "cid"), counts.withColumnRenamed("cid", "class"), "class", hot.select("class").distinct(), "left")
    linked = placed_rows.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    alone = rows.where("not good or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
