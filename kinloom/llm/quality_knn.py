"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms are hashed words, the shapes of blank-separated tokens (case, digits,
trailing marks, length, a repeat of the token before) and pairs of neighbouring
shapes.  Each family is weighted by tf-idf and brought to unit length; a
truncated SVD of a bounded sample of labelled rows gives the latent space.  The
sample's vectors are broadcast (at most ``SAMPLE`` rows of ``RANK`` floats, 1.5
MB), every document's cosine to each of them is computed in blocks, and the
nearest ``NEIGHBOURS`` vote with a power of the cosine as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from kinloom.llm import textkernel as K

#: Labelled rows that the model is fitted on at most (give or take the hash's chance), latent dimensions, voters.
SAMPLE, RANK, NEIGHBOURS = 6_000, 64, 15
#: Hash slots of words, shapes and pairs of shapes, and the families' weights.
SLOTS, WEIGHTS = (512, 512, 1024), (0.4, 1.0, 1.0)
_EDGE = np.concatenate(([0], np.cumsum(SLOTS)))
TERMS = int(_EDGE[-1])
#: Power of the cosine in a vote.
SHARP = 8

_MARK = np.zeros(256, bool)
_MARK[0x21:0x30] = _MARK[0x3A:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOW = np.zeros(256, bool)
_LOW[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows by terms: how often each term stands in each row of a block."""
    rows = len(ends) - 1
    starts, stops, at = K.spans(K.NOT_SPACE[data], ends)
    out = np.zeros((rows, TERMS), np.float32)
    if not len(starts):
        return out
    row = np.repeat(np.arange(rows), np.diff(at))
    words = K.hashes(K.LOWER[data], starts, stops)

    def within(kind):
        total = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int32)))
        return total[stops] - total[starts]

    size, upper, low, marks = stops - starts, within(_UPPER), within(_LOW), within(_MARK)
    last = data[stops - 1].astype(np.uint64)
    tail = np.where(_MARK[data[stops - 1]], last, 0)
    tail = tail * np.uint64(4) + np.minimum(marks, 3).astype(np.uint64)
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    case = np.where(upper == 0, 0, np.where(low == 0, 3, np.where(_UPPER[data[starts]], 1, 2)))
    length = np.digitize(size, (4, 8, 13))
    shape = K.mix((((tail * np.uint64(4) + case.astype(np.uint64)) * np.uint64(4) + length.astype(np.uint64)) * np.uint64(2) + (within(_DIGIT) > 0)) * np.uint64(2) + again + np.uint64(1))
    pair = K.mix(shape[:-1] * np.uint64(31) + shape[1:])
    same = row[1:] == row[:-1]
    for f, (term, r) in enumerate(((words, row), (shape, row), (pair[same], row[1:][same]))):
        slot = (term >> np.uint64(40)).astype(np.int64) % SLOTS[f]
        out[:, _EDGE[f] : _EDGE[f + 1]] = np.bincount(r * SLOTS[f] + slot, minlength=rows * SLOTS[f]).reshape(rows, -1)
    return out


def weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of the counts times idf; each family of unit length times its weight."""
    x = np.sqrt(x) * idf
    for f, w in enumerate(WEIGHTS):
        part = x[:, _EDGE[f] : _EDGE[f + 1]]
        part *= w / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def sampled(labels: DataFrame, label: str, learn, limit: int, key: str = "doc_id") -> DataFrame:
    """``doc_id, label`` of about ``limit`` rows at most to learn from, chosen by a hash of the key.

    Rows with a null key or a label other than 0 and 1 are left out; of a key's
    several labels the largest holds.
    """
    good = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    good = good.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = good.count()
    part = min(1.0, limit / max(total, 1))
    return good.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) <= part * (1 << 20))


def taught(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, label, text`` of about ``limit`` rows at most to learn from, however many rows share a key.

    All texts of a chosen key count.  Where that makes more rows than the limit, a text
    that a key has many times counts once, and rows beyond the limit are left out by a hash of key and text.
    """
    chosen = sampled(labels, label, learn, limit, key)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # bounded by the sample
    if rows.count() <= limit + 10 * limit**0.5:
        return rows
    part = min(1.0, limit / rows.select("doc_id", F.xxhash64("text")).distinct().count())
    return rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 20)) <= part * (1 << 20)).dropDuplicates(["doc_id", "text"])


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """The model: idf, latent axes, the sample's latent vectors and their labels."""
    rows = taught(docs, labels, label, learn, sample, key, text)

    def run(batches):
        for block, data, ends in K.blocks(batches):
            x = counts(data, ends).astype(np.uint16 if len(data) < 60_000 else np.uint32)
            sparse = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array([i.astype(np.uint16).tobytes() for i in sparse], pa.binary()), pa.array([r[i].astype(np.uint32).tobytes() for r, i in zip(x, sparse, strict=True)], pa.binary())],
                ["doc_id", "label", "terms", "times"],
            )

    got = rows.mapInArrow(run, "doc_id long, label int, terms binary, times binary").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending"), ("times", "ascending")])
    x = np.zeros((len(got), TERMS), np.float32)
    for i, (t, n) in enumerate(zip(got["terms"].to_pylist(), got["times"].to_pylist(), strict=True)):
        x[i, np.frombuffer(t, np.uint16)] = np.frombuffer(n, np.uint32)
    y = got["label"].to_numpy().astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    w = weigh(x, idf)
    rank = min(RANK, max(1, len(w)))
    basis = np.random.default_rng(9).standard_normal((TERMS, rank + 16)).astype(np.float32)
    if len(w):
        for _ in range(3):  # subspace iteration
            basis = np.linalg.qr(w.T @ (w @ basis))[0]
        turn = np.linalg.svd(w @ basis, full_matrices=False)[2]
        basis = basis @ turn.T
    axes = np.ascontiguousarray(basis[:, :rank])
    return {"idf": idf, "axes": axes, "vectors": _unit(w @ axes), "labels": y}


def vote(model: dict, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of a block's rows: the share of label 1 among the nearest, weighted by similarity."""
    y = model["labels"]
    if not len(y):
        return np.full(len(ends) - 1, 0.5)
    z = _unit(weigh(counts(data, ends), model["idf"]) @ model["axes"])
    cos = z @ model["vectors"].T
    k = min(NEIGHBOURS, len(y))
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(y) else np.tile(np.arange(len(y)), (len(z), 1))
    weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARP
    total = weight.sum(1)
    prior = float(y.mean())
    return np.where(total > 1e-12, np.clip((weight * y[near]).sum(1) / np.maximum(total, 1e-12), 0, 1), prior)


def scored(docs: DataFrame, model: dict, judge, text: str = "text", score: str = "score") -> DataFrame:
    """The rows with a double column of scores added; a column of that name is replaced."""
    spark = docs.sparkSession
    docs = docs.drop(score)
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches):
        for block, data, ends in K.blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(judge(sent.value, data, ends).astype(np.float64))], [*block.schema.names, score])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, train: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "quality", score: str = "score") -> DataFrame:
    """The rows of ``docs`` with a quality score from 0 to 1, learnt from ``labels`` over ``train``.

    ``learn`` gives a condition on the key for rows whose label may be read.
    Null and empty texts score by the labelled share of 1, since they have no
    terms.  Repeated rows are scored each; an empty table gives an empty result;
    without any labelled row all score 0.5.  Other columns stay as they are.
    """
    return scored(docs, fit(train, labels, learn, label, key, text), vote, text, score)
