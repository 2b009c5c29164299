"""Toxicity: a factorization machine over hashed terms.

Terms are 64-bit hashes of lower-cased words and of their first 4, 5 and 6
bytes, present or absent.  The machine has a weight for each term and a factor
vector for each term; products of two terms' vectors weigh pairs, such as an
insult with the mention of a group, beyond what the sum of their own weights says.

Out of a bounded sample of labelled rows a term is kept if it tells the classes
apart by itself (a likelihood-ratio statistic of at least ``LEAST_G``).  A word
that doesn't may still do so together with another, as a group's name does with
an insult.  So each word that stands in a row of ``COMMON`` is held against all
kept terms and all such words, and kept if what the pair says exceeds what both
say alone by ``LEAST_PAIR`` and by a ``PART`` of all that the labels hold.  The rules bound the terms by the
sample; there is no other cap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import textkernel as K
from kinloom.llm.quality_knn import scored, taught

#: Labelled rows that the model is fitted on at most (give or take the hash's chance), factors.
SAMPLE, FACTORS = 20_000, 8
#: Statistic from which a term counts by itself, and rows that it must stand in; that of a pair beyond its parts; and one of how many rows a word of a pair stands in.
LEAST_G, LEAST_ROWS, LEAST_PAIR, PART, COMMON = 12.0, 4, 30.0, 0.02, 50
_SALT = [np.uint64(s * 0x9E3779B97F4A7C15 % 2**64) for s in range(4)]


def terms(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of a block and the row of each, with repeats; the lowest two bits tell words (0) from beginnings."""
    data = K.LOWER[data]
    starts, stops, at = K.spans(K.ALNUM[data], ends)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(at))
    found, rows = [], []
    for kind, (salt, size) in enumerate(zip(_SALT, (0, 4, 5, 6), strict=True)):
        own = slice(None) if not size else stops - starts > size
        s = starts[own]
        e = stops[own] if not size else s + size
        found.append((K.hashes(data, s, e) + salt) & ~np.uint64(3) | np.uint64(kind))
        rows.append(row[own])
    found = np.concatenate(found)
    return found, np.concatenate(rows)


class Table:
    """Finds the kept terms among many hashes."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys, self.shift = np.sort(keys), np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are kept terms, and which terms."""
        hit = np.flatnonzero(self.some[(hashes >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[hit])
        good = at < len(self.keys)
        good[good] = self.keys[at[good]] == hashes[hit][good]
        return hit[good], at[good]


def _present(table: Table, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and terms of a block, each pair once, by row."""
    hashes, rows = terms(data, ends)
    hit, term = table.find(hashes)
    n = max(1, len(table.keys))
    both = np.unique(rows[hit] * n + term)
    return both // n, both % n


def raw(model: dict, rows: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of each row, and each row's sum of factor vectors."""
    v = model["v"][term]
    total = np.zeros((n, v.shape[1]))
    np.add.at(total, rows, v)
    linear = np.bincount(rows, model["w"][term], n)
    square = np.bincount(rows, (v * v).sum(1), n)
    return model["bias"] + linear + 0.5 * ((total * total).sum(1) - square), total


def train(rows: np.ndarray, term: np.ndarray, y: np.ndarray, n_terms: int, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 2e-4) -> dict:
    """Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(10)
    base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = {"bias": np.log(base / (1 - base)), "w": np.zeros(n_terms), "v": rng.normal(0, 0.02, (n_terms, FACTORS))}
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in model.items()}
    edge, step = np.searchsorted(rows, np.arange(len(y) + 1)), 0
    for _ in range(epochs if n_terms else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            size = edge[pick + 1] - edge[pick]
            r = np.repeat(np.arange(len(pick)), size)
            t = term[np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge[pick], size)]
            value, total = raw(model, r, t, len(pick))
            slope = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[pick]) / len(pick)
            grad = {"bias": slope.sum(), "w": np.bincount(t, slope[r], n_terms) + decay * model["w"], "v": decay * model["v"]}
            np.add.at(grad["v"], t, slope[r][:, None] * (total[r] - model["v"][t]))
            step += 1
            for k, g in grad.items():
                m, s = state[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                state[k] = [m, s]
                model[k] = model[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def _split(n: np.ndarray, p: np.ndarray, share: float) -> np.ndarray:
    """What n rows with p ones add to the likelihood-ratio statistic, where ``share`` of all rows are ones."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ones = np.where(p > 0, p * np.log(p / (n * share)), 0)
        zeros = np.where(n > p, (n - p) * np.log((n - p) / (n * (1 - share))), 0)
    return 2 * (ones + zeros)


def allied(rows: np.ndarray, term: np.ndarray, y: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Which terms to keep: those that aren't weak, and weak ones that say more with another term than both say alone.

    A weak term at a time is held against all others, so that memory grows with
    the terms and not with the product of both.
    """
    terms, few, share = len(weak), np.flatnonzero(weak), float(y.mean()) if len(y) else 0.0
    if not len(few) or not 0 < share < 1:
        return ~weak
    edge = np.searchsorted(rows, np.arange(len(y) + 1))
    at = rows[np.argsort(term, kind="stable")]  # the rows of each term
    first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=terms))))
    total, toxic = float(len(y)), float(y.sum())
    n, p = np.bincount(term, minlength=terms).astype(np.float64), np.bincount(term, y[rows], terms)
    held = -2 * total * (share * np.log(share) + (1 - share) * np.log(1 - share))
    alone = _split(n, p, share) + _split(total - n, toxic - p, share)
    good = ~weak

    def beside(some):
        """How often each term stands in some rows."""
        size = edge[some + 1] - edge[some]
        own = np.arange(int(size.sum())) + np.repeat(edge[some] - np.cumsum(size) + size, size)
        return np.bincount(term[own], minlength=terms).astype(np.float64)

    for i in few:
        mine = at[first[i] : first[i + 1]]
        n11, p11 = beside(mine), beside(mine[y[mine] > 0])
        n10, p10, n01, p01 = n[i] - n11, p[i] - p11, n - n11, p - p11
        whole = _split(n11, p11, share) + _split(n10, p10, share) + _split(n01, p01, share) + _split(total - n11 - n10 - n01, toxic - p11 - p10 - p01, share)
        told = whole - alone[i] - alone >= max(LEAST_PAIR, PART * held)
        told[i] = False
        good[told] = True
        good[i] |= told.any()
    return good


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """The model: kept terms, their weights and factor vectors, and the bias.

    Rows without a key, a text or a label of 0 or 1 teach nothing; of several
    labels of a key the largest holds, and all texts of a key count.  A text in
    many chosen rows counts once, with the label of most of them (1 if as many
    have 0): else all that only one text says would pass for what many rows say.
    """
    rows = taught(docs, labels, label, learn, sample, key, text)
    rows = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), (F.avg("label") >= 0.5).cast("int").alias("label")).select("doc_id", "label", "text")

    def tally(batches):
        for block, data, ends in K.blocks(batches, limit=4 << 20):
            y = block.column(1).to_numpy()
            found, row = terms(data, ends)
            order = np.lexsort((row, found))
            found, row = found[order], row[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            found, row = found[new], row[new]
            names, start = np.unique(found, return_index=True)
            ones = np.add.reduceat(y[row], start) if len(start) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.array(np.diff(np.append(start, len(found))).astype(np.int64)), pa.array(ones.astype(np.int64))], ["term", "rows", "ones"]
            )

    size, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counted = rows.mapInArrow(tally, "term long, rows long, ones long").groupBy("term").agg(F.sum("rows").alias("n"), F.sum("ones").alias("p"))
    counted = counted.where(F.col("n") >= LEAST_ROWS)
    share = F.lit(ones / max(size, 1))

    def part(seen, due):
        return F.when(seen > 0, seen * F.log(seen / F.greatest(due, F.lit(1e-9)))).otherwise(0.0)

    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    all_n, all_p = F.lit(float(size)), F.lit(float(ones))
    g = 2 * (part(p, n * share) + part(n - p, n * (1 - share)) + part(all_p - p, (all_n - n) * share) + part(all_n - all_p - n + p, (all_n - n) * (1 - share)))
    weak = F.round(g, 6) < LEAST_G
    word = (F.col("n") * COMMON >= size) & (F.col("term").bitwiseAND(F.lit(3)) == 0)
    best = counted.where(~weak | word).select("term", weak.alias("weak")).toArrow()
    keys = best["term"].to_numpy().view(np.uint64) if len(best) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    weak = best["weak"].to_numpy()[order] if len(best) else np.zeros(0, bool)
    sent = docs.sparkSession.sparkContext.broadcast(Table(keys[order]))

    def index(batches):
        for block, data, ends in K.blocks(batches):
            r, t = _present(sent.value, data, ends)
            cut = np.searchsorted(r, np.arange(len(block) + 1))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array([t[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "label", "terms"]
            )

    got = rows.mapInArrow(index, "doc_id long, label int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    lists = [np.frombuffer(t, np.int32) for t in got["terms"].to_pylist()]
    r, t = np.repeat(np.arange(len(lists)), [len(t) for t in lists]), np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int64)
    y = got["label"].to_numpy().astype(np.float64)
    kept = allied(r, t, y, weak)
    r, t = r[kept[t]], (np.cumsum(kept) - 1)[t[kept[t]]]
    return {"table": Table(keys[order][kept]), **train(r, t, y, int(kept.sum()))}


def judge(model: dict, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of a block's rows."""
    rows, term = _present(model["table"], data, ends)
    value, _ = raw(model, rows, term, len(ends) - 1)
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic", score: str = "score") -> DataFrame:
    """The rows of ``docs`` with a toxicity score from 0 to 1, learnt from ``labels`` over ``train_docs``.

    ``learn`` gives a condition on the key for rows whose label may be read.
    Null and empty texts have no terms and score by the bias alone.  Repeated
    rows are scored each; an empty table gives an empty result; without any
    labelled row all score 0.5.  Other columns stay as they are.
    """
    return scored(docs, fit(train_docs, labels, learn, label, key, text), judge, text, score)
