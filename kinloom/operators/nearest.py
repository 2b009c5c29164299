"""The best candidate of each wanted name, found by bounds instead of by all pairs of a surname.

What is best goes by surnames in common, then by the given name, then by the
score.  So the search narrows in three steps, and pairs below the best so far are
never made:

1. Blocks are sets of surnames.  A wanted name keeps the blocks of most surnames
   that anyone bears; without any, those of its short surnames, then of prefixes.
2. Within a block only the distinct given names count.  An equal one can't be
   beaten; else all of the block's given names are compared, in cells of bounded size.
3. Within a block and its best given name, whole names are compared, in such cells.

A cell holds some names of each side, so a common surname is spread over many
tasks.  Inside a cell, letters in common bound every pair's ratio: the pair of the
best bound is compared first, then only those whose bound reaches its score.
Cells of given names are rows in order, a few wanted ones and then many others that
pass by some at a time, so that no task holds a cell and what is known of a wanted
name bounds all that follows.  Cells of whole names are two arrays, taken a few
names at a time.  What leaves a cell is a wanted name's best there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import names as N
from kinloom.functions.similarity import WORD, Strings, in_order, partial_ratio, partials, ratio, ratios
from kinloom.session import cut

#: Whole names on a cell's side, pairs of names that a worker bounds at once, and names that it holds at once.
SIDE, PAIRS, HELD = 512, 300_000, 16_384
#: Wanted given names of a cell and others that pass by them, and how many of these at a time.
FEW, MANY, SOME = 2_048, 131_072, 8_192
#: Bounds so far below a wanted name's best one are looked at last.
NEAR = 7


def _sets(frame: DataFrame, names: str) -> DataFrame:
    """The rows with ``sets``: all sets of up to three names with ``block``, ``rank`` (their number) and ``common`` (common ones)."""
    listed = F.array_sort(names)
    frame = frame.withColumns({f"name{i}": F.get(listed, i) for i in range(3)})
    sets = []
    for m in range(1, 8):
        own = [F.col(f"name{i}") for i in range(3) if m >> i & 1]
        whole = F.lit(True)
        for x in own:
            whole = whole & x.isNotNull()
        common = sum((x.isin(N.COMMON).cast("int") for x in own), F.lit(0))
        sets.append(F.when(whole, F.struct(F.concat(F.lit("s:"), F.concat_ws(" ", *own)).alias("block"), F.lit(len(own)).alias("rank"), common.alias("common"))))
    return frame.withColumn("sets", F.array(*sets)).drop("name0", "name1", "name2")


def wanted_blocks(wanted: DataFrame) -> DataFrame:
    """``key, g, block, rank, common``: sets of surnames by their size, short surnames as 0, prefixes as -1."""
    wanted = wanted.select("key", F.col("given").alias("g"), "surnames", N.drop_short(F.col("surnames")).alias("own"))
    rows = _sets(wanted, "own").select("key", "g", F.explode("sets").alias("b")).where("b IS NOT NULL").select("key", "g", "b.block", "b.rank", "b.common")
    short = wanted.select("key", "g", F.explode(F.array_except("surnames", "own")).alias("s")).select("key", "g", F.concat(F.lit("s:"), "s").alias("block"), F.lit(0).alias("rank"))
    begin = wanted.select("key", "g", F.explode(N.prefixes(F.col("surnames"))).alias("s")).select("key", "g", F.concat(F.lit("p:"), "s").alias("block"), F.lit(-1).alias("rank"))
    return rows.unionByName(short.unionByName(begin).withColumn("common", F.lit(0)))


def people_blocks(people: DataFrame) -> DataFrame:
    """``other, ord, firsts, block`` for every set of surnames and every prefix of a person's name."""
    people = people.select(F.col("key").alias("other"), "ord", "firsts", "surnames")
    sets = _sets(people, "surnames").select("other", "ord", "firsts", F.explode("sets").alias("b")).where("b IS NOT NULL").select("other", "ord", "firsts", "b.block")
    begin = people.select("other", "ord", "firsts", F.explode(N.prefixes(F.col("surnames"))).alias("s"))
    return sets.unionByName(begin.select("other", "ord", "firsts", F.concat(F.lit("p:"), "s").alias("block")))


def best_blocks(wanted: DataFrame, people: DataFrame) -> DataFrame:
    """The wanted names' blocks of the highest rank that a person has."""
    asked = wanted_blocks(wanted).join(people.select("block").distinct(), "block", "left_semi")
    top = asked.groupBy("key").agg(F.max("rank").alias("rank"))
    return asked.join(top, ["key", "rank"])


def cells(left: DataFrame, right: DataFrame, by: list[str], item: Column, other: Column, side: int = SIDE) -> DataFrame:
    """``by, xs, ys``: items of both sides that agree in ``by``, dealt to cells of about ``side`` by ``side`` items."""
    sides = []
    for frame, value in ((left, item), (right, other)):
        sides.append(frame.select(*by, value.alias("v")).withColumn("salt", F.xxhash64("v")))
    counts = [s.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / side).alias(f"n{k}")) for k, s in enumerate(sides)]
    parts = counts[0].join(counts[1], by)
    packed = []
    for k, s in enumerate(sides):
        mine, many = f"c{k}", f"n{1 - k}"
        dealt = s.join(parts, by).withColumn(mine, F.pmod("salt", F.col(f"n{k}")))
        packed.append(dealt.groupBy(*by, mine, many).agg(F.collect_list("v").alias("xy"[k] + "s")).withColumn(f"c{1 - k}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))).drop(many))
    # Cells are few bytes but much work, so a number of tasks is named: by their bytes they would be joined into one.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed[0].join(packed[1], [*by, "c0", "c1"]).repartition(tasks, *by, "c0", "c1").drop("c0", "c1")


def streams(left: DataFrame, right: DataFrame, few: int, many: int) -> DataFrame:
    """``block, c0, c1, side, salt, v``: names of both sides that agree in their block, dealt to cells of about ``few`` by ``many``.

    A partition has whole cells, the left names (side 0) of each before the right
    ones; names of the same letters share a cell and stand side by side.
    """
    sides = [frame.select("block", F.col(name).alias("v")).withColumn("salt", F.xxhash64(_letters(F.col("v")))) for frame, name in ((left, "g"), (right, "t"))]
    counts = [s.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / n).alias(f"n{k}")) for k, (s, n) in enumerate(zip(sides, (few, many), strict=True))]
    parts = counts[0].join(counts[1], "block")
    rows = []
    for k, s in enumerate(sides):
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{1 - k}") - 1))
        rows.append(s.join(parts, "block").select("block", F.pmod("salt", F.col(f"n{k}")).alias(f"c{k}"), other.alias(f"c{1 - k}"), F.lit(k).alias("side"), "salt", "v").select("block", "c0", "c1", "side", "salt", "v"))
    # Cells are few bytes but much work, so a number of tasks is named: by their bytes they would be joined into one.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows[0].unionByName(rows[1]).repartition(tasks, "block", "c0", "c1").sortWithinPartitions("block", "c0", "c1", "side", "salt")


def _letters(name: Column) -> Column:
    """A name's letters in order; anagrams have the same."""
    return F.array_join(F.array_sort(F.split(name, "")), "")


def _pairs(xs: np.ndarray, ys: np.ndarray):
    """Slices of cells with at most ``PAIRS`` pairs (or one row of a cell): pairs' places in both sides, and the cell of each left item."""
    x_at, y_at = np.concatenate(([0], np.cumsum(xs))), np.concatenate(([0], np.cumsum(ys)))
    cell = np.repeat(np.arange(len(xs)), xs)
    width = ys[cell]
    done = np.concatenate(([0], np.cumsum(width)))
    a = 0
    while a < len(cell):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
        w = width[a:b]
        left = np.repeat(np.arange(a, b), w)
        right = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(y_at[cell[a:b]], w)
        yield left, right
        a = b


def _bags(table: Strings) -> list[np.ndarray]:
    """How often each letter stands in each string of both sides."""
    out = []
    for codes, sizes in zip(table.codes, table.sizes, strict=True):
        bag = np.zeros((len(codes), len(table.letters)), np.uint8)
        rows = np.arange(len(codes))
        for i in range(codes.shape[1]):
            live = rows[i < sizes]
            bag[live, codes[live, i]] += 1
        out.append(bag)
    return out


def _alike(bags: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Letters in common: no common subsequence is longer."""
    out, step = np.empty(len(x), np.int64), max(1, (16 << 20) // max(1, bags[0].shape[1]))
    for i in range(0, len(x), step):
        out[i : i + step] = np.minimum(bags[0][x[i : i + step]], bags[1][y[i : i + step]]).sum(1, dtype=np.int64)
    return out


def _leaders(left: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The pair of the highest bound of each left item; ``left`` is in order."""
    head = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
    high = np.maximum.reduceat(bound, head)
    size = np.diff(np.append(head, len(left)))
    at = np.flatnonzero(bound == np.repeat(high, size))
    return at[np.unique(left[at], return_index=True)[1]]


def search(left: np.ndarray, right: np.ndarray, bound: np.ndarray, score) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that have their left item's highest score, and that score; only pairs whose bound reaches a known score are compared."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = _leaders(left, bound)
    known = np.zeros(int(left.max()) + 1, np.int64)
    known[left[first]] = score(left[first], right[first])
    rest = bound >= known[left]
    at = np.flatnonzero(rest)
    value = score(left[at], right[at])
    np.maximum.at(known, left[at], value)
    best = value == known[left[at]]
    return at[best], value[best]


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _compare(work, one, table: Strings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``work`` on pairs whose strings fit a word, ``one`` on the others."""
    fits = (table.sizes[0][x] <= WORD) & (table.sizes[1][y] <= WORD)
    if fits.all():
        return work(table, x, y)
    out = np.zeros(len(x), np.int32)
    out[fits] = work(table, x[fits], y[fits])
    for i in np.flatnonzero(~fits):
        out[i] = one(table.texts[0][x[i]], table.texts[1][y[i]])
    return out


def _whole(total: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.where(total > 0, np.rint(200 * common / np.maximum(total, 1)), 0).astype(np.int64)


def _by_letters(bag: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of one cell and the same letters as groups: the names in the groups' order, where each group begins, its cell."""
    order = np.lexsort((*bag.T, cell))
    new = np.ones(len(order), bool)
    new[1:] = (bag[order[1:]] != bag[order[:-1]]).any(1) | (cell[order[1:]] != cell[order[:-1]])
    head = np.flatnonzero(new)
    return order, np.append(head, len(order)), cell[order[head]]


def _expanded(left: np.ndarray, right: np.ndarray, x_at: np.ndarray, y_at: np.ndarray):
    """Slices of pairs of groups as pairs of places, at most ``PAIRS`` (or one pair of groups), and the pair of groups of each."""
    size = (x_at[left + 1] - x_at[left]) * (y_at[right + 1] - y_at[right])
    done, a = np.concatenate(([0], np.cumsum(size))), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
        of = np.repeat(np.arange(a, b), size[a:b])
        i, width = np.arange(len(of)) - (done[of] - done[a]), y_at[right[of] + 1] - y_at[right[of]]
        yield x_at[left[of]] + i // width, y_at[right[of]] + i % width, of
        a = b


def _closest(wanted: list[str], others: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs whose ratio is a wanted name's best of what is known and of all these others, and that ratio; ``known`` is raised.

    Names of the same letters have the same bounds, so bounds are taken once for each two sets of letters.
    """
    table = Strings(wanted, others)
    bags = _bags(table)
    x, x_at, _ = _by_letters(bags[0], np.zeros(len(wanted), np.int8))
    y, y_at, _ = _by_letters(bags[1], np.zeros(len(others), np.int8))
    some = [bags[0][x[x_at[:-1]]], bags[1][y[y_at[:-1]]]]
    sizes = [g.sum(1, dtype=np.int64) for g in some]
    best, found = known[x], []
    for left, right in _pairs(np.array([len(some[0])]), np.array([len(some[1])])):
        bound = _whole(sizes[0][left] + sizes[1][right], _alike(some, left, right))
        first = _leaders(left, bound)
        own = np.arange(x_at[left[first[0]]], x_at[left[first[-1]] + 1])  # a slice's groups stand one after another
        lead, most = (np.repeat(c, np.diff(x_at)[left[first]]) for c in (y_at[right[first]], bound[first]))
        rise = most > best[own]
        best[own[rise]] = np.maximum(best[own[rise]], _compare(ratios, ratio, table, x[own[rise]], y[lead[rise]]))
        high = np.zeros(len(some[0]), np.int64)
        high[left[first]] = bound[first]
        near = bound + NEAR >= high[left]
        for part in (near, ~near):  # pairs of the best bounds first: what they score spares most of the others
            keep = np.flatnonzero(part & (bound >= np.minimum.reduceat(best, x_at[:-1])[left]))
            for i, j, of in _expanded(left[keep], right[keep], x_at, y_at):
                fits = bound[keep][of] >= best[i]
                i, j = i[fits], j[fits]
                value = _compare(ratios, ratio, table, x[i], y[j]).astype(np.int64)
                np.maximum.at(best, i, value)
                top = value == best[i]
                found.append((i[top], j[top], value[top]))
    known[x] = best
    i, j, value = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    top = value == best[i]
    return x[i[top]], y[j[top]], value[top]


def _given(batches):
    """Of each cell of ``streams``: given names asked for, their best ratio there, and the given names that have it."""
    cell, wanted, known, found, held = None, [], None, [], 0

    def best():
        i, t, value = (np.concatenate(c) for c in zip(*found, strict=True))
        top = value == known[i]
        return i[top], t[top], value[top]

    def result():
        i, t, value = best()
        return pa.RecordBatch.from_arrays([pa.array([cell[0]] * len(i), pa.string()), pa.array([wanted[k] for k in i], pa.string()), pa.array(t, pa.string()), pa.array(value, pa.int32())], ["block", "g", "t", "s_given"])

    for batch in batches:
        if not len(batch):
            continue
        block = batch.column(0).dictionary_encode()
        at = [block.indices.to_numpy(), *(batch.column(k).to_numpy() for k in (1, 2, 3))]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in at], axis=0)))
        edges = np.append(np.flatnonzero(new), len(batch))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = (block.dictionary[at[0][a]].as_py(), at[1][a], at[2][a])
            if own != cell:
                if found:
                    yield result()
                cell, wanted, known, found, held = own, [], None, [], 0
            names = batch.column(5).slice(a, b - a).to_pylist()
            if at[3][a] == 0:
                wanted += names
                continue
            known = np.zeros(len(wanted), np.int64) if known is None else known
            for k in range(0, len(names), SOME):
                others = names[k : k + SOME]
                i, j, value = _closest(wanted, others, known)
                found.append((i, np.array(others, object)[j], value))
                held += len(i)
                if held > HELD * 8:  # names that were the best for a while go
                    found = [best()]
                    held = len(found[0][0])
    if found:
        yield result()


def _slices(batches):
    """Cells of at most ``HELD`` names at once, or one larger."""
    for batch in batches:
        size = sum(batch.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        done, a = np.concatenate(([0], np.cumsum(size))), 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(done, done[a] + HELD, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _names(batches):
    """Of each cell: wanted names with the other name of the best score there, the first person's if several have it."""
    for batch in _slices(batches):
        (xs, m), (ys, n) = _lists(batch.column(0)), _lists(batch.column(1))
        mine, other, order = xs.field(0), ys.field(0), ys.field(2).to_numpy()
        table, sorted_ = Strings(mine.to_pylist(), other.to_pylist()), Strings(xs.field(1).to_pylist(), ys.field(1).to_pylist())
        less = xs.field(2).to_numpy().astype(np.int64)
        bags = _bags(table)
        for left, right in _pairs(m, n):
            common = _alike(bags, left, right)
            a, b = table.sizes[0][left], table.sizes[1][right]
            short = np.minimum(a, b)
            most = np.minimum(common, short)
            bound = 11 * _whole(a + b, common) + 5 * _whole(short + most, most)

            def both(x, y):
                return _compare(ratios, ratio, sorted_, x, y), _compare(partials, partial_ratio, table, x, y)

            def score(x, y):
                token, part = both(x, y)
                return 11 * token.astype(np.int64) + 5 * part

            at, value = search(left, right, bound, score)
            rank = np.lexsort((order[right[at]], left[at]))
            keep = rank[np.unique(left[at][rank], return_index=True)[1]] if len(rank) else rank
            x, y = left[at][keep], right[at][keep]
            token, part = both(x, y)
            yield pa.RecordBatch.from_arrays(
                [mine.take(pa.array(x)), other.take(pa.array(y)), pa.array(order[y]), pa.array(token, pa.int32()), pa.array(part, pa.int32()), pa.array(value[keep] - 80 * less[x], pa.int64())],
                ["key", "other", "ord", "s_token", "s_part", "value"],
            )


def best_candidates(wanted: DataFrame, people: DataFrame, side: int = SIDE) -> DataFrame:
    """``key, other, ord, s_given, s_token, s_part, inter``: each wanted name's best person, if any shares a surname or a prefix.

    ``wanted`` and ``people`` are names' features, people with ``ord``, each name
    once.  The same as the best of all pairs of the pools.
    """
    people = cut(people_blocks(people), "people-blocks")
    asked = cut(best_blocks(wanted, people), "best-blocks")
    people = people.join(asked.select("block").distinct(), "block", "left_semi")
    people = people.select("block", "other", "ord", F.explode(F.array_distinct("firsts")).alias("t"))
    given = people.select("block", "t").distinct()
    # A ratio below 100 may round to 100 only for names of a hundred letters, which are compared like others.
    equal = asked.where(F.length("g") < 90).join(given, (asked["block"] == given["block"]) & (asked["g"] == given["t"])).select(asked["*"], "t", F.lit(100).alias("s_given"))
    rest = asked.join(equal.select("key").distinct(), "key", "left_anti")
    found = streams(rest.select("block", "g").distinct(), given, min(FEW, 4 * side), min(MANY, 256 * side)).mapInArrow(_given, "block string, g string, t string, s_given int")
    found = cut(found, "best-of-cells")  # it is read twice
    near = rest.join(found, ["block", "g"])
    top = near.groupBy("key").agg(F.max("s_given").alias("s_given"))
    chosen = equal.select("key", "block", "common", "rank", "t", "s_given").unionByName(near.join(top, ["key", "s_given"]).select("key", "block", "common", "rank", "t", "s_given"))
    chosen = cut(chosen, "best-given")
    own = F.struct("key", in_order(F.col("key")).alias("sorted"), "common")
    theirs = F.struct("other", in_order(F.col("other")).alias("sorted"), "ord")
    compared = cells(chosen, people, ["block", "t"], own, theirs, side).select("xs", "ys").mapInArrow(_names, "key string, other string, ord long, s_token int, s_part int, value long")
    row = F.struct("other", "ord", "s_token", "s_part")
    best = compared.groupBy("key").agg(F.max_by(row, F.struct("value", (-F.col("ord")).alias("first"))).alias("b")).select("key", "b.*")
    facts = chosen.groupBy("key").agg(F.max("s_given").alias("s_given"), F.greatest(F.max("rank"), F.lit(0)).alias("inter"))
    return best.join(facts, "key")
