"""Shortest paths through marriages: persons and families as one undirected graph.

Both ends of a pair spread, two edges at a time: from persons by their families to
the families' other persons.  It is always the turn of the side whose last level is
the smaller, so that a few ends are spread over the tree instead of many.  A level is a table of (end, person); on
the second end's side each row also names the best step back to that end.  In such a
graph a level's neighbours lie in the level before or the one behind, so what was
seen is the level before and no more.  Paths aren't carried along.  Where a pair has
met, the persons on its shortest paths are marked backwards over the written levels,
and one path is read off forwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.pedigree import edges
from kinloom.session import cut, cut_and_count

HOPS = 40
#: Steps of a path that are read off between two written tables.
STEP = 3


def _places(person: DataFrame, member: DataFrame) -> DataFrame:
    """``pid, po, fid, fo``: who is in which family, with both's ordinals."""
    order = member.groupBy("fid").agg(F.min("fam_ord").alias("fo"))
    own = edges(person, member).join(person.select(F.col("pid").alias("src"), F.col("ord").alias("po")), "src")
    return own.select(F.col("src").alias("pid"), "po", F.col("dst").alias("fid")).join(order, "fid").select("pid", "po", "fid", "fo")


def _spread(level: DataFrame, before: DataFrame | None, places: DataFrame) -> DataFrame:
    """The next level of each end: ``src, node, back``, where ``back`` is the best step to the level: family's and person's ordinal, person."""
    step = F.min(F.struct("po", F.col("node").alias("to"))).alias("s")
    families = level.join(places.withColumnRenamed("pid", "node"), "node").groupBy("src", "fid", "fo").agg(step)
    back = F.min(F.struct("fo", "s.po", "s.to")).alias("back")
    new = families.join(places.select("fid", F.col("pid").alias("node")), "fid").groupBy("src", "node").agg(back)
    new = new.join(level.select("src", "node"), ["src", "node"], "left_anti")
    return new.join(before.select("src", "node"), ["src", "node"], "left_anti") if before is not None else new


def _marked(met: DataFrame, levels: list[DataFrame], last: int, places: DataFrame) -> dict[int, DataFrame]:
    """For each step from the first end: ``a, b, node`` of the persons on a shortest path, of the pairs that met at that step or later."""
    marks = {}
    for k in range(last, 0, -1):
        own = met.where(F.col("i") == k).select("a", "b", "node")
        if k < last:
            families = marks[k + 1].join(places.select(F.col("pid").alias("node"), "fid"), "node").select("a", "b", "fid").distinct()
            near = families.join(places.select("fid", F.col("pid").alias("node")), "fid").select("a", "b", "node").distinct()
            own = own.unionByName(near.join(levels[k].select(F.col("src").alias("a"), "node"), ["a", "node"], "left_semi").select("a", "b", "node"))
        marks[k] = cut(own, "marks")
    return marks


def _read(met: DataFrame, left: list[DataFrame], right: list[DataFrame], places: DataFrame) -> DataFrame:
    """``a, b, path`` of pairs that met at the persons ``node``, ``i`` steps from the first end and ``j`` from the second."""
    path = met.select("a", "b", "i", "j").distinct().select("a", "b", "i", "j", F.col("a").alias("at"), F.array("a").alias("path"))
    columns, (most_i, most_j) = path.columns, met.agg(F.max("i"), F.max("j")).first()
    one, two = places.select(F.col("pid").alias("at"), "fid", "fo"), places.select("fid", F.col("pid").alias("node"), "po")
    marks, done = _marked(met, left, most_i, places), 0

    def stepped(path: DataFrame, going, to: DataFrame) -> DataFrame:
        """Paths that go on, with their next person from ``a, b, next``, and the others as they are."""
        nonlocal done
        done += 1
        on = path.where(going).join(to, ["a", "b"]).withColumn("path", F.concat("path", F.array("next"))).withColumn("at", F.col("next")).select(columns)
        path = on.unionByName(path.where(~going))
        return cut(path, "paths") if done % STEP == 0 else path

    for k in range(1, most_i + 1):
        going = F.col("i") >= k
        near = path.where(going).select("a", "b", "at").join(one, "at").join(two, "fid").join(marks[k], ["a", "b", "node"], "left_semi")
        path = stepped(path, going, near.groupBy("a", "b").agg(F.min(F.struct("fo", "po", "node"))["node"].alias("next")))
    for k in range(most_j, 0, -1):
        going = F.col("j") >= k
        back = right[k].select(F.col("src").alias("b"), F.col("node").alias("at"), F.col("back.to").alias("next"))
        path = stepped(path, going, path.where(going).select("a", "b", "at").join(back, ["b", "at"]).select("a", "b", "next"))
    return path.select("a", "b", "path")


def shortest_paths(pairs: DataFrame, person: DataFrame, member: DataFrame, hops: int = HOPS) -> DataFrame:
    """``a, b, path``: the persons on a shortest path of at most ``hops`` edges, two persons at least.

    Of equally short paths the one counts whose ordinals are the smallest,
    position by position: the second person's family's, the second person's, and
    so on, by ``ord`` and ``fam_ord``.  Ends that aren't persons have no path;
    repeated pairs count once.
    """
    known = person.select("pid")
    pairs = pairs.select("a", "b").distinct().where("a <> b").join(known.withColumnRenamed("pid", "a"), "a", "left_semi").join(known.withColumnRenamed("pid", "b"), "b", "left_semi")
    open_, n_open = cut_and_count(pairs, "pairs")
    places, found = cut(_places(person, member), "places"), []
    levels = {end: [open_.select(F.col(end).alias("src")).distinct().select("src", F.col("src").alias("node"), F.lit(None).cast("struct<fo: long, po: long, to: string>").alias("back"))] for end in "ab"}
    sizes = {end: level[0].count() for end, level in levels.items()}
    for _ in range(hops // 2):
        if not n_open:
            break
        end = min("ab", key=sizes.get)
        own = levels[end]
        live = own[-1].join(open_.select(F.col(end).alias("src")).distinct(), "src", "left_semi")
        level, sizes[end] = cut_and_count(_spread(live, own[-2] if len(own) > 1 else None, places), "spread")
        own.append(level)
        if not sizes[end]:
            break
        met = open_.join(levels["a"][-1].select(F.col("src").alias("a"), "node"), "a").join(levels["b"][-1].select(F.col("src").alias("b"), "node"), ["b", "node"])
        met, n = cut_and_count(met.select("a", "b", "node", F.lit(len(levels["a"]) - 1).alias("i"), F.lit(len(levels["b"]) - 1).alias("j")), "met")
        if n:
            found.append(met)
            open_, n_open = cut_and_count(open_.join(met.select("a", "b").distinct(), ["a", "b"], "left_anti"), "pairs")
    if not found:
        return pairs.where(F.lit(False)).withColumn("path", F.array().cast("array<string>"))
    return _read(reduce(DataFrame.unionByName, found), levels["a"], levels["b"], places)
