"""Ancestors and common ancestors.

The search climbs from both ends, level by level, the first end first, and stops
when an end has no one left to climb to.  Its outcome has a closed form over the
two closures of ancestors, so many pairs are answered at once with joins.

Where few first ends meet most of a tree, the second ends don't climb: the first ends'
ancestors descend, which reaches only those who share them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.session import cut, cut_and_count

#: Most levels of a climb, and levels between two written tables.
DEPTH, STEP = 20, 4
#: Rows of one side's ancestors to broadcast at most; beyond, the join shuffles.
FEW = 200_000
#: Second ends for each first end, at least, and persons with parents for each second end, at most, where ancestors descend.
MANY, REST = 64, 2


def closure(starts: DataFrame, parents: DataFrame, depth: int = DEPTH, down: bool = False) -> DataFrame:
    """``src, node, d, o, ids``: each ancestor's least distance and, of such climbs, the first by parents' places.

    With ``down`` the nodes are those who climb to the start: ``o`` and ``ids`` are their climbs.
    """
    level = seen = cut(starts.select("src").distinct().select("src", F.col("src").alias("node"), F.lit(0).alias("d"), F.array().cast("array<int>").alias("o"), F.array("src").alias("ids")), "level")
    at, to = ("parent", "child") if down else ("child", "parent")

    def longer(climb, step):
        return F.concat(F.array(step), climb) if down else F.concat(climb, F.array(step))

    best = F.min(F.struct(longer("o", "pos").alias("o"), longer("ids", to).alias("ids"))).alias("b")
    for d in range(1, depth + 1, STEP):
        steps = []
        for k in range(d, min(d + STEP, depth + 1)):
            up = level.join(parents, level.node == parents[at]).groupBy("src", F.col(to).alias("node")).agg(best)
            level = up.select("src", "node", F.lit(k).alias("d"), "b.o", "b.ids")
            steps.append(level)
        written, n = cut_and_count(reduce(DataFrame.unionByName, steps), "levels")
        if not n:
            break
        seen, level = seen.unionByName(written), written.where(F.col("d") == k)
    # A least climb goes by least climbs, so that climbs round about fall out here.
    return seen.groupBy("src", "node").agg(F.min(F.struct("d", "o", "ids")).alias("b")).select("src", "node", "b.d", "b.o", "b.ids")


def _met_above(pairs: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """``a, b, node, d1, o1, i1, m1, d2, o2, i2, m2`` of all common ancestors, by climbs of both ends; ``m`` is an end's highest ancestor."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("src"))
    reach = cut(closure(ends, parents, depth), "closure")
    top = reach.groupBy("src").agg(F.max("d").alias("m"))
    one = pairs.join(top.select(F.col("src").alias("a"), F.col("m").alias("m1")), "a").join(top.select(F.col("src").alias("b"), F.col("m").alias("m2")), "b")
    # The second ends' ancestors meet the first ends' by both, so a first end that all pairs share multiplies nothing.
    right = one.join(reach.select(F.col("src").alias("b"), "node", F.col("d").alias("d2"), F.col("o").alias("o2"), F.col("ids").alias("i2")), "b")
    left = reach.join(pairs.select(F.col("a").alias("src")).distinct(), "src", "left_semi")
    left = left.select(F.col("src").alias("a"), "node", F.col("d").alias("d1"), F.col("o").alias("o1"), F.col("ids").alias("i1"))
    return right.join(F.broadcast(left) if left.count() <= FEW else left, ["a", "node"])


def _met_below(pairs: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """The same rows, by the first ends' climbs and their ancestors' descents.

    ``m2`` is asked for only where a second end is nearer by two or more, so only those climb too; elsewhere it is null.
    """
    reach = cut(closure(pairs.select(F.col("a").alias("src")), parents, depth), "climbs")
    top = reach.groupBy("src").agg(F.max("d").alias("m1"))
    left = reach.join(top, "src").select(F.col("src").alias("a"), "node", F.col("d").alias("d1"), F.col("o").alias("o1"), F.col("ids").alias("i1"), "m1")
    below = closure(reach.select(F.col("node").alias("src")), parents, depth, down=True)
    below = below.select(F.col("src").alias("node"), F.col("node").alias("b"), F.col("d").alias("d2"), F.col("o").alias("o2"), F.col("ids").alias("i2"))
    both = cut(below.join(F.broadcast(left) if left.count() <= FEW else left, "node").join(pairs, ["a", "b"], "left_semi"), "descents")
    near = both.where(F.col("d1") > F.col("d2") + 1).select(F.col("b").alias("src"))
    height = closure(near, parents, depth).groupBy(F.col("src").alias("b")).agg(F.max("d").alias("m2"))
    return both.join(height, "b", "left")


def common_ancestors(pairs: DataFrame, parents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``a, b, path, ancestor`` for the pairs whose climb meets; a person and itself meet at once."""
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    few, many = pairs.agg(F.count_distinct("a"), F.count_distinct("b")).first()
    low = few * MANY <= many and parents.select("child").distinct().count() <= many * REST
    both = (_met_below if low else _met_above)(pairs.where("a <> b"), parents, depth)
    first = (F.col("d1") == F.col("d2")) | (F.col("d1") > F.col("d2") + 1)
    both = both.select(
        "a", "b", "node", "i1", "i2",
        F.when(first, F.col("d1")).otherwise(F.col("d2")).alias("round"),
        F.when(first, 0).otherwise(1).alias("phase"),
        F.when(first, F.col("o1")).otherwise(F.col("o2")).alias("key"),
        F.when(F.col("d1") == F.col("d2"), True).when(first, F.col("m2") >= F.col("d1") - 1).otherwise(F.col("m1") >= F.col("d2")).alias("ok"),
    ).where(F.col("ok") & (F.col("round") < depth))
    best = both.groupBy("a", "b").agg(F.min_by(F.struct("node", "i1", "i2"), F.struct("round", "phase", "key")).alias("m"))
    down = F.reverse("m.i2")
    path = F.concat("m.i1", F.slice(down, 2, F.size(down)))
    met = best.select("a", "b", path.alias("path"), F.col("m.node").alias("ancestor"))
    same = pairs.where("a = b").select("a", "b", F.array("a").alias("path"), F.col("a").alias("ancestor"))
    return met.unionByName(same)
