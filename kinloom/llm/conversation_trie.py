"""A trie of conversations' shared beginnings, built level by level.

Turns are numbered within their conversation; a turn's content is known by the
SHA-256 of its role and text.  Per depth, the live conversations are grouped by
(parent node, next turn); the smallest conv_id of a group is its node's name at
that depth.  A conversation leaves the loop when its node has no other member:
what is left of it is a chain, whose nodes are written from its turns at once.  So
there are as many levels as the longest beginning that two conversations share.
Leaves and savings are then rolled up by joins of each level with the one below.

A group of any size is handled by its counts: the groups that hold more than a
thousandth of the conversations, at most a thousand, are joined by broadcast, the
others by shuffle.  A conversation of any length is numbered in ranges of turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.scratch import Scratch

#: Conversations from which a group is joined by broadcast; groups that hold a ``SHARE``-th of all are joined so at least.
HOT, SHARE = 1000, 1000
#: Turns of a chain that are written by one key, and the span of ids whose decimals are joined in one string.
CHAIN, SPAN = 4096, 50_000


def _numbered(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns with a running number of the table's order, and for each conversation and range of rows where its own begin.

    Rows are sorted in ranges that may cut a conversation, so none is too long for a task.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    content = F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    rows = scratch.cut(
        rows.select("conv_id", F.unhex(F.sha2(content, 256)).alias("key"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")), "rows"
    )
    part = F.shiftright("row", 33).alias("part")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", part).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = scratch.cut(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "parts")
    return rows.withColumn("part", part), parts


def rebuilt(conversations: DataFrame, scratch: Scratch, heads=None) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, at, key, chars)`` per turn, counted from 0, and ``(conv_id, size)`` per conversation.

    Turns stand in ascending order, null first, ties by role and text.  With
    ``heads``, a function from the id to (how many, at most 64; whose), so many
    of a conversation's first turns are replaced by the first turns of another
    one: all of them if it has fewer, none if it isn't there.
    """
    rows, parts = _numbered(conversations, scratch)
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    if heads:
        many, whose = heads(F.col("conv_id"))
        convs = convs.withColumn("h", many.cast("long")).withColumn("base", whose)
        lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
        lengths = lengths.join(convs.select("base").distinct(), "base", "left_semi")
        convs = convs.join(lengths, "base", "left").withColumn("nb", F.least("h", F.coalesce("base_n", F.lit(0))))
    else:
        convs = convs.withColumn("h", F.lit(0).cast("long")).withColumn("nb", F.lit(0).cast("long")).withColumn("base", F.lit(None).cast("long"))
    convs = scratch.cut(convs.select("conv_id", "base", "h", "nb", (F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    placed = rows.join(parts.drop("n").join(convs.drop("size", "base"), "conv_id"), ["conv_id", "part"])
    placed = placed.withColumn("nth", F.col("before") + F.col("row") - F.col("first"))
    turns = placed.where("nth >= h").select("conv_id", (F.col("nth") - F.col("h") + F.col("nb")).alias("at"), "key", "chars")
    if heads:
        asked = convs.where("nb > 0").select("conv_id", "base", "nb")
        first = placed.where("nth < 64").select(F.col("conv_id").alias("base"), F.col("nth").alias("at"), "key", "chars")
        turns = turns.unionByName(first.join(asked, "base").where("at < nb").select("conv_id", "at", "key", "chars"))
    turns = scratch.cut(turns.repartitionByRange("at", "conv_id").sortWithinPartitions("at", "conv_id"), "turns")  # a level reads its own row groups
    return turns, convs.select("conv_id", "size")


def _assigned(live: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Live conversations of shared groups with the name of their new node."""
    least = max(HOT, total // SHARE)
    groups = groups.where("n_convs > 1").select("node", "key", F.col("conv_id").alias("child"), "n_convs")
    hot = F.broadcast(groups.where(F.col("n_convs") >= least).drop("n_convs"))  # at most total / least groups
    cold = groups.where(F.col("n_convs") < least).drop("n_convs")
    live = live.where("key IS NOT NULL").select("conv_id", "size", "node", "key")
    found = live.join(hot, ["node", "key"]).unionByName(live.join(hot, ["node", "key"], "left_anti").join(cold, ["node", "key"]))
    return found.select("conv_id", "size", F.col("child").alias("node"))


def prefix_trie(conversations: DataFrame, scratch: Scratch, heads=None) -> tuple[DataFrame, DataFrame]:
    """Nodes, and which conversations end at them.

    Nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at
    the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (summed over
    the subtree with its top: members but one, times the code points of the
    node's last text), and ``single``: whether one conversation alone is its member.
    Ends: ``conv_id, depth, member`` for the nodes that aren't single.

    Null roles and texts are empty, null conv_ids are no conversation, repeated
    rows are turns of their own, other columns are ignored, and an empty table
    has no node, not even the root.  ``heads`` is that of ``rebuilt``.
    """
    spark = scratch.spark
    turns, convs = rebuilt(conversations, scratch, heads)
    total, root = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    levels, lives, rolls = scratch.path("levels"), scratch.path("live"), scratch.path("rolled")

    def written(frame: DataFrame, folder: str, depth: int) -> DataFrame:
        path = f"{folder}/depth={depth}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    def with_turn(live: DataFrame, depth: int) -> DataFrame:
        return live.join(turns.where(F.col("at") == depth).select("conv_id", "key", "chars"), "conv_id", "left")

    top = convs.limit(0) if root is None else convs
    live = written(with_turn(top.withColumn("node", F.lit(root).cast("long")), 0), lives, 0)
    depth, found = 0, []
    while root is not None:
        groups = live.where("key IS NOT NULL").groupBy("node", "key").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("size").alias("size")
        )
        groups = written(groups, levels, depth + 1)
        found.append(groups)
        shared = groups.where("n_convs > 1").limit(1).count()
        if not shared:
            break
        depth += 1
        live = written(with_turn(_assigned(live, groups, total), depth), lives, depth)

    schema = "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, single boolean, size long"
    below = spark.createDataFrame([], schema)
    for d in range(len(found), -1, -1):
        if d:
            single = F.col("n_convs") == 1
            nodes = found[d - 1].select("conv_id", F.col("node").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), single.alias("single"), "size")
        else:
            nodes = spark.createDataFrame([(root, None, total, 0, False, None)] if total else [], "conv_id long, parent_conv_id long, n_convs long, own long, single boolean, size long")
        under = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        joined = nodes.where("NOT single").join(under, "conv_id", "left").unionByName(nodes.where("single"), allowMissingColumns=True)
        rolled = joined.select(
            "conv_id",
            "parent_conv_id",
            "n_convs",
            F.when(F.col("single"), (F.col("size") > d).cast("long")).otherwise(F.coalesce("c", F.lit(0))).alias("n_children"),
            F.coalesce("l", F.lit(1)).alias("n_leaves"),
            (F.col("own") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
            "single",
            "size",
        )
        below = written(rolled, rolls, d)

    nodes = spark.read.schema(f"{schema}, depth int").parquet(rolls).withColumn("depth", F.col("depth").cast("long"))
    chains = nodes.where("single AND size > depth").select("conv_id", F.col("depth").alias("start"), "size")
    part = F.floor(F.col("at") / CHAIN).alias("part")
    chains = chains.withColumn("part", F.explode(F.sequence(F.floor(F.col("start") / CHAIN), F.floor((F.col("size") - 1) / CHAIN))))
    deeper = turns.select("conv_id", "at", part).join(chains, ["conv_id", "part"]).where("at >= start")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    deeper = deeper.select(
        "conv_id", (F.col("at") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("at") + 1 < F.col("size")).cast("long").alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.lit(True).alias("single"),
    )
    ends = spark.read.schema("conv_id long, size long, node long, depth int").parquet(lives).where("size = depth")
    return nodes.drop("size").unionByName(deeper), ends.select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("conv_id").alias("member"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: SHA-256 of the members' decimals, ascending, with commas between.

    Ids of one span are joined natively, at most ``SPAN`` of them; a node's spans
    are hashed one after another as they are read, so that no list of all members is held.
    """
    span = F.floor(F.col("member") / SPAN).alias("span")
    some = ends.groupBy("depth", "conv_id", span).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("text"))
    dealt = some.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "span").select("conv_id", "depth", "text")

    def digests(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for conv, depth, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, depth) == now:
                    state.update(b"," + text.encode())
                    continue
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (conv, depth), hashlib.sha256(text.encode())
            yield _digest_rows(done)
        if now:
            yield _digest_rows([(*now, state.hexdigest())])

    return dealt.mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    conv, depth, text = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(text, pa.string())], ["conv_id", "depth", "ends_sha256"])


def shared_heads(conv_id: Column) -> tuple[Column, Column]:
    """The first crc32(decimal) mod 6 turns are those of the last hundred's conversation."""
    return F.crc32(conv_id.cast("string")) % 6, conv_id - conv_id % 100
