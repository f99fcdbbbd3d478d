"""The trie of conversations that begin alike, rolled up in bands of fixed height.

A conversation is first rebuilt: its opening turns are those of the first conversation of its block of ``BLOCK`` ids.
A node is a distinct sequence of opening turns. Its key is made of sums over (place, turn) hashes, so that prefixes
of a very long conversation come from sums over chunks of it and never from one task that reads it whole.

Totals of subtrees: within a band of ``band`` depths a node explodes to its ancestors in that band only. The tops of
the bands form a smaller trie, whose bands are treated likewise, and so on; the completed totals of the tops then go
down again and count in the band above them. So no node explodes to more than ``band`` ancestors, and a trie of depth
d takes about 2 log(d) / log(band) rounds.

Order: turn, NULL first; ties by the MD5 of role and text, and equal rows follow one another. NULL role or text is empty; rows
without conv_id are left out; repeated rows are turns of their own; an empty table has no node, not even the root.
Extra columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.texts import WORD, written

BAND = 16
BLOCK = 20
OPENINGS = 4
#: Turns of a conversation that are summed in one group, and characters of ids that are joined before the last sort.
CHUNK = 4096
JOINED = 1 << 16
SUMS = ("s1", "s2", "s3", "s4")
KEY = ("k1", "k2")
UP = ("p1", "p2")


def _positions(conversations: DataFrame) -> DataFrame:
    """conv_id, pos from 0, x (digest of role and text) and words. Rows are ranged before they are numbered, so that one
    conversation may span many tasks."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("x")
    words = F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    known = conversations.where("conv_id is not null")
    rows = known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest, words, F.monotonically_increasing_id().alias("tie"))
    order = ("turn", "x", "tie")
    ranged = written(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-ranged")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).where("before is not null").drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    # at most one conversation of each part began in an earlier one
    numbered = ranged.withColumn("at", place).join(F.broadcast(later), ["conv_id", "part"], "left")
    return written(numbered.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0)) - 1).cast("long").alias("pos"), "x", "words"), "trie-turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, i, x, words, size of each rebuilt turn; conv_id and size of each conversation."""
    turns = _positions(conversations)
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("most"))
    base = F.expr(f"conv_id - conv_id % {BLOCK}")
    own = sizes.select("conv_id", (F.col("most") + 1).alias("n"), base.alias("base"))
    wanted = F.when(base == F.col("conv_id"), F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS)
    own = own.withColumn("wanted", wanted.cast("long"))
    first = sizes.where(f"conv_id % {BLOCK} = 0").select(F.col("conv_id").alias("base"), (F.col("most") + 1).alias("there"))
    taken = F.least("wanted", F.coalesce("there", F.lit(0)))
    plan = own.join(first, "base", "left").withColumn("taken", taken)
    plan = plan.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("wanted"), F.lit(0)))
    plan = written(plan.select("conv_id", "base", "wanted", "taken", "size"), "trie-plan")
    later = turns.join(plan, "conv_id").where("pos >= wanted").withColumn("i", F.expr("pos - wanted + taken"))
    heads = turns.where(f"conv_id % {BLOCK} = 0 and pos < {OPENINGS - 1}").withColumnRenamed("conv_id", "base")
    opening = heads.join(plan, "base").where("pos < taken").withColumn("i", F.col("pos"))
    columns = ("conv_id", "i", "x", "words", "size")
    return written(later.select(*columns).unionByName(opening.select(*columns)), "trie-rebuilt"), plan.select("conv_id", "size")


def _key(depth: Column, sums: list[Column], names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), depth, *sums).alias(name) for seed, name in zip((3, 4), names)]


def _members(conversations: DataFrame) -> DataFrame:
    """A row for each conversation and node on its path: conv_id, depth, the node's key, its parent's key, words, last."""
    turns, plan = rebuilt(conversations)
    one, two = (F.xxhash64(F.lit(seed), "i", "x") for seed in (1, 2))
    low = F.lit((1 << 32) - 1)
    parts = (one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32))
    rows = turns.select("*", F.floor(F.col("i") / CHUNK).alias("chunk"), *(p.alias(f"f{s}") for p, s in zip(parts, SUMS)))
    totals = rows.groupBy("conv_id", "chunk").agg(*(F.sum(f"f{s}").alias(f"t{s}") for s in SUMS))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "chunk", *(F.sum(f"t{s}").over(earlier).alias(f"b{s}") for s in SUMS)).where("chunk > 0")
    within = Window.partitionBy("conv_id", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *(F.sum(f"f{s}").over(within).alias(s) for s in SUMS)).join(before, ["conv_id", "chunk"], "left")
    upto = [F.col(s) + F.coalesce(f"b{s}", F.lit(0)) for s in SUMS]
    prior = [u - F.col(f"f{s}") for u, s in zip(upto, SUMS)]
    depth = F.col("i") + 1
    paths = summed.select(
        "conv_id", depth.alias("depth"), *_key(depth, upto, KEY), *_key(F.col("i"), prior, UP), "words", (depth == F.col("size")).alias("last")
    )
    zero = [F.lit(0).cast("long") for _ in SUMS]
    none = [F.lit(None).cast("long").alias(name) for name in UP]
    roots = plan.select("conv_id", zero[0].alias("depth"), *_key(zero[0], zero, KEY), *none, zero[0].alias("words"), (F.col("size") == 0).alias("last"))
    return written(paths.unionByName(roots), "trie-members")


def _nodes(members: DataFrame) -> DataFrame:
    """A row a node: key, conv_id (its smallest member), depth, parent's key, n_convs, n_children, leaf, saved."""
    least = [F.min(c).alias(c) for c in ("conv_id", "depth", *UP, "words")]
    nodes = members.groupBy(*KEY).agg(*least, F.count(F.lit(1)).alias("n_convs"))
    children = nodes.where("depth > 0").groupBy(*(F.col(p).alias(k) for p, k in zip(UP, KEY))).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, list(KEY), "left").fillna(0, ["n_children"])
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    return written(nodes.withColumn("leaf", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words"), "trie-nodes")


def _with_ups(paths: DataFrame, step: int, band: int) -> DataFrame:
    """``paths`` (conv_id, depth in steps, parent's key) with ``ups``: the keys from the top of the parent's band down to the parent."""
    segment = F.floor((F.col("depth") / step - 1) / band)
    order = Window.partitionBy("conv_id", segment).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return paths.withColumn("ups", F.collect_list(F.struct(*UP)).over(order))


def _rolled_up(members: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """Key, n_leaves and saved_tokens of each node: leaf and saved summed over its subtree."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select("conv_id", "depth", "leaf", "saved")
    paths = _with_ups(members.where("depth > 0").select("conv_id", "depth", *KEY, *UP), 1, band)
    paths = paths.join(own, ["conv_id", "depth"], "left").where(f"leaf is not null or depth % {band} = 0").drop(*UP)
    paths = written(paths, "trie-paths")
    root = nodes.where("depth = 0").select(*KEY, "depth", "leaf", "saved", F.array().cast(paths.schema["ups"].dataType).alias("ups"))
    columns = (*KEY, "depth", "leaf", "saved", "ups")
    levels, step = [paths.where("leaf is not null").select(*columns).unionByName(root)], 1
    while deepest >= step * band:  # the tops of the bands are the next level's nodes
        step *= band
        top = [F.when(F.col("depth") % step == 0, F.col(k)).otherwise(F.col("ups")[0][p]).alias(k) for k, p in zip(KEY, UP)]
        totals = levels[-1].groupBy(*top).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        tops = paths.where(f"depth % {step} = 0").select(
            "conv_id", "depth", *KEY, *(F.col("ups")[0][p].alias(p) for p in UP), F.col("leaf").isNotNull().alias("is_node")
        )
        paths = written(_with_ups(tops, step, band).withColumn("leaf", F.when(F.col("is_node"), 1)).drop("is_node", *UP), "trie-tops")
        shape = paths.where("leaf is not null").select(*KEY, "depth", "ups").unionByName(root.select(*KEY, "depth", "ups"))
        levels.append(written(shape.join(totals, list(KEY)).select(*columns), "trie-level"))
    done = None
    for level in reversed(levels):
        amounts = level.withColumns({"up_leaf": F.col("leaf"), "up_saved": F.col("saved")})
        if done is not None:  # the tops of lower bands bring their completed totals
            known = done.select(*KEY, F.col("n_leaves").alias("all_leaf"), F.col("saved_tokens").alias("all_saved"))
            amounts = level.join(known, list(KEY), "left").withColumns({"up_leaf": F.coalesce("all_leaf", "leaf"), "up_saved": F.coalesce("all_saved", "saved")})
        here = F.array(F.struct(*(F.col(k) for k in KEY), F.col("leaf"), F.col("saved")))
        above = F.transform("ups", lambda up: F.struct(up["p1"].alias("k1"), up["p2"].alias("k2"), F.col("up_leaf").alias("leaf"), F.col("up_saved").alias("saved")))
        shares = amounts.select(F.explode(F.concat(here, above)).alias("share")).select("share.*")
        done = written(shares.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "trie-done")
    return done


def _ends(members: DataFrame) -> DataFrame:
    """Key and ends_sha256 of each node at which conversations end. Ids of a node are ranged and joined to pieces first; one task
    then reads the pieces of a node in order and holds no more than the state of the digest."""

    def pieces(batches):
        node, ids, size = None, [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"k1": node[0], "k2": node[1], "first": ids[0], "piece": ",".join(map(str, ids))}])

        for batch in batches:
            for k1, k2, c in zip(*(batch.column(x).to_pylist() for x in (*KEY, "conv_id"))):
                if node != (k1, k2) or size >= JOINED:
                    if ids:
                        yield row()
                    node, ids, size = (k1, k2), [], 0
                ids.append(c)
                size += 20
        if ids:
            yield row()

    def digests(batches):
        node, state = None, None

        def row():
            return pa.RecordBatch.from_pylist([{"k1": node[0], "k2": node[1], "ends_sha256": state.hexdigest()}])

        for batch in batches:
            for k1, k2, piece in zip(*(batch.column(x).to_pylist() for x in (*KEY, "piece"))):
                if node == (k1, k2):
                    state.update(b",")
                else:
                    if node:
                        yield row()
                    node, state = (k1, k2), hashlib.sha256()
                state.update(piece.encode())
        if node:
            yield row()

    last = members.where("last").select(*KEY, "conv_id")
    joined = last.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pieces, "k1 long, k2 long, first long, piece string")
    joined = written(joined, "trie-pieces").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return joined.mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members = _members(conversations)
    nodes = _nodes(members)
    key = list(KEY)
    ended = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    full = nodes.join(_rolled_up(members, nodes, band), key).join(_ends(members), key, "left").withColumn("ends_sha256", ended)
    full = written(full.drop("leaf", "saved"), "trie-full")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = full.join(parents, list(UP), "left")  # a parent with very many children: plain rows, which Spark splits
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
