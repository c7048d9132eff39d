"""Conversation prefix trie, built level by level.

Turns are numbered along each conversation by a range sort, so that a conversation of any length is numbered by many
tasks. At each depth the live conversations are grouped by (parent node, next turn) and the smallest conv_id names
the node; a conversation that is alone in its node needs no more grouping: the rest of it is a chain. Then the levels
are joined in reverse order, children into parents, to sum leaves and savings. A turn is compared by the SHA-256 of
its role and text; digests travel in blocks of `BLOCK` turns. Groups that hold many conversations are summed and
joined by parts (`WAYS`).

Conversations are rebuilt before: conversation c starts with the first h turns of c - c % 100 (% with the sign of c)
and goes on with its own turns after its first h.

Defined cases: rows without a conv_id take no part; a null turn comes first; rows that tie in turn are ordered by role,
then text; rows that repeat each count; a null role or text is empty; a conversation without turns ends in the root; an
empty table has no node; other columns are ignored; a very long text is read once, for its digest and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain_planning, table

#: Turns whose digests travel together.
BLOCK = 32
#: Parts of a group of conversations.
WAYS = 256
#: Conversation ids that are hashed as one row.
IDS = 4096
#: Nodes of a chain that one row is expanded to.
CHAIN = 4096
SHARED, GROUP = 6, 100


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, k (from 1 along the conversation's rows of that part), digest, chars. A conversation's parts
    follow each other in order."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),  # equal rows can be dealt out too
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    slim = ranged.select("conv_id", F.spark_partition_id().cast("long").alias("part"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) + 1
            if ids[0] == last:
                place[: starts[1] if len(starts) > 1 else len(ids)] += k
            last, k = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(place, pa.int64()), *batch.columns[2:]], names=["conv_id", "part", "k", "digest", "chars"])

    return materialize(slim.mapInArrow(number, "conv_id long, part long, k long, digest binary, chars long"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_turns) and (conv_id, block, turns) of the rebuilt conversations."""
    turns = numbered(conversations)
    parts = Window.partitionBy("conv_id").orderBy("part")  # few parts: a task's rows of a conversation are one
    runs = materialize(
        turns.groupBy("conv_id", "part")
        .agg(F.max("k").alias("size"))
        .withColumn("before", F.sum("size").over(parts) - F.col("size"))
        .withColumn("total", F.sum("size").over(Window.partitionBy("conv_id")))
    )
    whole = runs.where("before = 0").select("conv_id", "total", shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    first = whole.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    taken = F.least("h", F.coalesce("base_total", F.lit(0)))
    convs = materialize(
        whole.join(first, "base", "left").select("conv_id", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("n_turns"))
    )
    own = runs.join(convs, "conv_id").select("conv_id", "part", "before", "h", "taken")
    after = (
        turns.join(own, ["conv_id", "part"])
        .where("before + k > h")
        .select("conv_id", (F.col("taken") + F.col("before") + F.col("k") - F.col("h")).alias("depth"), "digest", "chars")
    )
    heads = turns.where(F.col("k") < SHARED).join(runs.where(F.col("before") < SHARED), ["conv_id", "part"]).select(F.col("conv_id").alias("base"), (F.col("before") + F.col("k")).alias("depth"), "digest", "chars")
    start = convs.join(heads.where(F.col("depth") < SHARED), "base").where("depth <= h").select("conv_id", "depth", "digest", "chars")
    blocks = (
        start.unionByName(after)
        .groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "chars"))).alias("turns"))
    )
    return convs.select("conv_id", "n_turns"), materialize(blocks)


def levels_of(convs: DataFrame, blocks: DataFrame) -> list[DataFrame]:
    """A frame for each depth: conv_id, n_turns, turns, parent, chars, node and n_convs of the live conversations."""
    total, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return []
    none = F.lit(None).cast("array<struct<depth: long, digest: binary, chars: long>>")
    at = materialize(convs.select("conv_id", "n_turns", none.alias("turns"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("chars"), F.lit(least).alias("node"), F.lit(total).alias("n_convs")))
    levels, depth = [at], 0
    while True:
        live = at.where((F.col("n_convs") > 1) & (F.col("n_turns") > depth)).select("conv_id", "n_turns", F.col("node").alias("parent"), "turns")
        if live.isEmpty():
            return levels
        if depth % BLOCK == 0:
            live = live.drop("turns").join(blocks.where(F.col("block") == depth // BLOCK).select("conv_id", "turns"), "conv_id")
        turn = F.element_at("turns", depth % BLOCK + 1)
        live = live.select("*", turn["digest"].alias("digest"), turn["chars"].alias("chars"), F.pmod(F.xxhash64("conv_id"), F.lit(WAYS)).alias("way"))
        group = Window.partitionBy("parent", "digest")  # a row for each way at most
        sums = (
            live.groupBy("parent", "digest", "way")
            .agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
            .select("parent", "digest", "way", F.min("least").over(group).alias("node"), F.sum("n").over(group).alias("n_convs"))
        )
        at = materialize(live.join(sums, ["parent", "digest", "way"]).select("conv_id", "n_turns", "turns", "parent", "chars", "node", "n_convs"))
        levels.append(at)
        depth += 1


def rolled_up(levels: list[DataFrame]) -> list[DataFrame]:
    """For each depth its nodes: depth, conv_id, parent_conv_id, n_convs, n_turns, n_children, n_leaves, saved_tokens."""
    out: list[DataFrame] = []
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].where("conv_id = node").select("conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", "n_turns", "chars")
        if out:
            below = out[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = nodes.join(below, "conv_id", "left")
        else:
            nodes = nodes.select("*", *[F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        chain = F.when((F.col("n_convs") == 1) & (F.col("n_turns") > depth), 1).otherwise(0)
        nodes = nodes.select(
            "conv_id",
            F.lit(depth).cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_turns",
            F.coalesce("children", chain).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
        )
        out.append(materialize(nodes))
    return out[::-1]


def hashed_ends(ends: DataFrame) -> DataFrame:
    """depth, node, conv_id -> depth, node, ends_sha256. Ids are range-sorted and joined in pieces; a node's pieces
    then go through one SHA-256 in order, a piece in memory at a time."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            depth, node, ids = (c.to_numpy() for c in batch.columns)
            new = np.concatenate([[True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])])
            starts = np.flatnonzero(new)
            cuts = np.unique(np.concatenate([starts, *(np.arange(a, b, IDS) for a, b in zip(starts, np.append(starts[1:], len(ids))) if b - a > IDS)]))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(ids)))]
            yield pa.RecordBatch.from_arrays([pa.array(depth[cuts]), pa.array(node[cuts]), pa.array(ids[cuts]), pa.array(texts)], names=["depth", "node", "first", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (depth, node) == key:
                    sha.update(b",")
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (depth, node), hashlib.sha256()
                sha.update(ids.encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["depth", "node", "ends_sha256"])
                done = []
        if key:
            done.append((*key, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["depth", "node", "ends_sha256"])

    order = ["depth", "node", "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, node long, first long, ids string")
    return joined.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digests, "depth long, node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    with plain_planning(spark):
        levels = levels_of(*rebuilt(conversations))
        if not levels:
            return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
        nodes = rolled_up(levels)
        ends = hashed_ends(_union([at.where((F.col("n_convs") > 1) & (F.col("n_turns") == d)).select(F.lit(d).cast("long").alias("depth"), "node", "conv_id") for d, at in enumerate(levels)]))
        ends = materialize(ends).withColumnRenamed("node", "conv_id")
    own, empty = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256), F.lit(hashlib.sha256(b"").hexdigest())
    alone = F.when((F.col("n_convs") == 1) & (F.col("n_turns") == F.col("depth")), own)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = _union(nodes)
    shared = grouped.join(ends, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", alone, empty)).select(*columns)
    # What follows a node that one conversation has alone: a chain, expanded piece by piece.
    steps = F.explode(F.sequence(F.col("depth") + 1, F.col("n_turns"), F.lit(CHAIN).cast("long"))).alias("from")
    chains = grouped.where((F.col("n_convs") == 1) & (F.col("n_turns") > F.col("depth"))).select("conv_id", "n_turns", steps).repartition("conv_id", "from")
    chain = chains.select("conv_id", "n_turns", F.explode(F.sequence("from", F.least("n_turns", F.col("from") + CHAIN - 1))).alias("depth"))
    last, one = F.col("depth") == F.col("n_turns"), F.lit(1).cast("long")
    single = chain.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, own).otherwise(empty).alias("ends_sha256"),
    )
    return shared.unionByName(single)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def op13_prefixtrie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Prefixes as digests of digests; ancestors through the smallest member. The list of sixteen is CRC-32's table for
#: four bits, a fixed value.
OP13_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT c, c - c % 100 AS b, ((4294967295::UBIGINT - list_reduce(
    list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::UBIGINT & 15, ascii(x)::UBIGINT >> 4]))),
    lambda crc, x: xor(crc >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::UBIGINT[])[(xor(crc, x) & 15)::BIGINT + 1]))) % 6)::BIGINT AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth, role, text FROM (
    SELECT i.c, 0 AS own, t.pos, t.role, t.text FROM i JOIN t ON t.c = i.b AND t.pos <= i.h
    UNION ALL
    SELECT i.c, 1, t.pos, t.role, t.text FROM i JOIN t ON t.c = i.c AND t.pos > i.h)
), m AS (
  SELECT c, depth, length(text) AS chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth)) AS key FROM r
  UNION ALL
  SELECT c, 0, 0, '' FROM i
), n AS (
  SELECT depth, key, min(c) AS c, count(*) AS n_convs, min(chars) AS chars FROM m GROUP BY depth, key
), p AS (
  SELECT n.*, up.c AS parent FROM n LEFT JOIN m ON m.c = n.c AND m.depth = n.depth - 1 LEFT JOIN n up ON up.depth = m.depth AND up.key = m.key
), k AS (
  SELECT depth - 1 AS depth, parent AS c, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL
), q AS (
  SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM p LEFT JOIN k ON k.depth = p.depth AND k.c = p.c
), s AS (
  SELECT m.depth, m.key, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((q.n_convs - 1) * q.chars) AS saved
  FROM q JOIN m ON m.c = q.c AND m.depth <= q.depth GROUP BY ALL
), e AS (
  SELECT depth, key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(depth) AS depth, arg_max(key, depth) AS key FROM m GROUP BY c) GROUP BY ALL
)
SELECT q.c AS conv_id, CAST(q.depth AS BIGINT) AS depth, q.parent AS parent_conv_id, q.n_convs, q.n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM q JOIN s ON s.depth = q.depth AND s.key = q.key LEFT JOIN e ON e.depth = q.depth AND e.key = q.key
"""
