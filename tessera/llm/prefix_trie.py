"""Prefix trie of conversations: shared beginnings as nodes, with what hangs below each of them.

Each turn is reduced to a digest. Along a conversation the digests are chained, so that the digest at depth d stands for
the whole sequence of the first d turns; every conversation is exploded to its prefixes, and rows of equal (depth, digest)
are one node. For sums over subtrees each node is exploded to all of its ancestors. A node is known by its smallest
conversation, and the nodes of one conversation are a path downwards: their values are summed along that path first, so
the explosion has one row per prefix at most, however deep the trie is.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize

ROOT = hashlib.sha256(b"").digest()
NONE = hashlib.sha256(b"").hexdigest()
#: So many consecutive conv_ids at most are gathered into one string before it is hashed.
ENDS = 4096
#: A parent with this share of all nodes as children, or more, is joined by broadcast; there are at most so many of them.
HOT = 1000


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_digest, chars: turns in order, without their texts.

    Null role or text count as empty, null turns come first, equal turn numbers are ordered by digest. Rows without
    conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    t = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("turn_digest"), F.length(text).cast("long").alias("chars"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    return t.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn_digest", "chars")


def _chained(frames):
    """Prefixes of conversations that arrive in order of conv_id and pos, each with a row of pos 0 first."""
    conv, link, depth, last = None, ROOT, 0, None
    for f in frames:
        rows = []
        for c, turn, n in zip(f["conv_id"].tolist(), f["turn_digest"].tolist(), f["chars"].tolist(), strict=True):
            if last is not None:
                rows.append((*last, c != conv))
            if c != conv:
                conv, link, depth, parent = c, ROOT, 0, None
            else:
                parent, depth = link, depth + 1
                link = hashlib.sha256(parent + bytes(turn)).digest()
            last = (c, depth, link, parent, n)
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "depth", "node", "parent", "chars", "ends"])
    if last is not None:
        yield pd.DataFrame([(*last, True)], columns=["conv_id", "depth", "node", "parent", "chars", "ends"])


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, chars, ends: a row for each prefix of each conversation, from the root (depth 0) down.

    convs: conv_id, once each. turns: conv_id, pos (over 0, no repeats in a conversation), turn_digest, chars.
    A conversation is streamed through one task in order; no more than a batch of it is held.
    """
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("chars"))
    rows = marks.unionByName(turns.select("conv_id", "pos", "turn_digest", "chars")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInPandas(_chained, "conv_id long, depth long, node binary, parent binary, chars long, ends boolean")


def _hashed(frames):
    """SHA-256 of the chunks of each node, which arrive in order."""
    node, depth, state = None, None, None
    for f in frames:
        rows = []
        for d, x, chunk in zip(f["depth"].tolist(), f["node"].tolist(), f["chunk"].tolist(), strict=True):
            x = bytes(x)
            if x != node:
                if state:
                    rows.append((depth, node, state.hexdigest()))
                node, depth, state = x, d, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if rows:
            yield pd.DataFrame(rows, columns=["depth", "node", "ends_sha256"])
    if state:
        yield pd.DataFrame([(depth, node, state.hexdigest())], columns=["depth", "node", "ends_sha256"])


def ends_digests(paths: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 of the conversations that end at a node. Ids are gathered in ranges of ENDS, ranges are streamed."""
    width = ENDS.bit_length() - 1
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = paths.where("ends").groupBy("depth", "node", F.shiftright("conv_id", width).alias("range")).agg(ids.alias("chunk"))
    return chunks.repartition("node").sortWithinPartitions("node", "range").select("depth", "node", "chunk").mapInPandas(_hashed, "depth long, node binary, ends_sha256 string")


def subtree_sums(paths: DataFrame, nodes: DataFrame, **values) -> DataFrame:
    """depth, node and the sum of each value over all nodes of the subtree, for nodes where some sum is not 0.

    values: column expressions over nodes, which has conv_id, depth (unique together).
    """
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), *[v.cast("long").alias(k) for k, v in values.items()])
    mine = paths.select("conv_id", "depth", "node", *[F.lit(0).cast("long").alias(k) for k in values])
    below = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    sums = mine.unionByName(own).select("depth", "node", *[F.sum(k).over(below).alias(k) for k in values])
    some = F.greatest(*[F.abs(k) for k in values]) if len(values) > 1 else F.abs(*values)
    return sums.where(F.col("node").isNotNull() & (some > 0)).groupBy("depth", "node").agg(*[F.sum(k).alias(k) for k in values])


def _with_parent(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. Parents of very many children are few, and broadcast; so no child list is one task."""
    many = max(10_000, -(-nodes.count() // HOT))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot, rest = (up.where(c).drop("n_children") for c in (F.col("n_children") >= many, (F.col("n_children") > 0) & (F.col("n_children") < many)))
    keys = ["depth", "parent"]
    return nodes.join(F.broadcast(hot), keys).unionByName(nodes.join(F.broadcast(hot), keys, "left_anti").join(rest, keys, "left"))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: depth, node (digest), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's members but one times the code points of its last text), ends_sha256.

    convs and turns as for prefixes(). No conversations, no nodes; conversations without turns are members of the root only.
    """
    paths = materialize(prefixes(convs, turns), "prefixes")
    bare = materialize(paths.groupBy("depth", "node", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    kids = bare.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(bare.join(kids, ["depth", "node"], "left").fillna(0, ["n_children"]), "nodes")
    sums = subtree_sums(paths, nodes, saved_tokens=(F.col("n_convs") - 1) * F.col("chars"), n_leaves=F.col("n_children") == 0)
    full = _with_parent(nodes).join(sums, ["depth", "node"], "left").join(ends_digests(paths), ["depth", "node"], "left")
    return full.select("depth", "node", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; see placed_turns() and trie()."""
    turns = placed_turns(conversations)
    return trie(turns.select("conv_id").distinct(), turns)


def rebuilt(turns: DataFrame, most: int = 5, every: int = 100) -> DataFrame:
    """Turns whose first h come from conversation c - c % every instead; h = crc32(c) % (most + 1)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") <= most))
    lead = first.groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("pos", "turn_digest", "chars")).alias("lead"))
    convs = turns.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    head = convs.join(lead, "base").select("conv_id", F.explode(F.filter("lead", lambda t: t["pos"] <= h)).alias("t"))
    return head.select("conv_id", "t.*").unionByName(turns.where(F.col("pos") > h))


def op11_trie(spark, sf_dir: str) -> DataFrame:
    turns = materialize(placed_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(turns.select("conv_id").distinct(), rebuilt(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         sha256(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS sig, CAST(length(COALESCE(text, '')) AS BIGINT) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), made AS (
  SELECT c.conv_id, t.pos, t.sig, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, t.sig, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list(sig) OVER w AS prefix, chars, count(*) OVER (PARTITION BY conv_id) AS whole FROM made
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT c.conv_id, 0, [], 0, (SELECT count(*) FROM made m WHERE m.conv_id = c.conv_id) FROM convs c
), keyed AS (
  SELECT conv_id, depth, array_to_string(prefix, '/') AS node, array_to_string(prefix[:-2], '/') AS up, chars, depth = whole AS ends FROM paths
), nodes AS (
  SELECT depth, node, up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM keyed GROUP BY depth, node, up
), kids AS (
  SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT n.*, COALESCE(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, node)
), sums AS (
  SELECT p.depth, p.node, CAST(sum((y.n_convs - 1) * y.chars) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves
  FROM full_nodes y JOIN keyed p ON p.conv_id = y.conv_id AND p.depth <= y.depth GROUP BY 1, 2
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (depth, node) LEFT JOIN full_nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.node = n.up
"""
