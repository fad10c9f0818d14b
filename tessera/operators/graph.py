"""Traversals over dependencies. Each step is one join with what is already known taken out, cut at every level."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where the cluster shares what is written between jobs; a folder of this machine is only taken in local mode."""
    named, jsc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc()
    if not named and not jsc.getCheckpointDir().isDefined():
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return named or jsc.getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table that its caller deletes."""
    return f"{shared_folder(spark).rstrip('/')}/tessera-core/{name}-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a side that may be broadcast.
SMALL = 200_000


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, cut, with a hint to broadcast it where it has few rows; of narrow rows only."""
    df = _cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def levels(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """node, level: everything reachable from starts (node) along src -> dst, with the least number of steps."""
    reached = front = _cut(starts.select("node").distinct().withColumn("level", F.lit(0)))
    step = 0
    while most is None or step < most:
        step += 1
        new = edges.join(front, edges["src"] == front["node"]).select(edges["dst"].alias("node")).distinct()
        front = _cut(new.join(reached.select("node"), "node", "left_anti").withColumn("level", F.lit(step)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def closure(edges: DataFrame, start, kind: str = "prerequisite") -> DataFrame:
    """Nodes reachable along edges of one kind, the start left out."""
    e = _cut(edges.where(F.col("dependency_type") == kind).select("src", "dst").distinct())  # else made anew at each level
    starts = edges.sparkSession.createDataFrame([(start,)], ["node"])
    return levels(e, starts).where("level > 0").select("node")


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def simple_paths(edges: DataFrame, start, goal, most: int = 6, limit: int = 5) -> DataFrame:
    """path (array of nodes): the first `limit` simple paths of up to `most` (10 at most) steps between two nodes, edges taken
    either way; shorter paths first, then in order of their nodes.

    Distances from the goal are found first, and paths grow only to nodes from which the goal can still be reached in time.
    On shortest paths the distance falls at each step, so no node comes twice and the `limit` least paths to each node are
    all that is needed; longer paths are looked for, length by length, only while there are fewer than `limit`.
    """
    spark, most = edges.sparkSession, min(most, 10)
    e = _cut(undirected(edges))
    away = _cut(levels(e, spark.createDataFrame([(goal,)], ["node"]), most))
    far = away.where(F.col("node") == F.lit(start)).first()
    first = spark.createDataFrame([([start],)], e.select(F.array("src").alias("path")).schema)
    if far is None or not far["level"]:
        return first.limit(0)
    found, n = first.limit(0), 0
    for length in range(far["level"], most + 1):
        paths = first
        for left in range(length - 1, -1, -1):
            near = away.where(F.col("level") == left if length == far["level"] or not left else (F.col("level") <= left) & (F.col("level") > 0)).select("node")
            grown = paths.join(e, F.element_at("path", -1) == e["src"]).join(near, F.col("dst") == near["node"]).where(~F.array_contains("path", F.col("dst")))
            grown = grown.select(F.concat("path", F.array("dst")).alias("path"), "dst")
            if length == far["level"]:
                grown = grown.withColumn("_n", F.row_number().over(W.partitionBy("dst").orderBy("path"))).where(F.col("_n") <= limit)
            paths = _cut(grown.select("path"))
        own = _cut(paths.orderBy("path").limit(limit - n))
        found, n = found.unionByName(own), n + own.count()
        if n >= limit:
            break
    return found.orderBy(F.size("path"), "path")


def shortest_paths(edges: DataFrame, start, goal, most: int = 6, limit: int = 5) -> DataFrame:
    """Of simple_paths() those of the least length."""
    found = simple_paths(edges, start, goal, most, limit)
    return found.withColumn("_n", F.min(F.size("path")).over(W.partitionBy())).where(F.size("path") == F.col("_n")).select("path").orderBy("path")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """step, src, dst, dependency_type, strength, direction of the edges along each path."""
    hops = paths.select("path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("step", "a")).withColumn("b", F.element_at("path", F.col("step") + 2))
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "dependency_type", "strength", F.lit("outgoing").alias("direction"))
    two = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "dependency_type", "strength", F.lit("incoming").alias("direction"))
    return hops.join(one.unionByName(two), ["a", "b"]).select("path", "step", "a", "b", "dependency_type", "strength", "direction")


def neighbourhood(rules: DataFrame, edges: DataFrame, rule_id, siblings: int = 10) -> DataFrame:
    """relation (out, in, category, sibling), other: what one rule touches."""
    own = rules.where(F.col("rule_id") == rule_id)
    out = edges.where(F.col("src") == rule_id).select(F.lit("out").alias("relation"), F.col("dst").cast("string").alias("other"))
    in_ = edges.where(F.col("dst") == rule_id).select(F.lit("in"), F.col("src").cast("string"))
    cat = own.select(F.lit("category"), "category")
    sib = rules.join(F.broadcast(own.select("category")), "category").where(F.col("rule_id") != rule_id).orderBy("rule_id").limit(siblings)
    return out.union(in_).union(cat).union(sib.select(F.lit("sibling"), F.col("rule_id").cast("string"))).distinct()


def chains(edges: DataFrame, kind: str = "prerequisite") -> DataFrame:
    """first, middle, last: two hops of one kind. Counted or limited by the caller."""
    e = edges.where(F.col("dependency_type") == kind)
    return e.select(F.col("src").alias("first"), F.col("dst").alias("middle")).join(e.select(F.col("src").alias("middle"), F.col("dst").alias("last")), "middle").select("first", "middle", "last")


def named_edges(edges: DataFrame, rules: DataFrame) -> DataFrame:
    n = rules.select("rule_id", "rule_name")
    return edges.join(n.withColumnsRenamed({"rule_id": "src", "rule_name": "from_name"}), "src").join(n.withColumnsRenamed({"rule_id": "dst", "rule_name": "to_name"}), "dst")


def neighbours(rules: DataFrame, edges: DataFrame, rule_id) -> DataFrame:
    """other, direction, dependency_type, strength, rule_name (null if unknown): the edges of one rule, both ways."""
    out = edges.where(F.col("src") == rule_id).select(F.col("dst").alias("other"), F.lit("outgoing").alias("direction"), "dependency_type", "strength")
    in_ = edges.where(F.col("dst") == rule_id).select(F.col("src").alias("other"), F.lit("incoming").alias("direction"), "dependency_type", "strength")
    return out.unionByName(in_).join(rules.select(F.col("rule_id").alias("other"), "rule_name"), "other", "left").select("other", "direction", F.coalesce("dependency_type", F.lit("")).alias("dependency_type"), "strength", "rule_name")


def rule_overlap(rules: DataFrame, edges: DataFrame, nodes: list) -> DataFrame:
    """kind, node: what all the given rules depend on (target) and what depends on all of them (source); then same_category
    and same_entity, with `true` or `false` as node."""
    own = rules.where(F.col("rule_id").isin(nodes)).agg(F.count_distinct("category").alias("c"), F.count("category").alias("cn"), F.count_distinct("entity_type").alias("e"), F.count("entity_type").alias("en"), F.count("*").alias("n"))
    flags = own.select(F.explode(F.array(F.struct(F.lit("same_category").alias("kind"), ((F.col("c") == 1) & (F.col("cn") == F.col("n"))).cast("string").alias("node")), F.struct(F.lit("same_entity").alias("kind"), ((F.col("e") == 1) & (F.col("en") == F.col("n"))).cast("string").alias("node")))).alias("f")).select("f.*")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    side = lambda e, kind: shared_targets(e, nodes).select(F.lit(kind).alias("kind"), F.col("node").cast("string").alias("node"))
    return side(edges, "target").unionByName(side(turned, "source")).unionByName(flags)


def shared_targets(edges: DataFrame, nodes: list) -> DataFrame:
    """What all the given rules depend on."""
    e = edges.where(F.col("src").isin(nodes)).select("src", "dst").distinct()
    return e.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") == len(set(nodes))).select(F.col("dst").alias("node"))


def projection(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a report: a hub `type_<t>` per type, sized 60 + 2n, and each rule tied to its hub; rows that
    share an id get `_dup2`, `_dup3` in order of name."""
    turn = F.row_number().over(W.partitionBy("rule_id").orderBy("rule_name"))
    own = rules.withColumn("turn", turn).withColumn("id", F.when(F.col("turn") == 1, F.col("rule_id").cast("string")).otherwise(F.concat_ws("_dup", F.col("rule_id").cast("string"), F.col("turn").cast("string"))))
    hub = rules.groupBy("rule_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("type_"), "rule_type").alias("id"), F.col("rule_type").alias("label"), (F.col("n") * 2 + 60).cast("int").alias("size"))
    nodes = hub.unionByName(own.select("id", F.col("rule_name").alias("label"), F.lit(20).alias("size")))
    return nodes, own.select(F.concat(F.lit("type_"), "rule_type").alias("src"), F.col("id").alias("dst"))
