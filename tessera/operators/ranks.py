"""Ranks and one-to-one assignment of groups that no single task holds."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import _cut

#: Ranks that one row of a dealt range is exploded to at once.
BLOCK = 10_000
#: Links of a component that one task matches at once.
LINKS = 200_000


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the place (from 0) of each row in its group. A group may span many partitions: rows are sorted by ranges, each
    partition counts its own, and only these counts are added up. Rows that tie in order get any of their places."""
    put = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    put = _cut(put.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    per = put.groupBy("_p", *group).agg(F.min("_i").alias("_lo"), F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition at most
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("_p", *group)])
    place = (F.col("_i") - F.col("_lo") + F.col("_before")).cast("long")
    return put.alias("x").join(per.alias("y"), same).select(*[F.col(f"x.{c}") for c in df.columns], place.alias(name))


def _greedy(links: pd.DataFrame) -> pd.DataFrame:
    """matched_classes() of the links of whole components."""
    e = links.sort_values(["confidence", "f1", "c", "f2", "d"], ascending=[False, True, True, True, True])
    used1: dict = {}
    used2: dict = {}
    out = []
    for c, d, p, n1, n2, u1, u2 in e[["c", "d", "confidence", "n1", "n2", "u1", "u2"]].itertuples(index=False):
        x, y = used1.get(c, 0), used2.get(d, 0)
        m = min(n1 - x, n2 - y)
        if m > 0:
            out.append((c, d, p, m, u1 + x, u2 + y))
            used1[c], used2[d] = x + m, y + m
    return pd.DataFrame(out, columns=["c", "d", "confidence", "m", "c_from", "d_from"])


def matched_classes(one: DataFrame, two: DataFrame, links: DataFrame) -> DataFrame:
    """c, d, confidence, m, c_from, d_from: m members of class c from place c_from on are matched with as many of class d.

    one: c, n, first (members, and what breaks ties; unique). two: d, n, first. links: c, d, confidence. The result is greedy:
    links are taken by falling confidence, then by first of c and of d, each as far as members last. Components of links
    don't touch each other, so each is solved by one task; of one with more than LINKS links, the best LINKS in that order
    come first, and what is left of the others after that in the next round. Classes are rows, however many members they have.
    """
    from tessera.operators.match import _components

    e = links.join(one.select("c", F.col("n").alias("n1"), F.col("first").alias("f1")), "c").join(two.select("d", F.col("n").alias("n2"), F.col("first").alias("f2")), "d")
    e = _cut(e.where("n1 > 0 AND n2 > 0"))
    schema = f"c {dict(e.dtypes)['c']}, d {dict(e.dtypes)['d']}, confidence double, m long, c_from long, d_from long"
    if e.isEmpty():
        return e.sparkSession.createDataFrame([], schema)
    # whichever side an id is of: where ids of both sides are equal, components grow together, which does no harm
    parts = _components(e.select(F.col("c").alias("a"), F.col("d").alias("b"))).select(F.col("id").alias("c"), "p")
    left = _cut(e.join(parts, "c").withColumns({"u1": F.lit(0).cast("long"), "u2": F.lit(0).cast("long")}))
    done = []
    while True:
        size = left.groupBy("p").agg(F.count("*").alias("size"))
        large = _cut(size.where(F.col("size") > LINKS).select("p"))
        some = not large.isEmpty()
        now = left
        if some:
            put = ranked(left.join(large, "p", "left_semi").withColumn("o", -F.col("confidence")), ["p"], ["o", "f1", "c", "f2", "d"]).where(F.col("rank") < LINKS).drop("o", "rank")
            now = left.join(large, "p", "left_anti").unionByName(put)
        few = max(1, now.count() // LINKS)
        # small components are dealt to bundles, a large one is a bundle
        of = now.join(large, "p", "left_semi").withColumn("_b", F.concat_ws("-", F.lit("p"), F.col("p").cast("string"))) if some else now.limit(0).withColumn("_b", F.lit(""))
        of = of.unionByName(now.join(large, "p", "left_anti").withColumn("_b", F.pmod(F.xxhash64("p"), F.lit(few)).cast("string")))
        take = _cut(of.drop("p").groupBy("_b").applyInPandas(lambda x: _greedy(x), schema))
        done.append(take)
        if not some:
            return reduce(DataFrame.unionByName, done)
        m1, m2 = take.groupBy("c").agg(F.sum("m").alias("m1")), take.groupBy("d").agg(F.sum("m").alias("m2"))
        rest = left.join(large, "p", "left_semi").join(now.select("c", "d"), ["c", "d"], "left_anti")
        rest = rest.join(m1, "c", "left").join(m2, "d", "left").fillna(0, ["m1", "m2"])
        rest = rest.withColumns({"n1": F.col("n1") - F.col("m1"), "u1": F.col("u1") + F.col("m1"), "n2": F.col("n2") - F.col("m2"), "u2": F.col("u2") + F.col("m2")})
        left = _cut(rest.drop("m1", "m2").where("n1 > 0 AND n2 > 0"))


def dealt(taken: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """g1, g2, confidence: the members behind matched_classes(). one: c, g1; two: d, g2. Members of a class go by their order."""
    taken = _cut(taken)
    start = taken.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(BLOCK).cast("long")))).repartition("c", "b")
    each = start.withColumn("i", F.explode(F.sequence(F.col("b"), F.least(F.col("b") + BLOCK, F.col("m")) - 1)))
    each = each.select("c", "d", "confidence", (F.col("c_from") + F.col("i")).alias("r1"), (F.col("d_from") + F.col("i")).alias("r2"))
    mine = ranked(one.join(taken.select("c").distinct(), "c", "left_semi").select("c", "g1"), ["c"], ["g1"], "r1")
    theirs = ranked(two.join(taken.select("d").distinct(), "d", "left_semi").select("d", "g2"), ["d"], ["g2"], "r2")
    return each.join(mine, ["c", "r1"]).join(theirs, ["d", "r2"]).select("g1", "g2", "confidence")
