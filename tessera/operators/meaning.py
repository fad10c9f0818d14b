"""Pairs of alike vectors of two sides: candidates for a judge that no words have in common.

Vectors are dealt to the nearest of a bounded number of pivots. Angles obey the triangle inequality, so a vector of one side is
sent to those cells of the other that can hold one within the angle asked for, and to no others; cells are split into blocks
of bounded size, and each pair of blocks is one product of matrices. A group whose cells hold little apart is dealt by blocks only.
Exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import _cut, if_small
from tessera.operators.match import rule_facts
from tessera.operators.search import embed
from tessera.operators.vector_index import _directed

#: Most pivots, and rows of a side that one task multiplies at once.
PIVOTS, BLOCK = 512, 2048
#: What is broadcast of cells is a number for each group and pivot; more groups than that are not dealt by cells but by group.
GROUPS = 2000
SLACK = 1e-7


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(x, float) for x in rows]).reshape(len(rows), -1)


def vector_pairs(one: DataFrame, two: DataFrame, least: float, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """g, a, b, similarity: pairs of rows of one group whose cosine similarity is `least` or more; least is over 0.

    one, two: g (string), id, embedding; vectors of one length. Vectors that are null, zero, or hold null or non-finite
    components are like nothing. Rows without g meet no other. Repeated ids of a side give repeated pairs.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    unit = lambda df, n: _directed(df.select("g", "id", "embedding")).where("unit IS NOT NULL AND g IS NOT NULL").select(F.lit(n).alias("side"), "g", "id", "unit")
    rows = _cut(unit(one, 1).unionByName(unit(two, 2)))
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    schema = f"g string, a {kind}, b {kind}, similarity double"
    n = rows.count()
    centre = rows.orderBy(F.xxhash64("id", "side"), "id").limit(min(pivots, int(n**0.5) + 1)).select("unit").collect()  # bounded
    if not centre:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(_matrix([r["unit"] for r in centre]))

    def near(frames):
        for f in frames:
            if len(f):
                cos = np.clip(_matrix(f["unit"]) @ shared.value.T, -1, 1)
                cell = cos.argmax(1)
                yield f.assign(cell=cell.astype(np.int32), angle=np.arccos(cos[np.arange(len(f)), cell]))

    placed = _cut(rows.where("side = 2").mapInPandas(near, f"side int, g string, id {kind}, unit array<double>, cell int, angle double"))
    cells = placed.groupBy("g", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"))
    groups = cells.select("g").distinct().count()
    # of each group, or of all groups together where there are very many, the reach of each cell
    told = (cells if groups <= GROUPS else cells.groupBy("cell").agg(F.max("r").alias("r")).withColumn("g", F.lit(None).cast("string"))).select("g", "cell", "r").collect()
    reach: dict = {}
    for r in told:
        reach.setdefault(r["g"], []).append((r["cell"], r["r"]))
    reaches = spark.sparkContext.broadcast({g: (np.array([c for c, _ in v]), np.array([r for _, r in v])) for g, v in reach.items()})
    far = float(np.arccos(least))

    def reached(frames):
        """Of up to 1,024 rows of a group: the rows, and row and cell of each that has to meet."""
        for f in frames:
            for g, own in f.groupby("g"):
                known = reaches.value.get(g, reaches.value.get(None))
                if known is None:
                    continue
                c, r = known
                for at in range(0, len(own), 1024):
                    part = own.iloc[at : at + 1024]
                    angle = np.arccos(np.clip(_matrix(part["unit"]) @ shared.value[c].T, -1, 1))
                    row, to = np.nonzero(angle <= r[None, :] + far + SLACK)
                    yield g, part, row, c[to].astype(np.int32)

    def count(frames):
        for g, _, _, cell in reached(frames):
            cell, m = np.unique(cell, return_counts=True)
            yield pd.DataFrame({"g": g, "cell": cell, "m": m.astype(np.int64)})

    def send(frames):
        for _, part, row, cell in reached(frames):
            yield pd.DataFrame({"g": part["g"].to_numpy()[row], "id": part["id"].to_numpy()[row], "unit": part["unit"].to_numpy()[row], "cell": cell})

    # vectors are counted before they are sent: where cells hold little apart, each row meets most cells, and blocks of the whole
    # group are dealt with fewer copies
    parts = lambda df: df.withColumns({"p1": F.ceil(F.col("m") / block).cast("int"), "p2": F.ceil(F.col("n") / block).cast("int")})
    mine = rows.where("side = 1").select("g", "id", "unit")
    asked = mine.mapInPandas(count, "g string, cell int, m long").groupBy("g", "cell").agg(F.sum("m").alias("m"))
    by_cell = _cut(parts(cells.join(asked, ["g", "cell"])))
    copies = F.col("m") * F.col("p2") + F.col("n") * F.col("p1")
    whole = parts(rows.groupBy("g").agg(F.count_if(F.col("side") == 1).alias("m"), F.count_if(F.col("side") == 2).alias("n"))).withColumn("whole", copies)
    each = by_cell.groupBy("g").agg((F.sum(copies) + F.sum("m")).alias("each"))  # what is sent is written once besides
    plain = if_small(whole.join(each, "g").where("whole < each").select("g", F.lit(-1).alias("cell"), "p1", "p2"))
    of = lambda df, how: df.join(plain.select("g"), "g", how)
    one_cell = lambda df: of(df.select("g", "id", "unit"), "left_semi").withColumn("cell", F.lit(-1))
    sent = _cut(of(mine, "left_anti").mapInPandas(send, f"g string, id {kind}, unit array<double>, cell int")).unionByName(one_cell(mine))
    placed = of(placed.select("g", "id", "unit", "cell"), "left_anti").unionByName(one_cell(rows.where("side = 2")))
    deal = _cut(of(by_cell.select("g", "cell", "p1", "p2"), "left_anti").unionByName(plain.select("g", "cell", "p1", "p2")))

    def dealt(df: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(i)
        return df.join(deal, ["g", "cell"]).select("g", "cell", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j), "id", "unit")

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"g": [], "a": [], "b": [], "similarity": []}).astype({"g": object})
        cos = _matrix(x["unit"]) @ _matrix(y["unit"]).T
        a, b = np.nonzero(cos >= least)
        return pd.DataFrame({"g": x["g"].to_numpy()[a], "a": x["id"].to_numpy()[a], "b": y["id"].to_numpy()[b], "similarity": cos[a, b]})

    keys = ["g", "cell", "i", "j"]
    return dealt(sent, "p1", "p2", "i", "j").groupBy(*keys).cogroup(dealt(placed.select("g", "cell", "id", "unit"), "p2", "p1", "j", "i").groupBy(*keys)).applyInPandas(solve, schema)


def meaning_keys(g1: DataFrame, g2: DataFrame, least: float = 0.8, model=embed, facts: DataFrame | None = None) -> DataFrame:
    """behavior, k1, k2, similarity: unlike token sets of one behaviour whose texts are alike by `least` in cosine similarity of
    their embeddings (model(df, column) adds embedding), whatever words they share. Copies of a token set count once, by
    the text of the smallest rule_id; so a group of copies is a row."""
    facts = rule_facts(g1, g2) if facts is None else facts

    def side(g: DataFrame, n: int) -> DataFrame:
        first = facts.where(F.col("side") == n).groupBy("behavior", "k").agg(F.min("rule_id").alias("rule_id"))
        texts = g.select("behavior", "rule_id", "text").join(first, ["behavior", "rule_id"])
        return model(texts, "text").select(F.col("behavior").alias("g"), F.col("k").alias("id"), "embedding")

    return vector_pairs(side(g1, 1), side(g2, 2), least).where("a <> b").select(F.col("g").alias("behavior"), F.col("a").alias("k1"), F.col("b").alias("k2"), "similarity")


def meaning_pairs(g1: DataFrame, g2: DataFrame, keys: DataFrame) -> DataFrame:
    """g1, g2, behavior, texts and qualities of pairs (behavior, k1, k2), as candidate_pairs() gives them to a judge: of each
    token set the rule of smallest id, with how many rules it stands for (g1_copies, g2_copies)."""
    facts = rule_facts(g1, g2)

    def side(g: DataFrame, n: int) -> DataFrame:
        per = facts.where(F.col("side") == n).groupBy("behavior", "k").agg(F.min("rule_id").alias("rule_id"), F.count("*").alias(f"g{n}_copies"))
        told = g.select("behavior", "rule_id", "text", "quality").join(per, ["behavior", "rule_id"])
        return told.select("behavior", F.col("k").alias(f"k{n}"), F.col("rule_id").alias(f"g{n}"), F.col("text").alias(f"g{n}_text"), F.col("quality").alias(f"g{n}_quality"), f"g{n}_copies")

    return keys.join(side(g1, 1), ["behavior", "k1"]).join(side(g2, 2), ["behavior", "k2"]).drop("k1", "k2")
