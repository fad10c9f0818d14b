"""A persisted index of vectors: cells of alike directions as partitions of files, so that a search reads few of them.

Each vector lies in the cell of its nearest centre. What is kept of a cell is its centre and how far its rows are from it, as
an angle; so the nearest that any of its rows can be to a query is known without reading it. A search reads the most
promising cells until it has k rows, and then all cells that could hold a better one: results are exact.
"""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graph import _cut

#: Centres are learned from at most so many rows (those of smallest hash of their id), and there are at most so many.
SAMPLE, CELLS = 50_000, 4096
#: Rows in a file of a cell.
FILE_ROWS = 200_000
#: Angles are told apart by this much in cosine.
SLACK = 1e-7


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def _directed(vectors: DataFrame) -> DataFrame:
    """vectors with unit: to length 1; null for vectors that are null, zero or hold null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    v = vectors.withColumn("_length", F.when(finite, _length(F.col("embedding"))))
    unit = F.when(F.col("_length") > 0, F.transform("embedding", lambda x: x.cast("double") / F.col("_length")))
    return v.withColumn("unit", unit).drop("_length")


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> None:
    """Write an index of vectors (vec_id, embedding, graph if there are several) to path.

    cells: how many; by default the square root of the rows, CELLS at most. Vectors without a direction (see _directed) are
    in a cell of their own, -1, with similarity 0 to all. A cell of many rows is several files.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if "graph" not in vectors.columns:
        vectors = vectors.withColumn("graph", F.lit(""))
    v = _cut(_directed(vectors.select(F.coalesce(F.col("graph").cast("string"), F.lit("")).alias("graph"), "vec_id", "embedding")))
    n = v.where("unit IS NOT NULL").count()
    cells = min(CELLS, cells or max(1, round(n**0.5)))
    if n:
        some = v.where("unit IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(array_to_vector("unit").alias("features"))
        model = KMeans(k=max(2, cells), seed=seed, maxIter=8, initMode="random", distanceMeasure="cosine").fit(some)
        # a centre's length doesn't matter for the cell, but for the angle
        centres = [(i, [float(x) for x in c / (np.linalg.norm(c) or 1.0)]) for i, c in enumerate(model.clusterCenters())]
        known = model.transform(v.where("unit IS NOT NULL").withColumn("features", array_to_vector("unit"))).withColumnRenamed("prediction", "cell").drop("features")
    else:
        centres, known = [], v.limit(0).withColumn("cell", F.lit(0))
    c = v.sparkSession.createDataFrame(centres, "cell int, centre array<double>")
    near = F.aggregate(F.zip_with("unit", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = known.join(F.broadcast(c), "cell").withColumn("near", near).drop("unit", "centre")
    rows = _cut(rows.unionByName(v.where("unit IS NULL").drop("unit").withColumns({"cell": F.lit(-1), "near": F.lit(0.0)})))
    told = rows.groupBy("graph", "cell").agg(F.count("*").alias("n"), F.min("near").alias("least")).join(c, "cell", "left")
    told.coalesce(1).write.parquet(f"{path}/cells")
    part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / FILE_ROWS))
    dealt = rows.join(F.broadcast(told.select("graph", "cell", "n")), ["graph", "cell"]).withColumn("_part", part)
    dealt.repartition("graph", "cell", "_part").select("vec_id", "embedding", "graph", "cell").write.partitionBy("graph", "cell").parquet(f"{path}/rows")


def bounds(cells: pd.DataFrame, queries: np.ndarray) -> np.ndarray:
    """The largest similarity that a row of each cell can have to each query."""
    width = queries.shape[1]
    centre = np.array([c if c is not None else [0.0] * width for c in cells["centre"]]).reshape(len(cells), width)
    length = np.linalg.norm(queries, axis=1, keepdims=True)
    unit = np.divide(queries, length, out=np.zeros_like(queries), where=length > 0)
    reach = np.arccos(np.clip(cells["least"].to_numpy(), -1, 1))
    bound = np.cos(np.maximum(np.arccos(np.clip(unit @ centre.T, -1, 1)) - reach, 0)) + SLACK
    bound[:, cells["cell"].to_numpy() < 0] = 0.0
    return bound


class VectorIndex:
    """Searches an index that build() wrote. files tells how many files the last search read, and of how many."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        cells = spark.read.parquet(f"{path}/cells").orderBy("graph", "cell").collect()  # at most CELLS + 1 of each graph
        self.cells = pd.DataFrame([(r["graph"], r["cell"], r["n"], r["least"], r["centre"]) for r in cells], columns=["graph", "cell", "n", "least", "centre"])
        self.rows = spark.read.schema("vec_id long, embedding array<float>, graph string, cell int").option("basePath", f"{path}/rows").parquet(f"{path}/rows") if cells else None
        self.all_files = self.rows.inputFiles() if cells else []
        self.files: tuple[int, int] = (0, 0)

    def _hits(self, pairs: DataFrame, graph: str | None) -> DataFrame:
        """query_id, vec_id, similarity of all rows in pairs (query_id, q, cell) of queries and cells."""
        wanted = [r["cell"] for r in pairs.select("cell").distinct().collect()]
        rows = self.rows.where(F.col("cell").isin(wanted))
        rows = rows if graph is None else rows.where(F.col("graph") == graph)
        self._read |= {f for f in self.all_files if any(f"/cell={c}/" in f for c in wanted) and (graph is None or f"/graph={graph}/" in unquote(f))}
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        same = F.try_divide(dot("embedding", "q"), F.sqrt(dot("embedding", "embedding") * dot("q", "q")))
        finite = (F.abs(same) <= 2) & ~F.isnan(same)
        return pairs.join(rows, "cell").select("query_id", "vec_id", F.coalesce(F.when(finite, same), F.lit(0.0)).alias("similarity"))

    def search(self, queries: DataFrame, k: int, graph: str | None = None) -> DataFrame:
        """query_id, rank, vec_id, similarity: for each of queries (query_id, embedding) the k rows of largest cosine
        similarity, ties to the smaller vec_id; with graph, of its rows only. Queries are finite and as long as the rows."""
        kind = dict(queries.dtypes)["query_id"]
        cells = self.cells if graph is None else self.cells[self.cells["graph"] == graph]
        if cells.empty:
            return self.spark.createDataFrame([], f"query_id {kind}, rank int, vec_id long, similarity double")
        cells = cells.groupby("cell", as_index=False).agg({"n": "sum", "least": "min", "centre": "first"})
        queries = queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q"))
        schema = f"query_id {kind}, q array<double>, cells array<int>"
        self._read: set[str] = set()

        def chosen(frames, pick):
            for f in frames:
                if len(f):
                    b = bounds(cells, np.array(f["q"].tolist(), float).reshape(len(f), -1))
                    yield f[["query_id", "q"]].assign(cells=pd.Series([pick(row, f.iloc[i]).tolist() for i, row in enumerate(b)], index=f.index, dtype=object))

        def first(row, _):
            """The most promising cells of a query, until they hold k rows."""
            order = np.argsort(-row, kind="stable")
            return cells["cell"].to_numpy()[order[: int(np.searchsorted(np.cumsum(cells["n"].to_numpy()[order]), k)) + 1]]

        def rest(row, query):
            """All cells that can hold a row as near as the k-th of those found, but the ones that were read."""
            return cells["cell"].to_numpy()[~cells["cell"].isin(query["seen"]).to_numpy() & (row >= query["goal"])]

        one = _cut(queries.mapInPandas(lambda f: chosen(f, first), schema).select("query_id", "q", F.explode("cells").alias("cell")))
        order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = _cut(best(self._hits(one, graph)))
        goal = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(-2.0)).alias("goal"))
        seen = one.groupBy("query_id").agg(F.collect_set("cell").alias("seen"), F.first("q").alias("q"))
        two = _cut(seen.join(goal, "query_id").mapInPandas(lambda f: chosen(f, rest), schema).select("query_id", "q", F.explode("cells").alias("cell")))
        out = _cut(best(found.drop("rank").unionByName(self._hits(two, graph))))
        self.files = (len(self._read), len(self.all_files))
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "similarity")
