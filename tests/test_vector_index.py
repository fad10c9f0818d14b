"""The vector index against whole scans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, vector_index


def vectors(seed, n=600, clusters=12, dims=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = centres[r.randrange(3) if i % 3 else r.randrange(clusters)]  # a few cells hold most rows
        rows.append((i, [x + r.gauss(0, 0.08) for x in c], r.choice(["a", "b", None])))
    rows += [(n + i, rows[5][1], "a") for i in range(4)]  # ties
    return [*rows, (n + 4, [0.0] * dims, "a"), (n + 5, None, "b"), (n + 6, [math.nan] + [1.0] * (dims - 1), "b"), (n + 7, [None] + [1.0] * (dims - 1), "b")]


def brute(rows, q, k, graph=None):
    def cos(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) or not any(q):
            return 0.0
        return sum(a * b for a, b in zip(v, q, strict=True)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in q))

    return sorted(((-cos(v), i) for i, v, g in rows if graph is None or g == graph))[:k]


@pytest.mark.parametrize("files", [200_000, 20])
def test_exact_and_few_files(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(vector_index, "FILE_ROWS", files)
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, graph string").withColumn("embedding", F.col("embedding").cast("array<float>"))
    own = [(r["vec_id"], r["embedding"], r["graph"]) for r in df.collect()]
    vector_index.build(df, str(tmp_path / "i"), cells=24)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    queries = [(i, list(map(float, own[i][1]))) for i in (0, 5, 17, 300)] + [(-1, [1.0] * 8), (-2, [0.0] * 8)]
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    for k, graph in ((7, None), (5, "a"), (700, None), (3, "none")):
        got = {}
        for x in index.search(q, k, graph).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], -x["similarity"], x["vec_id"]))
        for i, v in queries:
            want = brute(own, v, k, graph)
            have = sorted(got.get(i, []))
            assert [x[2] for x in have] == [x[1] for x in want], (i, k, graph)
            assert all(abs(a[1] - b[0]) < 1e-9 for a, b in zip(have, want, strict=True))
    near = index.search(q.where("query_id = 17"), 5, "a")
    read, all_files = index.files
    assert near.count() == 5 and 0 < read < all_files / 3, index.files
    assert [x["vec_id"] for x in near.orderBy("rank").collect()] == [r["vec_id"] for r in search.knn(df.where("graph = 'a' AND vec_id < 604"), queries[2][1], 5).collect()]


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vector_index.build(none, str(tmp_path / "none"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert vector_index.VectorIndex(spark, str(tmp_path / "none")).search(q, 3).count() == 0
    vector_index.build(none.union(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], none.schema)), str(tmp_path / "two"))
    got = vector_index.VectorIndex(spark, str(tmp_path / "two")).search(q, 3).orderBy("rank").collect()
    assert [(x["vec_id"], round(x["similarity"], 6)) for x in got] == [(2, 0.707107), (1, 0.0)]
