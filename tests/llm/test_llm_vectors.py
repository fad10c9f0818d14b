"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hnsw, voronoi


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 12)).astype(np.float32)
    x[100:160] = x[7]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0, None] * 6), (2080, [float("inf")] * 12), (None, [1.0] * 12)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).cache(), x


@pytest.mark.parametrize("per_group,per_block,pivots,groups", [(4096, 16384, None, None), (3, 50, 8, 5), (4096, 100, 30, 1)])
def test_exact_top_k(table, per_group, per_block, pivots, groups):
    df, x = table
    rows = voronoi.quantize(df)
    got = {}
    for r in voronoi.knn_join(rows.where("vec_id % 20 = 0"), rows, 10, pivots, groups, per_group, per_block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    z = np.floor(x.astype(np.float64) * 1024).astype(int)
    z = np.vstack([z, np.zeros((1, 12), int)])
    ids = np.append(np.arange(900), 2020)
    for at in [*range(0, 900, 20), 900]:
        s = z @ z[at]
        best = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if j != at)[:10]
        assert [got[int(ids[at])][k + 1] for k in range(10)] == [(j, -v) for v, j in best]
    assert set(got) == {int(i) for i in ids if i % 20 == 0}


def test_exact_top_k_edges(spark, table):
    df, _ = table
    rows = voronoi.quantize(df.where("vec_id < 4"))
    assert voronoi.knn_join(rows, rows, 10).count() == 12
    assert voronoi.knn_join(rows.limit(0), rows, 10).count() == 0 and voronoi.knn_join(rows, rows.limit(0), 10).count() == 0
    big = voronoi.exact_scores(np.array([[1 << 31, 5]]), np.array([[1 << 31, 7]]))
    assert big.tolist() == [[(1 << 62) + 35]]


def test_bounds_prune(spark):
    """On clustered vectors most rows go to no query group that they cannot matter to, also where a group has many queries."""
    r = np.random.default_rng(5)
    c = r.normal(size=(40, 16))
    x = c[r.integers(0, 40, 4000)] / np.linalg.norm(c, axis=1).mean() + r.normal(size=(4000, 16)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = voronoi.quantize(df).cache()
    for groups, most in ((None, 0.05), (150, 0.25)):
        asked, sent = voronoi.plan_join(rows.where("vec_id % 10 = 0"), rows, 10, groups=groups)
        n = asked.select("i").distinct().count()
        assert sent.count() < most * n * 4000, groups


def test_odd_vectors(spark):
    """Columns whose names are used inside, components beyond 64 bits, vectors of unlike length, repeated rows."""
    rows = [(0, [1.0, 2.0]), (1, [3.0, 0.5]), (1, [3.0, 0.5]), (2, [1e30, 0.0]), (3, [2.0, 2.0, 9.0]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("g", "d", "v", "i", "s", "b", "goal", "task", "shard", "index", "e", "ids", "n", "block", "score", "rank"):
        df = df.withColumn(c, F.lit("own"))
    q = voronoi.quantize(df)
    got = [tuple(r) for r in voronoi.knn_join(q.where("vec_id = 0"), q, 10).orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 3), (2, 1), (3, 1), (4, 4)]
    found = hnsw.nearest(df.where("vec_id = 0"), hnsw.index(df.where("vec_id <> 2"), 5), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in found][:2] == [3, 1]
    assert voronoi.exact_scores(np.array([[1 << 62]]), np.array([[1 << 62]])).tolist() == [[(1 << 63) - 1]]


def test_recall_over_shards_of_full_size(spark, monkeypatch):
    """Several shards of SHARD_ROWS vectors, far more than the search is wide."""
    r = np.random.default_rng(2)
    x = r.normal(size=(3 * hnsw.SHARD_ROWS - 100, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    shards = hnsw.index(df, 20)
    assert shards.count() == 3
    got = {}
    for row in hnsw.nearest(df.where("vec_id % 500 = 0"), shards, 20).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = 0
    for q in got:
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == -(-len(x) // 500) and hits / (20 * len(got)) >= 0.9


def test_graph_search(table):
    df, x = table
    shards = hnsw.index(df, 20, shard_rows=300)
    assert shards.count() >= 2
    got = {}
    for r in hnsw.nearest(df.where("vec_id % 20 = 0"), shards, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        best = [j for _, j in sorted((-s[j], j) for j in range(900) if j != q)[:20]]
        assert [k for k, _, _ in got[q]] == list(range(1, 21)) and len({j for _, j, _ in got[q]}) == 20
        assert all(v == pytest.approx(s[j]) for _, j, v in got[q])
        hits += len({j for _, j, _ in got[q]} & set(best))
    assert hits / (45 * 20) >= 0.9 and set(got) == set(range(0, 900, 20))
    # the copies of one vector are found in order of id
    assert [j for _, j, _ in got[100]][:20] == [7, *range(101, 120)]


def test_graph_edges(spark, table):
    df, _ = table
    few = df.where("vec_id < 3")
    assert hnsw.nearest(few, hnsw.index(few, 20), 20).count() == 6
    none = df.limit(0)
    assert hnsw.nearest(few, hnsw.index(none, 20), 20).count() == 0 and hnsw.nearest(none, hnsw.index(few, 20), 20).count() == 0
