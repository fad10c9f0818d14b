"""Edges that were found by reading: large vectors, numbers that are no letters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, voronoi


@pytest.mark.parametrize("size", [3e7, 1e8, 3e8])
def test_search_of_large_vectors(spark, size):
    """Rows nearly at right angles to the queries, all scores within 64 bits: bounds lose no row to rounding."""
    r = np.random.default_rng(int(size))
    n, k = 3000, 5
    q = r.normal(size=(30, 8)) * size
    x = r.normal(size=(n, 8)) * size
    for i in range(n - n // 6):  # taken to within a few units of the plane that is at right angles to a query
        u = q[i % 30] / np.linalg.norm(q[i % 30])
        x[i] -= (x[i] @ u) * u
    rows = [(100 * i, [int(v) for v in np.floor(a)]) for i, a in enumerate(q)] + [(100 * i + 50, [int(v) for v in np.floor(a)]) for i, a in enumerate(x)]
    df = spark.createDataFrame([(i, bytearray(np.array(v, "<i8").tobytes())) for i, v in rows], "vec_id long, v binary").repartition(4)
    got = {}
    for y in voronoi.knn_join(df.where("vec_id % 100 = 0"), df, k).collect():
        got.setdefault(y["query_id"], []).append((y["rank"], y["vec_id"], y["score"]))
    for i, v in rows[:30]:
        score = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)[:k]
        assert [(j, s) for _, j, s in sorted(got[i])] == [(j, -s) for s, j in score]


def test_numbers_are_no_letters(spark):
    learned = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden of the man", "en"), ("das haus und der garten des mannes", "de")] * 6)]
    odd = [(100, "½ ²"), (101, "①"), (102, "Ⅷ"), (103, "_ 12 %"), (104, "é"), (105, "½ the house")]
    df = spark.createDataFrame(learned + [(i, t, None) for i, t in odd], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["_lang_pred"] for r in langid.identify(df.withColumn("source", F.lit("s"))).collect()}
    assert [got[i] == "und" for i, _ in odd] == [True] * 4 + [False] * 2
