"""The similarity join of vectors against all pairs, and what it adds for a judge."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import meaning


def cos(a, b):
    if any(v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) for v in (a, b)):
        return 0.0
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize(("least", "pivots", "block", "groups"), [(0.9, 40, 2048, 2000), (0.3, 9, 7, 2000), (0.97, 5, 50, 0)])
def test_all_pairs(spark, monkeypatch, least, pivots, block, groups):
    monkeypatch.setattr(meaning, "GROUPS", groups)
    r = random.Random(pivots)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]

    def side():
        rows = []
        for i in range(150):
            c = centres[0] if i % 3 == 0 else r.choice(centres)  # one cell holds a third
            rows.append((r.choice(["x", "x", "y", None]), i, [v + r.gauss(0, 0.3) for v in c]))
        return [*rows, ("x", 500, [0.0] * 6), ("x", 501, None), ("y", 502, [math.nan] * 6), ("x", 503, centres[0]), ("x", 504, centres[0])]

    one, two = side(), side()
    schema = "g string, id long, embedding array<double>"
    got = meaning.vector_pairs(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), least, pivots, block).collect()
    want = {(g, i, j): c for g, i, a in one for h, j, b in two if g is not None and g == h and (c := cos(a, b)) >= least}
    assert len(got) == len(want) > 100
    assert all(abs(want[x["g"], x["a"], x["b"]] - x["similarity"]) < 1e-9 for x in got)


def test_vectors_without_clusters_are_not_sent_to_every_cell(spark, monkeypatch):
    """Of 1,600 vectors in all directions each reaches most of 41 cells: they are dealt by blocks instead, few copies each."""
    seen, cut = [], meaning._cut
    monkeypatch.setattr(meaning, "_cut", lambda df: seen.append(cut(df)) or seen[-1])
    r = random.Random(8)
    side = lambda: [("x" if i % 2 else "y", i, [r.gauss(0, 1) for _ in range(12)]) for i in range(800)]
    one, two = side(), side()
    schema = "g string, id long, embedding array<double>"
    got = meaning.vector_pairs(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), 0.6, block=100).collect()
    assert {(x["g"], x["a"], x["b"]) for x in got} == {(g, i, j) for g, i, a in one for h, j, b in two if g == h and cos(a, b) >= 0.6}
    assert max(x.count() for x in seen if "unit" in x.columns) <= 1600


def test_nothing_to_join(spark):
    none = spark.createDataFrame([], "g string, id long, embedding array<double>")
    some = spark.createDataFrame([("x", 1, [1.0, 0.0])], none.schema)
    assert meaning.vector_pairs(none, some, 0.5).count() == meaning.vector_pairs(some, none, 0.5).count() == meaning.vector_pairs(none, none, 0.5).count() == 0
    with pytest.raises(ValueError):
        meaning.vector_pairs(some, some, 0.0)


def test_reworded_rules_reach_a_judge(spark):
    """A model that knows what words mean brings texts together that share none; copies stand for one."""
    known = {"borrower": [1.0, 0.0, 0.1], "debtor": [0.98, 0.05, 0.1], "escrow": [0.0, 1.0, 0.0]}

    def model(df, column):
        each = F.array(*[F.when(F.contains(column, F.lit(w)), F.array(*map(F.lit, v))) for w, v in known.items()])
        return df.withColumn("embedding", F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0)))

    schema = "rule_id int, behavior string, text string, quality int"
    g1 = spark.createDataFrame([(1, "b", "borrower shows earnings", None), (2, "b", "Borrower shows earnings", 1), (3, "b", "borrower shows earnings", None), (4, "b", "escrow account", None)], schema)
    g2 = spark.createDataFrame([(11, "b", "debtor proves salary", 0), (12, "c", "debtor proves salary", 0), (13, "b", None, None)], schema)
    keys = meaning.meaning_keys(g1, g2, 0.9, model)
    assert keys.count() == 1
    got = meaning.meaning_pairs(g1, g2, keys).collect()
    assert [(x["g1"], x["g2"], x["g1_copies"], x["g2_copies"], x["g2_text"]) for x in got] == [(1, 11, 3, 1, "debtor proves salary")]
