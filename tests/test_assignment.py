"""Ranks and one-to-one assignment by classes, against plain greedy."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import match, ranks


def test_ranks_across_partitions(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, id int").repartition(7)
    got = {(x["g"], x["id"]): x["rank"] for x in ranks.ranked(df, ["g"], ["id"]).collect()}
    assert len(got) == 3000
    for g in ("hot", "a", "b", None):
        mine = sorted(i for k, i in data if k == g)
        assert [got[g, i] for i in mine] == list(range(len(mine)))


def greedy_classes(one, two, links):
    left, right, out = {c: n for c, n, _ in one}, {d: n for d, n, _ in two}, []
    f1, f2 = {c: f for c, _, f in one}, {d: f for d, _, f in two}
    for c, d, p in sorted(links, key=lambda x: (-x[2], f1[x[0]], f2[x[1]])):
        m = min(left[c], right[d])
        if m:
            out.append((c, d, p, m))
            left[c] -= m
            right[d] -= m
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_classes_with_capacities(spark, seed):
    r = random.Random(seed)
    one = [(f"c{i}", r.choice([1, 2, 1000]), i) for i in range(12)]
    two = [(f"d{i}", r.choice([1, 3, 700]), 50 - i) for i in range(9)]
    links = [(c, d, r.choice([1.0, 0.9, 0.8])) for c, _, _ in one for d, _, _ in two if r.random() < 0.4]
    frames = spark.createDataFrame(one, "c string, n long, first int"), spark.createDataFrame(two, "d string, n long, first int"), spark.createDataFrame(links, "c string, d string, confidence double")
    got = ranks.matched_classes(*frames).collect()
    assert sorted((x["c"], x["d"], x["confidence"], x["m"]) for x in got) == greedy_classes(one, two, links)
    for key, start in (("c", "c_from"), ("d", "d_from")):  # ranges of a class neither overlap nor leave gaps
        for k in {x[key] for x in got}:
            at = 0
            for a, m in sorted((x[start], x["m"]) for x in got if x[key] == k):
                assert a == at
                at += m
    assert ranks.matched_classes(frames[0], frames[1], frames[2].limit(0)).count() == 0


def test_one_behaviour_holds_all_rules(spark, monkeypatch):
    """4,000 copies of one text among the rules of a single behaviour: a row of its class, dealt by rank in blocks."""
    monkeypatch.setattr(ranks, "BLOCK", 300)
    text, near = "alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon zeta"
    one = [(i, "b", text, None) for i in range(0, 4000, 2)] + [(9000, "b", near, None), (9002, "b", "epsilon delta gamma beta alpha", 1)]
    two = [(i, "b", text, None) for i in range(1, 3000, 2)] + [(9001, "b", near, None), (9003, "b", "unlike words stand here", None), (9005, None, text, None)]
    schema = "rule_id int, behavior string, text string, quality int"
    g1, g2 = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    m = match.match_members(g1, g2)
    plan = m._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan and "MapInPandas" not in plan
    got = sorted((x["g1"], x["g2"], x["relationship"]) for x in m.collect())
    assert got == sorted([(i, i + 1, "IDENTICAL") for i in range(0, 3000, 2)] + [(9000, 9001, "IDENTICAL")])
    sizes = {x["operation"]: x["n"] for x in match.set_sizes(g1.where("behavior = 'b'"), g2.where("behavior = 'b'"), m, match.conflict_classes(g1, g2, m)).collect()}
    assert sizes == {"INTERSECTION": 1501, "G1_MINUS_G2": 501, "G2_MINUS_G1": 1, "UNION": 2003}


def test_no_rules(spark):
    none = spark.createDataFrame([], "rule_id int, behavior string, text string, quality int")
    some = none.union(spark.createDataFrame([(1, "b", None, None), (2, "b", "", 0)], none.schema))
    assert match.match_members(none, some).count() == match.match_members(none, none).count() == 0
    assert [(x["g1"], x["g2"]) for x in match.match_members(some, some.withColumn("rule_id", F.col("rule_id") + 10)).collect()]


@pytest.mark.parametrize("most", [ranks.LINKS, 7])
def test_near_copies_of_one_confidence(spark, monkeypatch, most):
    """Classes that are all linked with the same confidence took a round each; a component is one step, or one for each
    LINKS links."""
    monkeypatch.setattr(ranks, "LINKS", most)
    cuts, cut = [], ranks._cut
    monkeypatch.setattr(ranks, "_cut", lambda df: cuts.append(1) or cut(df))
    one, two = [(f"c{i:02}", 1 + i % 3, i) for i in range(20)], [(f"d{i:02}", 2, 50 - i) for i in range(20)]
    links = [(c, d, 0.9) for c, _, _ in one[:-2] for d, _, _ in two[:-2]] + [("c19", "d19", 0.8), ("c18", "d19", 0.9)]
    if most < 10:
        one, two, links = one[:6], two[:6], [x for x in links if x[0] < "c06" and x[1] < "d06"]
    frames = spark.createDataFrame(one, "c string, n long, first int"), spark.createDataFrame(two, "d string, n long, first int"), spark.createDataFrame(links, "c string, d string, confidence double")
    got = ranks.matched_classes(*frames).collect()
    assert sorted((x["c"], x["d"], x["confidence"], x["m"]) for x in got) == greedy_classes(one, two, links)
    assert most < 10 or len(cuts) < 10
