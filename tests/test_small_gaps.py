"""Sections of office files, creation of vertices, orphan rate."""

from pyspark.sql import functions as F

from tessera.operators import load, segment, stats


def test_block_chunks(spark):
    rows = [
        ("a", 0, 0, "lost"), ("a", 1, 1, " One "), ("a", 2, 0, "x" * 50), ("a", 3, 2, "Two"), ("a", 4, 0, "short"), ("a", 5, 1, "Three"), ("a", 6, 0, "y" * 60), ("a", 7, 0, "  "),
        ("b", 0, 0, "no heading"), ("b", 1, None, "at all"),
        ("c", 0, 1, "H"), ("c", 1, 0, "s"), ("c", 2, 1, "I"), ("c", 3, 0, "t"),
        ("d", 0, 0, None), ("d", 1, 0, ""),
    ]
    got = sorted(map(tuple, segment.block_chunks(spark.createDataFrame(rows, "doc_id string, ord int, level int, text string"), 40).collect()))
    assert got == [("a", 1, "One", "# One\n\n" + "x" * 50), ("a", 2, "Three", "# Three\n\n" + "y" * 60), ("b", 1, None, "no heading\n\nat all"), ("c", 1, "I", "# I\n\nt")]


def plain_chunks(ps, size, least):
    out, now = [], []
    for p in ps:
        now.append(p)
        if len("\n\n".join(now)) >= size:
            out.append("\n\n".join(now))
            now = []
    if now and (len("\n\n".join(now)) >= least or not out):
        out.append("\n\n".join(now))
    return out


def test_paragraph_chunks(spark):
    docs = {f"d{k}": ["w" * ((k * 37 + i * 101) % 900 + 1) for i in range(k)] for k in range(12)}
    df = spark.createDataFrame([(d, i, f" {p}\n") for d, ps in docs.items() for i, p in enumerate(ps)] + [("d3", 99, " ")], "doc_id string, ord int, text string").repartition(4)
    got = {}
    for r in segment.paragraph_chunks(df).orderBy("n").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    assert got == {d: plain_chunks(ps, 2000, 500) for d, ps in docs.items() if ps}


def test_vertices_are_checked(spark):
    v = spark.createDataFrame([("c1", "entity_category", "Loan", ""), ("r1", "business_rule", "Old rule", "text")], "vertex_id string, label string, name string, content string")
    text = "long enough content"
    rows = [
        (0, " New rule ", None, text, "constraint", None, "Loan", "55"),
        (1, "New rule", "business_rule", text, None, "cat", "Loan", None),
        (2, "Old rule", "business_rule", text, None, None, None, None),
        (3, " ", "thing", "short", "odd", None, None, "many"),
        (4, "Other", "entity_category", text, "odd", "own", "Unknown", "101"),
        (5, "Third", "entity_category", text, "odd", "own", "Unknown", "100"),
    ]
    new = spark.createDataFrame(rows, "ord int, name string, label string, content string, rule_type string, category string, entity_or_relationship string, confidence_score string")
    created, edges, errors = load.create_vertices(v, new)
    ids = {r["name"]: r["vertex_id"] for r in created.collect()}
    assert sorted((r["name"], r["label"], r["category"]) for r in created.collect()) == [("New rule", "business_rule", "constraint"), ("Third", "entity_category", "odd")]
    assert [tuple(r) for r in edges.collect()] == [(ids["New rule"], "c1", "belongs_to_category", "categorization")]
    told = {r["ord"]: r["errors"] for r in errors.collect()}
    assert told[1] == ["A vertex named 'New rule' already exists in this graph"] and told[2] == ["A vertex named 'Old rule' already exists in this graph"]
    assert [x.split()[0] for x in told[3]] == ["name", "content", "confidence_score"] or [x.split()[0] for x in told[3]] == ["label", "name", "content", "confidence_score"]
    assert told[4] == ["confidence_score must be between 0 and 100"] and set(told) == {1, 2, 3, 4}
    assert load.create_vertices(v, new.limit(0))[0].count() == 0


def test_orphan_rate(spark):
    rules = spark.createDataFrame([(i,) for i in range(8)], "rule_id int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (9, 3)], "src int, dst int")
    assert tuple(stats.orphan_rate(rules, edges).first()) == (8, 4, 50.0)
    assert tuple(stats.orphan_rate(rules.limit(0), edges).first()) == (0, 0, 0.0)
    assert stats.orphan_rate(rules, edges.where(F.lit(False))).first()["percent"] == 100.0
