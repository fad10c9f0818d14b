import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, impact, load, match, register, search, segment, stats, validate
from tessera.plans.engine import RuleGraph
from tessera.plans.judges import batched, dependency_judge
from tessera.streaming import logs


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_unique_rules(spark):
    r = spark.createDataFrame([(0, "R1", "Name"), (1, "R1", "name "), (2, "R1", "Other"), (3, "", ""), (4, "", ""), (5, "R1_v2", "x"), (6, "Q", None)], "ord int, rule_id string, rule_name string")
    got = rows(match.unique_rules(r), "ord", "new_id", "new_name")
    assert [g[1] for g in got[:3]] == ["R1", "R1_v3", "R1_v4"]
    assert got[1][2] == "name  (Variant 2)" and got[3][1:] == ("", "") and got[4][1:] == ("", "") and got[6][2] is None


def greedy(pairs):
    a, b, out = set(), set(), []
    for c, i, j in sorted(((-c, i, j) for i, j, c in pairs)):
        if i not in a and j not in b:
            a.add(i), b.add(j), out.append((i, j))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_assignment_is_greedy(spark, seed):
    r = random.Random(seed)
    pairs = [(i, j, r.choice([1.0, 0.9, 0.8])) for i in range(8) for j in range(8) if r.random() < 0.5]
    df = spark.createDataFrame([("b", i, j, "IDENTICAL", c) for i, j, c in pairs], "behavior string, g1 int, g2 int, relationship string, confidence double")
    assert rows(match.assign(df), "g1", "g2") == greedy(pairs)


@pytest.mark.parametrize("seed", range(4))
def test_members_match_as_their_pairs_do(spark, seed):
    r = random.Random(seed)
    texts = ["alpha beta gamma", "Alpha  beta gamma", "gamma beta alpha", "delta epsilon"]
    rows_ = [(r.choice([1, 2]), i, "b", r.choice(texts), r.choice([None, 0, 1])) for i in range(30)]
    g = spark.createDataFrame(rows_, "graph int, rule_id int, behavior string, text string, quality int")
    one, two = g.where("graph = 1"), g.where("graph = 2")
    judged = match.default_judge(match.candidate_pairs(one, two))
    m = match.match_members(one, two)
    assert rows(m, "g1", "g2", "relationship") == rows(match.assign(judged), "g1", "g2", "relationship")
    assert rows(match.member_conflicts(one, two, m), "g1", "g2") == rows(match.contradictions(judged, m), "g1", "g2")


def test_near_rules_meet_and_values_conflict(spark):
    s = "behavior string, rule_id int, text string, quality int"
    one = spark.createDataFrame([("b", 1, "borrower income documents kept seven files complete archive", None), ("b", 3, "late payment fee equals $1,200 per account", None), ("b", 5, "ownership above 25% needs approval", None), ("b", 7, "gamma delta epsilon zeta", 1), ("b", 9, "notice within 30 days of closing", None)], s)
    two = spark.createDataFrame([("b", 2, "borrower income documents kept seven files complete folder", None), ("b", 4, "late payment fee equals $1,500 per account", None), ("b", 6, "ownership above 40% needs approval", None), ("b", 8, "nothing alike here whatever", 1), ("b", 10, "Notice within 30 day of closing", None), ("c", 12, "gamma delta epsilon zeta", 1)], s)
    judged = match.default_judge(match.candidate_pairs(one, two))
    assert rows(judged, "g1", "g2", "relationship") == [(1, 2, "EQUIVALENT"), (3, 4, "CONTRADICTORY"), (5, 6, "CONTRADICTORY")]
    m = match.match_members(one, two)
    assert rows(m, "g1", "g2", "relationship") == [(1, 2, "EQUIVALENT")] == rows(match.assign(judged), "g1", "g2", "relationship")
    assert rows(match.member_conflicts(one, two, m), "g1", "g2") == [(3, 4), (5, 6)]


@pytest.mark.parametrize("seed", range(3))
def test_near_matches_against_all_pairs(spark, seed):
    r = random.Random(seed)
    vocab = [f"word{c}" for c in "abcdefghijkl"]
    base = [[r.choice(vocab) for _ in range(9)] + [r.choice(["", "10%", "20%", "300"])] for _ in range(4)]
    def text():
        w = list(r.choice(base))
        w[r.randrange(9)] = r.choice(vocab)
        return " ".join(w)
    rows_ = [(r.choice([1, 2]), i, "b", text(), r.choice([None, None, 0, 1])) for i in range(40)]
    g = spark.createDataFrame(rows_, "graph int, rule_id int, behavior string, text string, quality int")
    one, two = g.where("graph = 1"), g.where("graph = 2")
    every = match.default_judge(one.select("behavior", F.col("rule_id").alias("g1"), F.col("text").alias("g1_text"), F.col("quality").alias("g1_quality")).join(two.select("behavior", F.col("rule_id").alias("g2"), F.col("text").alias("g2_text"), F.col("quality").alias("g2_quality")), "behavior"))
    near = match.default_judge(match.candidate_pairs(one, two))
    good = "relationship IN ('IDENTICAL', 'EQUIVALENT')"
    assert rows(every.where(good), "g1", "g2", "relationship") == rows(near.where(good), "g1", "g2", "relationship")
    m = match.match_members(one, two)
    assert rows(m, "g1", "g2", "relationship") == rows(match.assign(every), "g1", "g2", "relationship")
    assert rows(match.member_conflicts(one, two, m), "g1", "g2") == rows(match.contradictions(near, m), "g1", "g2")


def test_near_duplicates(spark):
    w = [f"w{i}" for i in range(60)]
    text = lambda *at: " ".join("changed" if i in at else x for i, x in enumerate(w))
    data = [(4, text()), (2, text(30)), (3, text(30).upper()), (5, text(0, 30)), (6, " ".join(reversed(w))), (7, "short one"), (8, "Short  one"), (9, None), (10, ""), (1, text(5, 12, 20, 28, 36, 44, 52))]
    df = spark.createDataFrame(data, "rule_id int, text string")
    assert rows(match.near_duplicate_groups(df), "primary", "duplicate") == [(2, 3), (2, 4), (2, 5), (7, 8)]


def test_numbering(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 9, 9, 3, 7)], "ord double")
    assert [o for _, o in sorted((r["n"], r["ord"]) for r in segment.numbered(df, "ord", "n", 3).collect())] == [1, 3, 5, 7, 9, 9]


def test_set_identity(spark):
    j = spark.createDataFrame([("b", 1, 2, "IDENTICAL", 1.0), ("b", 3, 2, "EQUIVALENT", 0.9), ("b", 3, 4, "CONTRADICTORY", 0.5), ("b", 1, 4, "CONTRADICTORY", 0.5)], "behavior string, g1 int, g2 int, relationship string, confidence double")
    g1 = spark.createDataFrame([(1, "b"), (3, "b"), (5, "b")], "rule_id int, behavior string")
    g2 = spark.createDataFrame([(2, "b"), (4, "b")], "rule_id int, behavior string")
    m = match.assign(j)
    c = match.contradictions(j, m)
    assert rows(m, "g1", "g2") == [(1, 2)] and rows(c, "g1", "g2") == [(3, 4)]
    n = {r["operation"]: r["n"] for r in match.set_sizes(g1, g2, m, c).collect()}
    assert n["UNION"] == n["INTERSECTION"] + n["G1_MINUS_G2"] + n["G2_MINUS_G1"] == 4


def test_aligned_verdicts(spark):
    p = spark.createDataFrame([(0,), (1,), (2,)], "pair_id int")
    v = spark.createDataFrame([(0, 2, "IDENTICAL", 0.9, 95.0), (1, 0, "EQUIVALENT", 0.8, 80.0), (2, 2, "UNRELATED", 0.1, 1.0)], "ord int, pair_id int, relationship string, confidence double, similarity_score double")
    assert rows(match.aligned(p, v), "pair_id", "relationship", "similarity_score") == [(0, "EQUIVALENT", 80.0), (1, "UNRELATED", 50.0), (2, "IDENTICAL", 95.0)]


def test_traversals(spark):
    e = spark.createDataFrame([(1, 2, "prerequisite", 5), (2, 3, "prerequisite", 4), (3, 1, "prerequisite", 3), (3, 4, "override", 2), (5, 4, "prerequisite", 1)], "src int, dst int, dependency_type string, strength int")
    assert rows(graph.closure(e, 1)) == [(2,), (3,)]
    assert [r["path"] for r in graph.shortest_paths(e, 1, 5).collect()] == [[1, 3, 4, 5]]
    assert graph.shortest_paths(e, 1, 5, most=2).count() == 0 and graph.shortest_paths(e, 1, 1).count() == 0
    steps = rows(graph.path_edges(graph.shortest_paths(e, 1, 5), e), "step", "direction")
    assert steps == [(0, "incoming"), (1, "outgoing"), (2, "incoming")]
    d = {r["node"]: r["degree"] for r in stats.degrees(spark.createDataFrame([(1, 1), (1, 2)], "src int, dst int")).collect()}
    assert d == {1: 3, 2: 1}


def test_category_fallback(spark):
    r = spark.createDataFrame([("R1", "BORROWER"), ("R2", "NOPE"), ("R3", None)], "rule_id string, entity_or_relationship string")
    c = spark.createDataFrame([("BORROWER",)], "name string")
    assert rows(load.category_edges(r, c)) == [("R1", "BORROWER", "categorization"), ("R2", "_uncategorized_", "categorization_fallback"), ("R3", "_uncategorized_", "categorization_fallback")]


def test_canonical_names(spark):
    r = spark.createDataFrame([("suspicious activity-report",), ("filed by",), ("none",)], "entity_or_relationship string")
    e = spark.createDataFrame([("SUSPICIOUS_ACTIVITY_REPORT",)], "name string")
    rel = spark.createDataFrame([("FILED_BY",), ("suspicious_activity_report",)], "name string")
    assert rows(match.canonical_names(r, e, rel)) == [("FILED_BY",), ("SUSPICIOUS_ACTIVITY_REPORT",), ("none",)]
    assert rows(match.orphans(match.canonical_names(r, e, rel), e.union(rel)), "entity_or_relationship") == [("none",)]


def test_register(spark):
    o = spark.createDataFrame([("g", "p", f"R{i}", s, None if i else "", "n") for i, s in enumerate(["mapped", "unmapped", "partially_mapped", "exempted"])], "graph_name string, provider string, rule_id string, status string, rule_type string, notes string").withColumn("risk_level", F.lit("high"))
    assert register.compliance_score(o).first()["score"] == 37.5
    assert register.compliance_score(o.where("false")).first()["score"] == 0.0
    h = rows(register.heatmap(o).where("facet = 'rule_type'"), "value", "status", "n")
    assert {v for v, _, _ in h} == {"unknown"} and sum(n for *_, n in h) == 4
    new = o.limit(0).union(spark.createDataFrame([("g", "p", "R1", "mapped", "t", "x", "low"), ("g", "p", "R9", "unmapped", "t", "x", "low")], o.schema))
    got = {r["rule_id"]: r for r in register.upsert(o, new).collect()}
    assert len(got) == 5 and got["R1"]["status"] == "unmapped" and got["R1"]["rule_type"] == "t" and got["R9"]["notes"] == "x"
    s = register.suggestions(spark.createDataFrame([("R", "Property wire rule", "process", "critical")], "rule_id string, rule_name string, rule_type string, risk_level string"))
    assert s.count() == 6


def test_diff_against_reference_cases(spark):
    old = ["Alpha provision stays as it is.", "The ratio must not exceed 80 percent of value."]
    new = ["Alpha provision stays as it is.", "The ratio must not exceed 90 percent of value."]
    assert [k for k, _ in impact.diff_lists(old, new)] == ["modified"]
    assert [k for k, _ in impact.diff_lists(old[:1], old)] == ["added"] and [k for k, _ in impact.diff_lists(old, old[:1])] == ["removed"] and impact.diff_lists([], []) == []
    pairs = spark.createDataFrame([(1, old, new), (2, [], [])], "pair_id int, old array<string>, new array<string>")
    rules = spark.createDataFrame([("R1", "Ratio limit", "ratio must not exceed percent of value", "property"), ("R2", "Ships", "maritime cargo", "boat")], "rule_id string, rule_name string, description string, entity_type string")
    got = impact.analyse(impact.diff(pairs), rules).collect()
    assert len(got) == 1 and got[0]["affected"] == 1 and got[0]["severity"] == "breaking" and got[0]["recommendation"].startswith("URGENT") and "Ratio limit" in got[0]["recommendation"]


def test_provisions(spark):
    d = spark.createDataFrame([(1, "First provision that is long enough.\n\n1) Second provision that is long.\n2) Third provision, long as well.\nshort")], "doc_id int, text string")
    assert [t for _, t in rows(impact.provisions(d), "ord", "text")] == ["First provision that is long enough.", "1) Second provision that is long.", "2) Third provision, long as well.\nshort"]


CHUNKS = "doc_id int, ord int, chunk_id string, title string, path array<string>, content string"


def test_size_normalisation(spark):
    c = [("a", "A", ["s", "x"], "w " * 10), ("b", "B", ["s", "y"], "w " * 10), ("c", "C", ["s", "z"], "w " * 10), ("d", "D", ["t", "z"], "p " * 50 + "\n\n" + "q " * 50)]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(c)] + [(2, 0, "e", "E", None, "w"), (2, 1, "f", "F", None, "w")], CHUNKS)
    got = rows(segment.normalise_sizes(df, most=60, least=20, target=20), "doc_id", "ord", "chunk_id", "title", "parent_id", "word_count")
    assert got == [(1, 0, "a", "A + B", None, 20), (1, 1, "c", "C", None, 10), (1, 2, "d_sub_001", "D (Part 1)", "d", 50), (1, 3, "d_sub_002", "D (Part 2)", "d", 50), (2, 0, "e", "E", None, 1), (2, 1, "f", "F", None, 1)]


def test_size_normalisation_keeps_words(spark):
    """Of 60 documents of chunks of any size: no word is lost, no chunk too long, and what could be joined is joined once."""
    r = random.Random(3)
    sizes = {d: [r.randint(1, 60) for _ in range(r.randint(0, 12))] for d in range(60)}
    df = spark.createDataFrame([(d, i, f"{i}", "t", ["s", str(i)], " ".join(["w"] * n)) for d, ns in sizes.items() for i, n in enumerate(ns)], CHUNKS)
    got = {}
    for x in segment.normalise_sizes(df, most=80, least=20, target=50).orderBy("doc_id", "ord").collect():
        assert len(x["content"].split()) == x["word_count"]
        got.setdefault(x["doc_id"], []).append((int(x["chunk_id"]), x["word_count"]))
    for d, ns in sizes.items():
        own = got.get(d, [])
        assert sum(n for _, n in own) == sum(ns) and all(n <= 80 for _, n in own)
        ends = [i for i, _ in own[1:]] + [len(ns)]
        for (i, n), end in zip(own, ends):
            assert n == sum(ns[i:end]) and end - i == (2 if i + 1 < len(ns) and ns[i] < 20 and ns[i] + ns[i + 1] <= 80 else 1)


def model_batches(files, target, most):
    out, now, words = [], [], 0
    for w, f in sorted(((-w, f) for f, w in files)):
        w = -w
        if w >= target:
            out += [now] * bool(now) + [[f]]
            now, words = [], 0
        elif words + w > target or len(now) >= most:
            out += [now] * bool(now)
            now, words = [f], w
        else:
            now.append(f)
            words += w
    return out + [now] * bool(now)


@pytest.mark.parametrize("seed", range(4))
def test_word_batches(spark, seed):
    r = random.Random(seed)
    files = [(i, r.choice([5, 20, 40, 99, 130])) for i in range(r.randint(1, 25))]
    df = spark.createDataFrame([("g", f, w) for f, w in files], "group string, file_id int, word_count int")
    got = {}
    for _, f, b in rows(segment.word_batches(df, 100, 3)):
        got.setdefault(b, set()).add(f)
    assert [got[b] for b in sorted(got)] == [set(b) for b in model_batches(files, 100, 3)]


@pytest.mark.parametrize("seed", range(6))
def test_word_batches_across_blocks(spark, seed):
    """Blocks of a few files, a group that holds most of them, a null one, and files that are alike."""
    r = random.Random(seed)
    files = [(r.choice(["hot"] * 5 + ["cold", None]), r.randint(0, 40), r.choice([0, 1, 20, 33, 40, 99, 100, 130, None])) for _ in range(60)]
    df = spark.createDataFrame(files, "group string, file_id int, word_count int")
    got = {}
    for g, f, b in [tuple(x) for x in segment.word_batches(df, 100, 3, block=r.choice([3, 4, 7])).collect()]:
        got.setdefault(g, {}).setdefault(b, []).append(f)
    assert sum(len(x) for bs in got.values() for x in bs.values()) == len(files)
    for g in {f[0] for f in files}:
        want = model_batches([(f, w or 0) for k, f, w in files if k == g], 100, 3)
        assert sorted(got[g]) == list(range(len(want)))
        assert [len(got[g][b]) for b in sorted(got[g])] == [len(b) for b in want]
        assert [sorted(got[g][b]) for b in sorted(got[g])] == [sorted(b) for b in want]
    assert segment.word_batches(df.limit(0)).count() == 0


def test_pages_and_paths(spark):
    toc = spark.createDataFrame([(1, 0, None, 9), (1, 1, 3, 9), (1, 2, 3, 9), (1, 3, None, 9)], "doc_id int, ord int, page int, total_pages int")
    assert rows(segment.fill_pages(toc), "ord", "first", "last") == [(0, 1, 2), (1, 3, 3), (2, 3, 3), (3, 3, 9)]
    d = spark.createDataFrame([(1, "lost\n# A\nx\n## B\ny\n# C\nz")], "doc_id int, text string")
    c = segment.heading_chunks(d)
    assert rows(c, "n", "title", "content") == [(1, "A", "x"), (2, "B", "y"), (3, "C", "z")]
    assert rows(segment.section_paths(c), "n", "path") == [(1, ["A"]), (2, ["A", "B"]), (3, ["C"])]


def test_findings(spark):
    r = spark.createDataFrame([("R1", 50.0, "extreme"), ("R2", None, "low")], "rule_id string, confidence_score double, risk_level string")
    got = rows(validate.findings(r), "rule_id", "check", "severity")
    assert ("R1", "confidence", "high") in got and ("R1", "enum_validation", "medium") in got and ("R2", "confidence", "medium") in got and ("R2", "completeness", "high") in got


def test_reference_verification(spark):
    text = "the borrower must provide proof of income before closing and the lender must verify it in writing"
    c = spark.createDataFrame([("a.txt", text)], "path string, content string")
    refs = spark.createDataFrame([(1, "a.txt", 0, 5, "the borrower must provide proof", "d"), (2, "a.txt", 90, 99, "the lender must verify it in writing", "d"), (3, "b.txt", 0, 5, "x", "d"), (4, "a.txt", 0, 2, "zzzz qqqq", "d")], "rule_id int, chunk_path string, start int, end int, source_text string, description string")
    assert rows(validate.verify_references(refs, c), "rule_id", "note") == [(1, "verified"), (2, "recovered_by_text"), (3, "chunk_not_found"), (4, "text_mismatch")]
    a, b, r = validate.find_window(text, "The lender must verify it")
    assert " ".join(text.split()[a:b]) == "the lender must verify it" and r == 1.0
    assert validate.find_window(text, "maritime cargo law") is None and validate.find_window("", "x") is None and validate.find_window("x", "") is None
    # words are missing and others stand between
    a, b, r = validate.find_window("zero one " * 50 + text + " two three" * 50, "borrower must provide full proof of income before the closing")
    assert {"borrower", "proof", "income", "closing"} <= set(("zero one " * 50 + text + " two three" * 50).split()[a:b]) and 0.8 < r < 1
    again = validate.find_window(text + " " + text, "provide proof of income")
    assert again[:2] == (3, 7) and again[2] == 1.0


def test_offline_verification(spark):
    c = spark.createDataFrame([("a.txt", "the borrower must provide proof of income before closing")], "path string, content string")
    refs = spark.createDataFrame([(1, "a.txt", 0, 5, "the borrower must provide proof", "d", None), (2, "a.txt", 0, 5, "as in section B2", "d", True)], "rule_id int, chunk_path string, start int, end int, source_text string, description string, legacy boolean")
    got = validate.reverify(refs, c)
    assert rows(got, "rule_id", "note", "verified") == [(1, "verified", True), (2, "legacy_skipped", None)] and "legacy" not in got.columns


def test_search(spark):
    i = spark.createDataFrame([("c1", "B2-1.5-04, Loan Limits"), ("c2", "Personal Gifts"), ("c3", "B3-4.3-17 Gifts")], "chunk_id string, title string")
    assert [r["score"] for r in search.match_reference(i, "personal gifts").collect()][0] == 100
    assert rows(search.match_reference(i, "See B2-1.5-04 on loans"), "chunk_id", "score") == [("c1", 90)]
    c = spark.createDataFrame([("c1", "Gift funds", "gift funds are gift money"), ("c2", "Other", "funds"), ("c3", "x", "y")], "chunk_id string, title string, content string")
    assert rows(search.knowledge_search(c, "gift funds"), "chunk_id", "score") == [("c1", 125.0), ("c2", 41.5)]
    p = spark.createDataFrame([(1, "ratio limits for property loans"), (2, "maritime cargo")], "provision_id int, text string")
    r = spark.createDataFrame([("R1", "Ratio", "limits for property", "loan"), ("R2", "Other", "nothing", "x")], "rule_id string, rule_name string, description string, entity_type string")
    assert rows(search.affected_rules(p, r), "provision_id", "rule_id", "score") == [(1, "R1", 0.75)]


def test_rule_graph(spark):
    r = spark.createDataFrame([(1, "a", "process", "c", "e", "text one", 80.0, True, False), (2, "b", "process", "c", "e", "text two", 60.0, True, True)], "rule_id int, rule_name string, rule_type string, category string, entity_type string, description string, confidence_score double, mandatory boolean, requires_review boolean")
    e = spark.createDataFrame([(1, 2, "override", 3)], "src int, dst int, dependency_type string, strength int")
    g = RuleGraph(spark, r, e)
    assert g.execute("SELECT count(*) AS n FROM rules").first()["n"] == 2
    assert g.execute("WITH x AS (SELECT rule_name AS process, 1 AS file FROM rules) SELECT process, file FROM x ORDER BY process").first()["process"] == "a"
    assert g.execute("SELECT 'DROP TABLE rules; -- INSERT' AS t").first()["t"].startswith("DROP")
    for bad in ("DROP TABLE rules", "", "SET x = 1", "WITH x AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '/tmp/no' USING parquet SELECT * FROM x", "FROM rules INSERT OVERWRITE DIRECTORY '/tmp/no' USING parquet SELECT *", "CREATE TABLE t AS SELECT 1", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM (SELECT java_method('java.lang.System', 'gc') AS a)", "SELECT TRANSFORM(rule_id) USING 'cat' FROM rules", "SELECT * FROM parquet.`/etc/passwd`", "SELECT 1; DROP TABLE rules"):
        with pytest.raises(PermissionError):
            g.execute(bad)
    one, near = g.vertex_details(1)
    assert one.first()["out_degree"] == 1 and rows(near, "other", "direction", "rule_name") == [(2, "outgoing", "b")]
    assert rows(g.compare_rules([1, 2])[1], "kind", "node") == [("same_category", "true"), ("same_entity", "true")]
    assert g.resolve("b").first()["rule_id"] == 2 and g.resolve("text").first()["rule_id"] == 1
    assert g.graph_statistics()["hubs"].count() == 2


def test_judges(spark):
    calls = []

    def call(batch):
        calls.append(len(batch))
        return [{"pair_id": b["pair_id"], "verdict": b["text"].upper()} for b in reversed(batch) if b["text"] != "gap"]

    df = spark.createDataFrame([("a",), ("gap",), ("c",)], "text string")
    assert sorted(map(str, rows(batched(call, ["text"], "verdict string", size=2)(df), "text", "verdict"))) == sorted(map(str, [("a", "A"), ("gap", None), ("c", "C")]))
    r = spark.createDataFrame([("R1", "needs R2 first"), ("R2", "stands alone, not R1x")], "rule_id string, description string")
    assert rows(dependency_judge(r), "src", "dst") == [("R1", "R2")]


def test_event_folds(spark):
    c = spark.createDataFrame([(1, 0, 'data: {"content":"He'), (1, 1, 'llo","label":"s1"}\ndata: x\n'), (1, 2, 'data: {"status":"done","content":"!"}'), (2, 0, 'data: {"message":"oops"}\n')], "stream_id int, ord int, chunk string")
    assert rows(logs.fold_events(c)) == [(1, "Hello!", None), (2, "oops", None)]
    lines = spark.createDataFrame([("r", '[LLM_COST]{"cost": 0.5, "prompt_tokens": 10}'), ("r", "[LLM_COST]broken{"), ("r", '[LLM_COST]{"cost": 0.25}'), ("r", "INFO")], "run_id string, line string")
    got = logs.costs(lines).first()
    assert got["total_cost"] == 0.75 and got["prompt_tokens"] == 10


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "run1.log").write_text("Step 1 running\nStep 1 completed\n❌ FAILED here\nWARNING x\n")
    stream = logs.read_log(spark, str(tmp_path / "in"))
    q = stream.groupBy("run_id", "level").count().writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("levels")) == [("run1", "ERROR", 1), ("run1", "INFO", 2), ("run1", "WARN", 1)]
    q = logs.stream_steps(stream.select("run_id", "line"), ["1", "2"]).writeStream.outputMode("update").format("memory").queryName("steps").start()
    q.processAllAvailable()
    q.stop()
    assert ("run1", "1", "completed") in rows(spark.table("steps")) and ("run1", "2", "running") in rows(spark.table("steps"))
    assert logs.advance((0, ("pending",) * 2), "Step 3.5 completed", ["3", "3.5"])[0] == 0


def test_path_resolution(spark):
    refs = spark.createDataFrame([(1, "b/c/one.txt"), (2, "zz/two.txt"), (3, "q/c/three.txt"), (4, "nope.txt")], "ref_id int, path string")
    chunks = spark.createDataFrame([("b/c/one.txt",), ("x/y/two.txt",), ("a/c/three.txt",), ("b/c/three.txt",), ("r/q/c/three.txt",)], "path string")
    assert rows(search.resolve_chunks(refs, chunks), "ref_id", "chunk") == [(1, "b/c/one.txt"), (2, "x/y/two.txt"), (3, "a/c/three.txt"), (4, None)]
    index = chunks.withColumn("ord", F.monotonically_increasing_id())
    assert rows(search.resolve_path(refs, index), "ref_id", "entry") == [(1, "b/c/one.txt"), (3, "r/q/c/three.txt")]
    got = rows(search.resolve_segments(refs.where("ref_id = 1"), chunks), "entry", "hits")
    assert ("b/c/one.txt", 3) in got and ("b/c/three.txt", 2) in got


def test_mappings(spark):
    m = spark.createDataFrame([(0, "i1", "FULL", [("R1", 2.0)]), (1, "i1", "NONE", [("R1", 0.5), ("R1", 0.9), ("XX", 1.0)])], "ord int, item_id string, coverage string, matched array<struct<rule_id:string,confidence:double>>")
    items = spark.createDataFrame([("i1",), ("i2",)], "item_id string")
    r = spark.createDataFrame([("R1",), ("R2",)], "rule_id string")
    got = {x["item_id"]: x for x in search.normalised_mappings(m, items, r).collect()}
    assert got["i1"]["coverage"] == "PARTIAL" and [tuple(y) for y in got["i1"]["matched"]] == [(0.5, "R1")] and got["i2"]["coverage"] == "NONE"
    u = spark.createDataFrame([("BR_LOAN_FILE_CONSTRAINT_001",), ("BR_PROCESS_1",), ("BR_USED_PROCESS_1",)], "rule_id string")
    assert rows(search.unused_rules(u, u.where("rule_id LIKE '%USED%'"), ["CONSTRAINT", "PROCESS"])) == [("LOAN_FILE", 1), ("UNKNOWN", 1)]
    c = spark.createDataFrame([("i", "R2", 0.5), ("i", "R1", 0.5)], "item_id string, rule_id string, lexical_score double")
    assert rows(search.fallback_mapping(c), "rule_id", "confidence") == [("R1", 0.35)]


def test_rebucketing_and_publish(spark, tmp_path):
    r = spark.createDataFrame([("R1", "A"), ("R2", "lost"), ("R3", "bad"), ("R4", "keep")], "rule_id string, entity_or_relationship string")
    names = spark.createDataFrame([("A",)], "name string")
    judge = lambda rows_: rows_.withColumn("suggestion", F.when(F.col("rule_id") == "R2", "A").when(F.col("rule_id") == "R3", "DROP").otherwise("nonsense"))
    assert rows(match.rebucketed(r, names, judge), "rule_id", "entity_or_relationship") == [("R1", "A"), ("R2", "A"), ("R4", "keep")]
    path = str(tmp_path / "g")
    assert register.publish(r, path, lambda d: d.count() == 4) and not register.publish(r.limit(1), path, lambda d: d.count() == 4)
    assert spark.read.parquet(path).count() == 4


def test_splitting(spark):
    text = "aaa bbb ccc\n\nddd eee"
    assert segment.recursive_split(text, 12, 0) == ["aaa bbb ccc", "ddd eee"]
    assert segment.recursive_split("aa bb cc dd", 5, 2) == ["aa bb", "bb cc", "cc dd"]
    assert segment.recursive_split("x" * 7, 3, 0) == ["xxx", "xxx", "x"]
    d = spark.createDataFrame([(1, "intro\n# A\nx\n## B\n```\n# no\n```\ny")], "doc_id int, text string")
    assert rows(segment.markdown_chunks(d), "n", "path") == [(1, []), (2, ["A"]), (3, ["A", "B"])]


def test_annotations(spark):
    a = spark.createDataFrame([(1, "yes", None, None), (2, None, None, True), (9, "yes", "yes", False)], "vertex_id int, reviewed string, approved string, deleted boolean")
    v = spark.createDataFrame([(1, "one"), (2, "two")], "vertex_id int, name string")
    assert rows(register.named_annotations(a, v), "vertex_id", "vertex_name") == [(1, "one"), (9, "vertex:9")]
    assert rows(register.orphaned_annotations(a, v), "vertex_id") == [(9,)]
    assert tuple(register.review_counts(a).first()) == (2, 1, 0, 1)
    new = spark.createDataFrame([(1, "no")], "vertex_id int, approved string")
    assert [(r["reviewed"], r["approved"]) for r in register.merge_annotations(a, new).where("vertex_id = 1").collect()] == [("yes", "no")]
    runs = spark.createDataFrame([("a", "running"), ("b", "running"), ("c", "completed")], "run_id string, status string")
    assert rows(register.reconciled_runs(runs, runs.where("run_id = 'a'"))) == [("a", "running"), ("b", "failed"), ("c", "completed")]


def test_references_and_features(spark):
    r = spark.createDataFrame([("P", [("a",)]), ("D", [("b",), ("c",)])], "rule_id string, source_reference array<struct<chunk_path:string>>")
    g = spark.createDataFrame([("P", "D")], "primary string, duplicate string")
    assert [x["chunk_path"] for x in match.collected_references(r, g).first()["references"]] == ["a", "b", "c"]
    f = spark.createDataFrame([("R", "n", "d" * 600)], "rule_id string, rule_name string, description string")
    assert len(match.key_features(f).first()["features"]) < 600
    assert rows(match.apply_duplicates(spark.createDataFrame([("P",), ("D",), ("X",)], "rule_id string"), g), "rule_id", "merge_count") == [("P", 1), ("X", 0)]
    b = spark.createDataFrame([("k", 0, 0, "R1", "a"), ("k", 0, 1, "R1", "a"), ("k", 1, 2, "R1", "b"), ("k", 1, 3, "R9", "A"), ("k", 1, 4, "R8", "c")], "bucket string, batch int, ord int, rule_id string, rule_name string")
    assert rows(match.merge_batches(b), "ord") == [(0,), (1,), (4,)]


@pytest.mark.parametrize("seed", range(3))
def test_simple_paths(spark, seed):
    """The first paths by length, then nodes, as an exhaustive walk finds them; longer ones where the short are few."""
    r = random.Random(seed)
    pairs = {(r.randrange(9), r.randrange(9)) for _ in range(14)} | {(0, 1), (1, 8)}
    e = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "src int, dst int, dependency_type string, strength int")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def walk(path, most):
        if path[-1] == 8:
            yield path
        elif len(path) <= most:
            for n in near.get(path[-1], ()):
                if n not in path:
                    yield from walk([*path, n], most)

    for most in (2, 4):
        want = sorted(walk([0], most), key=lambda p: (len(p), p))[:5]
        assert [x["path"] for x in graph.simple_paths(e, 0, 8, most).collect()] == want


def test_section_paths_of_levels(spark):
    """Against a stack of open headings."""
    r = random.Random(1)
    levels = [r.randint(1, 4) for _ in range(40)]
    want, open_ = [], []
    for i, k in enumerate(levels):
        open_ = [x for x in open_ if x[0] < k] + [(k, f"h{i}")]
        want.append([t for _, t in open_])
    df = spark.createDataFrame([(1, i, k, f"h{i}") for i, k in enumerate(levels)], "doc_id int, n int, level int, title string")
    assert [x["path"] for x in segment.section_paths(df).orderBy("n").collect()] == want
    assert segment.section_paths(df.limit(0)).count() == 0


def test_text_neighbours_and_filter(spark):
    df = spark.createDataFrame([(1, "g1", "loan limits for small property"), (2, "g2", "limits of loans and property"), (3, "g1", "maritime cargo"), (4, "g1", None)], "vec_id int, graph string, text string")
    assert [x["vec_id"] for x in search.text_knn(df, "text", "property limits", 2).collect()] == [2, 1]
    assert [x["vec_id"] for x in search.text_knn(df, "text", "property limits", 2, graph="g1").collect()][0] == 1
    assert search.embed(df.limit(0), "text").count() == 0


def test_reference_resolution(spark):
    c = spark.createDataFrame([(0, "guide/part-b/limits.txt", "c1", "B2-1.5-04, Loan Limits", "a" * 4000), (1, "guide/part-c/gifts.txt", "c2", "Personal Gifts", "gifts"), (2, "other/gifts.txt", "c3", "Other Gifts", "x")], "ord int, path string, chunk_id string, title string, content string")
    i = c.drop("content")
    assert [tuple(x) for x in search.resolve_reference(i, "part-b/limits.txt").collect()] == [("path", "c1", 1)]
    assert [x["chunk_id"] for x in search.resolve_reference(i, "guide/part-c/nothing").collect()][0] == "c2"
    assert [(x["how"], x["chunk_id"]) for x in search.resolve_reference(i, "see B2-1.5-04").collect()] == [("title", "c1")]
    r = spark.createDataFrame([(1, "limits.txt"), (2, None)], "rule_id int, source_reference string")
    assert [(x["how"], len(x["content"])) for x in search.rule_sources(r, c, 1).collect()] == [("path", 3000)]
    assert search.rule_sources(r, c, 2).count() == search.rule_sources(r, c, 9).count() == 0


def test_judged_impact(spark):
    old = spark.createDataFrame([(1, "First provision that is long enough.\n\nSecond provision that is long.")], "doc_id int, text string")
    new = spark.createDataFrame([(1, "First provision that is long enough.\n\nThird thing, entirely unlike what stood here.")], "doc_id int, text string")
    rules = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "rule_id int, rule_name string")
    seen = []

    def mapper(changes, shown):
        seen.append(shown.count())
        return changes.select("change_id").crossJoin(shown.where("rule_id < 2").select("rule_id")).withColumn("relevance", F.when(F.col("rule_id") == 1, "High").otherwise("low"))

    merged, n = impact.judged_analysis(old, new, rules, mapper, lambda c: c.where("change_type = 'added'").select("change_id", F.lit("breaking").alias("severity"), F.lit("why").alias("rationale")), rules_=3)
    got = merged.collect()
    assert seen == [3] and got and all([tuple(a) for a in x["affected"]] == [(0.9, 1), (0.3, 0)] for x in got)
    assert {x["severity"] for x in got if x["change_type"] != "added"} <= {"cosmetic"} and sum(x["n"] for x in n.collect()) == len(got)
    assert rows(impact.merged_changes(merged.select("change_id", "change_type", "text"), mapper(merged, rules).limit(0), merged.limit(0).select("change_id", "severity", "rationale")), "severity")[0] == ("cosmetic",)


def test_controls_and_runs(spark):
    c = spark.createDataFrame([(1, "Audit", "detective")], "rule_id int, control_name string, control_type string")
    more = register.add_controls(c, spark.createDataFrame([(1, "Audit", "x"), (2, "Audit", "y"), (2, "Audit", "y")], c.schema))
    assert rows(more, "rule_id", "control_name") == [(1, "Audit"), (2, "Audit")]
    assert rows(register.remove_controls(more, c), "rule_id") == [(2,)]
    o = spark.createDataFrame([("g", 1), ("g", 2), ("h", 2)], "graph_name string, rule_id int")
    kept, left = register.reset(o, more, "g")
    assert rows(kept, "graph_name", "rule_id") == [("h", 2)] and rows(left, "rule_id") == [(2,)]
    runs = spark.createDataFrame([(1, "running", "a"), (2, "done", "b")], "run_id int, status string, kind string")
    now = register.put_runs(runs, spark.createDataFrame([(1, "done"), (3, "running")], "run_id int, status string"))
    assert rows(now, "run_id", "status", "kind") == [(1, "done", "a"), (2, "done", "b"), (3, "running", None)]
    assert rows(register.drop_runs(now, runs.where("run_id = 2")), "run_id") == [(1,), (3,)]
    assert rows(register.filtered_items(runs, status="done", kind=None), "run_id") == [(2,)]


def test_match_summary_and_capped_batches(spark):
    n = spark.createDataFrame([("b", 5, 4), ("c", 1, 0)], "behavior string, g1 int, g2 int")
    m = spark.createDataFrame([("b", 1, 2), ("b", 3, 4)], "behavior string, g1 int, g2 int")
    assert rows(match.match_summary(n, m, m.limit(1)), "behavior", "matches", "contradictions", "g1_unmatched", "g2_unmatched") == [("b", 2, 1, 3, 2), ("c", 0, 0, 1, 0)]
    assert match.capped_batches(spark.range(50).withColumnRenamed("id", "batch"), 20, 5).count() == 14


def test_cut_needs_a_shared_folder():
    from types import SimpleNamespace as N

    class Conf:
        def get(self, key, default=None):
            return default

    for master in ("yarn", "local-cluster[2,1,1024]"):
        scala = N(getCheckpointDir=lambda: N(isDefined=lambda: False))
        with pytest.raises(RuntimeError):
            graph._cut(N(sparkSession=N(conf=Conf(), sparkContext=N(master=master, _jsc=N(sc=lambda: scala)))))


def test_duplicates_hand_over(spark):
    r = spark.createDataFrame([(1, "one", ["a"]), (2, "two", ["b", "a"]), (3, "three", None), (4, "four", None)], "rule_id int, description string, examples array<string>")
    g = spark.createDataFrame([(1, 2, None), (1, 3, "both")], "primary int, duplicate int, description string")
    assert rows(match.apply_duplicates(r, g)) == [(1, "both", ["a", "b"], [2, 3], 2), (4, "four", None, None, 0)]
    assert rows(match.apply_duplicates(r, g.drop("description")), "rule_id", "description") == [(1, "one"), (4, "four")]


def test_whole_graph_load(spark):
    r = spark.createDataFrame([("R1", "one", "Bank", [("R2", "prerequisite", "4"), ("R9", "x", "1")]), ("R2", None, "Nowhere", [])], "rule_id string, rule_name string, entity_or_relationship string, dependencies array<struct<depends_on_rule:string,dependency_type:string,strength:string>>")
    r = r.withColumns({"rule_type": F.lit("process"), "description": F.lit("d"), "confidence_score": F.lit("80"), "mandatory": F.lit(True), "requires_review": F.lit(None).cast("boolean")})
    e = spark.createDataFrame([("Bank", "entity"), ("Fee", "entity")], "name string, definition string")
    rel = spark.createDataFrame([("Bank", "clash", "Bank", "Fee"), ("Pays", "rel", "Bank", "Fee"), ("Lost", "rel", "Bank", "Gone")], "name string, definition string, source_entity string, target_entity string")
    v, g = load.load_graph(r, e, rel)
    assert rows(v, "vertex_id", "content") == [("Bank", "entity"), ("Fee", "entity"), ("Lost", "rel"), ("Pays", "rel"), ("R1", "d"), ("R2", "d"), ("_uncategorized_", "")]
    assert rows(g, "src", "dst", "label") == [("Bank", "Fee", "relates_to"), ("Bank", "Fee", "relates_to"), ("R1", "Bank", "belongs_to_category"), ("R1", "R2", "depends_on"), ("R2", "_uncategorized_", "belongs_to_category")]
    a = spark.createDataFrame([("R1", "x"), ("R2", "y")], "vertex_id string, note string")
    assert rows(load.drop_annotations(a, spark.createDataFrame([("R1",)], "node string"))) == [("R2", "y")]


def test_suggestions_from_vectors(spark):
    r = spark.createDataFrame([(i, "constraint" if i % 2 else "process", "c", "e") for i in range(20)], "rule_id long, rule_type string, category string, entity_type string")
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(20)], "vec_id long, embedding array<double>")
    g = RuleGraph(spark, r, spark.createDataFrame([], "src long, dst long, dependency_type string, strength int"), embeddings=v)
    got = g.suggest([1.0, 0.0], "constraint", "e", "c", 2).collect()
    assert [x["rule_id"] for x in got] == [1, 3] and got[0]["score"] >= got[1]["score"]


def test_conflicts_by_class(spark):
    """A group of copies is one row of its class; told rule by rule it is all its pairs."""
    text = "the fee limit is 25% of the payment"
    g1 = spark.createDataFrame([(i, "b", text, 1) for i in range(6)], "rule_id int, behavior string, text string, quality int")
    g2 = spark.createDataFrame([(10 + i, "b", text.replace("25", "40"), 1) for i in range(5)], g1.schema)
    none = spark.createDataFrame([(5, 14, "b")], "g1 int, g2 int, behavior string")
    c = match.conflict_classes(g1, g2, none).collect()
    assert [(x["n1"], x["n2"], x["pairs"]) for x in c] == [(5, 4, 20)]
    assert rows(match.member_conflicts(g1, g2, none), "g1", "g2") == [(a, b) for a in range(5) for b in range(10, 14)]
    sizes = {x["operation"]: x["n"] for x in match.set_sizes(g1, g2, none, match.conflict_classes(g1, g2, none)).collect()}
    assert sizes == {"INTERSECTION": 1, "G1_MINUS_G2": 5, "G2_MINUS_G1": 4, "UNION": 10, "CONTRADICTIONS": 20}
