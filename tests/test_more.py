"""Small operators, each on a few rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T
from tessera.operators import graph, impact, load, match, register, search, segment, stats, validate
from tessera.plans.engine import RuleGraph
from tessera.plans.judges import parsed_reply
from tessera.sources import readers, writers
from tessera.streaming import logs


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_text_functions(spark):
    lit = F.lit
    got = spark.range(1).select(
        T.title_key(lit(" Loan (Limits)/A_b,c-d ")).alias("title"), T.query_terms(lit("Of the Überweisung, 12a!")).alias("terms"), T.word_range(lit("a b c d"), lit(1), lit(3)).alias("range"),
        T.legacy_reference(lit("a/b.txt | S-1")).alias("legacy"), T.legacy_reference(lit("a/b.txt")).alias("bare"), T.truncated(lit("abcdef"), 3).alias("cut"), T.truncated(lit("abc"), 3).alias("whole"),
        T.filename_key(lit("dir/My File-2.TXT")).alias("file"), T.display_name(lit("loan-limits_guide")).alias("name"), T.has_keyword(lit("You MUST pay"), T.BREAKING).alias("has"), T.has_keyword(lit("mustard"), T.BREAKING).alias("not"),
        T.tokens(lit("The fee-limit is 250 of it")).alias("tokens"),
    ).first()
    assert got["title"] == "loan limits a b c d" and got["terms"] == ["the", "überweisung", "12a"] and got["range"] == "b c"
    assert tuple(got["legacy"]) == ("a/b.txt", "S-1") and tuple(got["bare"]) == ("a/b.txt", "") and got["cut"] == "abc..." and got["whole"] == "abc"
    assert got["file"] == "my_file_2" and got["name"] == "Loan Limits Guide" and got["has"] and not got["not"] and got["tokens"] == ["fee", "limit", "250"]


def test_number_functions(spark):
    lit = F.lit
    got = spark.range(1).select(N.safe_float(lit("x")).alias("f"), N.safe_float(lit("1.5")).alias("g"), N.clamp01(lit("7")).alias("c"), N.clamp01(lit(None).cast("string")).alias("d"), N.suggestion_strength(lit(0.05)).alias("low"), N.suggestion_strength(lit(0.5)).alias("mid"), N.lookup({"a": 1}, lit("b")).alias("no"), impact.relevance_score(lit("HIGH")).alias("r")).first()
    assert tuple(got) == (0.0, 1.5, 1.0, 0.5, 1, 2, None, 0.9)


def test_change_stats_and_export(spark):
    a = spark.createDataFrame([(f"c{i}", k, s, "t" * 600, 2, ["x", "y"], "do") for i, (k, s) in enumerate([("added", "breaking"), ("removed", "cosmetic"), ("modified", "cosmetic")])], "change_id string, change_type string, severity string, text string, affected int, rule_names array<string>, recommendation string")
    hit, rules = spark.createDataFrame([(1,), (1,), (2,)], "rule_id int"), spark.range(8).withColumnRenamed("id", "rule_id")
    got = impact.change_stats(a, hit, rules).first().asDict()
    assert got == {"total": 3, "added": 1, "removed": 1, "modified": 1, "breaking": 1, "material": 0, "cosmetic": 2, "rules_affected": 2, "rules": 8, "impact_percent": 25.0}
    e = impact.export(a).first()
    assert len(e["text"]) == 500 and e["rules"] == "x; y" and e["affected"] == "2"


def test_graph_edits(spark):
    nested = load.nested_rules(spark.createDataFrame([("Bank", [("R1", "one"), ("R2", "two")])], "name string, business_rules array<struct<rule_id:string,rule_name:string>>"))
    assert rows(nested, "entity_or_relationship", "rule_id") == [("Bank", "R1"), ("Bank", "R2")]
    root = spark.createDataFrame([("R1", "root")], "rule_id string, rule_name string")
    assert rows(load.all_rules(root, nested), "rule_id", "rule_name") == [("R1", "root"), ("R2", "two")]
    c = load.category_vertices(spark.createDataFrame([("A", "e")], "name string, definition string"), spark.createDataFrame([("A", "r"), ("B", None)], "name string, definition string"))
    assert rows(c, "name", "content", "kind") == [("A", "e", "entity"), ("B", "", "relationship")]
    v = spark.createDataFrame([(1, None, None, "process", None, "business_rule"), (2, "two", "cat", None, "n", "x")], "rule_id int, name string, category string, rule_type string, node_type string, label string")
    assert rows(load.full_vertices(v), "name", "category", "node_type") == [("1", "process", "business_rule"), ("two", "cat", "n")]
    small = v.select("rule_id", "name").where("name = 'two'")
    assert rows(load.add_vertices(small, spark.createDataFrame([(3, "TWO"), (4, "new"), (5, "new")], small.schema)), "name") == [("new",), ("two",)]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    left, edges = load.drop_vertices(v, e, spark.createDataFrame([(1,)], "node int"))
    assert rows(left, "rule_id") == [(2,)] and rows(edges) == [(2, 3)]
    assert rows(graph.undirected(spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "src int, dst int"))) == [(1, 2), (2, 1)]
    assert rows(match.nested_by_bucket(spark.createDataFrame([("R2", "", "E"), ("R1", None, "E"), ("R3", "Rel", "E")], "rule_id string, relationship string, entity string"))) == [("E", ["R1", "R2"]), ("Rel", ["R3"])]


def test_similar_sets(spark):
    one = spark.createDataFrame([("g", 1, [1, 2, 3, 4]), ("g", 2, [7, 8]), ("h", 3, [1, 2, 3, 4])], "g string, id int, w array<long>")
    two = spark.createDataFrame([("g", 10, [2, 3, 4]), ("g", 11, [1, 2, 9]), ("g", 12, [])], "g string, id int, w array<long>")
    assert rows(match.similar_sets(one, two), "a", "b", "both") == [(1, 10, 3)]


def test_register_edits(spark):
    r = spark.createDataFrame([("g", "p", 1, "unmapped"), ("g", "p", 2, "mapped")], "graph_name string, provider string, rule_id int, status string")
    assert rows(register.with_status(r, r.where("rule_id = 1").withColumn("status", F.lit("exempted"))), "rule_id", "status") == [(1, "exempted"), (2, "mapped")]
    c = register.with_controls(r, spark.createDataFrame([(1, "B", "y"), (1, "A", "x")], "rule_id int, control_name string, control_type string"))
    assert rows(register.export(c), "rule_id", "control_name", "control_type") == [(1, "A", "x"), (1, "B", "y"), (2, "", "")]


def test_consistency(spark):
    g = spark.createDataFrame([("a", 2), ("b", 0)], "graph string, rules int")
    e, v = spark.createDataFrame([("a",), ("a",)], "graph string"), spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "graph string, vertex_id int")
    n = spark.createDataFrame([(1,), (9,)], "vertex_id int")
    r = spark.createDataFrame([("a", True), ("a", False)], "graph string, reference_verified boolean")
    got = {(x["check"], x["subject"]): (x["ok"], x["detail"]) for x in register.consistency(g, e, n, v, r).collect()}
    assert got == {("graph", "a"): (True, "2"), ("graph", "b"): (False, "0"), ("embeddings", "a"): (True, "2/2"), ("embeddings", "b"): (False, "0/1"), ("annotations", "all"): (False, "1"), ("references", "a"): (False, "0.50")}


def test_pages_and_words(spark):
    toc = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 3, 9)], "doc_id int, ord int, first int, last int")
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (1, 3, " ")], "doc_id int, page int, text string")
    assert rows(segment.pages_of(toc, pages)) == [(1, 0, "one\ntwo")]
    h = segment.heading_lines(spark.createDataFrame([(1, "x\n## A b \n#no")], "doc_id int, text string"))
    assert rows(h.where("level IS NOT NULL"), "ord", "level", "title") == [(1, 2, "A b")]
    assert rows(segment.words_of(spark.createDataFrame([(" a  b ",), (None,)], "content string")), "word_count") == [(0,), (2,)]


def test_finding_summary(spark):
    r = spark.createDataFrame([("R1", 50.0), ("R2", None), ("R3", 10.0)], "rule_id string, confidence_score double")
    got = validate.summary(r, validate.findings(r)).where("check = 'confidence'")
    assert rows(got, "severity", "n", "rules", "mean_confidence") == [("high", 2, 2, 20.0), ("medium", 1, 1, 20.0)]
    assert rows(r.select("rule_id", validate.falsy(r, "confidence_score").alias("f"))) == [("R1", False), ("R2", True), ("R3", False)]
    assert value(spark, validate.locate(F.lit("one two three four"), F.lit("two three")))["start"] == 1


def test_tools(spark):
    r = spark.createDataFrame([(1, "a", "process", "c", "e", "text one", 80.0, True, False, "g"), (2, "b", "process", "c", "e", "text two", 60.0, True, True, "g")], "rule_id int, rule_name string, rule_type string, category string, entity_type string, description string, confidence_score double, mandatory boolean, requires_review boolean, graph string").withColumn("content", F.col("description"))
    e = spark.createDataFrame([(1, 2, "override", 3)], "src int, dst int, dependency_type string, strength int")
    chunks = spark.createDataFrame([("c1", "Gifts", "gift " * 2000)], "chunk_id string, title string, content string")
    notes = spark.createDataFrame([("yes", None, False), (None, None, False), ("yes", "yes", True)], "reviewed string, approved string, deleted boolean")
    g = RuleGraph(spark, r, e, chunks, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>"), notes)
    assert [x["rule_id"] for x in g.semantic_search([1.0, 0.1], 2).collect()] == [1, 2]
    nodes, ties = g.graph_data()
    assert nodes.count() == 3 and ties.count() == 2 and ("out", "2") in rows(g.find_related_rules(1), "relation", "other")
    assert rows(g.find_dependency_path(2, 1), "step", "direction") == [(0, "incoming")]
    assert len(g.get_source_reference("gifts").first()["content"]) == 3000 and g.search_knowledge_base("gift").count() == 1
    assert tuple(g.get_review_status().first()) == (1, 0, 1, 1) and rows(g.cross_graph_search("text"), "rule_id") == [(1,), (2,)]
    assert g.text_search("one").count() == 1


def test_replies(spark):
    df = spark.createDataFrame([(1, 'so: ```json\n[{"pair_id": 1}]\n```'), (2, "none")], "id int, reply string")
    got = {r["id"]: r["verdicts"] for r in parsed_reply(df, "pair_id int").collect()}
    assert [tuple(x) for x in got[1]] == [(1,)] and got[2] is None


def test_writers_and_readers(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    writers.write_chunks(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, content string"), at("chunks"))
    assert spark.read.parquet(at("chunks")).where("doc_id = 2").first()["content"] == "y"
    writers.write_graph(spark.createDataFrame([("R1",)], "rule_id string"), at("graph"))
    assert readers.knowledge_graphs(spark, [at("none"), at("graph")], "rule_id string").first()["rule_id"] == "R1"
    with pytest.raises(FileNotFoundError):
        readers.knowledge_graphs(spark, [at("none")], "rule_id string")
    ops = spark.createDataFrame([("UNION", 1), ("INTERSECTION", 2)], "operation string, n int")
    writers.write_set_operations(ops, at("ops"))
    writers.write_set_operations(ops.where("n = 1").withColumn("n", F.lit(5)), at("ops"))
    assert rows(spark.read.parquet(at("ops")), "operation", "n") == [("INTERSECTION", 2), ("UNION", 5)]
    writers.write_findings(ops, at("found"))
    writers.write_csv(ops, at("csv"))
    writers.write_embeddings(spark.createDataFrame([("g", 3, [1.0])], "graph string, vec_id int, embedding array<double>"), at("vec"))
    assert spark.read.json(at("found")).count() == 2 and readers.delimited(spark, at("csv")).columns == ["operation", "n"] and spark.read.parquet(at("vec")).first()["id"] == "g_3"
    assert readers.chunk_text_index(spark.createDataFrame([("# T\nbody text",)], "content string"), 4).first()["content_snippet"] == "body"
    assert rows(readers.graph_counts(spark.createDataFrame([("a",), ("a",)], "graph string"), spark.createDataFrame([("b",)], "graph string"))) == [("a", 2, 0), ("b", 0, 1)]


def test_slides():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for i in (10, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p {ns}><a:p><a:t>Title {i}</a:t></a:p><a:p><a:t>one</a:t></a:p><a:p/></p>")
    assert readers.pptx_slides(held.getvalue()) == [(1, "Title 2", ["one"]), (2, "Title 10", ["one"])]


def test_fan_out_drops_what_fails(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "run_id int, line string").write.parquet(str(tmp_path / "in"))
    got = []

    def broken(batch, n):
        raise OSError("gone")

    stream = spark.readStream.schema("run_id int, line string").parquet(str(tmp_path / "in"))
    q = logs.fan_out(stream, [broken, lambda batch, n: got.append(batch.count())]).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(got) == 3
    assert value(spark, logs.mentions(F.lit("Step 2 running"), "2")) and not value(spark, logs.mentions(F.lit("Step 20 running"), "2"))
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b")], "k int, o int, v string")
    assert rows(logs.forward_fill(df, "k", "o", "v"), "o", "v") == [(1, "a"), (2, "a"), (3, "b")]


def test_broadcast_hubs_only_while_small(spark):
    r, e = spark.createDataFrame([(1, "a"), (2, "b")], "rule_id int, rule_name string"), spark.createDataFrame([(1, 2), (1, 2)], "src int, dst int")
    assert rows(stats.hubs(r, e, 200_000), "rule_id", "degree") == [(1, 2), (2, 2)]
    assert value(spark, search.cosine(F.array(F.lit(1.0), F.lit(0.0)), [2.0, 0.0])) == 1.0
