import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,name", [("Section 3: Fees!", "section_3_fees"), ("--", "untitled"), ("", "untitled"), ("A" * 120, "a" * 100), ("é x", "x")])
def test_sanitize(spark, text, name):
    assert value(spark, T.sanitize_folder_name(F.lit(text))) == name


@pytest.mark.parametrize("query,word", [
    ("g.V().hasLabel('business_rule').count()", None), ("g.V().has('name', 'drop').values('name')", None), ("g.V().has(\"property\", 1)", None), ("g.V().drop()", "drop"), ("g.V().Drop ()", "drop"),
    ("g.addV('x')", "addv"), ("g.V().property('a', 1)", "property"), ("java.lang.Runtime", "runtime"), ("new File('x')", "file"), ("System.exit(0)", "system"), ("exec('ls')", "exec("), ("", None), ("g.V().properties()", None),
])
def test_safety(spark, query, word):
    assert value(spark, T.safety_violation(F.lit(query))) == word


def test_thresholds(spark):
    got = value(spark, T.thresholds(F.lit("At least 25% or $1,500.50 within 30 days; FICO score 620. CTR over $10,000. Beneficial ownership of 25%. OFAC and FATF.")))
    assert got == ["25%", "25%", "$1,500.50", "$10,000.", "30 days", "score:620", "ctr_sar:$10,000", "bo_pct:25%", "fatf_ref", "sanctions_ref"]


def test_words_and_counts(spark):
    assert value(spark, T.word_count(F.lit(" a  b\tc\n"))) == 3
    assert value(spark, T.word_count(F.lit(None).cast("string"))) in (0, -1)
    assert value(spark, T.frequency(F.lit("aaaa"), F.lit("aa"))) == 2
    assert value(spark, T.key_phrases(F.lit("The éabc def was über all"))) == ["def"]
    assert value(spark, T.section_codes(F.lit("see B2-1.5-04, B2-1.5-04 and A3-2"))) == ["B2-1.5-04", "A3-2"]
    assert value(spark, T.sentence_segments(F.lit("First sentence here. Second one follows... tail of it"))) == ["First sentence here.", "Second one follows", "tail of it"]
    assert value(spark, T.fenced_json(F.lit("x ```json\n[1]\n``` y"))) == "[1]"
    assert value(spark, T.entity_key(F.lit(" suspicious-Activity report"))) == "SUSPICIOUS_ACTIVITY_REPORT"
    assert value(spark, T.graph_key(F.lit("My Graph (v2)"))) == "my_graph_v2"


def test_ratio_is_the_sequence_matchers(spark):
    import difflib

    a, b = "the borrower must pay", "a borrower must not pay"
    assert value(spark, T.similarity_ratio(F.lit(a), F.lit(b))) == difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("text,affected,kind", [("must file", 0, "breaking"), ("unlimited use", 0, "cosmetic"), ("the limit", 0, "material"), ("colour", 5, "material"), ("colour", 4, "cosmetic")])
def test_severity(spark, text, affected, kind):
    assert value(spark, N.severity(F.lit(text), F.lit(affected))) == kind


def test_scores(spark):
    m = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv])
    assert value(spark, N.weighted_confidence(m(extraction_clarity=90.0, numeric_precision=80.0))) == 47.0
    assert value(spark, N.dependency_confidence(m(semantic_similarity=80.0, logical_connection=90.0))) == 85.45
    assert value(spark, N.dependency_confidence(m(other=30.0, more=50.0))) == 40.0
    assert value(spark, N.dependency_confidence(F.lit(None).cast("map<string,double>"))) == 50.0
    assert [value(spark, N.strength_confidence(F.lit(s))) for s in (5, 1, 9)] == [95, 55, 70]
    assert value(spark, N.safe_int(F.lit("3.9"))) == 3 and value(spark, N.safe_int(F.lit("x"))) == 0
    assert value(spark, N.token_cost(F.lit("gpt-4o-mini-2024"), F.lit(1_000_000), F.lit(0))) == 0.15
    assert value(spark, N.token_cost(F.lit("none"), F.lit(5), F.lit(5))) == 0.0
    assert value(spark, N.type_affinity(F.lit("validation"), F.lit("constraint"))) == 0.9
    assert value(spark, N.behavior(F.lit("bad"), F.lit("covenant"))) == "threshold"
