"""The text index against searches that scan."""

import random

from pyspark.sql import functions as F

from tessera.operators import search, text_index


def test_equals_scans(spark, tmp_path):
    r = random.Random(2)
    vocab = ["loan", "loans", "Loaned", "general", "public", "généralement", "a", "of", "x1_y", "loan-to-value", "LOANLOAN", "publicly.", "général public", "general public"]
    rows = [(f"c{i:03}", r.choice([None, "", "General Public", "loan", r.choice(vocab)]), " ".join(r.choice(vocab) for _ in range(r.randint(0, 25))) if i % 9 else None) for i in range(200)]
    rows += [("dup1", "loan", "loan"), ("dup2", "loan", "loan"), ("long", "", "loan " * 5000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, title string, content string")
    text_index.build(chunks, str(tmp_path / "i"))
    index = text_index.TextIndex(spark, str(tmp_path / "i"), chunks)
    asked = ["General Public", "loan", "loan loan value", " LOANS of ", "a", "of a", "", "x1_y!", "nothing here", "généralement public", "publicly.", "loan-to", "oanl"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for x in index.search(queries.union(spark.createDataFrame([(99, None)], queries.schema)), 15).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["chunk_id"], x["score"]))
    for i, q in enumerate(asked):
        want = [(x["chunk_id"], x["score"]) for x in search.knowledge_search(chunks.withColumn("title", F.coalesce("title", F.lit(""))), q, 15).collect()]
        assert [x[1:] for x in sorted(got.get(i, []))] == want, q
    assert 99 not in got


def test_no_texts(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id string, title string, content string")
    text_index.build(none, str(tmp_path / "none"))
    q = spark.createDataFrame([(1, "loan"), (2, "")], "query_id int, query string")
    assert text_index.TextIndex(spark, str(tmp_path / "none"), none).search(q).count() == 0
