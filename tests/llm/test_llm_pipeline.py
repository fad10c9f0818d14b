"""The pipeline's stages, each on its own input, and all of them together."""

import collections

import corpus_pipeline
from tessera.llm.queries import QUERIES
from tessera.llm import jaccard, mixing, secret_scan
from tests.llm.test_llm_documents import brute_components, brute_secrets


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "packing"]


def test_stages(spark, docs, rows, tmp_path):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        out = stage(spark, now, "")
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids = collections.Counter(r["doc_id"] for r in now.select("doc_id").collect())
        own = {r["doc_id"]: r for r in before.collect()} if name != "packing" else {}
        if name != "packing":
            assert now.columns == docs.columns
        if name == "language_id":
            assert set(ids) <= {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
            assert {r[0] for r in rows if len(r[1] or "") > 200} <= set(ids)
        elif name == "near_duplicates":
            part = [(i, r["text"]) for i, r in sorted(own.items())]
            want = {i for i, (n, c) in brute_components(part).items() if not n or c == i}
            assert set(ids) == want and max(ids.values()) == 1
        elif name == "secrets":
            assert set(ids) == set(own)
            for r in now.collect():
                assert (r["text"] == own[r["doc_id"]]["text"]) == (not brute_secrets(own[r["doc_id"]]["text"]))
        elif name == "mixing":
            plan = {r["doc_id"]: r["_copies"] for r in mixing.mix_plan(before).collect()}
            assert ids == collections.Counter({k: v for k, v in plan.items() if v})
        else:
            assert set(ids) == {r["doc_id"] for r in before.collect()}
    assert jaccard and secret_scan


def test_run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_odd_input(spark, odd, empty):
    """Every stage by itself: an empty table, null ids, repeated rows, further columns of clashing names."""
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        out = stage(spark, odd, "")
        assert out.count() > 0 and (name == "packing" or out.columns == odd.columns), name
