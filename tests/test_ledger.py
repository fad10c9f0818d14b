"""Verdicts that are kept: nothing is judged twice, and what was judged outlives a failure."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.plans.judges import Ledger, batched

SCHEMA = "verdict string, cost double"


def calls(folder):
    return sorted(line for f in os.listdir(folder) for line in (folder / f).read_text().splitlines())


def client(folder, fail=None, wait=0.0):
    """Writes down what it is asked."""

    def call(rows):
        with open(folder / f"{os.getpid()}-{time.monotonic_ns()}", "w") as f:
            f.write("\n".join(str(r["text"]) for r in rows))
        if fail and any(r["text"] == fail for r in rows):
            raise ValueError(fail)
        time.sleep(wait)
        return [{"pair_id": r["pair_id"], "verdict": str(r["text"]).upper(), "cost": 0.5} for r in rows]

    return batched(call, ["text"], SCHEMA, size=1, retries=1)


def test_nothing_is_judged_twice(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"), ["text"], SCHEMA, "v1")
    assert ledger.spent() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string").withColumn("key", F.lit("own"))
    got = sorted((r["id"], r["key"], r["verdict"]) for r in ledger.judge(rows, client(asked)).collect())
    assert got == [(1, "own", "A"), (2, "own", "B"), (3, "own", "A"), (4, "own", "NONE")]
    assert calls(asked) == ["None", "a", "b"] and ledger.spent() == 1.5
    more = rows.select("id", "text").union(spark.createDataFrame([(5, "c")], "id int, text string"))
    assert sorted(r["verdict"] for r in ledger.judge(more, client(asked)).collect()) == ["A", "A", "B", "C", "NONE"]
    assert calls(asked) == ["None", "a", "b", "c"]
    other = Ledger(spark, str(tmp_path / "ledger"), ["text"], SCHEMA, "v2")  # another judge knows nothing yet
    assert other.judge(rows.limit(0), client(asked)).count() == 0 and other.judge(rows.where("id = 1"), client(asked)).first()["verdict"] == "A"
    assert calls(asked).count("a") == 2 and ledger.spent() == 2.0 and other.spent() == 0.5


def test_a_failure_keeps_what_was_judged(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"), ["text"], SCHEMA, "v1")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(24)], "id int, text string")
    with pytest.raises(Exception, match="t9"):
        ledger.judge(rows, client(asked, fail="t9"), parts=24)
    done = {r["verdict"].lower() for r in ledger.verdicts().collect()}
    before = calls(asked)
    assert "t9" not in done and 0 < len(done) < 24
    assert ledger.judge(rows, client(asked), parts=4).where("verdict IS NOT NULL").count() == 24
    again = calls(asked)
    assert all(again.count(x) == 1 for x in done) and len(again) - len(before) == 24 - len(done)


def test_deadline_and_budget(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "id int, text string")
    ledger = Ledger(spark, str(tmp_path / "ledger"), ["text"], SCHEMA, "v1")
    with pytest.raises(TimeoutError):
        ledger.judge(rows, client(asked), parts=12, deadline=0.0)
    with pytest.raises(RuntimeError):
        ledger.judge(rows, client(asked), parts=12, budget=1.0)
    assert 1.0 < ledger.spent() < 6.0
    slow = batched(lambda x: time.sleep(30), ["text"], SCHEMA, retries=2, wait=0.0, limit=0.2)
    with pytest.raises(Exception, match="no verdicts after"):
        slow(rows.limit(1)).collect()
