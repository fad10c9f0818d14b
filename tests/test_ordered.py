"""Folds in order of event time: late, split and repeated lines."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.streaming import logs, ordered

SCHEMA = "key string, ts timestamp, id long, text string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ordered.PROVIDER)
    yield spark
    spark.conf.unset(key)


def feed(spark, tmp_path, fold, batches, name):
    """Each batch is a file and a micro-batch; rows (key, minute, id, text). What comes out, by batch."""
    folder, out = tmp_path / "in", []
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).json(str(folder))
    q = ordered.ordered_fold(stream, fold, "10 minutes", 3600).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).start()
    got = []
    try:
        for i, rows in enumerate(batches):
            part = folder / f".{i}.json"
            part.write_text("\n".join(json.dumps({"key": k, "ts": (dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)).isoformat() + "Z", "id": n, "text": t}) for k, m, n, t in rows))
            part.rename(folder / f"{i}.json")
            q.processAllAvailable()
            got.append([r for b in out for r in b])
            out.clear()
    finally:
        q.stop()
    return got


def test_steps_in_order_of_time(rocks, tmp_path):
    fold = ordered.Steps(["1", "2"])
    batches = [
        [("r", 1, 0, "Step 1 running"), ("r", 5, 3, "Step 2 completed")],  # the end of step 2 comes before that of step 1
        [("r", 3, 1, "Step 1 completed"), ("r", 3, 1, "Step 1 completed"), ("r", 4, 2, None)],
        [("other", 40, 0, "LAUNCHING AGENT")],
        [("other", 200, 1, "nothing"), ("r", 2, 9, "❌ Step 1 FAILED long ago")],  # too late: dropped
    ]
    got = feed(rocks, tmp_path, fold, batches, "steps")
    assert got[0] == [] and got[1] == []
    told = [r for b in got for r in b if r[0] == "r"]
    assert told[0:2] == [("r", "1", "running", None), ("r", "2", "pending", None)]
    assert ("r", "1", "completed", None) in told and told[-2:] == [("r", "1", "completed", None), ("r", "2", "completed", None)]
    assert not any(r[2] == "failed" for r in told)
    assert ("other", "1", "running", None) in [r for b in got for r in b]


def test_events_split_over_chunks(rocks, tmp_path):
    batches = [
        [("s", 1, 0, 'data: {"content":"He'), ("s", 1, 1, 'llo","label":"s1"}\ndata: x\n'), ("t", 1, 0, 'data: {"message":"oops"}')],
        [("s", 3, 2, 'data: {"status":"done","content":"!"}'), ("s", 1, 1, 'llo","label":"s1"}\ndata: x\n')],
        [("u", 30, 0, "data: {}")],
        [("u", 300, 0, "data: {}")],
        [("u", 400, 0, "data: {}")],
    ]
    told = [r for b in feed(rocks, tmp_path, ordered.Events(), batches, "events") for r in b]
    s = [r[1:] for r in told if r[0] == "s"]
    assert s[0] == ("Hello", "s1", False) or s[0] == ("", None, False)
    assert ("Hello", "s1", False) in s and s[-1] == ("Hello!", None, True)
    assert [r[1:] for r in told if r[0] == "t"][-1] == ("oops", None, True)


def test_other_state_store_is_refused(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("k").alias("key"), F.col("timestamp").alias("ts"), F.col("value").alias("id"), F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        ordered.ordered_fold(stream, ordered.Events())


def test_steps_fold():
    fold, state = ordered.Steps(["6", "7", "8"], {"7": "1/2", "8": "2/2"}, {"7": "Matching"}), None
    state = fold.start()
    seen = []
    for line in ("Step 6 running", "Step 6 completed", "STEP 1/2 starts", "❌ matching FAILED", "STEP 2/2 starts", "x", "JOINS COMPLETE!", "Step 8 again"):
        state = fold.step(state, line)
        seen.append(list(state["status"]))
    assert seen == [["running", "pending", "pending"], ["completed", "running", "pending"], ["completed", "running", "pending"], ["completed", "failed", "pending"], ["completed", "completed", "running"], ["completed", "completed", "running"], ["completed"] * 3, ["completed"] * 3]
    assert state["detail"] == [None, "❌ matching FAILED", None]
    steps, plain = ["1", "3", "3.5"], (0, ("pending",) * 3)
    state = ordered.Steps(steps).start()
    for line in ("Step 1", "step 1 completed", "Step 3.5 completed", "LAUNCHING AGENT", "Step 3 completed", "Step 3.5 completed", "Step 9"):
        plain, state = logs.advance(plain, line, steps), ordered.Steps(steps).step(state, line)
        assert (state["at"], tuple(state["status"])) == plain


def test_fold_of_a_table(spark):
    rows = [(k, i, t) for k in ("a", "b", None) for i, t in enumerate(['data: {"content":"x"}\nda', 'ta: {"content":"y"}\n', None, 'data: {"label":"s"}'])]
    df = spark.createDataFrame(rows, "key string, ord int, text string").repartition(3)
    assert sorted(map(str, ordered.fold_table(df, ordered.Events()).collect())) == sorted(f"Row(key={k!r}, content='xy', step='s', last=True)" for k in ("a", "b", None))
    assert ordered.fold_table(df.limit(0), ordered.Events()).count() == 0
