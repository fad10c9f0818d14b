"""Run logs as streams: level, cost totals, step states, event folds. Batch forms share the column logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COST = "[LLM_COST]"


def level(line="line") -> Column:
    c = F.col(line) if isinstance(line, str) else line
    return F.when(F.regexp_like(c, F.lit("❌|ERROR|FAILED")), "ERROR").when(F.regexp_like(c, F.lit("⚠️|WARNING")), "WARN").otherwise("INFO")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of log files in a folder, with their level; cost lines are left to costs()."""
    lines = spark.readStream.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("run_id"), F.col("value").alias("line"))
    return lines.withColumn("level", level())


def costs(lines: DataFrame) -> DataFrame:
    """Running totals per run of the cost lines; works on streams (update mode) and tables. Lines that don't parse don't count."""
    own = lines.where(F.startswith("line", F.lit(COST))).withColumn("c", F.from_json(F.substring("line", len(COST) + 1, 1_000_000), "cost double, prompt_tokens long, completion_tokens long, cached_tokens long, bad string", {"columnNameOfCorruptRecord": "bad"}))
    total = lambda n: F.sum(F.coalesce(f"c.{n}", F.lit(0)))
    return own.where("c IS NOT NULL AND c.bad IS NULL").groupBy("run_id").agg(F.round(total("cost"), 6).alias("total_cost"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), total("cached_tokens").alias("cached_tokens"), F.count("*").alias("calls"))


def mentions(line: Column, step: str) -> Column:
    """Whether a line names the step as a whole: Step 3 is not Step 3.5."""
    return F.regexp_like(line, F.lit(rf"(?i)Step {step.replace('.', '[.]')}(?![\d.])"))


def advance(states: tuple, line: str, steps: list[str]) -> tuple:
    """(index, statuses) after a line: a completion line of the current step ends it and starts the next."""
    import re

    at, status = states
    if at >= len(steps):
        return states
    status = list(status)
    named = re.search(rf"Step {re.escape(steps[at])}(?![\d.])", line, re.IGNORECASE) is not None
    if named and "completed" in line.lower():
        status[at] = "completed"
        at += 1
        if at < len(steps):
            status[at] = "running"
    elif named or "LAUNCHING AGENT" in line:
        status[at] = "running"
    return at, tuple(status)


def step_states(lines: DataFrame, steps: list[str]) -> DataFrame:
    """run_id, step, status of a table of lines (run_id, id, line): the fold of each run's lines in order of id."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("on"))
    named = F.array(*[mentions(F.col("line"), s) for s in steps])
    rows = lines.select("run_id", F.struct("id", named.alias("named"), F.contains(F.lower("line"), F.lit("completed")).alias("done"), F.contains("line", F.lit("LAUNCHING AGENT")).alias("launch")).alias("e"))
    # other lines change nothing; runs without any line that does stay
    rows = rows.withColumn("e", F.when(F.exists("e.named", lambda x: x) | F.col("e.launch"), F.col("e")))
    runs = rows.groupBy("run_id").agg(F.sort_array(F.collect_list("e")).alias("es"))

    def step(acc, e):
        hit = F.coalesce(F.try_element_at(e["named"], acc["at"] + 1), F.lit(False))
        ends = hit & e["done"]
        return F.struct((acc["at"] + ends.cast("int")).alias("at"), (acc["on"] | ends | hit | e["launch"]).alias("on"))

    end = runs.select("run_id", F.aggregate("es", zero, step).alias("s"))
    each = end.select("run_id", "s", F.posexplode(F.array(*[F.lit(x) for x in steps])).alias("i", "step"))
    status = F.when(F.col("i") < F.col("s.at"), "completed").when((F.col("i") == F.col("s.at")) & F.col("s.on"), "running").otherwise("pending")
    return each.select("run_id", "step", status.alias("status"))


def stream_steps(lines: DataFrame, steps: list[str]) -> DataFrame:
    """The same state machine on a stream of (run_id, line): run_id, step, status after each batch, by keyed state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, status = (state.get[0], tuple(state.get[1].split(","))) if state.exists else (0, ("pending",) * len(steps))
        for f in frames:
            for line in f["line"]:
                at, status = advance((at, status), line, steps)
        state.update((at, ",".join(status)))
        yield pd.DataFrame({"run_id": key[0], "step": steps, "status": list(status)})

    kind = dict(lines.dtypes)["run_id"]
    return lines.groupBy("run_id").applyInPandasWithState(run, f"run_id {kind}, step string, status string", "at int, status string", "update", GroupStateTimeout.NoTimeout)


def seen(lines: DataFrame) -> DataFrame:
    """run_id, line, first, last: when each kind of line was seen first and last."""
    return lines.groupBy("run_id", "line").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def page(lines: DataFrame, after: int, limit: int) -> DataFrame:
    """The next lines after a cursor."""
    return lines.where(F.col("id") > after).orderBy("id").limit(limit)


def fan_out(stream: DataFrame, subscribers: list[Callable[[DataFrame, int], None]]):
    """A writer that gives each batch to all subscribers; one that fails is dropped."""
    alive = list(subscribers)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for s in list(alive):
            try:
                s(batch, number)
            except Exception:  # a dead subscriber must not stop the stream
                alive.remove(s)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each)


def apply_event(content: str, step: str | None, line: str) -> tuple[str, str | None]:
    """(content, step) after one line of an event stream: tokens append, `done` clears the step, a message stands in for
    missing tokens. Lines that aren't JSON data change nothing."""
    import json

    line = line.removesuffix("\r")
    if not line.startswith("data:") or not (payload := line[5:].strip()):
        return content, step
    try:
        data = json.loads(payload)
    except ValueError:
        return content, step
    if not isinstance(data, dict):
        return content, step
    own = data.get("content")
    if isinstance(own, str) and own:
        content += own
    if data.get("status") == "done":
        step = None
    elif "label" in data:
        step = data["label"]
    if "message" in data and not own:
        content += str(data["message"])
    return content, step


def fold_events(chunks: DataFrame) -> DataFrame:
    """stream_id, content, step of a table of chunks (stream_id, ord, chunk): chunks join to lines, the last may lack its end."""
    from tessera.streaming.ordered import Events, fold_table

    lines = chunks.select(F.col("stream_id").alias("key"), "ord", F.col("chunk").alias("text"))
    return fold_table(lines, Events()).select(F.col("key").alias("stream_id"), "content", "step")


def level_windows(lines: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extra: counts by level and window of event time; late lines are dropped on streams."""
    return lines.withColumn("level", level()).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "level").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "level", "n")


def forward_fill(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
