"""Folds over streams in order of event time: rows that arrive late wait their turn, and what has been idle is closed.

Rows of a key are kept by (ts, id) until the watermark has passed them, so repeats count once and order of arrival does not
matter; timers of event time fold them and close a key. State is the fold's own text and the rows that still wait.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.logs import apply_event

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What is folded: start() gives a state that JSON can hold, step() the next one, and rows() what is told of it; last is
    true when a key has been idle and is closed."""

    schema = ""

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, text: str) -> Any:
        raise NotImplementedError

    def rows(self, state: Any, last: bool) -> list[tuple]:
        raise NotImplementedError


class OrderedFold(StatefulProcessor):
    def __init__(self, fold: Fold, idle_ms: int):
        self.fold, self.idle_ms = fold, idle_ms
        self.names = [c.split()[0] for c in fold.schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "state string, ts long")
        self.waiting = handle.getMapState("waiting", "ts long, id long", "text string")

    def _told(self, key: tuple, state: Any, last: bool) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], *r) for r in self.fold.rows(state, last)], columns=["key", *self.names])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            for ts, i, text in zip(f["ms"].tolist(), f["id"].tolist(), f["text"].tolist(), strict=True):
                if text is not None:
                    self.waiting.updateValue((int(ts), int(i)), (text,))
                    self.handle.registerTimer(int(ts))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k for k in self.waiting.keys() if k[0] <= now)
        known = self.state.get() if self.state.exists() else None
        state, last = (json.loads(known[0]), known[1]) if known else (self.fold.start(), 0)
        if due:
            for k in due:
                state = self.fold.step(state, self.waiting.getValue(k)[0])
                self.waiting.removeKey(k)
            if known:
                self.handle.deleteTimer(last + self.idle_ms)
            self.state.update((json.dumps(state), due[-1][0]))
            self.handle.registerTimer(due[-1][0] + self.idle_ms)
            return self._told(key, state, False)
        if known and now >= last + self.idle_ms:
            self.state.clear()
            return self._told(key, state, True)
        return iter(())

    def close(self) -> None:
        pass


def ordered_fold(lines: DataFrame, fold: Fold, late: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """A stream of the fold's rows after each step in time, of a stream of lines (key, ts, id, text).

    Lines later than `late` behind the newest are dropped. Lines of one ts go by id; equal (ts, id) count once, null texts not
    at all. A key without lines for `idle` seconds is told of once more, and its state goes; a line after that starts anew. The
    session's state store has to be RocksDB (ValueError).
    """
    spark: SparkSession = lines.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    kind = dict(lines.dtypes)["key"]
    put = lines.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"), F.col("id").cast("long").alias("id"), "text")
    return put.groupBy("key").transformWithStateInPandas(OrderedFold(fold, idle * 1000), f"key {kind}, {fold.schema}", "update", "eventTime")


class Steps(Fold):
    """Status of the steps of a run: pending, running, completed or failed, with the line that tells of a failure.

    joins: steps that lines name by another label (`STEP 1/4`); the next one's start, or `JOINS COMPLETE`, ends the one before.
    labels: how lines that tell of a failure name a step.
    """

    schema = "step string, status string, detail string"

    def __init__(self, steps: list[str], joins: dict[str, str] | None = None, labels: dict[str, str] | None = None):
        self.steps, self.joins, self.labels = steps, joins or {}, labels or {}

    def start(self):
        return {"at": 0, "status": ["pending"] * len(self.steps), "detail": [None] * len(self.steps)}

    def _named(self, at: int, line: str) -> bool:
        return re.search(rf"Step {re.escape(self.steps[at])}(?![\d.])", line, re.IGNORECASE) is not None

    def _joined(self, at: int, line: str) -> bool:
        label = self.joins.get(self.steps[at]) if at < len(self.steps) else None
        return label is not None and f"STEP {label}" in line

    def step(self, state, line):
        at = state["at"]
        if at >= len(self.steps):
            return state
        status, detail = list(state["status"]), list(state["detail"])
        ends = self._named(at, line) and "completed" in line.lower()
        if self.steps[at] in self.joins:
            ends = ends or self._joined(at + 1, line) or "JOINS COMPLETE" in line
        if ends:
            status[at] = "completed"
            if at + 1 < len(self.steps):
                status[at + 1] = "running"
        elif self._named(at, line) or self._joined(at, line) or "LAUNCHING AGENT" in line:
            status[at] = "running"
        label = self.labels.get(self.steps[at], f"Step {self.steps[at]}")
        if ("FAILED" in line or "❌" in line) and label.lower() in line.lower():
            status[at], detail[at] = "failed", line
        return {"at": at + ends, "status": status, "detail": detail}

    def rows(self, state, last):
        return list(zip(self.steps, state["status"], state["detail"], strict=True))


class Events(Fold):
    """Content and step of an event stream whose chunks may end within a line; the last line needs no end."""

    schema = "content string, step string, last boolean"

    def start(self):
        return {"content": "", "step": None, "rest": ""}

    def step(self, state, chunk):
        *lines, rest = (state["rest"] + chunk).split("\n")
        content, step = state["content"], state["step"]
        for line in lines:
            content, step = apply_event(content, step, line)
        return {"content": content, "step": step, "rest": rest}

    def rows(self, state, last):
        content, step = (apply_event(state["content"], state["step"], state["rest"])) if last else (state["content"], state["step"])
        return [(content, step, last)]


def fold_table(lines: DataFrame, fold: Fold) -> DataFrame:
    """The end of the fold of each key of a table of lines (key, ord, text), in order of ord: rows as of a closed key. A key
    is streamed through one task, its state and a batch of lines held at a time. Null texts count as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, key, state, open_ = ["key", *(c.split()[0] for c in fold.schema.split(", "))], None, None, False
        for f in frames:
            out = []
            for k, text in zip(f["key"].tolist(), f["text"].tolist(), strict=True):
                if not open_ or k != key:
                    out += [(key, *r) for r in fold.rows(state, True)] if open_ else []
                    key, state, open_ = k, fold.start(), True
                state = fold.step(state, text or "")
            yield pd.DataFrame(out, columns=names).astype(object)
        if open_:
            yield pd.DataFrame([(key, *r) for r in fold.rows(state, True)], columns=names).astype(object)

    kind = dict(lines.dtypes)["key"]
    return lines.repartition("key").sortWithinPartitions("key", "ord").select("key", "text").mapInPandas(run, f"key {kind}, {fold.schema}")
