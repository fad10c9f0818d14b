"""Judgements as plug-ins: a judge maps rows of texts to verdict columns, in batches, and has a rule-based default."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import _cut
from tessera.operators.match import duplicate_groups
from tessera.operators.match import default_judge as match_judge

__all__ = ["Judge", "Ledger", "batched", "dependency_judge", "duplicate_groups", "match_judge", "parsed_reply"]


class Judge(Protocol):
    """Rows in, the same rows with verdict columns out."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


def _within(call: Callable[[list[dict]], list[dict]], rows: list[dict], limit: float | None) -> list[dict]:
    """call(rows), or TimeoutError after `limit` seconds; a call that hangs is left behind."""
    if limit is None:
        return call(rows)
    got: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            got.put((call(rows), None))
        except BaseException as err:  # told to the caller
            got.put((None, err))

    threading.Thread(target=run, daemon=True).start()
    try:
        verdicts, err = got.get(timeout=limit)
    except queue.Empty:
        raise TimeoutError(f"no verdicts after {limit} s") from None
    if err:
        raise err
    return verdicts


def batched(call: Callable[[list[dict]], list[dict]], columns: list[str], schema: str, size: int = 10, retries: int = 3, wait: float = 1.0, limit: float | None = None) -> Judge:
    """A judge that sends rows to `call` in batches of `size` as dicts of `columns`, and gets a list of dicts with pair_id.

    Verdicts are placed by pair_id, the first of each counts, missing ones are null. A batch that fails, or takes more than
    `limit` seconds, is tried again, `retries` times in all, then raised, so that Spark runs the task anew.
    """
    fields = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            for a in range(0, len(f), size):
                part = f.iloc[a : a + size].reset_index(drop=True)
                rows = [{"pair_id": i, **{c: r[c] for c in columns}} for i, r in part.iterrows()]
                for turn in range(retries):
                    try:
                        got = _within(call, rows, limit)
                        break
                    except Exception:
                        if turn + 1 == retries:
                            raise
                        time.sleep(wait * 2**turn)
                by: dict = {}
                for v in got:
                    if isinstance(v, dict) and v.get("pair_id") is not None:
                        by.setdefault(v["pair_id"], v)
                yield part.assign(**{c: pd.Series([by.get(i, {}).get(c) for i in range(len(part))], dtype=object) for c in fields})

    def judge(rows: DataFrame) -> DataFrame:
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInPandas(run, f"{own}, {schema}")

    return judge


def dependency_judge(rules: DataFrame) -> DataFrame:
    """The default verdict on dependencies: a rule whose description names another rule's id depends on it.

    Ids are found as words, so rules meet by a join on words and only ids are joined.
    """
    words = rules.select(F.col("rule_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit(r"[A-Za-z0-9_.-]+"), F.lit(0)))).alias("dst"))
    ids = rules.select(F.col("rule_id").alias("dst")).distinct()
    return words.join(ids, "dst").where("src <> dst").select("src", "dst", F.lit("prerequisite").alias("dependency_type"), F.lit(3).alias("strength"))


def parsed_reply(replies: DataFrame, schema: str, column: str = "reply") -> DataFrame:
    """replies with `verdicts`: the JSON array in each reply, with or without a fence; null if it can't be read."""
    from tessera.functions.text import fenced_json

    return replies.withColumn("verdicts", F.from_json(fenced_json(column), f"array<struct<{schema}>>"))


class Ledger:
    """Verdicts that were paid for, kept in a folder by content of what was judged and version of the judge.

    A row is known by the SHA-256 of its judged columns as JSON, so equal content is judged once, wherever it turns up again.
    schema: the columns that the judge adds; a double named cost is what a verdict cost.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], schema: str, version: str):
        self.spark, self.path, self.columns, self.version = spark, path, columns, version
        self.fields = [c.split()[0] for c in schema.split(", ")]
        self.schema = f"key string, version string, at timestamp, {schema}"

    def _key(self) -> Column:
        return F.sha2(F.to_json(F.struct(*self.columns), {"ignoreNullFields": "false"}), 256)

    def _all(self) -> DataFrame:
        """Rows of all versions; a folder that isn't there yet has none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def verdicts(self) -> DataFrame:
        """key and verdict columns of this version; of a key that two runs judged, the first to be written counts."""
        told = self._all().where(F.col("version") == self.version)
        return told.groupBy("key").agg(F.min_by(F.struct(*self.fields), F.struct("at", *self.fields)).alias("v")).select("key", "v.*")

    def spent(self) -> float:
        """What all verdicts of this version cost, those judged twice counted twice."""
        return float(self._all().where(F.col("version") == self.version).agg(F.sum("cost")).first()[0] or 0.0)

    def judge(self, rows: DataFrame, by: Judge, parts: int = 8, deadline: float | None = None, budget: float | None = None) -> DataFrame:
        """rows with the verdict columns; only content without a verdict is given to `by`.

        Open content is judged in `parts` shares, each written as a whole when it is done: after a failure, or a stop, what
        was judged stays and the next run goes on from there. Between shares, TimeoutError is raised `deadline` seconds after
        the start, and RuntimeError once more than `budget` is spent. Null columns are content too; repeated rows share a verdict.
        """
        end = time.monotonic() + deadline if deadline is not None else None
        open_ = rows.select(*self.columns, self._key().alias("_key")).dropDuplicates(["_key"])
        open_ = _cut(open_.join(self.verdicts().select(F.col("key").alias("_key")), "_key", "left_anti").withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts))))
        for n in sorted(r["_part"] for r in open_.select("_part").distinct().collect()):
            if end is not None and time.monotonic() > end:
                raise TimeoutError(f"verdicts are open after {deadline} s")
            if budget is not None and self.spent() > budget:
                raise RuntimeError(f"verdicts are open and {budget} is spent")
            told = by(open_.where(F.col("_part") == n).drop("_part"))
            told.select(F.col("_key").alias("key"), F.lit(self.version).alias("version"), F.current_timestamp().alias("at"), *self.fields).write.mode("append").parquet(self.path)
        known = self.verdicts().withColumnRenamed("key", "_key")
        return rows.withColumn("_key", self._key()).join(known, "_key", "left").drop("_key")
