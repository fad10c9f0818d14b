"""Substring dedup over a log-structured fingerprint index.

The index is a folder of immutable sorted runs of window fingerprints: a level-0 run for each batch that came in, and
merged runs. A batch is fingerprinted and added, and its anchors are merge-joined with the runs of all earlier batches, by
part of the fingerprint space. What matches is verified window by window with fingerprints of 128 bits over the words
themselves; of earlier batches only the documents that match are read again. Runs are compacted when there are too many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import windows as win
from tessera.llm.common import mix64, scratch, word_hashes

WINDOW, GRAM, FANOUT = 20, 6, 8
#: dedup_in_batches() loads this share of the documents first, and then the others in batches of these shares.
SHARES = (0.7, 0.15, 0.15)


def word_units(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text, np.uint8))[2]


_WEIGHTS = mix64(np.arange(1, 2 * 4096 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def window_hashes(units: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at the given places."""
    one, two = np.zeros(at.size, np.uint64), np.zeros(at.size, np.uint64)
    for j in range(window):
        u = units[at + j]
        one += u * _WEIGHTS[j]
        two += mix64(u ^ _WEIGHTS[4096 + j]) * _WEIGHTS[4096 + j]
    return mix64(one), mix64(two)


_PAIRS = "part int, one binary, two binary, local binary, start binary, uid binary, ord binary, age binary"


def _spread(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Window hashes of the runs to compare, as blobs by part of the hash space."""

    def run(batches):
        held, docs_, total = [], [], 0

        def blobs():
            one, two, start = (np.concatenate([h[i] for h in held]) for i in range(3))
            local = np.repeat(np.arange(len(held)), [h[0].size for h in held])
            part = (one % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            meta = [np.array([d[i] for d in docs_], np.int64) for i in range(3)]
            out = []
            for a, b in zip(edge, np.append(edge[1:], part.size)):
                o = order[a:b]
                own, at = np.unique(local[o], return_inverse=True)
                out.append((int(part[a]), one[o].tobytes(), two[o].tobytes(), at.astype(np.uint16).tobytes(), start[o].astype(np.int32).tobytes(), *[m[own].tobytes() for m in meta]))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32()] + [pa.binary()] * 7)], names=[c.split()[0] for c in _PAIRS.split(", ")])

        for b in batches:
            for uid, order, text, age, fields in zip(*b.columns):
                f = np.concatenate([np.frombuffer(x["fields"], np.int32) for x in fields.as_py()]).reshape(-1, 4)
                first, count = f[:, 0].astype(np.int64), f[:, 1].astype(np.int64)
                at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                held.append((*window_hashes(word_units(text.as_py().encode()), at, window), at))
                docs_.append((uid.as_py(), order.as_py(), age.as_py()))
                total += at.size
                if total > 200_000 or len(held) == 65_535:
                    yield blobs()
                    held, docs_, total = [], [], 0
        if held:
            yield blobs()

    return docs.select("_uid", "_ord", "text", "_age", "runs").mapInArrow(run, _PAIRS)


def _verify(blobs: DataFrame, window: int, batch: int) -> DataFrame:
    """Spans of windows of `batch` that equal an earlier one."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        cat = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in f[c]])
        one, two, start = cat("one", np.uint64), cat("two", np.uint64), cat("start", np.int32)
        uid, ord_, age = (np.concatenate([np.frombuffer(u, np.int64)[np.frombuffer(i, np.uint16)] for u, i in zip(f[c], f["local"])]) for c in ("uid", "ord", "age"))
        o = np.lexsort((start, uid, ord_, age, two, one))
        one, two, start, uid, ord_, age = (x[o] for x in (one, two, start, uid, ord_, age))
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        h = np.flatnonzero(new)[np.cumsum(new) - 1]
        r = np.flatnonzero(~((ord_ == ord_[h]) & (uid == uid[h]) & (start == start[h]) & (age == age[h])) & (age == batch))
        return win._by_uid(uid[r], ord_[r], 0, np.stack([start[r], start[r] + window], 1), int(f["part"].iloc[0]))

    return blobs.groupBy("part").applyInPandas(run, win._FOUND)


class FingerprintLog:
    """The index at a path: runs/<batch>-<level>, each a Parquet folder of sorted runs with the batch they came from.

    parts divides the fingerprint space and is fixed when the index begins. There are at most `fanout` live runs between
    batches. A batch that broke off can be run again: what it left is replaced, and a merged run hides those it stands for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = 12, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.path, self.parts, self.window, self.gram, self.fanout = spark, path or scratch(spark, "fingerprints"), parts, window, gram, fanout
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    @staticmethod
    def _name(path: str) -> tuple[int, int]:
        """Newest batch and level of a run."""
        batch, level = path.rstrip("/").rsplit("/", 1)[1].split("-")
        return int(batch), int(level)

    def _written(self) -> list[str]:
        root = self._path(f"{self.path}/runs")
        if not self._fs.exists(root):
            return []
        return sorted(str(s.getPath()) for s in self._fs.listStatus(root) if self._fs.exists(self._path(f"{s.getPath()}/_SUCCESS")))

    def levels(self) -> list[str]:
        """Paths of the live runs, oldest first: those that no merged run of a higher level stands for."""
        found = {p: self._name(p) for p in self._written()}
        return [p for p, (batch, level) in found.items() if not any(b >= batch and v > level for b, v in found.values())]

    def holds_earlier(self, batch: int) -> bool:
        return any(b < batch or level for b, level in map(self._name, self.levels()))

    def add(self, docs: DataFrame, batch: int) -> None:
        """Fingerprint docs (as windows.keyed gives them) and append their runs, sorted. A batch that a merged run already
        holds is not added again."""
        if not any(b >= batch and level for b, level in map(self._name, self.levels())):
            new = win.sorted_runs(docs, word_units, self.window, self.gram, self.parts, batch)
            new.write.mode("overwrite").parquet(f"{self.path}/runs/{batch:012d}-0")

    def read(self) -> DataFrame:
        return self.spark.read.schema(win._RUNS).parquet(*self.levels())

    def compact(self) -> None:
        """Merge runs while more than `fanout` are live: those of the lowest level, and where that holds one run only, those of
        the next level with it. So older runs are not written again each time. Old runs go last."""
        while len(live := self.levels()) > self.fanout:
            by_level: dict[int, list[str]] = {}
            for p in live:
                by_level.setdefault(self._name(p)[1], []).append(p)
            old: list[str] = []
            for level in sorted(by_level):
                old += by_level[level]
                if len(old) > 1:
                    break
            self._merge(old, level + 1)

    def _merge(self, old: list[str], level: int) -> None:
        """Write the runs at old as one of the given level: sorted per part and batch; of a part that holds more runs than one
        task should (as a group of near copies can make it), the blobs are dealt to several, each sorted by itself."""

        def merge(f: pd.DataFrame) -> pd.DataFrame:
            own = win._loaded(f)
            own = own[np.lexsort((own["body"], own["anchor"]))]
            rows = []
            for a in range(0, own.size, 65_535):  # so that places in the table of documents fit in 16 bits
                r = own[a : a + 65_535]
                uid, ord_, local = win._documents(r["uid"], r["ord"])
                rows.append((f["part"].iloc[0], f["batch"].iloc[0], r["anchor"].tobytes(), r["body"].tobytes(), local.astype(np.uint16).tobytes(), r["first"].tobytes(), r["count"].tobytes(), uid.tobytes(), ord_.tobytes()))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in win._RUNS.split(", ")])

        blobs = self.spark.read.schema(win._RUNS).parquet(*old)
        largest = blobs.groupBy("part", "batch").agg(F.sum(F.octet_length("anchor") / 4).alias("n")).agg(F.max("n")).first()[0] or 0
        deal = max(1, -(-int(largest) // (4 * win.RUNS_PER_PART)))
        newest = max(self._name(p)[0] for p in old)
        dealt = blobs.withColumn("deal", F.pmod(F.xxhash64("body", "uid"), F.lit(deal)).cast("int"))
        dealt.groupBy("part", "batch", "deal").applyInPandas(merge, win._RUNS).write.mode("overwrite").parquet(f"{self.path}/runs/{newest:012d}-{level}")
        live = self.levels()
        for p in self._written():
            if p not in live:
                self._fs.delete(self._path(p), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)


def repeated_spans(log: FingerprintLog, docs: DataFrame, batch: int = 0, history: DataFrame | None = None) -> DataFrame:
    """kind 0 rows of spans (in words) of docs that repeat an earlier window: of an earlier batch in the log, or of docs
    itself (smaller doc_id; same document, earlier place). docs are added to the log.

    docs, history: as windows.keyed gives them; history holds all documents of earlier batches, with _age their batch. Of
    these only such are read whose fingerprints match.
    """
    if history is None and log.holds_earlier(batch):
        raise ValueError("the index holds earlier batches: their documents are needed to verify matches")
    later, whole = win.copies(docs, True)
    docs = win.without(docs, later)
    log.add(docs, batch)
    found = win.stored(win.settle(log.read(), log.window, True, batch), "settled")
    texts = docs.withColumn("_age", F.lit(batch).cast("long"))
    if history is not None:
        texts = texts.unionByName(history.select(texts.columns))
    verified = win.stored(_verify(_spread(win.fetch(found, texts), log.window, log.parts), log.window, batch), "verified")
    log.compact()
    return found.where("kind = 0").unionByName(verified).unionByName(whole)


def rendered(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """docs with _n_words, _n_removed and _kept, given the spans that were found."""
    kept = [c for c in docs.columns if c not in {"_n_words", "_n_removed", "_kept", "_uid", "_ord", "_spans", "_u", "_o"}]
    spans = win.with_spans(docs.select(*kept, *win.identity(docs)), found)
    at, names = kept.index("text"), [*kept, "_n_words", "_n_removed", "_kept"]

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                total, gone, left = [], [], []
                for text, s in zip(b.column(at), b.column(b.num_columns - 1)):
                    words = (text.as_py() or "").encode().split()
                    c = win.cover(s.as_py(), len(words), window)
                    total.append(len(words))
                    gone.append(int((c[:, 1] - c[:, 0]).sum()))
                    edge = [0, *c.ravel().tolist(), len(words)]
                    left.append(b" ".join(w for i in range(0, len(edge), 2) for w in words[edge[i] : edge[i + 1]]).decode())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=names)

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*docs.select(*kept).schema.fields, StructField("_n_words", LongType()), StructField("_n_removed", LongType()), StructField("_kept", StringType())])
    return spans.select(*kept, "_spans").mapInArrow(run, schema)


def new_log(docs: DataFrame, window: int = WINDOW, fanout: int = FANOUT) -> FingerprintLog:
    """An empty index in the shared folder whose parts fit docs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return FingerprintLog(docs.sparkSession, parts=win.part_count(size // 6, window, GRAM, win.RUNS_PER_PART), window=window, fanout=fanout)


def dedup(docs: DataFrame, log: FingerprintLog | None = None, batch: int = 0, history: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """docs with _n_words, _n_removed and _kept (the words that stay, joined by one space).

    A word goes if a window of `window` words covers it whose words also start earlier: in docs or, with a log, in an
    earlier batch, whose documents history must then give (ValueError if it doesn't). Null and empty text has no words.
    Null doc_id sorts first; among rows of one doc_id a hash of the text decides, and a row repeated whole is one document.
    An empty table gives an empty one. `_uid`, `_ord`, `_spans` are not kept.
    """
    own, passing = win.keyed(docs), log is None
    log = new_log(docs, window) if passing else log
    found = repeated_spans(log, own, batch, history)
    if passing:
        log.drop()  # what it told is written; a log that is kept is given by the caller
    return rendered(docs, found, window)


def dedup_in_batches(docs: DataFrame, shares: tuple[float, ...] = SHARES, window: int = WINDOW) -> DataFrame:
    """What dedup() gives for docs, with documents dealt by ranges of doc_id to batches of about these shares, which go
    through one index one after another, as they would arrive, and runs compacted between them."""
    upto = np.cumsum(shares)[:-1].tolist()
    first = sorted({int(b) for b in docs.select(F.col("doc_id").cast("double").alias("o")).approxQuantile("o", upto, 0.01)})
    log, found, id_ = new_log(docs, window, fanout=1), None, F.col("doc_id")
    for batch in range(len(first) + 1):
        over = id_ >= first[batch - 1] if batch else F.lit(True)
        own = over & (id_ < first[batch]) if batch < len(first) else over
        part = docs.where(own if batch else own | id_.isNull())
        history = None
        for i in range(batch):
            old = docs.where((id_ < first[0]) | id_.isNull() if not i else (id_ >= first[i - 1]) & (id_ < first[i]))
            old = win.keyed(old).withColumn("_age", F.lit(i).cast("long"))
            history = old if history is None else history.unionByName(old)
        spans = repeated_spans(log, win.keyed(part), batch, history)
        found = spans if found is None else found.unionByName(spans)
    log.drop()
    return rendered(docs, found, window)


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_in_batches(docs)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS turn FROM win) WHERE turn > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM later, range(0, 20) t(j)
), words AS (
  SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
