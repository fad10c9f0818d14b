"""What the training-data operators share: shared scratch space, word rules, array helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none, a local one is set in local mode; else it is an error,
    as each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get()


#: Scratch paths of each application, for release().
_written: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = f"{checkpoint_root(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. To be called when results that read them have been written."""
    for p in _written.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts lineage, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of keys are broadcast up to so many rows; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows. df should be cheap to count, as a written table is."""
    return F.broadcast(df) if df.count() <= rows else df


def tidy(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go once the driver's JVM has collected what refers to them."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/tessera/" not in f:  # only what materialize() wrote
                raise ValueError(f)
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches to Python hold at most 2,000 rows or 8 MB, unless the session asks for something else."""
    for key, usual, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864", "8388608")):
        if spark.conf.get(key, usual) in (usual, "64MB", "64m"):
            spark.conf.set(key, own)


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with all columns but the used ones renamed, so that none clashes with what an operator adds."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c not in used})


def restored(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """The columns of docs again, in order, after set_aside()."""
    return df.select(*[F.col(f"`{c}`") if c in used else F.col(f"`_own_{c}`").alias(c) for c in columns])


def word_count(text):
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_batches(texts: list[bytes], limit: int = 1 << 18):
    """Ranges of texts of about `limit` bytes together; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(buf: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a byte buffer: start, end and 64-bit hash of each word. Equal words have equal hashes, wherever they stand."""
    if not buf.size:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not start.size:
        return start, end, np.zeros(0, np.uint64)
    length = end - start
    # each byte is weighed by a power of an odd number that depends on its place in its word
    longest = int(length.max())
    power = np.cumprod(np.full(longest, np.uint64(seed | 1)), dtype=np.uint64)
    body = np.flatnonzero(inside)
    place = np.arange(body.size) - np.repeat(np.cumsum(length) - length, length)
    weighed = (buf[body].astype(np.uint64) + np.uint64(1)) * mix64(power)[place]
    total = np.add.reduceat(weighed, np.cumsum(length) - length)
    return start, end, mix64(total ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def ngram_hashes(words: np.ndarray, n: int, seed: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hash of each n consecutive entries."""
    m = words.size - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(seed))
    for k in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m])
    return out
