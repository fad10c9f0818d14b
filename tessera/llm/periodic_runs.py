"""Periodic runs of words: stretches where the same few words come round again and again.

For every period q a grid of places 0, q, 2q, ... is laid over a text; there are n ln n pairs of period and grid place in
all. A stretch of `repeats` times q words holds `repeats` neighbouring grid places, so equality of hashes between
those places tells which pairs lie in a run. For these, binary searches over prefix hashes find at once how far the words
q apart stay equal to either side (longest common extensions). Runs are then checked word by word and told apart.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import WORD, set_aside, small_batches

#: Hashes are taken modulo two primes, so products fit in 64 bits.
PRIMES = (2147483647, 2147483629)
#: So many pairs of period and grid place are looked at together, and so many words of several texts.
PAIRS, WORDS = 1 << 20, 1 << 17
RESULT = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class PrefixHashes:
    """Sums of words weighed by powers of a base, so that equal stretches are known by two subtractions."""

    def __init__(self, ids: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for p in PRIMES:
            base = int(r.integers(1 << 20, p - 1))
            power = np.ones(1, np.uint64)
            while power.size <= ids.size:  # doubled each time
                power = np.concatenate([power, power * np.uint64(pow(base, power.size, p)) % np.uint64(p)])
            values = r.integers(1, p, int(ids.max(initial=-1)) + 1).astype(np.uint64)
            weighed = values[ids] * power[: ids.size] % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)]))
            self.powers.append(power)

    def equal(self, at: np.ndarray, length: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether `length` words from `at` equal those q further on; never False where they do."""
        same = np.ones(at.size, bool)
        for p, s, power in zip(PRIMES, self.sums, self.powers, strict=True):
            here, there = (s[at + length] - s[at]) % np.uint64(p), (s[at + q + length] - s[at + q]) % np.uint64(p)
            same &= here * power[q] % np.uint64(p) == there
        return same


def _extension(holds, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest length for which holds(length) is true, for all pairs at once; true for low already."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not open_.size:
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        yes = holds(open_, mid)
        low[open_[yes]] = mid[yes]
        high[open_[~yes]] = mid[~yes] - 1


def _grid(starts: np.ndarray, sizes: np.ndarray, repeats: int):
    """Pairs of all texts: place, period and text, in blocks. A place has repeats - 1 further grid places of its text after it."""
    most = sizes // repeats
    text = np.repeat(np.arange(sizes.size), most)
    q = np.arange(text.size) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (sizes[text] - 1) // q - (repeats - 2)
    ends = np.cumsum(places)
    for a in range(0, int(ends[-1]) if ends.size else 0, PAIRS):
        b = min(a + PAIRS, int(ends[-1]))
        first, last = np.searchsorted(ends, [a, b - 1], side="right")
        k = np.arange(first, last + 1)
        k = np.repeat(k, np.minimum(ends[k], b) - np.maximum(ends[k] - places[k], a))
        yield starts[text[k]] + (np.arange(a, b) - (ends[k] - places[k])) * q[k], q[k], text[k]


def _candidates(ids, starts, ends, least, repeats, seed):
    """start, end, period of runs of all texts, by hashes."""
    h, found = PrefixHashes(ids, seed), []
    for at, q, text in _grid(starts, ends - starts, repeats):
        keep = np.flatnonzero(ids[at] == ids[at + q])
        at, q, text = at[keep], q[keep], text[keep]
        known = q * (repeats - 2) + 1
        keep = h.equal(at, known, q)
        at, q, text, known = at[keep], q[keep], text[keep], known[keep]
        if not at.size:
            continue
        after = _extension(lambda i, m: h.equal(at[i], m, q[i]), known, ends[text] - at - q)
        before = _extension(lambda i, m: h.equal(at[i] - m, m, q[i]), np.zeros(at.size, np.int64), at - starts[text])
        start, end = at - before, at + q + after
        keep = end - start >= np.maximum(least, repeats * q)
        found.append(np.unique(np.stack([start[keep], end[keep], q[keep]], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def find_runs(ids: np.ndarray, ends: np.ndarray, least: int = 6, repeats: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of each run of texts that stand one after another; in order of start, then period.

    ids: whole numbers from 0, equal where words are; ends: end of each text in them. A run has at least `least`
    words and `repeats` (2 or more) times its period; it can't be extended in its text. Should hashes agree where words
    don't, the search is made again with other hashes, so the result is exact.
    """
    if repeats < 2:
        raise ValueError("repeats must be 2 or more")
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if ends.size else ends
    for seed in count():
        c = _candidates(ids, starts, ends, least, repeats, seed)
        head = np.ones(len(c), bool)
        head[1:] = (c[1:, :2] != c[:-1, :2]).any(1)
        start, end, q = c[head].T
        # longer periods of the same stretch are multiples of its smallest one
        if (c[:, 2] % np.repeat(q, np.diff(np.flatnonzero(np.append(head, True))))).any():
            continue
        if all(np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True)):
            order = np.lexsort((q, start))
            return start[order], end[order], q[order]


def _numbered(texts: list[bytes | None]):
    """Blocks of texts: their words and a number for each word."""
    block, size = [], 0
    for t in texts:
        block.append((t or b"").split())  # ASCII white space, as for WORD
        size += len(block[-1])
        if size >= WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(texts: list[bytes | None], least: int, repeats: int):
    """Of each text: runs as (start, length, period) arrays, and the text without repetitions."""
    for block in _numbered(texts):
        words = [w for t in block for w in t]
        number = dict(zip(dict.fromkeys(words), count()))
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ends = np.cumsum([len(t) for t in block])
        start, end, q = find_runs(ids, ends, least, repeats)
        gone = np.cumsum(np.bincount(start + q, minlength=ids.size + 1) - np.bincount(end, minlength=ids.size + 1)) > 0
        of = np.searchsorted(start, np.concatenate([np.zeros(1, np.int64), ends]))
        for i, t in enumerate(block):
            a, b = of[i], of[i + 1]
            base = ends[i] - len(t)
            kept = t if a == b else [w for w, g in zip(t, gone[base : ends[i]].tolist(), strict=True) if not g]
            yield start[a:b] - base, (end - start)[a:b], q[a:b], b" ".join(kept)


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4) -> DataFrame:
    """docs with runs (array of start, length, period; by start, then period) and collapsed: its words joined by one space,
    without those that some run holds after its first period.

    Words are runs of anything but ASCII white space, numbered from 0. Null and empty texts have no runs and an empty
    collapsed text. Texts are taken whole, one row at a time, so repeated rows and null ids don't matter. Columns named runs
    or collapsed are replaced, all others stay. No shuffle; memory follows the longest text.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("runs", "collapsed")
    put = set_aside(docs, "text").withColumn("text", F.col("text").cast("string"))
    schema = StructType([*put.schema.fields, *StructType.fromDDL(RESULT).fields])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def scan(batches):
        for b in batches:
            found = list(_scan(b.column("text").cast(pa.large_binary()).to_pylist(), least, repeats))
            offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32())
            parts = [pa.array(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64), pa.int64()) for k in range(3)]
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
            collapsed = pa.array([x[3] for x in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, runs.cast(kind), collapsed], names=[*b.schema.names, "runs", "collapsed"])

    out = put.mapInArrow(scan, schema)
    own = [F.col("text") if c == "text" else F.col(f"`_own_{c}`").alias(c) for c in docs.columns]
    return out.select(*own, "runs", "collapsed")


def looped(docs: DataFrame) -> DataFrame:
    """docs where the end of some texts, chosen by a hash of doc_id, goes round in a loop of words. Without doc_id texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size("_words").cast("long")
    a, p = F.expr("_g % size(_words)"), F.expr("1 + (size(_words) - _a) div (3 + _g % 8)")
    chosen = F.coalesce((h % 10 == 0) & F.col("text").isNotNull(), F.lit(False))
    d = docs.withColumn("_g", g).withColumn("_words", F.when(chosen, words))
    d = d.withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    at = "transform(_words, (w, i) -> _words[cast(if(i < _a, i, _a + (i - _a) % _p) as int)])"
    return d.withColumn("text", F.when(n > 0, F.array_join(F.expr(at), " ")).otherwise(F.col("text"))).drop("_g", "_words", "_a", "_p")


def op12_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = periodic_runs(looped(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div -best.period")
    return d.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
