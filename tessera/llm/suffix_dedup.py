"""Suffix-array dedup of byte strings by two-stage sorting.

Anchored runs (windows.py) settle copies and leave aside what has no company. What remains are unlike runs of one
anchor: their bytes meet in one place, where a suffix array over them shows which windows are alike. Only suffixes
smaller than their successors are sorted directly; all others are induced from them by a scan of the buckets of first
bytes; then common prefixes of neighbours are computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows as win
from tessera.llm.common import discard, if_small, materialize, mix64

WINDOW, GRAM = 400, 64
SORT_BLOCK, BYTES_PER_ARRAY = 20_000, 1 << 19
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def byte_units(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def _slices(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Byte strings of `width` that start at the given places, as one fixed-width column."""
    rows = np.lib.stride_tricks.sliding_window_view(buf, width)[at]
    return np.ascontiguousarray(rows)


def direct_sort(buf: np.ndarray, at: np.ndarray, depth: int, done: int = 0) -> np.ndarray:
    """Places in order of their next `depth` bytes. buf is padded. Memory is bounded: large sets are first split by
    eight bytes, and what these leave tied by eight more."""
    if at.size <= 1 or done >= depth:
        return at
    if at.size <= SORT_BLOCK:
        width = depth - done
        return at[np.argsort(_slices(buf, at + done, width).view(f"S{width}").ravel(), kind="stable")]
    word = _slices(buf, at + done, 8).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(word, kind="stable")
    at, word = at[order], word[order]
    edge = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), at.size)
    out, a = [], 0
    while a < edge.size - 1:
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + SORT_BLOCK, "right")) - 1)
        out.append(direct_sort(buf, at[edge[a] : edge[b]], depth, done + 8 if b == a + 1 else done))
        a = b
    return np.concatenate(out)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text in order, as far as their first `depth` bytes tell them apart. The end counts as smallest."""
    n = text.size
    if n < 2:
        return np.arange(n)
    buf = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    # smaller than its successor: the next different byte is larger
    change = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.searchsorted(change, np.arange(n))
    ended = nxt == change.size
    after = change[np.minimum(nxt, max(change.size - 1, 0))] if change.size else np.zeros(n, int)
    small = ~ended & (text[np.minimum(after + 1, n - 1)] > text)
    ordered = direct_sort(buf, np.flatnonzero(small), depth)
    total, smaller = np.bincount(text, minlength=256), np.bincount(text[ordered], minlength=256)
    head = np.cumsum(total) - total
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    sa = np.empty(n, np.int64)
    s_at = np.cumsum(smaller) - smaller

    def induce(wave: np.ndarray) -> None:
        """Predecessors that aren't smaller than their successors go to the fronts of their buckets, in this order."""
        prev = wave[wave > 0] - 1
        prev = prev[~small[prev]]
        first = text[prev]
        for c in np.unique(first).tolist():
            induced[c].append(prev[first == c])

    induce(np.array([n]))  # the empty suffix comes before all others
    for c in range(256):
        if not total[c]:
            continue
        done, put = 0, head[c]
        while done < len(induced[c]):  # a wave may add to its own bucket
            wave = induced[c][done]
            sa[put : put + wave.size] = wave
            put += wave.size
            induce(wave)
            done += 1
        own = ordered[s_at[c] : s_at[c] + smaller[c]]
        sa[put : put + own.size] = own
        induce(own)
        induced[c] = []
    return sa


def repeats(text: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """For the suffixes where valid holds: whether their first `window` bytes also begin another such suffix."""
    sa = suffix_array(text, window)
    sa = sa[valid[sa]]
    buf = np.concatenate([text, np.zeros(window, np.uint8)])
    out = np.zeros(text.size, bool)
    pairs = np.arange(sa.size - 1)
    for w in range(0, window - 7, 8):  # common prefixes of neighbours, eight bytes at a time; most fall at once
        if not pairs.size:
            break
        pairs = pairs[(_slices(buf, sa[pairs] + w, 8) == _slices(buf, sa[pairs + 1] + w, 8)).all(1)]
        if w == 32:
            break
    for a in range(0, pairs.size, 5_000):
        p = pairs[a : a + 5_000]
        p = p[(_slices(buf, sa[p], window) == _slices(buf, sa[p + 1], window)).all(1)]
        out[sa[p]] = out[sa[p + 1]] = True
    return out


_BODIES = "part int, anchor binary, uid binary, ord binary, first binary, count binary, settled binary, bytes binary"


def _bodies(open_: DataFrame, window: int) -> DataFrame:
    """The bytes of the runs to compare, as blobs by part of the anchor space."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def blobs():
            rows = []
            for part, items in held.items():
                cols = [np.concatenate([i[c] for i in items]) for c in range(6)]
                rows.append((part, *[c.tobytes() for c in cols], b"".join(i[6] for i in items)))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32()] + [pa.binary()] * 7)], names=[c.split()[0] for c in _BODIES.split(", ")])

        for b in batches:
            for uid, ord_, text, groups in zip(*b.columns):
                text, uid, ord_ = text.as_py().encode(), uid.as_py(), ord_.as_py()
                for g in groups.as_py():
                    f = np.frombuffer(g["fields"], np.int32).reshape(-1, 4)
                    body = b"".join(text[s : s + c - 1 + window] for s, c in f[:, :2].tolist())
                    held.setdefault(g["part"], []).append((f[:, 3], np.full(len(f), uid, np.int64), np.full(len(f), ord_, np.int64), f[:, 0], f[:, 1], f[:, 2].astype(np.uint8), body))
                    size += len(body) + 32 * len(f)
                if size > 4 << 20:
                    yield blobs()
                    held, size = {}, 0
        if held:
            yield blobs()

    return open_.select("_uid", "_ord", "text", "runs").mapInArrow(run, _BODIES)


def _compare(blobs: DataFrame, window: int) -> DataFrame:
    """Spans of windows of unlike runs that some other run of the same anchor holds too."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        cat = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in f[c]])
        anchor, uid, ord_, first, count, settled = (cat(c, t) for c, t in (("anchor", np.int32), ("uid", np.int64), ("ord", np.int64), ("first", np.int32), ("count", np.int32), ("settled", np.uint8)))
        body = np.frombuffer(b"".join(f["bytes"]), np.uint8)
        size = count.astype(np.int64) - 1 + window
        begin = np.cumsum(size) - size
        order = np.lexsort((first, uid, ord_, anchor))
        edge = np.append(np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1])), order.size)
        out = []
        a = 0
        while a < edge.size - 1:
            b, total = a + 1, int(size[order[edge[a] : edge[a + 1]]].sum())
            while b < edge.size - 1 and total + int(size[order[edge[b] : edge[b + 1]]].sum()) <= BYTES_PER_ARRAY:
                total += int(size[order[edge[b] : edge[b + 1]]].sum())
                b += 1
            out.append(_marked(body, begin, size, count, first, settled, order[edge[a] : edge[b]], window))
            a = b
        run_, spans = (np.concatenate([o[i] for o in out]) for i in range(2))
        return win._by_uid(uid[run_], ord_[run_], 0, spans, int(f["part"].iloc[0]))

    return blobs.groupBy("part").applyInPandas(run, win._FOUND)


def _marked(body, begin, size, count, first, settled, own, window):
    """Runs and spans of the windows of `own` runs that another of them holds too."""
    # a zero byte parts the runs; no valid window reaches it
    text = np.zeros(int(size[own].sum()) + own.size, np.uint8)
    at = np.cumsum(size[own] + 1) - (size[own] + 1)
    fill = np.ones(text.size, bool)
    fill[at + size[own]] = False
    src = np.repeat(begin[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))
    text[fill] = body[src]
    delta = np.zeros(text.size + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + count[own], -1)
    valid = np.cumsum(delta[:-1]) > 0
    hit = repeats(text, valid, window)
    which = np.repeat(np.arange(own.size), count[own])
    place = np.arange(which.size) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
    ok = hit[at[which] + place] & (settled[own][which] == 0)
    which, place = which[ok], place[ok]
    fresh = np.append(True, (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)) if which.size else np.zeros(0, bool)
    s = np.flatnonzero(fresh)
    e = np.append(s[1:], which.size) - 1 if s.size else s
    start = first[own][which[s]].astype(np.int64) + place[s]
    return own[which[s]], np.stack([start, first[own][which[e]] + place[e] + window], 1).reshape(-1, 2)


def _repeated(own: DataFrame, window: int) -> DataFrame:
    """Spans (kind 0) of the windows of own that also start elsewhere in it."""
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blobs = win.stored(win.sorted_runs(own, byte_units, window, GRAM, win.part_count(size, window, GRAM, 200_000)), "runs")
    found = win.stored(win.settle(blobs, window, False), "settled")
    discard(blobs)
    compared = win.stored(_compare(_bodies(win.fetch(found, own), window), window), "compared")
    return found.where("kind = 0").unionByName(compared)


def _stretches(own: DataFrame, found: DataFrame, shorter: int, window: int) -> DataFrame:
    """own with _within: the stretches of `window` bytes or more that repeated windows of `shorter` bytes cover; others go.

    A window that is elsewhere is made of shorter ones that are, so no repeat lies outside of these.
    """
    spans = found.groupBy(F.col("uid").alias("_uid"), F.col("ord").alias("_ord")).agg(F.collect_list("fields").alias("s"))

    def run(batches):
        for b in batches:
            covers = [win.cover(x.as_py(), 1 << 40, shorter) for x in b.column(2)]
            longer = [c[c[:, 1] - c[:, 0] >= window].tobytes() for c in covers]
            keep = pa.array([bool(x) for x in longer])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([x for x in longer if x], pa.binary())], names=["_uid", "_ord", "_within"])

    within = win.stored(spans.mapInArrow(run, "_uid long, _ord long, _within binary"), "within")
    keys = within.select("_uid", "_ord")
    if (small := if_small(keys)) is not keys:  # then no other text is shuffled
        own = own.join(small, ["_uid", "_ord"], "left_semi")
    return own.join(within, ["_uid", "_ord"])


def dedup(docs: DataFrame, window: int = WINDOW, notice: int | None = None) -> DataFrame:
    """docs with _n_bytes, _n_removed, _removed (binary: maximal removed spans as pairs of 64-bit numbers), _kept (binary)
    and _n_shared.

    A byte of the UTF-8 text goes if a `window`-byte string covers it that also starts anywhere else, the same document
    included; no copy stays. With `notice`, _n_shared is the number of bytes that strings of that length cover which are
    elsewhere too: passages too short to go are told of that way. Without, it is _n_removed. Null and empty text has no
    bytes. Repeated rows are copies of each other. An empty table gives an empty one.
    """
    own = win.keyed(docs)
    later, whole = win.copies(own, False)
    own, seen = win.without(own, later), None
    if notice and notice < window:
        seen = _repeated(own, notice)
        own = materialize(_stretches(own, seen, notice, window), "stretches")
    found = _repeated(own, window).unionByName(whole)
    if seen is not None:
        found = found.unionByName(seen.unionByName(whole).withColumn("kind", F.lit(3)))
    kept = [c for c in docs.columns if c not in {"_n_bytes", "_n_removed", "_removed", "_kept", "_n_shared", "_uid", "_ord", "_spans", "_noticed", "_u", "_o"}]
    spans = win.with_spans(docs.select(*kept, *win.identity(docs)), found)
    at, names = kept.index("text"), [*kept, "_n_bytes", "_n_removed", "_removed", "_kept", "_n_shared"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                b = whole.slice(a, 500)
                out = [[], [], [], [], []]
                for text, s, n in zip(b.column(at), b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                    t = (text.as_py() or "").encode()
                    c = win.cover(s.as_py(), len(t), window)
                    edge = [0, *c.ravel().tolist(), len(t)]
                    gone = int((c[:, 1] - c[:, 0]).sum())
                    shared = win.cover(n.as_py(), len(t), notice) if seen_too else None
                    for o, v in zip(out, (len(t), gone, c.tobytes(), b"".join(t[edge[i] : edge[i + 1]] for i in range(0, len(edge), 2)), int((shared[:, 1] - shared[:, 0]).sum()) if seen_too else gone)):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array(o, t) for o, t in zip(out, kinds)]], names=names)

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    seen_too = seen is not None
    schema = StructType([*docs.select(*kept).schema.fields, StructField("_n_bytes", LongType()), StructField("_n_removed", LongType()), StructField("_removed", BinaryType()), StructField("_kept", BinaryType()), StructField("_n_shared", LongType())])
    return spans.select(*kept, "_spans", "_noticed").mapInArrow(run, schema)


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), (F.octet_length("_removed") / 16).cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, encode(COALESCE(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)
), hit AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1
), runs AS (
  SELECT doc_id, r, min(i) AS s, max(i) + 399 AS e FROM (SELECT doc_id, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r
), per AS (
  SELECT doc_id, sum(e - s + 1) AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE list_reduce(list_transform(range(0, n_spans + 1), lambda k: b[(CASE WHEN k = 0 THEN 1 ELSE es[k] + 1 END):(CASE WHEN k = n_spans THEN octet_length(b) ELSE ss[k + 1] - 1 END)]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
