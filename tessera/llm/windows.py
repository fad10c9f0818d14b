"""Repeated windows of a fixed length, found through anchors.

A window of W units is anchored at the least hash of the k-grams in it (the leftmost of equals), which depends on the
window alone, so equal windows have equal anchors. Consecutive windows with one anchor are a run. Runs are dealt by
the hash of their anchor: equal runs settle all their windows at once, anchors with a single run have no repeats, and
only unlike runs of one anchor remain to be compared window by window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import if_small, materialize, mix64, small_batches, tidy

PLACE = np.uint64((1 << 28) - 1)
_R = 0x9E3779B97F4A7C15 | 1
_RI = pow(_R, -1, 1 << 64)
RUNS_PER_PART = 1_000_000
#: Longer texts are looked at in stretches of so many windows: a place takes 28 bits, and memory stays bounded.
STRETCH = 1 << 22


@lru_cache(maxsize=12)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, np.uint64(_R)), np.full(n, np.uint64(_RI))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def runs(units: np.ndarray, window: int, k: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sequence of 64-bit units: anchor hash, hash of all units of the run, first window and number of windows.

    Each window is in one run. The anchor of a window depends on nothing else, so a run that two stretches share becomes
    two with one anchor, and these are compared with others window by window.
    """
    n = units.size - window + 1
    if n > stretch:
        each = [(a, runs(units[a : min(a + stretch, n) - 1 + window], window, k, stretch)) for a in range(0, n, stretch)]
        return tuple(np.concatenate([r[i] + a if i == 2 else r[i] for a, r in each]) for i in range(4))
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    size = 1 << max(12, int(units.size).bit_length())
    up, down = (p[: units.size + 1] for p in _powers(size))
    total = np.zeros(units.size + 1, np.uint64)
    np.cumsum(units * up[:-1], dtype=np.uint64, out=total[1:])
    gram = mix64((total[k:] - total[:-k]) * down[: units.size + 1 - k])
    least = (gram & ~PLACE) | np.arange(gram.size, dtype=np.uint64)
    span, step = window - k + 1, 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: least.size - (span - step)], least[span - step :])
    at = (least & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(np.append(first, n))
    end = first + count - 1 + window
    body = mix64((total[end] - total[first]) * down[first] ^ mix64(count.astype(np.uint64)))
    return gram[at[first]], body, first, count


def keyed(docs: DataFrame) -> DataFrame:
    """_uid, _ord, text: a row is known by its doc_id (null: the least number, so first) and a hash of doc_id and text, by
    both together: unlike rows are only taken for one if they share their doc_id and 64 bits of hash."""
    small_batches(docs.sparkSession)
    return docs.select(*identity(docs), F.col("text"))


def identity(docs: DataFrame) -> list[Column]:
    return [F.xxhash64(docs["doc_id"], docs["text"]).alias("_uid"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("_ord")]


_RUNS = "part int, batch long, anchor binary, body binary, local binary, first binary, count binary, uid binary, ord binary"


def sorted_runs(docs: DataFrame, to_units, window: int, k: int, parts: int, batch: int = 0) -> DataFrame:
    """Blobs by part of the anchor space, each sorted by anchor and run: immutable once written.

    docs may have a column _within (packed starts and ends, in units): only windows inside one of these stretches count.
    """
    within, stretch = "_within" in docs.columns, STRETCH

    def of_text(text: str, stretches: bytes | None):
        units = to_units(text.encode())
        if stretches is None:
            return runs(units, window, k, stretch)
        found = []
        for a, b in np.frombuffer(stretches, np.int64).reshape(-1, 2).tolist():
            one = runs(units[a:b], window, k, stretch)
            found.append((*one[:2], one[2] + a, one[3]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches):
        held, docs_, total = [], [], 0

        def blobs():
            anchor, body, first, count = (np.concatenate([h[i] for h in held]) for i in range(4))
            local = np.repeat(np.arange(len(held)), [h[0].size for h in held])
            uid, order_ = (np.array([d[i] for d in docs_], np.int64) for i in range(2))
            part = (anchor % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((body, anchor, part))
            part = part[order]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            out = []
            for a, b in zip(edge, np.append(edge[1:], part.size)):
                o = order[a:b]
                own, at = np.unique(local[o], return_inverse=True)
                out.append((int(part[a]), batch, (anchor[o] >> np.uint64(32)).astype(np.uint32).tobytes(), body[o].tobytes(), at.astype(np.uint16).tobytes(), first[o].astype(np.int32).tobytes(), count[o].astype(np.uint16).tobytes(), uid[own].tobytes(), order_[own].tobytes()))
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _RUNS.split(", ")])

        for b in batches:
            for uid, order, text, *stretches in zip(*b.columns):
                text = text.as_py()
                if not text:
                    continue
                found = of_text(text, stretches[0].as_py() if within else None)
                if found[0].size:
                    held.append(found)
                    docs_.append((uid.as_py(), order.as_py()))
                    total += found[0].size
                    if total > 300_000 or len(held) == 65_535:
                        yield blobs()
                        held, docs_, total = [], [], 0
        if held:
            yield blobs()

    return docs.select("_uid", "_ord", "text", *["_within"] * within).mapInArrow(run, _RUNS)


def _by_uid(uid: np.ndarray, ord_: np.ndarray, kind: int, fields: np.ndarray, part: int) -> pd.DataFrame:
    """One row per document: its rows of fields, packed as 32-bit numbers."""
    order = np.lexsort((uid, ord_))
    uid, ord_, fields = uid[order], ord_[order], np.ascontiguousarray(fields[order].astype(np.int32))
    edge = np.flatnonzero(np.append(True, (uid[1:] != uid[:-1]) | (ord_[1:] != ord_[:-1]))) if uid.size else np.zeros(0, int)
    ends = np.append(edge[1:], uid.size)
    return pd.DataFrame({"uid": uid[edge], "ord": ord_[edge], "kind": np.int32(kind), "part": np.int32(part), "fields": [fields[a:b].tobytes() for a, b in zip(edge, ends)]})


def _documents(uid: np.ndarray, ord_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct documents of rows, and the place of each row's."""
    order = np.lexsort((uid, ord_))
    u, o = uid[order], ord_[order]
    new = np.append(True, (u[1:] != u[:-1]) | (o[1:] != o[:-1])) if u.size else np.zeros(0, bool)
    place = np.empty(u.size, np.int64)
    place[order] = np.cumsum(new) - 1
    return u[new], o[new], place


_FOUND = "uid long, ord long, kind int, part int, fields binary"


_HEAD = np.dtype([("anchor", "<u4"), ("body", "<u8"), ("age", "<i8"), ("ord", "<i8"), ("uid", "<i8"), ("first", "<i4"), ("count", "<u2"), ("many", "u1")])


def _loaded(f: pd.DataFrame, among: np.ndarray | None = None) -> np.ndarray:
    """The runs of blobs, one record each; with among (sorted anchors), those of these anchors only. Blobs are sorted by
    anchor, so each is merged with `among`, and what has no match is dropped before anything else is read."""
    out = []
    for anchor, *rest, batch in zip(*(f[c] for c in ("anchor", "body", "local", "first", "count", "uid", "ord", "batch"))):
        anchor = np.frombuffer(anchor, np.uint32)
        at = slice(None)
        if among is not None:
            lo, hi = np.searchsorted(anchor, among, "left"), np.searchsorted(anchor, among, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        body, local, first, count, uid, ord_ = (np.frombuffer(x, t) for x, t in zip(rest, (np.uint64, np.uint16, np.int32, np.uint16, np.int64, np.int64)))
        own = np.zeros(anchor[at].size, _HEAD)
        own["anchor"], own["body"], own["first"], own["count"], own["age"] = anchor[at], body[at], first[at], count[at], batch
        own["uid"], own["ord"] = uid[local[at]], ord_[local[at]]
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, _HEAD)


def _heads(runs_: np.ndarray, alone: bool = True) -> np.ndarray:
    """The earliest run of each anchor and body; many: there are several. Unless alone, anchors of a single run are left out."""
    if not alone and runs_.size:
        at = np.argsort(runs_["anchor"], kind="stable")
        a = runs_["anchor"][at]
        shared = np.zeros(a.size, bool)
        shared[1:] = a[1:] == a[:-1]
        shared[:-1] |= shared[1:]
        shared |= runs_["many"][at] > 0
        runs_ = runs_[at[shared]]
    r = runs_[np.lexsort([runs_[k] for k in ("first", "uid", "ord", "age", "body", "anchor")])]
    new = np.append(True, (r["anchor"][1:] != r["anchor"][:-1]) | (r["body"][1:] != r["body"][:-1])) if r.size else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    out = r[lead]
    if lead.size:
        out["many"] = (np.diff(np.append(lead, r.size)) > 1) | np.maximum.reduceat(r["many"], lead)
    return out


def _unlike(heads: np.ndarray, keep_first: bool, batch: int) -> np.ndarray:
    """Heads whose anchor has other bodies, one of them new in `batch`; where no first run stays, only if one of these has a
    single run."""
    if not heads.size:
        return heads
    group = np.cumsum(np.append(True, heads["anchor"][1:] != heads["anchor"][:-1])) - 1
    ok = ((np.bincount(group) > 1) & (np.bincount(group, weights=heads["age"] == batch) > 0))[group]
    return heads[ok if keep_first else ok & (np.bincount(group, weights=heads["many"] == 0) > 0)[group]]


def _open_rows(heads: np.ndarray, keep_first: bool, batch: int, part: int) -> pd.DataFrame:
    o = _unlike(heads, keep_first, batch)
    return _by_uid(o["uid"], o["ord"], 1, np.stack([o["first"], o["count"].astype(np.int32), o["many"].astype(np.int32), o["anchor"].copy().view(np.int32)], 1), part)


def _repeat_rows(runs_: np.ndarray, heads: np.ndarray, window: int, keep_first: bool, batch: int, part: int) -> pd.DataFrame:
    """Spans of the runs of `batch` that are repeats, given the heads."""
    key = lambda x: mix64(x["body"] ^ mix64(x["anchor"].astype(np.uint64)))
    hk = key(heads)
    order = np.argsort(hk, kind="stable")
    hk, heads = hk[order], heads[order]
    k = key(runs_)
    at = np.minimum(np.searchsorted(hk, k), max(hk.size - 1, 0))
    hit = hk[at] == k if hk.size else np.zeros(k.size, bool)
    h = heads[at] if hk.size else runs_
    if keep_first:  # a repeated row is the same document, so it is no earlier than itself
        hit &= ~((runs_["ord"] == h["ord"]) & (runs_["uid"] == h["uid"]) & (runs_["first"] == h["first"]) & (runs_["age"] == h["age"]))
    else:
        hit &= h["many"] > 0
    r = runs_[hit & (runs_["age"] == batch)]
    return _by_uid(r["uid"], r["ord"], 0, np.stack([r["first"], r["first"] + r["count"].astype(np.int64) - 1 + window], 1), part)


def settle(blobs: DataFrame, window: int, keep_first: bool, batch: int = 0, most: int = 4 * RUNS_PER_PART) -> DataFrame:
    """Merge the sorted runs of each part: those of earlier batches are merged with the anchors of `batch`, and only what
    meets one goes on. kind 0: spans (start, end) all of whose windows are repeats, of documents of `batch`; kind 1: runs
    (first, count, several, anchor) to compare by window, one of each body, of any batch, if one of the anchor is new.

    keep_first: of equal windows the earliest (by batch, doc_id, place) stays; else all are repeats. blobs should be
    written. A part is one group; if one holds more than `most` runs, as a group of near copies can make it, all parts
    are dealt to several tasks, which first agree on the earliest run of each body.
    """
    largest = blobs.groupBy("part").agg(F.sum(F.octet_length("anchor") / 4).alias("n")).agg(F.max("n")).first()[0] or 0
    deal = -(-int(largest) // most)

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        part, new = int(f["part"].iloc[0]), (f["batch"] == batch).to_numpy()
        own = _loaded(f[new])
        old = _loaded(f[~new], np.unique(own["anchor"]))
        heads = _heads(np.concatenate([old, own]), alone=False)
        return pd.concat([_repeat_rows(own, heads, window, keep_first, batch, part), _open_rows(heads, keep_first, batch, part)])

    if deal <= 1:
        return blobs.groupBy("part").applyInPandas(whole, _FOUND)

    def summary(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [f["part"].iloc[0]], "heads": [_heads(_loaded(f)).tobytes()]})

    def agreed(f: pd.DataFrame) -> pd.DataFrame:
        part = int(f["part"].iloc[0])
        heads = _heads(np.concatenate([np.frombuffer(h, _HEAD) for h in f["heads"]]), alone=False)
        return pd.concat([pd.DataFrame({"uid": [0], "ord": [0], "kind": [2], "part": [part], "fields": [heads.tobytes()]}), _open_rows(heads, keep_first, batch, part)])

    def flagged(f: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(h):
            return pd.DataFrame({"uid": [], "ord": [], "kind": [], "part": [], "fields": []})
        return _repeat_rows(_loaded(f), np.frombuffer(h["fields"].iloc[0], _HEAD), window, keep_first, batch, int(f["part"].iloc[0]))

    dealt = blobs.withColumn("salt", F.pmod(F.xxhash64("body", "uid"), F.lit(deal)).cast("int"))
    told = materialize(dealt.groupBy("part", "salt").applyInPandas(summary, "part int, heads binary").groupBy("part").applyInPandas(agreed, _FOUND), "heads")
    heads = told.where("kind = 2").select("part", "fields", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("salt"))
    spans = dealt.groupBy("part", "salt").cogroup(heads.groupBy("part", "salt")).applyInPandas(flagged, _FOUND)
    return spans.unionByName(told.where("kind = 1"))


def fetch(found: DataFrame, docs: DataFrame) -> DataFrame:
    """docs that have runs to compare, with runs (array of part and packed fields). found should be written."""
    own = found.where("kind = 1").groupBy(F.col("uid").alias("_uid"), F.col("ord").alias("_ord")).agg(F.collect_list(F.struct("part", "fields")).alias("runs"))
    keys = own.select("_uid", "_ord")
    if (small := if_small(keys)) is not keys:  # then no other text is shuffled
        docs = docs.join(small, ["_uid", "_ord"], "left_semi")
    return docs.join(own, ["_uid", "_ord"])


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (with _uid and _ord) with _spans (of kind 0) and _noticed (of kind 3): packed spans, in any order."""
    told = [F.collect_list(F.when(F.col("kind") == k, F.col("fields"))).alias(c) for k, c in ((0, "_spans"), (3, "_noticed"))]
    own = found.where("kind IN (0, 3)").groupBy(F.col("uid").alias("_u"), F.col("ord").alias("_o")).agg(*told)
    return docs.join(own, (docs["_uid"] == F.col("_u")) & (docs["_ord"] == F.col("_o")), "left").drop("_u", "_o")


def copies(own: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """(_uid, _ord of rows that need no look of their own; found rows of whole texts), settled by 128 bits of a hash of the
    text.

    One row of each group of equal texts, the first, stands for all. With keep_first the others are repeats from end to
    end; else all of the group are. However large a group is, it is only counted.
    """
    key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("copy"), F.col("text")).alias("h2")]
    keyed_ = own.where(F.octet_length("text") > 0).select("_uid", "_ord", *key)
    groups = keyed_.groupBy("h1", "h2").agg(F.min(F.struct("_ord", "_uid")).alias("f"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", F.col("f._uid").alias("_u"), F.col("f._ord").alias("_o"))
    members = materialize(keyed_.join(if_small(materialize(groups, "groups")), ["h1", "h2"]).select("_uid", "_ord", ((F.col("_uid") == F.col("_u")) & (F.col("_ord") == F.col("_o"))).alias("first")).distinct(), "members")
    later = members.where("NOT first").select("_uid", "_ord")
    whole = later if keep_first else members
    end = F.unhex(F.lit("00000000FFFFFF7F"))  # from 0 to the largest number, little-endian
    return later, whole.select(F.col("_uid").alias("uid"), F.col("_ord").alias("ord"), F.lit(0).alias("kind"), F.lit(-1).alias("part"), end.alias("fields"))


def without(own: DataFrame, later: DataFrame) -> DataFrame:
    return own.join(if_small(later), ["_uid", "_ord"], "left_anti")


def cover(spans: list[bytes] | None, size: int, window: int) -> np.ndarray:
    """Maximal runs (start, end) that packed spans cover in a text of `size` units, in order."""
    if not spans or size < window:
        return np.zeros((0, 2), np.int64)
    s = np.minimum(np.concatenate([np.frombuffer(x, np.int32) for x in spans]).reshape(-1, 2).astype(np.int64), size)
    s = s[np.argsort(s[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    fresh = np.append(True, s[1:, 0] > end[:-1])
    edge = np.flatnonzero(fresh)
    return np.stack([s[edge, 0], end[np.append(edge[1:], len(s)) - 1]], 1)


def part_count(units: int, window: int, k: int, per_part: int) -> int:
    return max(12, -(-int(units * 2 / (window - k + 2)) // per_part))


def stored(df: DataFrame, name: str) -> DataFrame:
    out = materialize(df, name)
    tidy(df.sparkSession)
    return out
