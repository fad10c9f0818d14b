"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, kept as flat neighbour
arrays; shard results are merged.

Nearness is the largest inner product. Within a shard vectors get one more component that makes all lengths equal,
so that the nearest in distance is the largest in product. Searches run for many queries at once over the arrays.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches
from tessera.llm.vectors import stack, usable

SHARD_ROWS = 8192
M, EF_BUILD, EF_SEARCH, WIDTH = 16, 96, 320, 4
QUERIES_PER_BLOCK, BLOCKS_PER_LOAD = 1024, 16
#: Shards are built in at most so many tasks.
MAX_TASKS = 20_000


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef nearest nodes found from its start node: ids (-1: none) and squared distances, nearest first.

    In each step every query opens its `width` nearest unopened nodes.
    """
    m, sq = len(q), (x * x).sum(1)
    seen = np.zeros((m, len(x) + 1), bool)
    ids = np.full((m, ef), -1, np.int32)
    dist = np.full((m, ef), np.inf, np.float32)
    fresh = np.zeros((m, ef), bool)
    ids[:, 0], fresh[:, 0] = start, True
    qq = (q * q).sum(1)
    dist[:, 0] = sq[start] - 2 * np.einsum("ij,ij->i", x[start], q) + qq
    seen[np.arange(m), start] = True
    live = np.arange(m)
    while live.size:
        w = min(width, ef)
        waiting = np.where(fresh[live], dist[live], np.inf)
        pick = np.argpartition(waiting, w - 1, axis=1)[:, :w] if w < ef else np.argsort(waiting, axis=1)
        good = np.isfinite(np.take_along_axis(waiting, pick, 1))
        rows = good.any(1)
        live, pick, good = live[rows], pick[rows], good[rows]
        if not live.size:
            break
        at = np.repeat(live, w).reshape(-1, w)
        fresh[at[good], pick[good]] = False
        nodes = np.where(good, ids[at, pick], -1)
        new = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(live.size, -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1  # -1 is the last column of seen, which stays unset
        seen[live[:, None], new] = True
        seen[:, -1] = False
        d = sq[new] - 2 * np.matmul(x[new], q[live][:, :, None])[:, :, 0] + qq[live][:, None]
        d[new < 0] = np.inf
        ids_, dist_, fresh_ = np.concatenate([ids[live], new], 1), np.concatenate([dist[live], d], 1), np.concatenate([fresh[live], new >= 0], 1)
        keep = np.argpartition(dist_, ef - 1, axis=1)[:, :ef]
        ids[live], dist[live], fresh[live] = np.take_along_axis(ids_, keep, 1), np.take_along_axis(dist_, keep, 1), np.take_along_axis(fresh_, keep, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def choose(x: np.ndarray, at: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of the nodes `at` from cand (-1: none): nearest first, passing over such as lie nearer to one that
    is already chosen; places left over go to the nearest of those."""
    n, c = cand.shape
    v = x[cand]
    own = x[at][:, None, :]
    d = ((v - own) ** 2).sum(2)
    d[(cand < 0) | (cand == at[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    gram = np.matmul(v, v.transpose(0, 2, 1))
    s = np.einsum("ncc->nc", gram)
    apart = s[:, :, None] + s[:, None, :] - 2 * gram
    taken = np.zeros((n, c), bool)
    for j in range(c):
        nearest = np.where(taken[:, :j], apart[:, j, :j], np.inf).min(1) if j else np.full(n, np.inf)
        taken[:, j] = np.isfinite(d[:, j]) & (d[:, j] < nearest) & (taken[:, :j].sum(1) < most)
    rank = np.where(np.isfinite(d), np.where(taken, 0, 1), 2) * c + np.arange(c)
    pick = np.argsort(rank, axis=1)[:, :most]
    out = np.where(np.isfinite(np.take_along_axis(d, pick, 1)), np.take_along_axis(cand, pick, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)


def _link_back(x: np.ndarray, near: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """The chosen neighbours get links back; where there is no room, they choose anew."""
    src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((nodes.size, int(count.max(initial=0))), -1, np.int32)
    extra[np.repeat(np.arange(nodes.size), count), np.arange(dst.size) - np.repeat(first, count)] = src
    degree = (near[nodes] >= 0).sum(1)
    for i in np.flatnonzero(degree + count <= near.shape[1]):
        near[nodes[i], degree[i] : degree[i] + count[i]] = extra[i, : count[i]]
    full = np.flatnonzero(degree + count > near.shape[1])
    for at in range(0, full.size, 128):
        f = full[at : at + 128]
        near[nodes[f]] = choose(x, nodes[f], np.concatenate([near[nodes[f]], extra[f]], 1), near.shape[1])


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 11) -> dict:
    """The graph of one shard: x (lengths made equal), one flat neighbour array per level, the entry node.

    Nodes go in by batches that double, up to 256: a batch searches the graph so far and itself.
    """
    n = len(vectors)
    sq = (vectors.astype(np.float64) ** 2).sum(1)
    x = np.hstack([vectors, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]]).astype(np.float32)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(m)).astype(int), 4)
    order = np.argsort(-level, kind="stable")  # the few nodes of high levels go first, so that the entry never moves
    rest = np.random.default_rng(seed + 1).permutation(np.arange(min(64, n), n))
    order = np.concatenate([order[:64], order[rest]]) if n > 64 else order
    top = int(level.max(initial=0))
    near = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)]
    entry, done = int(order[0]) if n else -1, 0
    while done < n:
        size = min(256, max(64, done), n - done)
        new = order[done : done + size]
        start = np.full(size, entry, np.int64)
        for k in range(top, -1, -1):
            joins = np.flatnonzero(level[new] >= k)
            if done:
                ids, _ = beam(x, near[k], x[new], start, ef if joins.size else 4)
                start = ids[:, 0].astype(np.int64)
            else:
                ids = np.full((size, 1), -1, np.int32)
            if not joins.size:
                continue
            own = new[joins]
            among = ((x[own][:, None, :] - x[own][None, :, :]) ** 2).sum(2) if own.size <= 64 else (sq_ := (x[own] ** 2).sum(1))[:, None] + sq_[None, :] - 2 * x[own] @ x[own].T
            np.fill_diagonal(among, np.inf)
            mates = own[np.argsort(among, axis=1)[:, : min(m, own.size - 1)]] if own.size > 1 else np.zeros((1, 0), int)
            cand = np.concatenate([ids[joins], mates], 1).astype(np.int32)
            chosen = np.concatenate([choose(x, own[a : a + 64], cand[a : a + 64], near[k].shape[1] // (2 if k == 0 else 1)) for a in range(0, own.size, 64)])
            near[k][own, : chosen.shape[1]] = chosen
            _link_back(x, near[k], own, chosen)
        done += size
    return {"x": x, "near": near, "entry": entry}


def search(graph: dict, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
    """For each query the k nodes of largest product found, -1 where there are fewer."""
    x, near = graph["x"], graph["near"]
    out = []
    for at in range(0, len(q), 256):
        p = np.hstack([q[at : at + 256], np.zeros((len(q[at : at + 256]), 1))]).astype(np.float32)
        start = np.full(len(p), graph["entry"], np.int64)
        for level in range(len(near) - 1, 0, -1):
            start = beam(x, near[level], p, start, 8)[0][:, 0].astype(np.int64)
        out.append(beam(x, near[0], p, start, max(ef, k))[0][:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int32)


def _packed(**arrays) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: shard, index (flat arrays). rows: vec_id, embedding; other columns are not looked at.

    Equal vectors are one node that keeps the k + 1 smallest ids, which is all that k results for any query can use.
    A shard gets its vectors by a hash, about shard_rows of them. Rows without id, and vectors that are null, zero or hold
    null or non-finite components, are in no shard; shorter vectors are filled with zeros. An empty table has no shard.
    """
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda v: v != 0))
    good = good.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    first = good.withColumn("n", F.row_number().over(W.partitionBy("e").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    nodes = materialize(first.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(first=f["ids"].map(lambda v: v[0])).sort_values("first", kind="stable")
        e = stack([np.asarray(v, np.float64).tobytes() for v in f["e"]], np.float64)
        g = build(e)
        ids = [np.asarray(v, np.int64) for v in f["ids"]]
        arrays = {f"near{i}": a for i, a in enumerate(g["near"])}
        blob = _packed(e=e, x=g["x"], entry=np.array(g["entry"]), levels=np.array(len(g["near"])), ids=np.concatenate(ids), start=np.cumsum([0, *map(len, ids)]), **arrays)
        return pd.DataFrame({"shard": [int(f["shard"].iloc[0])], "index": [blob]})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("e", F.lit("shard")), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(min(2 * shards, MAX_TASKS), "shard")  # a shard is seconds of work, so tasks are not coalesced
    return materialize(dealt.groupBy("shard").applyInPandas(run, "shard int, index binary"), "index")


def nearest(queries: DataFrame, shards: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: each query against all shards, in blocks of queries, merged. A task loads one shard for
    up to BLOCKS_PER_LOAD blocks. Work grows with queries times shards.

    Ties go to the smaller vec_id; the query's own id is left out. Queries whose vector is null, zero or not finite
    have no results; repeated queries count once. With no shard there is no result.
    """
    small_batches(queries.sparkSession)
    good = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda v: v != 0))
    good = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("e"))
    blocks = max(1, -(-good.count() // QUERIES_PER_BLOCK))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        e = stack([np.asarray(v, np.float64).tobytes() for v in f["e"]], np.float64)
        return pd.DataFrame({"block": [int(f["block"].iloc[0])], "queries": [_packed(e=e, ids=f["vec_id"].to_numpy())]})

    asked = good.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, queries binary")
    last = shards.agg(F.max("shard")).first()[0]
    load = F.floor(F.col("block") / BLOCKS_PER_LOAD).cast("int")
    asked = asked.select("queries", load.alias("load"), (F.lit(-1) if last is None else F.explode(F.sequence(F.lit(0), F.lit(last)))).alias("shard"))
    shards = shards.select("shard", "index", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_PER_LOAD))).alias("load"))
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def run(asked_: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asked_) or not len(shard):
            return none
        s = np.load(io.BytesIO(shard["index"].iloc[0]))
        e, ids, start = s["e"], s["ids"], s["start"]
        g = {"x": s["x"], "entry": int(s["entry"]), "near": [s[f"near{i}"] for i in range(int(s["levels"]))]}
        rows = []
        for own in asked_["queries"]:
            q = np.load(io.BytesIO(own))
            qe, qid = q["e"], q["ids"]
            fit = np.zeros((len(qe), e.shape[1]))
            fit[:, : min(qe.shape[1], e.shape[1])] = qe[:, : e.shape[1]]
            found = search(g, fit, k + 1, ef)
            score = np.einsum("qd,qkd->qk", fit, e[found])
            for i in range(len(qid)):
                ok = found[i] >= 0
                at, sc = found[i][ok], score[i][ok]
                many = start[at + 1] - start[at]
                members = np.concatenate([ids[start[a] : start[a + 1]] for a in at]) if at.size else np.zeros(0, np.int64)
                sc = np.repeat(sc, many)
                keep = members != qid[i]
                members, sc = members[keep], sc[keep]
                order = np.lexsort((members, -sc))[:k]
                rows.append((np.full(order.size, qid[i]), members[order], sc[order]))
        return pd.DataFrame({c: np.concatenate([r[n] for r in rows]) for n, c in enumerate(("query_id", "vec_id", "score"))})

    found = asked.groupBy("shard", "load").cogroup(shards.groupBy("shard", "load")).applyInPandas(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows.where(F.col("vec_id") % 20 == 0), index(rows, 20), 20)
