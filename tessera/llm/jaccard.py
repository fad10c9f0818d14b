"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set is its distinct word n-grams. Equal sets are one node. Two sets can only reach the threshold if
their sizes are close and if they share one of their first tokens in a common order (frequent ones last), so tokens
deal the sets into tiles. In a tile only sets of compatible size meet; the counts of bits that only one of their
bitmaps has bound the overlap from above; what is left is decided by intersecting sorted arrays.

A tile would give all pairs of a group of copies. So each set first meets one hub of its size band in the tile; sets
that verified links have joined by then need no further comparison, and only pairs across components go on, blocks
of size-sorted sets against blocks of compatible size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, if_small, materialize, mix64, ngram_hashes, small_batches, text_batches, tidy, word_hashes
from tessera.llm.components import components

WORDS, SIMILAR = 5, (75, 100)
ENTRIES_PER_TILE, BLOCK = 2_000_000, 1024
#: So many of the most frequent shingles are put last in the common order. Any order is exact; this one is fast.
FREQUENT = 200_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; of fewer words, one hash of them all."""
    out: list[np.ndarray] = []
    for a, b in text_batches(texts):
        part = texts[a:b]
        start, _, words = word_hashes(np.frombuffer(b"\n".join(part).translate(LOWER), np.uint8))
        edge = np.cumsum([0] + [len(t) + 1 for t in part])
        first = np.searchsorted(start, edge)
        grams = ngram_hashes(words, n)
        for i in range(len(part)):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                h = np.sort(grams[lo : hi - n + 1])
                out.append(h[np.append(True, h[1:] != h[:-1])])
            else:
                out.append(ngram_hashes(words[lo:hi], int(hi - lo), 7 + int(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out


def set_key(h: np.ndarray) -> int:
    """The node of a set: a hash of it, as a signed long."""
    return int(mix64(mix64(h).sum(keepdims=True) + np.uint64(h.size)).astype(np.int64)[0])


def set_check(h: np.ndarray) -> int:
    """64 further bits of a set: sets of one node that differ in these are told apart."""
    return int(mix64(mix64(h ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) * np.uint64(0xDA942042E4DD58B5) + np.uint64(h.size)).astype(np.int64)[0])


def node_of(h: np.ndarray, moved: dict[tuple[int, int], int]) -> int:
    """The node of a set; moved holds those of sets whose key another set has too."""
    key = set_key(h)
    return moved.get((key, set_check(h)), key) if moved else key


def bitmap(h: np.ndarray) -> bytes:
    """A signature of 4 to 8 bits an element, at least 64 bits; sets of compatible size differ by one doubling at most."""
    bits = 1 << max(6, int(4 * h.size - 1).bit_length())
    b = np.zeros(bits, np.uint8)
    b[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(b, bitorder="little").tobytes()


def _fold(b: np.ndarray, size: int) -> np.ndarray:
    while b.shape[-1] > size:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def may_link(na: int, a: bytes, nb: int, b: bytes, similar=SIMILAR) -> bool:
    """Whether the bits leave room for the overlap that the threshold needs."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(x.size, y.size)
    x, y = _fold(x, size), _fold(y, size)
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return linked(most, na, nb, similar)


def linked(both: int, na: int, nb: int, similar=SIMILAR) -> bool:
    return similar[1] * both >= similar[0] * (na + nb - both) and both > 0


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def cards(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """kind 0: doc_id, size, node and check of each row's set, with its bitmap; kind 1: size counts of the shingle in node.

    Shingles are counted over all rows, a stretch of sets at a time; those found once or twice in a stretch are not
    passed on, as only the order of the most frequent ones matters.
    """

    def run(batches):
        held, many = [], 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= 3].astype(np.int64), c[c >= 3]
            none = pa.nulls(h.size, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(h.size, np.int32)), none, pa.array(c), pa.array(h), none, pa.nulls(h.size, pa.binary())], names=names)

        names = ["kind", "doc_id", "size", "node", "check", "bits"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(_texts(batch, 1), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([set_check(s) for s in sets], pa.int64()), pa.array([bitmap(s) if s.size else None for s in sets], pa.binary())], names=names)
                held += sets
                many += sum(s.size for s in sets)
                if many > 1_000_000:
                    yield counted()
                    held, many = [], 0
        if many:
            yield counted()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, doc_id long, size long, node long, check long, bits binary")


def _prefix(h: np.ndarray, frequent: np.ndarray, similar) -> np.ndarray:
    """The first tokens of a set in the common order: so many that two linked sets share one of them."""
    need = h.size - -(-similar[0] * h.size // similar[1]) + 1
    rare = h
    if frequent.size:
        at = np.minimum(np.searchsorted(frequent, h), frequent.size - 1)
        often = frequent[at] == h
        rare = np.concatenate([h[~often], h[often]]) if often.any() else h
    return rare[:need]


def tiles(docs: DataFrame, frequent: np.ndarray, moved: dict, parts: int, n: int, similar) -> DataFrame:
    """Blobs of (token, set) by part of the token space. A set that a task has seen before is not sent again."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        seen: set[int] = set()
        nodes, sizes, tokens = [], [], []

        def blobs():
            which = np.repeat(np.arange(len(nodes)), [t.size for t in tokens]).astype(np.uint16)
            token = np.concatenate(tokens)
            part = (token % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, token, which = part[order], (token[order] >> np.uint64(32)).astype(np.uint32), which[order]
            ids, size = np.array(nodes, np.int64), np.array(sizes, np.int32)
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for a, b in zip(edge, np.append(edge[1:], part.size)):
                own, local = np.unique(which[a:b], return_inverse=True)
                rows.append((int(part[a]), token[a:b].tobytes(), local.astype(np.uint16).tobytes(), ids[own].tobytes(), size[own].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32()] + [pa.binary()] * 4)], names=["part", "token", "local", "nodes", "sizes"])

        total = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                for h in shingle_sets(_texts(whole.slice(at, 1000), 0), n):
                    if not h.size or (key := node_of(h, moved)) in seen:
                        continue
                    seen.add(key)
                    nodes.append(key)
                    sizes.append(h.size)
                    tokens.append(_prefix(h, shared.value, similar))
                    total += tokens[-1].size
                    if total > 600_000 or len(nodes) == 65_535:
                        yield blobs()
                        nodes, sizes, tokens, total = [], [], [], 0
        if nodes:
            yield blobs()

    return docs.select("text").mapInArrow(run, "part int, token binary, local binary, nodes binary, sizes binary")


def _meet(token: np.ndarray, size: np.ndarray, node: np.ndarray, similar):
    """Of the entries of a part, sorted by token and size: pairs of a hub with the others of its size band, and a mask
    of the entries of tiles that have further pairs.

    A band begins at the smallest set left and ends where sizes are no longer compatible with it, so all its sets are
    compatible. Its hub is the least node: tiles of one group of copies mostly choose the same.
    """
    if not token.size:
        return np.zeros((0, 2), np.int64), np.zeros(0, bool)
    edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    last = np.append(edge[1:], token.size)
    group = np.repeat(np.arange(edge.size), last - edge)
    # where each band of each tile begins: the first entry, and from there on the first that is too large
    start = np.zeros(token.size, bool)
    at = edge
    reach = size * similar[1] // similar[0]
    key = group.astype(np.int64) << np.int64(32) | size
    while at.size:
        start[at] = True
        nxt = np.searchsorted(key, group[at].astype(np.int64) << np.int64(32) | reach[at], "right")
        at = nxt[nxt < last[group[at]]]
    band = np.cumsum(start) - 1
    hub = np.minimum.reduceat(node, np.flatnonzero(start))[band]
    pairs = np.stack([np.minimum(hub, node), np.maximum(hub, node)], 1)[hub != node]
    members = last - edge
    return np.unique(pairs, axis=0), (members > 2)[group] | (np.bincount(group[start], minlength=edge.size) > 1)[group]


def _candidates(blobs: DataFrame, similar) -> DataFrame:
    """kind 0: pairs a, b; kind 1: entries of large tiles: a is the tile, b the node, size its size."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        token = np.concatenate([np.frombuffer(x, np.uint32) for x in f["token"]])
        node = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(i, np.uint16)] for n, i in zip(f["nodes"], f["local"])])
        size = np.concatenate([np.frombuffer(n, np.int32)[np.frombuffer(i, np.uint16)] for n, i in zip(f["sizes"], f["local"])]).astype(np.int64)
        order = np.argsort(token, kind="stable")
        t = token[order]
        shared = np.zeros(t.size, bool)
        shared[1:] = t[1:] == t[:-1]
        shared[:-1] |= shared[1:]
        order = order[shared]  # a token of one set joins nothing
        order = order[np.lexsort((node[order], size[order], token[order]))]
        token, node, size = token[order].astype(np.int64), node[order], size[order]
        fresh = np.ones(token.size, bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size = token[fresh], node[fresh], size[fresh]
        pairs, large = _meet(token, size, node, similar)
        part = np.int64(f["part"].iloc[0]) << np.int64(32)
        return pd.concat([pd.DataFrame({"kind": 0, "a": pairs[:, 0], "b": pairs[:, 1], "size": 0}), pd.DataFrame({"kind": 1, "a": token[large] + part, "b": node[large], "size": size[large]})])

    return blobs.groupBy("part").applyInPandas(run, "kind int, a long, b long, size long")


def _bounded(pairs: DataFrame, nodes: DataFrame, similar) -> DataFrame:
    """Pairs whose bitmaps leave room for a link, with the sizes."""
    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("bits").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("y"))

    def run(frames):
        for f in frames:
            ok = [may_link(*r, similar) for r in zip(f["na"], f["x"], f["nb"], f["y"])]
            yield f.loc[np.array(ok, bool), ["a", "b", "na", "nb"]]

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "x", "y").mapInPandas(run, "a long, b long, na long, nb long")


def _sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, moved: dict, n: int) -> DataFrame:
    """node, h: the sorted sets of the wanted nodes, read from one document of each."""
    which = materialize(wanted.join(reps, "node").select(F.col("rep").alias("_rep")).distinct(), "which")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(if_small(which), texts["doc_id"].eqNullSafe(F.col("_rep")), "left_semi").select("text")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                sets = [h for h in shingle_sets(_texts(whole.slice(at, 1000), 0), n) if h.size]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(h, moved) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "h"])

    return texts.mapInArrow(run, "node long, h binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similar) -> DataFrame:
    """Links: the pairs whose sorted arrays share enough."""

    def run(frames):
        for f in frames:
            ok = []
            for na, nb, x, y in zip(f["na"], f["nb"], f["x"], f["y"]):
                # neither set holds an element twice, so what is twice in both is shared
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]), kind="stable")
                ok.append(linked(int((both[1:] == both[:-1]).sum()), int(na), int(nb), similar))
            yield f.loc[np.array(ok, bool), ["a", "b"]]

    one = sets.select(F.col("node").alias("a"), F.col("h").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("h").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "na", "nb", "x", "y").mapInPandas(run, "a long, b long")


def _across(entries: DataFrame, nodes: DataFrame, labels: DataFrame, tried: DataFrame, similar, most: int | None) -> DataFrame:
    """Pairs of sets that share a tile, lie in different components and whose bitmaps leave room; of each pair of
    components the `most` closest ones, or all.

    Tiles with one least node are taken together, as those of a group of copies mostly have the same members: a pair
    is then compared once, not in each tile. Size-sorted blocks meet blocks of compatible sizes only.
    """
    e = entries.select(F.col("a").alias("tile"), F.col("b").alias("node"), "size").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = e.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("key")).where("lo < hi")
    e = e.join(mixed.select("tile", "key"), "tile").select("key", "node", "size", "component").distinct()
    place = F.floor((F.row_number().over(W.partitionBy("key").orderBy("size", "node")) - 1) / BLOCK).cast("int")
    e = materialize(e.withColumn("block", place), "mixed")
    span = e.groupBy("key", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    two = span.select("key", F.col("block").alias("c"), F.col("least").alias("least2"))
    meet = span.join(two, "key").where((F.col("c") >= F.col("block")) & (F.col("most") * similar[1] >= F.col("least2") * similar[0])).select("key", "block", "c")
    turned = meet.where("block < c").select("key", F.col("block").alias("first"), F.col("c").alias("block"))
    left = e.join(meet, ["key", "block"]).withColumn("side", F.lit(0))
    right = e.join(turned, ["key", "block"]).select("key", F.col("first").alias("block"), F.col("block").alias("c"), "node", "size", "component", F.lit(1).alias("side"))
    dealt = left.select("key", "block", "c", "node", "size", "component", "side").union(right).join(nodes.select("node", "bits"), "node")
    groups = max(12, -(-e.count() // 20_000))

    def block_pairs(x: pd.DataFrame, y: pd.DataFrame | None) -> pd.DataFrame | None:
        """Pairs within x, or of x and y, sorted by size."""
        own = y is None
        y = x if own else y
        if own and x["component"].nunique() < 2:
            return None
        nx, ny, kx, ky, cx, cy = x["size"].to_numpy(), y["size"].to_numpy(), x["node"].to_numpy(), y["node"].to_numpy(), x["component"].to_numpy(), y["component"].to_numpy()
        # widths grow with sizes, so the sets of one width stand together; each width is also kept folded to half
        width = np.array([len(b) for b in y["bits"]])
        rows = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            m = np.stack([np.frombuffer(b, np.uint8) for b in y["bits"].iloc[at]])
            rows[w] = [(int(at[0]), m.view(np.uint64))] + rows.get(w, [])
            if w > 8:
                rows.setdefault(w // 2, []).append((int(at[0]), _fold(m, w // 2).view(np.uint64)))
        out = []
        for i in range(len(x)):
            lo = i + 1 if own else 0
            hi = int(np.searchsorted(ny, nx[i] * similar[1] // similar[0], "right"))
            mine = np.frombuffer(x["bits"].iloc[i], np.uint64)
            for first, m in rows.get(mine.nbytes, []):
                j = np.arange(max(lo, first), min(hi, first + len(m)))
                j = j[cx[i] != cy[j]]
                if not j.size:
                    continue
                theirs = m[j - first]
                only = np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64)
                other = np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
                top = np.minimum(nx[i] - only, ny[j] - other)
                ok = similar[1] * top >= similar[0] * (nx[i] + ny[j] - top)
                j, top = j[ok], top[ok]
                if j.size:
                    flip = kx[i] < ky[j]
                    out.append(np.stack([np.where(flip, kx[i], ky[j]), np.where(flip, ky[j], kx[i]), np.where(flip, nx[i], ny[j]), np.where(flip, ny[j], nx[i]), np.minimum(cx[i], cy[j]), np.maximum(cx[i], cy[j]), top * 1_000_000 // (nx[i] + ny[j])], 1))
        return pd.DataFrame(np.concatenate(out), columns=names) if out else None

    names = ["a", "b", "na", "nb", "p", "q", "room"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, b, c), g in f.sort_values(["size", "node"]).groupby(["key", "block", "c"], sort=False):
            found = block_pairs(g, None) if b == c else block_pairs(g[g["side"] == 0], g[g["side"] == 1])
            if found is not None:
                out.append(found)
        if not out:
            return pd.DataFrame(columns=names)
        found = pd.concat(out).drop_duplicates(["a", "b"])
        return found.sort_values(["room", "a", "b"], ascending=[False, True, True]).groupby(["p", "q"]).head(most) if most else found

    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("key", "block", "c"), F.lit(groups)).cast("int"))
    found = dealt.groupBy("group").applyInPandas(run, "a long, b long, na long, nb long, p long, q long, room long")
    found = found.dropDuplicates(["a", "b"]).join(tried, ["a", "b"], "left_anti")
    if most:
        found = found.withColumn("turn", F.row_number().over(W.partitionBy("p", "q").orderBy(F.desc("room"), "a", "b"))).where(F.col("turn") <= most)
    return found.select("a", "b", "na", "nb")


def _nodes(own: DataFrame) -> DataFrame:
    """One row per node: size, bits, the smallest doc_id, and the range of check."""
    return materialize(own.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.min("doc_id").alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi")), "nodes")


def _moved(own: DataFrame, nodes: DataFrame) -> dict[tuple[int, int], int]:
    """(node, check) -> a node of its own, for unlike sets that share a key. Of 5e10 sets some 70 do, so this is small."""
    shared = nodes.where("lo <> hi").select("node", F.col("lo").alias("_lo"))
    if shared.isEmpty():
        return {}
    rows = own.where("size > 0").join(shared, "node").where("check <> _lo").select("node", "check").distinct().collect()
    return {(r["node"], r["check"]): int(mix64(np.array([r["node"] ^ r["check"]], np.int64).astype(np.uint64)).astype(np.int64)[0]) for r in rows}


def join_components(docs: DataFrame, n: int = WORDS, similar: tuple[int, int] = SIMILAR, per_tile: int = ENTRIES_PER_TILE) -> DataFrame:
    """doc_id, n_shingles, node, component_id: one row per row of docs.

    Two documents link when similar[1] * intersection >= similar[0] * union of their sets. component_id is the
    smallest doc_id reachable by links (null ids give way to others). Null and empty text and text without words have
    the empty set and link with nothing: node is null and component_id their own doc_id. Repeated rows have equal
    sets, so they are in one component. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    first = materialize(cards(docs, n), "cards")
    own = first.where("kind = 0").drop("kind")
    nodes = _nodes(own)
    moved = _moved(own, nodes)
    if moved:
        apart = spark.createDataFrame([(*k, v) for k, v in moved.items()], "node long, check long, _to long")
        own = own.join(F.broadcast(apart), ["node", "check"], "left").withColumn("node", F.coalesce("_to", "node")).drop("_to")
        nodes = _nodes(own)
    often = first.where("kind = 1").groupBy("node").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "node").limit(FREQUENT).select("node").toPandas()["node"].to_numpy(np.int64)
    own = materialize(own.select("doc_id", "size", "node"), "own")
    discard(first)  # bitmaps are in nodes now
    entries = nodes.agg(F.coalesce(F.sum(F.floor(F.col("size") * (1 - similar[0] / similar[1])) + 1), F.lit(0))).first()[0]
    found = materialize(_candidates(tiles(docs, np.sort(often.astype(np.uint64)), moved, max(12, -(-int(entries) // per_tile)), n, similar), similar), "candidates")

    pairs = materialize(_bounded(found.where("kind = 0").select("a", "b").distinct(), nodes.select("node", "size", "bits"), similar), "pairs")
    large = found.where("kind = 1")
    links = tried = known = labels = None
    for step in range(3):
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        ends = ends if known is None else ends.join(known.select("node"), "node", "left_anti")
        new = materialize(_sets(docs, ends, nodes.select("node", "rep"), moved, n), "sets")
        known = new if known is None else known.union(new)
        fresh = materialize(_verified(pairs, known, similar), "links")
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        if labels is None or not fresh.isEmpty():
            # components found so far stand for their links
            links = fresh if labels is None else fresh.union(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b"))
            labels = materialize(components(links), "labels")
        tidy(spark)
        if step == 2:
            break
        # first a few pairs of each two components: what these link needs no further pairs; then all that is left
        pairs = materialize(_across(large, nodes, labels, tried, similar, None if step else 2), "pairs")
        if pairs.isEmpty():
            break

    placed = nodes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = placed.join(ids, "component").select(F.col("node").alias("_node"), F.col("component_id").alias("_component_id"))
    out = own.join(placed, (F.col("node") == F.col("_node")) & (F.col("size") > 0), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.col("_node").alias("node"), F.when(F.col("_node").isNull(), F.col("doc_id")).otherwise(F.col("_component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each group of linked documents: the one of smallest doc_id, which names the group.

    Documents with the empty set are in no group and stay, as do rows without doc_id. Of repeated rows one stays; rows
    of one doc_id with unlike texts stay apart: each goes or stays by its own text.
    """
    repeated = materialize(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_again")).count().where("count > 1").select("_again"), "repeated")
    found = join_components(docs, **options)
    gone = materialize(found.where("node IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("node").alias("_set")).distinct(), "gone")
    if repeated.isEmpty():
        return docs.join(if_small(gone.select("_gone")), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(h) for h in shingle_sets([(t or "").encode() for t in texts], options.get("n", WORDS))], dtype="int64")

    # a row of a repeated doc_id goes by its own set, which is known by its key
    again = docs.join(if_small(repeated), docs["doc_id"].cast("long") == repeated["_again"], "left_semi")
    rest = docs.join(if_small(repeated), docs["doc_id"].cast("long") == repeated["_again"], "left_anti")
    rest = rest.join(if_small(gone.select("_gone").distinct()), rest["doc_id"].cast("long") == gone["_gone"], "left_anti")
    again = again.join(gone, (again["doc_id"].cast("long") == gone["_gone"]) & (key(again["text"]) == gone["_set"]), "left_anti")
    return rest.unionByName(again.dropDuplicates(["doc_id", "text"]))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_components(docs).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
