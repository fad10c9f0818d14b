"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters meet the
tolerance, then one exchange.

The sort key is (60 bits of a hash of the text, doc_id), so equal texts are neighbours: a group of copies is cut only
where it holds more bytes than the tolerance leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, materialize

KEY_BITS, PROBE_BITS = 60, 8
LOWEST = -(1 << 63)


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - KEY_BITS)


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LOWEST))


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """Splitters (hash, doc_id) and the total size. keys: _h long, _d long, _size long.

    Each round counts the exact bytes in 2**PROBE_BITS parts of every interval that still holds a target; the driver
    sees at most (shards - 1) * 2**PROBE_BITS counts. An interval of one hash is cut further by doc_id.
    """
    total = keys.agg(F.sum("_size")).first()[0] or 0
    near = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # (level, hash, low, width): level 0 cuts by hash, level 1 cuts one hash by doc_id; value: bytes below low
    open_: dict[tuple[int, int, int, int], list[int]] = {(0, 0, 0, 1 << KEY_BITS): list(range(1, shards))} if total else {}
    below = {k: 0 for k in open_}
    while open_:
        spots = list(open_)
        place = F.lit(None).cast("long")
        which = F.lit(None).cast("int")
        for i, (level, h, low, width) in enumerate(spots):
            step = max(1, width >> PROBE_BITS)
            if level == 0:
                inside = (F.col("_h") >= low) & (F.col("_h") < F.lit(low + width))
                part = F.shiftright(F.col("_h") - F.lit(low), step.bit_length() - 1)
            else:
                # doc_ids as unsigned offsets from the lowest one; widths are powers of two, so whole numbers tell the part
                offset, bits = F.col("_d").bitwiseXOR(F.lit(LOWEST)), width.bit_length() - 1
                inside = F.col("_h") == h
                if bits < 64:
                    inside = inside & (F.shiftrightunsigned(offset, bits) == F.lit(low >> bits))
                part = F.shiftrightunsigned(offset, step.bit_length() - 1).bitwiseAND(F.lit((1 << PROBE_BITS) - 1))
            place, which = F.when(inside, part).otherwise(place), F.when(inside, F.lit(i)).otherwise(which)
        rows = keys.select(which.alias("i"), place.alias("p"), "_size").where("i IS NOT NULL").groupBy("i", "p").agg(F.sum("_size").alias("b")).collect()
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            counts.setdefault(r["i"], []).append((r["p"], r["b"]))
        after: dict[tuple[int, int, int, int], list[int]] = {}
        for i, spot in enumerate(spots):
            level, h, low, width = spot
            step, done, waiting = max(1, width >> PROBE_BITS), below[spot], list(open_[spot])
            for p, b in sorted(counts.get(i, [])):
                at = low + p * step
                while waiting and done + b >= waiting[0] * total / shards:
                    k = waiting.pop(0)
                    goal = k * total / shards
                    left, right = goal - done, done + b - goal
                    cut = (lambda x: (x, LOWEST)) if level == 0 else (lambda x: (h, x + LOWEST))
                    if min(left, right) <= near or (level == 1 and step == 1):
                        found[k] = cut(at if left <= right else at + step)
                    else:
                        nxt = (level, h, at, step) if step > 1 else (1, at, 0, 1 << 64)
                        after.setdefault(nxt, []).append(k)
                        below[nxt] = done
                done += b
            for k in waiting:
                found[k] = (low + width, LOWEST) if level == 0 else (h, low + width + LOWEST)
        open_ = after
    return [found.get(k, (1 << KEY_BITS, LOWEST)) for k in range(1, shards)], total


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, group_bytes: int = 32 << 20) -> DataFrame:
    """docs with _size (UTF-8 bytes + 1), _shard and _slot (gapless from 0 in each shard).

    Law `bytes`: each cut lies within `tolerance` of a shard's share from its ideal place, as far as rows allow. Null
    text has no bytes. Rows with equal text and doc_id stay together; null doc_id sorts first. An empty table gives an
    empty one. Within a shard rows are dealt to parts of about `group_bytes`, each sorted and numbered by itself. Columns
    of docs named _size, _shard, _slot, _h, _d, _part, _turn, _s, _p or _first are left out.
    """
    docs = docs.drop("_size", "_shard", "_slot", "_h", "_d", "_part", "_turn", "_s", "_p", "_first")
    text, doc_id = docs["text"], docs["doc_id"]
    keys = materialize(docs.select(_key(text).alias("_h"), _order(doc_id).alias("_d"), _size(text).alias("_size")), "keys")
    splitters, total = find_splitters(keys, shards, tolerance)
    parts = max(1, -(-total // (shards * group_bytes)))

    def dealt(df: DataFrame, h: Column, d: Column) -> DataFrame:
        at = sum((((h > sh) | ((h == sh) & (d >= F.lit(sd)))).cast("int") for sh, sd in splitters), F.lit(0))
        return df.withColumn("_shard", at).withColumn("_part", F.pmod(F.xxhash64(h, d, F.lit("part")), F.lit(parts)).cast("int"))

    # rows of each part: as many counts as parts, each part holding group_bytes on the average
    counts = dealt(keys, F.col("_h"), F.col("_d")).groupBy("_shard", "_part").count()
    first = F.sum("count").over(W.partitionBy("_shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select(F.col("_shard").alias("_s"), F.col("_part").alias("_p"), F.coalesce(first, F.lit(0)).alias("_first"))
    out = dealt(docs.withColumn("_size", _size(text)).withColumn("_h", _key(text)).withColumn("_d", _order(doc_id)), F.col("_h"), F.col("_d"))
    turn = F.row_number().over(W.partitionBy("_shard", "_part").orderBy("_h", "_d"))
    few = shards * parts <= BROADCAST_ROWS  # a row for each part, so it grows with the bytes
    out = out.withColumn("_turn", turn).join(F.broadcast(first) if few else first, (F.col("_shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("_slot", F.col("_first") + F.col("_turn") - 1).drop("_h", "_d", "_part", "_turn", "_s", "_p", "_first")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))  # taken before the exchange, which then moves no text
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", crc.alias("text_crc32")))
    return out.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
