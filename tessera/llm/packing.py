"""Best-fit packing of tokenised documents, certified by lower bounds.

Partitions pack their pieces best-fit decreasing. Dual-feasible functions give a lower bound on the bins that a
partition needs; where the bound is met, the count is certified. Partitions with a gap, and the least filled bin of
the others, give their documents back: these are dealt anew to fewer partitions and packed again, as long as that
saves sequences.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches

CAPACITY, END = 2048, 0
PIECES_PER_PART = 100_000
#: Characters on which both tokenisers' word patterns agree by construction: their classes are old and settled.
SETTLED = re.compile("[\t\n\r -~¡-ɏЀ-ҁҊ-ӿ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]*")


def _tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text -> uint32 ids, as `tokenizers` gives them for the file at path without special tokens added.

    Texts of settled characters go through the faster BPE over the same vocabulary and merges; all others, and such as
    hold the text of a special token, go through `tokenizers` itself. If the file isn't a plain byte-level BPE, all do.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    added = [x["content"] for x in spec.get("added_tokens", [])]
    slow = lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout")
    if not plain:
        return slow
    # the byte alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    from public_tokenizers import PATTERN

    fast = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "It's 12 naïve  words,\n\n\tthey'll -- do!  \n"
    if slow(probe).tolist() != fast.encode_ordinary(probe):
        return slow

    def encode(text: str) -> np.ndarray:
        if SETTLED.fullmatch(text) is None or any(t in text for t in added):
            return slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def tokenize(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    A document is its ids and then id 0; null text is empty, so it is that one id. Only a document longer than
    `capacity` is cut: all its pieces but the first are full.
    """
    path = tokenizer or _tokenizer_file()
    small_batches(docs.sparkSession)

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                first = (ids.size - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, ids.size, capacity)]):
                    own = ids[start : first if piece == 0 else start + capacity]
                    for k, v in zip(out, (doc_id, piece, start, own.size, zlib.crc32(own.tobytes()), own.astype(np.int32) if keep_ids else None)):
                        out[k].append(v)
                    held += own.size * keep_ids
                if held > 1 << 21:
                    yield batch_of(out)
                    out, held = {k: [] for k in out}, 0
            yield batch_of(out)

    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds], names=[k for k, _ in kinds])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of many dual-feasible bounds on the bins that lengths need."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound() from the number of pieces of each length from 0 to capacity."""
    size = np.arange(capacity + 1)
    n, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * size))
    best = -(-int(mass[-1]) // capacity)
    k = np.arange(1, capacity // 2 + 1)
    # sizes over capacity - k count as whole bins, sizes under k as nothing
    large = n[-1] - n[capacity - k + 1]
    middle = mass[capacity - k + 1] - mass[k]
    best = max(best, int((large + -(-middle // capacity)).max(initial=0)))
    for j in range(1, 33):  # (j + 1) x / capacity rounded down to a whole number of j-ths, where it isn't one
        scaled = (j + 1) * size
        value = np.where(scaled % capacity == 0, size * j, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (j * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Bin of each length, longest first into the fullest bin with room; equal ones in order. Also the bins used."""
    bins = np.zeros(lengths.size, np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = mask >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i] = b
        if room > need:
            rooms[room - need].append(b)
            mask |= 1 << (room - need)
    return bins, used


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def _pack_parts(pieces: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    def run(frames):
        from pyspark import TaskContext

        held = [f for f in frames if len(f)]
        if not held:
            return
        f = pd.concat(held, ignore_index=True)
        # order and so the packing depend on the rows alone
        f = f.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = f["length"].to_numpy()
        bins, used = best_fit(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        total = np.cumsum(lengths[order])
        firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(f), np.int64)
        offset[order] = total - lengths[order] - np.repeat((total - lengths[order])[firsts], np.diff(np.append(firsts, len(f))))
        fill = np.bincount(bins, weights=lengths, minlength=used)
        if used == lower_bound(lengths, capacity):
            give = np.zeros(used, bool)  # certified: only the least filled one may still find company elsewhere
            give[np.argmin(fill)] = True
        else:
            give = np.ones(used, bool)
        give &= fill < capacity
        part = TaskContext.get().partitionId()
        yield f.assign(sequence_id=(turn << 56) + (part << 32) + bins, offset=offset, open=give[bins])[[x.split()[0] for x in _PACKED.split(", ")]]

    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(parts).mapInPandas(run, _PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES_PER_PART, rounds: int = 6) -> DataFrame:
    """pieces with sequence_id and offset, in as few sequences of at most `capacity` as certified best fit finds.

    Rows need not differ; ties are packed in order of doc_id and piece. Lengths are from 1 to `capacity`. An empty
    table gives an empty one. Each part holds about `per_part` pieces.
    """
    done, todo = [], pieces
    for turn in range(rounds):
        n = todo.count()
        parts = max(1, -(-n // per_part))
        packed = materialize(_pack_parts(todo, parts, turn, capacity), "packed")
        given = packed.where("open")
        if turn:
            now = packed.select("sequence_id").distinct().count()
            if now >= before:  # nothing saved: what stood before stays
                done.append(todo_packed)
                break
        before = given.select("sequence_id").distinct().count()
        if parts == 1 or before <= 1 or turn + 1 == rounds:
            done.append(packed)
            break
        done.append(packed.where("NOT open"))
        todo, todo_packed = given, given
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("open")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, bound, gap of a packing: how many sequences it has, the dual-feasible bound over all its pieces below which
    no packing can go, and what lies between. The driver sees one count per length. Of no pieces all are 0."""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    bound = bound_of_counts(count, capacity)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. Each holds at most `capacity` ids, so groups are bounded.

    Pieces with equal doc_id, piece and content are alike and are matched in any order.
    """
    from pyspark.sql import Window as W

    key = ["doc_id", "piece", "start", "ids_crc32"]
    turn = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    held = tokenize(docs, tokenizer, capacity, keep_ids=True).withColumn("turn", turn)
    plan = packed.withColumn("turn", turn).select(*[F.col(k).alias(f"_{k}") for k in [*key, "turn"]], "sequence_id", "offset")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*key, "turn"]]
    rows = held.join(plan, same).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten(F.col("rows.ids")).alias("ids"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(materialize(tokenize(docs), "pieces"))
