"""Documents into chunks: headings, packing, size normalisation, batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import strip, word_count
from tessera.operators.graph import _cut
from tessera.operators.ranks import ranked

MAX_WORDS, MIN_WORDS, TARGET_WORDS = 3000, 500, 2000
#: Files that one task of word_batches() folds at once.
BATCH_BLOCK = 4096


def fill_pages(toc: DataFrame, total_pages: str = "total_pages") -> DataFrame:
    """toc (doc_id, ord, page, total_pages) with first and last page: a missing page is that of the entry before it (1 at
    first), the last one is the page before the next entry, but not before the first."""
    w = W.partitionBy("doc_id").orderBy("ord")
    t = toc.withColumn("first", F.coalesce(F.last("page", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(1)))
    return t.withColumn("last", F.greatest("first", F.coalesce(F.lead("first").over(w) - 1, F.col(total_pages))))


def pages_of(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, content: the pages (doc_id, page, text) of each entry, in order; empty ones are left out."""
    p = pages.join(toc.select("doc_id", "ord", F.explode(F.sequence("first", "last")).alias("page")), ["doc_id", "page"])
    c = p.groupBy("doc_id", "ord").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text")))["text"], "\n").alias("content"))
    return c.where(F.trim("content") != "")


def heading_lines(docs: DataFrame) -> DataFrame:
    """doc_id, ord, level, title, line: lines with the level of a markdown heading, null for text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1))
    return lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.when(level > 0, F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2))))


def heading_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n, title, level, content: the lines under each heading; what comes before the first is left out."""
    lines = heading_lines(docs)
    n = F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    own = lines.withColumn("n", n).where("n > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("ord", "line")))), lambda x: x["line"]), "\n")
    return own.groupBy("doc_id", "n").agg(F.max("title").alias("title"), F.max("level").alias("level"), strip(text).alias("content"))


def block_chunks(blocks: DataFrame, least: int = 500) -> DataFrame:
    """doc_id, n (from 1), title, content of blocks (doc_id, ord, level, text; level 0 is no heading): each heading with what
    stands below it, parted by blank lines, from `least` characters on; a document's last section stays where no other does.

    What comes before the first heading is left out; a document without headings is one chunk without a title. Blank
    blocks count for nothing.
    """
    order = W.partitionBy("doc_id").orderBy("ord")
    text, level = strip("text"), F.coalesce(F.col("level"), F.lit(0))
    b = blocks.select("doc_id", "ord", level.alias("level"), text.alias("text")).where("text <> ''")
    b = b.withColumn("s", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    line = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    c = b.groupBy("doc_id", "s").agg(F.max(F.when(F.col("level") > 0, F.col("text"))).alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("content"))
    whole = W.partitionBy("doc_id")
    c = c.withColumns({"last": F.max("s").over(whole), "long": F.length("content") >= least}).where("s > 0 OR last = 0")
    c = c.withColumn("any", F.max("long").over(whole)).where("long OR (s = last AND NOT any)")
    return c.select("doc_id", F.row_number().over(whole.orderBy("s")).alias("n"), "title", "content")


def paragraph_chunks(blocks: DataFrame, size: int = 2000, least: int = 500) -> DataFrame:
    """doc_id, n (from 1), content of blocks (doc_id, ord, text): paragraphs in order, parted by blank lines, until a chunk has
    `size` characters; what is left over stays from `least` characters on, or where it is all there is."""
    text = strip("text")
    docs = blocks.select("doc_id", "ord", text.alias("text")).where("text <> ''").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("ps"))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, p):
        now = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        full = F.length(now) >= size
        return F.struct(F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(now).alias("open"))

    end = docs.select("doc_id", F.aggregate("ps", zero, add).alias("s"))
    rest = (F.col("s.open") != "") & ((F.length("s.open") >= least) | (F.size("s.done") == 0))
    all_ = F.when(rest, F.array_append("s.done", F.col("s.open"))).otherwise(F.col("s.done"))
    return end.select("doc_id", F.posexplode(all_).alias("n", "content")).select("doc_id", (F.col("n") + 1).alias("n"), "content")


def section_paths(headings: DataFrame) -> DataFrame:
    """headings (doc_id, n, level, title) with path: titles of the nearest headings above of lower level, and their own.

    The last heading of a level stands above a later one unless a heading of a lower level came between; so the last one of
    each level is all that a running window has to hold.
    """
    own = headings.withColumn("level", F.col("level").cast("int"))
    deepest = own.agg(F.max("level")).first()[0] or 0
    w = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.struct("n", "title")), ignorenulls=True).over(w).alias(f"_l{k}") for k in range(1, deepest)]
    own = own.select("*", *last)
    at = lambda k: F.coalesce(F.col(f"_l{k}.n").cast("long"), F.lit(-1))
    above = []
    for k in range(1, deepest):
        since = F.greatest(F.lit(-1).cast("long"), F.lit(-1).cast("long"), *[at(j) for j in range(1, k)])
        above.append(F.when((F.col("level") > k) & F.col(f"_l{k}").isNotNull() & (at(k) > since), F.col(f"_l{k}.title")))
    path = F.filter(F.array(*above, F.col("title")), lambda t: t.isNotNull()) if above else F.array("title")
    return own.select(*headings.columns, path.alias("path"))


def pack_paragraphs(text: Column, size: int, parting: str = "\n\n") -> Column:
    """Array of parts of up to `size` characters, paragraphs kept whole, in order. A fold of one text."""
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc, p):
        full = (F.length(acc["now"]) + F.length(p) + len(parting) > size) & (acc["now"] != "")
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit(parting), p))
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"), F.when(full, p).otherwise(joined).alias("now"))

    return F.aggregate(F.split(text, parting), zero, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]))


def row_groups(rows: DataFrame, columns: list[str], size: int = 50) -> DataFrame:
    """doc_id, part, content: `col: value` lines of rows (doc_id, ord, ...) in groups of `size`, nulls left out."""
    line = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]), lambda x: x.isNotNull()), " | ")
    n = rows.withColumn("part", F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1) / size).cast("int")).withColumn("line", F.concat(F.lit("Row "), (F.col("ord") + 1).cast("string"), F.lit(": "), line))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return n.groupBy("doc_id", "part").agg(F.concat(F.lit("Columns: " + ", ".join(columns) + "\n\n"), body).alias("content"))


def between_markers(text, start: str, end: str) -> Column:
    """From the start marker (or the beginning) to the end marker after it (or the end)."""
    t = F.col(text) if isinstance(text, str) else text
    a = F.greatest(F.locate(start, t), F.lit(1))
    b = F.instr(F.substring(t, a + len(start), F.length(t)), F.lit(end))
    return F.when(b > 0, F.substring(t, a, b + len(start) - 1)).otherwise(F.substring(t, a, F.length(t)))


def normalise_sizes(chunks: DataFrame, most: int = MAX_WORDS, least: int = MIN_WORDS, target: int = TARGET_WORDS) -> DataFrame:
    """chunks (doc_id, ord, chunk_id, title, path, content) cut and merged to size, with parent_id and word_count.

    Chunks of over `most` words are cut at blank lines into parts of about `target` words. Then a chunk of under `least`
    words is joined to the one after it, if both are whole, under one parent and together no longer than `most`; what was
    joined is not joined again, so in a row of chunks that could all be, every other one takes its successor.
    """
    own = chunks.select("doc_id", "ord", "chunk_id", "title", F.coalesce("path", F.array().cast("array<string>")).alias("path"), "content").withColumn("_large", word_count("content") > most)
    parts = own.select("*", F.posexplode(F.when(F.col("_large"), pack_paragraphs(F.col("content"), target * 5)).otherwise(F.array("content"))).alias("_k", "_part"))
    k = (F.col("_k") + 1).cast("string")
    cut = parts.select(
        "doc_id", "ord", "_k", "path", F.col("_part").alias("content"), word_count("_part").alias("word_count"),
        F.when(F.col("_large"), F.concat("chunk_id", F.lit("_sub_"), F.lpad(k, 3, "0"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("_large"), F.concat("title", F.lit(" (Part "), k, F.lit(")"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_large"), F.col("chunk_id")).alias("parent_id"),
    )
    order = W.partitionBy("doc_id").orderBy("ord", "_k")
    parent = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
    next_ = F.lead(F.struct("title", "content", "word_count", F.col("parent_id").isNull().alias("whole"), parent.alias("parent"))).over(order)
    seen = cut.withColumns({"_next": next_, "_at": F.row_number().over(order)})
    joins = (F.col("word_count") < least) & F.col("parent_id").isNull() & F.col("_next.whole") & (parent == F.col("_next.parent")) & (F.col("word_count") + F.col("_next.word_count") <= most)
    seen = seen.withColumn("_can", F.coalesce(joins, F.lit(False)))
    start = F.coalesce(F.max(F.when(~F.col("_can"), F.col("_at"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("_joins", F.col("_can") & ((F.col("_at") - start) % 2 == 1))
    left = seen.withColumn("_joined", F.coalesce(F.lag("_joins").over(order), F.lit(False))).where("NOT _joined")
    j = F.col("_joins")
    return left.select(
        "doc_id", (F.row_number().over(order) - 1).alias("ord"), "chunk_id",
        F.when(j, F.substring(F.concat("title", F.lit(" + "), "_next.title"), 1, 100)).otherwise(F.col("title")).alias("title"), "path",
        F.when(j, F.concat("content", F.lit("\n\n"), "_next.content")).otherwise(F.col("content")).alias("content"), "parent_id",
        F.when(j, F.col("word_count") + F.col("_next.word_count")).otherwise(F.col("word_count")).alias("word_count"),
    )


def _batch_ends(sizes: np.ndarray, target: int, most: int) -> np.ndarray:
    """Where a batch that begins at each place ends (exclusive): `most` files on, or before the words exceed `target`."""
    held = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(sizes))
    ends = np.minimum(np.searchsorted(held, held[:-1] + target, "right") - 1, place + most)
    return np.where(sizes >= target, place + 1, np.maximum(ends, place + 1))


def word_batches(files: DataFrame, target: int = 8000, most: int = 8, block: int = BATCH_BLOCK) -> DataFrame:
    """files (group, file_id, word_count) with batch: longest first, ties in order of file_id; a file of `target` words
    stands alone, others fill batches in turn by words and count. Null word counts are 0, a null group is one.

    What a batch takes depends on all before it, but a batch holds `most` files at most, so a block of consecutive files is
    entered at one of `most` places. Each block is folded once for all of these, a row a block tells where each leads and how
    many batches begin, and these rows alone are read in order; then blocks are told their place of entry and number their
    files. No task holds a group, and none sorts one.
    """
    if block < most:
        raise ValueError("a block holds as many files as a batch")
    kinds = dict(files.dtypes)
    own = files.select("group", "file_id", F.coalesce("word_count", F.lit(0)).cast("long").alias("w"), F.coalesce(F.col("group").cast("string"), F.lit("\0null")).alias("g"))
    own = ranked(own.withColumn("_d", -F.col("w")), ["g"], ["_d", "file_id"], "i").withColumn("b", F.floor(F.col("i") / block))
    # the first files of a block are told to the one before it, as its last batch may take them
    ahead = own.where((F.col("b") > 0) & (F.col("i") % block < most - 1)).withColumn("b", F.col("b") - 1)
    rows = _cut(own.drop("_d").withColumn("own", F.lit(True)).unionByName(ahead.drop("_d").withColumn("own", F.lit(False))))

    def leads(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        n, ends = int(f["own"].sum()), _batch_ends(f["w"].to_numpy(), target, most).tolist()
        out, begun = [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            e = ends[i]
            out[i], begun[i] = (e - n, 1) if e >= n else (out[e], begun[e] + 1)
        rest = [k - n for k in range(n, most)]
        return pd.DataFrame({"g": f["g"].iloc[0], "b": f["b"].iloc[0], "out": [(out + rest)[:most]], "begun": [(begun + [0] * len(rest))[:most]]})

    def enter(frames):
        now, at, batch = None, 0, 0
        for f in frames:
            told = []
            for g, out, begun in zip(f["g"], f["out"], f["begun"]):
                if g != now:
                    now, at, batch = g, 0, 0
                told.append((at, batch))
                at, batch = int(out[at]), batch + int(begun[at])
            yield pd.DataFrame({"g": f["g"], "b": f["b"], "at": [x for x, _ in told], "batch": [x for _, x in told]})

    def number(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        ends, n, i, batch = _batch_ends(f["w"].to_numpy(), target, most).tolist(), int(f["own"].sum()), int(f["at"].iloc[0]), int(f["batch"].iloc[0])
        out = [batch - 1] * i  # of a batch that began in the block before
        while i < n:
            out += [batch] * (ends[i] - i)
            i, batch = ends[i], batch + 1
        f = f[f["own"]]
        return pd.DataFrame({"group": f["group"], "file_id": f["file_id"], "batch": out[:n]})

    each = rows.select("g", "b", "i", "w", "own").groupBy("g", "b").applyInPandas(leads, "g string, b long, out array<int>, begun array<long>")
    entered = each.repartition("g").sortWithinPartitions("g", "b").mapInPandas(enter, "g string, b long, at int, batch long")
    return rows.join(entered, ["g", "b"]).groupBy("g", "b").applyInPandas(number, f"group {kinds['group']}, file_id {kinds['file_id']}, batch int")


def numbered(df: DataFrame, order: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with name, the place of each row (from 0) in order of a column, ties in any order, nulls first.

    Rows are dealt to ranges of the column (as many as the session shuffles to, unless told), and each range is numbered on
    top of what the ranges before it hold, so no task sorts all rows. Which range a row is in is written down first.
    """
    dealt = df.repartitionByRange(ranges, order) if ranges else df.repartitionByRange(order)
    own = _cut(dealt.withColumn("_range", F.spark_partition_id()))
    held = own.groupBy("_range").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per range
    turn = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return own.withColumn("_turn", turn).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_turn")).drop("_range", "_turn", "_before")


def rule_batches(rules: DataFrame, size: int) -> DataFrame:
    """rules (ord) with batch and place in it."""
    n = numbered(rules, "ord", "_n")
    return n.withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("place", (F.col("_n") % size).cast("int")).drop("_n")


def batch_pairs(batched: DataFrame, size: int) -> DataFrame:
    """For all pairs of batches i < j the leading min(20, size // 4) rules of both: i, j, rule_id. Batches are numbered
    without gaps from 0, so each leading rule is told once for each other batch, without a join."""
    last = batched.agg(F.max("batch")).first()[0]
    lead = batched.where(F.col("place") < min(20, size // 4)).select("batch", "rule_id", F.explode(F.sequence(F.lit(0), F.lit(-1 if last is None else last).cast("int"))).alias("other"))
    return lead.where("batch <> other").select(F.least("batch", "other").alias("i"), F.greatest("batch", "other").alias("j"), "rule_id")


def words_of(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn("word_count", word_count(column))


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Parts of up to `size` characters, cut at the first separator that occurs; parts still too long are cut at the next
    ones. Neighbouring pieces are joined up to the size, and a part begins with up to `overlap` characters of the last."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out, now = [], []

    def close() -> None:
        joined = sep.join(now).strip()
        if joined:
            out.append(joined)

    for p in pieces:
        if len(p) > size and rest:
            close()
            now = []
            out += recursive_split(p, size, overlap, rest)
            continue
        if now and len(sep.join([*now, p])) > size:
            close()
            while now and (len(sep.join(now)) > overlap or len(sep.join([*now, p])) > size):
                now.pop(0)
        now.append(p)
    close()
    return out


def markdown_chunks(docs: DataFrame, size: int = 10_000, overlap: int = 200) -> DataFrame:
    """doc_id, n, path, content of sections under headings of levels 1 to 4, headings kept in the text; if any section of a
    document is longer than `size`, all are split. Text before the first heading is a section without path."""
    import re

    def sections(text: str) -> list[tuple[list[str], str]]:
        path: list[tuple[int, str]] = []
        out: list[tuple[list[str], list[str]]] = [([], [])]
        fenced = False
        for line in text.split("\n"):
            fenced ^= line.lstrip().startswith("```")
            h = None if fenced else re.match(r"(#{1,4})\s+(.*)$", line)
            if h:
                path = [p for p in path if p[0] < len(h[1])] + [(len(h[1]), h[2].strip())]
                out.append(([t for _, t in path], []))
            out[-1][1].append(line)
        return [(p, "\n".join(ls).strip()) for p, ls in out if "\n".join(ls).strip()]

    def run(frames):
        for f in frames:
            rows = []
            for d, text in zip(f["doc_id"], f["text"]):
                own = sections(text or "")
                if any(len(t) > size for _, t in own):
                    own = [(p, s) for p, t in own for s in recursive_split(t, size, overlap)]
                rows += [(d, i, p, t) for i, (p, t) in enumerate(own, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "path", "content"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n int, path array<string>, content string")
