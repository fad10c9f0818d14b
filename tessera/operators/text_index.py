"""A persisted inverted index of texts, which many queries join instead of each scanning all texts.

Words of a text are what stands between other characters. A search term holds word characters only, so each of its
occurrences lies within one word: the words that hold a term are found by one of its trigrams, and the term's occurrences in
a text are those in its words. Only texts that hold all terms of a query are looked at again, for the whole query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import frequency, query_terms
from tessera.operators.graph import _cut
from tessera.operators.search import FEW, per_group

#: Folders that words are dealt to by hash; a search reads those of its words only.
SHARDS = 64
WORD = r"(?U)\w+"
PLACES, WORDS = "word string, chunk_id string, n long, head int, shard int", "gram string, word string, chunks long"


def _lowered(chunks: DataFrame) -> DataFrame:
    """chunk_id, text and title of chunks (chunk_id, title, content) as they are searched."""
    return chunks.select("chunk_id", F.lower(F.concat_ws(" ", "title", "content")).alias("text"), F.lower(F.coalesce("title", F.lit(""))).alias("title"))


def build(chunks: DataFrame, path: str) -> None:
    """Write an index of chunks (chunk_id, title, content; null title or content is empty) to path: for each word and chunk
    how often it stands there and whether in the title, sorted by word and dealt to SHARDS folders; a frequent word is
    many files. Words of under three characters hold no term and are left out. Chunk ids are unique."""
    words = lambda c: F.filter(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 2)
    t = _lowered(chunks)
    each = t.select("chunk_id", F.explode(F.transform(words("text"), lambda w: F.struct(w.alias("word"), F.lit(1).alias("n"), F.lit(0).alias("head")))).alias("w"))
    head = t.where("title <> ''").select("chunk_id", F.explode(F.transform(F.array_distinct(words("title")), lambda w: F.struct(w.alias("word"), F.lit(0).alias("n"), F.lit(1).alias("head")))).alias("w"))
    counts = each.unionByName(head).select(F.col("chunk_id").cast("string").alias("chunk_id"), "w.*").groupBy("word", "chunk_id").agg(F.sum("n").alias("n"), F.max("head").alias("head"))
    counts = counts.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(SHARDS)).cast("int"))
    counts.repartitionByRange("shard", "word", "chunk_id").sortWithinPartitions("shard", "word", "chunk_id").write.partitionBy("shard").parquet(f"{path}/places")
    known = chunks.sparkSession.read.schema(PLACES).parquet(f"{path}/places").groupBy("word").agg(F.count("*").alias("chunks"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring(F.col("word"), i, F.lit(3))))
    known.select(F.explode(grams).alias("gram"), "word", "chunks").repartitionByRange("gram").sortWithinPartitions("gram", "word").write.parquet(f"{path}/words")


class TextIndex:
    """Searches an index that build() wrote, over the chunks it was built of."""

    def __init__(self, spark: SparkSession, path: str, chunks: DataFrame):
        self.spark, self.path, self.chunks = spark, path, chunks

    def words(self, terms: DataFrame) -> DataFrame:
        """query_id, term, many, word, times: words that hold a term (of three characters or more), and how often."""
        grams = self.spark.read.schema(WORDS).parquet(f"{self.path}/words")
        met = grams.join(F.broadcast(terms) if terms.count() <= FEW else terms, F.substring("term", 1, 3) == F.col("gram"))
        return met.where(F.contains("word", F.col("term"))).select("query_id", "term", "many", "word", frequency("word", "term").alias("times")).distinct()

    def places(self, words: DataFrame) -> DataFrame:
        """The rows of words in all chunks."""
        places = self.spark.read.schema(PLACES).parquet(f"{self.path}/places")
        shards = [r["s"] for r in words.select(F.pmod(F.xxhash64("word"), F.lit(SHARDS)).cast("int").alias("s")).distinct().collect()]
        return places.where(F.col("shard").isin(shards)).drop("shard").join(words, "word")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, chunk_id, score, rank: the k best chunks of each of queries (query_id, query), as knowledge_search() scores
        them, ties to the smaller chunk_id. All queries share one pass; only those without a term scan the texts."""
        q = _cut(queries.select("query_id", F.lower(F.trim("query")).alias("q")).withColumn("terms", query_terms("q")).where("q IS NOT NULL"))
        terms = q.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("many"))
        words = _cut(self.words(terms))
        per = self.places(words).groupBy("query_id", "chunk_id", "term", "many").agg(F.sum(F.col("n") * F.col("times")).alias("times"), F.max("head").alias("head"))
        hit = per.groupBy("query_id", "chunk_id").agg(F.sum("many").alias("hits"), F.sum(F.col("many") * F.col("times")).alias("times"), F.max("head").alias("head"))
        # a word may stand in the title only as part of text, so head is told apart from times
        hit = _cut(hit.join(q.select("query_id", "q", F.size("terms").alias("of")), "query_id"))
        texts = _lowered(self.chunks).withColumn("chunk_id", F.col("chunk_id").cast("string"))
        whole = lambda df: df.where(F.contains("text", F.col("q"))).select("query_id", "chunk_id", (100.0 + frequency("text", "q") * 5.0).alias("whole"), F.contains("title", F.col("q")).alias("in_title"))
        found = whole(hit.where("hits = of").select("query_id", "chunk_id", "q").join(texts, "chunk_id"))
        part = hit.join(found, ["query_id", "chunk_id"], "left")
        base = F.coalesce("whole", F.col("hits") / F.col("of") * 80.0 + F.least("times", F.lit(10)) * 1.5)
        extra = F.when(F.coalesce("in_title", F.lit(False)), 15.0).when(F.col("head") > 0, 8.0).otherwise(0.0)
        scored = part.select("query_id", "chunk_id", F.round(base + extra, 2).alias("score"))
        short = q.where(F.size("terms") == 0)
        if not short.isEmpty():  # a stated set of queries against all texts
            all_ = whole(texts.join(F.broadcast(short.select("query_id", "q")), F.contains("text", F.col("q"))))
            scored = scored.unionByName(all_.select("query_id", "chunk_id", F.round(F.col("whole") + F.when(F.col("in_title"), 15.0).otherwise(0.0), 2).alias("score")))
        return per_group(scored, "query_id", [F.desc("score"), F.col("chunk_id")], k).select("query_id", "chunk_id", "score", "rank")
