"""Mixing sources to target weights, with DataFrame functions only.

Tokens (words) are summed per source, each source gets a target, and target over size is its repetition rate.
A document is emitted floor(rate) times, and once more where a number drawn from a hash of its doc_id lies below the
fraction, so that reruns agree and no order of rows matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, restored, set_aside, word_count

#: One row per source; up to so many rows the table is joined by broadcast, beyond that by Spark's own choice.
BROADCAST_ROWS = 100_000


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: source_size, target (double). One row per source, the null source included.

    Sources in code-point order, null last, take the weights in turn. `budget` times all sizes is shared by weight; a
    target stops at `cap` times its source's size and the excess is shared again by weight. The end of that sharing is
    a water level: in order of cap over weight, a source is at its cap as long as the level that the others would get
    is no lower. Sources without words get 0.
    """
    sized = docs.select(F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    turn = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("weight"))
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = every.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    share = (F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", share).withColumn("full", F.col("level") <= F.col("share"))
    water = F.max(F.when(~F.col("full"), F.col("share"))).over(whole)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(water * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with _size, _source_size, _target and _copies (how often the mix takes the document).

    Null text counts no words; null source is a source of its own, last in order. Rows with equal doc_id (null too)
    draw the same number. An empty table gives an empty one. Columns of docs with the names of added ones are replaced.
    """
    docs = docs.drop("_size", "_source", "_source_size", "_target", "_copies")
    targets = materialize(source_targets(docs, weights, budget, cap), "targets")
    few = targets.count() <= BROADCAST_ROWS
    t = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    # the word count is taken from the text where it is needed, so that the join carries no second scan
    out = docs.withColumn("_size", word_count(docs["text"])).join(F.broadcast(t) if few else t, docs["source"].eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn("_copies", whole.cast("long") + (uniform(docs["doc_id"], seed) < rate - whole).cast("long")).drop("_source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs, each as often as mix_plan says, with the columns of docs."""
    used = ("doc_id", "text", "source")
    plan = mix_plan(set_aside(docs, *used), **options).where(F.col("_copies") > 0)
    return restored(plan.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))), docs.columns, *used)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = mix_plan(docs)
    return p.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per
), levels AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS level FROM weighed
), shares AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - COALESCE(sum(most) OVER before, 0.0::DOUBLE))
          / (sum(weight) OVER () - COALESCE(sum(weight) OVER before, 0.0::DOUBLE)) AS share
  FROM levels WINDOW before AS (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT max(share) FILTER (WHERE level > share) AS h2o FROM shares
), targets AS (
  SELECT source, source_size, CASE WHEN level <= share THEN most ELSE h2o * weight END AS target FROM shares, water
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || COALESCE(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated
"""
