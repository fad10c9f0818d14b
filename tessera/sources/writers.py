"""Writers: chunk trees, graph documents, set operations, findings, registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sanitize_folder_name


def chunk_files(chunks: DataFrame) -> DataFrame:
    """file, value: path by section (all but the last part of path) and title, and the text with its header.

    Titles that collide in a folder are told apart by chunk_id, so none is lost.
    """
    folder = F.array_join(F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), sanitize_folder_name), "/")
    from pyspark.sql import Window as W

    twice = F.count("*").over(W.partitionBy("folder", "name")) > 1
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\nSource: "), F.col("source"), F.lit("\nChunk ID: "), F.col("chunk_id"), F.lit("\nSection Path: "), F.array_join("path", " > "), F.lit("\n---\n\n"), F.col("content"))
    c = chunks.withColumn("folder", folder).withColumn("name", sanitize_folder_name("title"))
    name = F.when(twice, F.concat_ws("_", "name", "chunk_id")).otherwise(F.col("name"))
    return c.select(F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.concat(name, F.lit(".txt"))).alias("file"), head.alias("value"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows as Parquet by document."""
    chunks.write.mode("overwrite").partitionBy("doc_id").parquet(path)


def write_graph(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)


def write_set_operations(rows: DataFrame, path: str) -> None:
    """One folder per operation; only the operations in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("operation").parquet(path)


def write_findings(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Vectors with id `{graph}_{row}`, by graph."""
    rows.withColumn("id", F.concat_ws("_", "graph", F.col("vec_id").cast("string"))).write.mode("overwrite").partitionBy("graph").parquet(path)


def replace_graph(rows: DataFrame, path: str) -> None:
    """Load graphs in place of what was there for them; other graphs stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_name").parquet(path)
