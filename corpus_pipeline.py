"""Corpus pipeline: language ID, near duplicates, secrets, mixing, packing. Part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs are all rows that the stage before returned, read
again from Parquet. All but the last return the columns of documents; further columns of docs stay, whatever their names.
An empty table gives an empty one at every stage. Which rows go, stay or change is told at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialize
from tessera.llm.jaccard import keep_one
from tessera.llm.langid import accept
from tessera.llm.mixing import mix
from tessera.llm.packing import pack, tokenize
from tessera.llm.secret_scan import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; what is learned comes from the rows of docs that carry lang.

    Null text and text without a letter go. A null lang is filled with the prediction, a given one stays, right or wrong;
    without any lang nothing is learned and all rows go. Repeated rows go or stay together. Other nulls don't matter.
    """
    return accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id.

    Null, empty and blank texts are in no group and stay, as do rows without doc_id; of repeated rows one stays, and rows of
    one doc_id with unlike texts each go or stay by their own text.
    """
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked in its text; n_chars follows where a text changes.

    All rows stay, repeated ones too. Null and empty texts, and texts without secrets, stay as they are.
    """
    return redact(spark, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for.

    The null source is one of its own. A source without words is not taken; in another, texts without words are drawn like
    others. Rows of one doc_id, or without one, are drawn alike.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences.

    Null and empty texts are a piece of one id. Repeated rows are packed each; ties are in order of doc_id and piece.
    """
    return pack(materialize(tokenize(docs), "pieces"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: The classifier of the first stage has no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
