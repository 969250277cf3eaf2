"""Corpus pipeline: language, repeated lines, near duplicates, secrets, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. doc_id names a document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.llm.common import dropped, stored
from kinescape.llm.langid import NO_LANGUAGE, fit, predict
from kinescape.llm.line_dedup import drop_repeated
from kinescape.llm.minhash import near_duplicates
from kinescape.llm.packing import pack
from kinescape.llm.secrets import redact

#: A language is rejected below this probability. Clean texts of a few words come down to 0.36.
LEAST_SCORE = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose text has no letter or no likely language; a null lang is filled."""
    told = predict(docs, fit(docs, F.lit(True)), carry=True)
    kept = told.where((F.col("lang_pred") != NO_LANGUAGE) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without runs of 50 words or more that stand earlier; documents left empty go."""
    cut = drop_repeated(docs)
    left = cut.where((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return _measured(left.select(docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group with five-word similarity of 0.8."""
    gone = near_duplicates(docs, width=5, threshold=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind."""
    return _measured(redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_near_dedup", near),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: SQL cannot express the kernel, winnowing or tokenising; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each on a written table of what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
