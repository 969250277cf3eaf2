"""Language-model scores of every document, learned from six sevenths of them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.llm.common import crc_mod
from kinescape.llm.lm_score import score


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: the base is tested against plain counts, the model for probabilities that sum to one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = crc_mod(F.col("doc_id"), 7)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    told = score(docs, part != 2, path, pattern).withColumnRenamed("key", "doc_id")
    return told.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
