"""Encode every document by the rank file and decode it again; digests of both."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.llm.byte_bpe import decode, encode


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: tested against the library that the ranks are made for, and by round trips."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern, offsets=False)
    told = ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "n_split",
        "ids",
    )
    return decode(told, path, pattern).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_split"
    )
