"""Pack every document into sequences of at most 2048 ids."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinescape.llm.packing import pack


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: tested against the library's own ids, and for gapless sequences."""
    return pack(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )
