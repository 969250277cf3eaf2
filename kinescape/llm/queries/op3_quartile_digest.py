"""Digests of every document and its edited text."""

from pyspark.sql import DataFrame, SparkSession

from kinescape.llm.fingerprints import fingerprint_edits


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: tested against a plain loop over the sorted documents."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
