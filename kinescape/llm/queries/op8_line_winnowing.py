"""Documents without later repeats of runs of words."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.llm.line_dedup import drop_repeated


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: tested against a plain search of all earlier runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated(docs).select(
        "doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )
