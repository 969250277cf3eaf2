"""Licence wordings of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.llm.licenses import scan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: alignment; tested against a search for each whole wording."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = F.transform(
        "matches",
        lambda m: F.concat_ws(
            ":", m["license"], m["start"].cast("string"), m["end"].cast("string"),
            F.format_number(m["coverage"], 3),
        ),
    )
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.array_join(told, ",").alias("spans"),
    )
