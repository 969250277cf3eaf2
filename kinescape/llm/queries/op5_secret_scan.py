"""Secrets of every document: counts of base kinds, their digest, and all spans."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.llm.secrets import scan


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not SQL: non-overlapping matches with code-point positions; tested against plain patterns."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s["linked"])
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["linked"])).cast("long").alias("n_linked"),
    )
