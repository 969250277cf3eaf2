"""Queries that drain a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and kind, from a stream with a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    counts = online.window_counts(online.file_stream(spark, sf_dir, schema, "events.parquet"))
    day = F.datediff(F.to_date("start"), F.lit("2024-01-01").cast("date")).cast("long")
    return online.drained(counts).select(day.alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


QUERIES["stream_window_counts"] = stream_window_counts
SQL["stream_window_counts"] = """SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 3) AS total
FROM events GROUP BY 1, 2"""
