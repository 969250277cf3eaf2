"""Views of the generic tables as trajectories, detections, pixels, tiles, measures and series.

Each has the same view in SQL, as text of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a track for each user, a frame for each day with its first event."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    first = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    one = events.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    frame = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return one.select(
        F.col("user_id").alias("track_id"), frame.cast("long").alias("frame"), F.floor(frame / 7).cast("long").alias("week"),
        F.col("value").alias("x"), F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("y"),
        F.when(F.col("event_type") == "error", "ambiguous").otherwise("matched").alias("link_status"), "event_type",
    )


TRAJECTORY = """trajectory AS (
  SELECT user_id AS track_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame,
    CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS BIGINT) AS week,
    value AS x, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS y,
    CASE WHEN event_type = 'error' THEN 'ambiguous' ELSE 'matched' END AS link_status, event_type
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
  WHERE n = 1)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: a frame for each brand, places by size and price, two populations by type."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_brand").alias("frame"), F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"),
        F.col("p_retailprice").alias("y"),
        F.when(F.length("p_type") % 2 == 0, "a").otherwise("b").alias("kind"),
    )


DETECTIONS = """detections AS (
  SELECT p_brand AS frame, p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
    CASE WHEN length(p_type) % 2 = 0 THEN 'a' ELSE 'b' END AS kind FROM part)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: a frame for each supplier; channels by price and quantity; masks by fixed levels."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias("frame"), F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"),
        (F.col("l_extendedprice") > 30000).alias("in_a"), (F.col("l_quantity") > 25).alias("in_b"),
        F.col("l_returnflag").alias("flag"),
    )


PIXELS = """pixels AS (
  SELECT l_suppkey AS frame, l_extendedprice AS a, l_quantity AS b, l_extendedprice > 30000 AS in_a, l_quantity > 25 AS in_b,
    l_returnflag AS flag FROM lineitem)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: 8 by 8 tiles; a movie for each label, frames in order of vec_id."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("movie"), (F.row_number().over(order) - 1).alias("frame"), "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("values"),
    )


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select(
        "vec_id", F.posexplode("values").alias("pos", "v")
    ).select("vec_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), "v")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: objects with a kind by return flag, a frame by line number, and derived measures."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')")
    return lines.select(
        F.when(F.col("l_returnflag") == "A", "p").otherwise("q").alias("kind"), F.col("l_linenumber").cast("long").alias("frame"),
        F.col("l_orderkey").alias("object_id"), F.col("l_quantity").alias("area"), (F.col("l_discount") * 10).alias("eccentricity"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("solidity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("aspect_ratio"),
    )


SHAPES = """shapes AS (
  SELECT CASE WHEN l_returnflag = 'A' THEN 'p' ELSE 'q' END AS kind, CAST(l_linenumber AS BIGINT) AS frame, l_orderkey AS object_id,
    l_quantity AS area, l_discount * 10 AS eccentricity, CASE WHEN l_tax > 0 THEN l_tax END AS solidity,
    l_extendedprice / l_quantity AS aspect_ratio FROM lineitem WHERE l_returnflag IN ('A', 'R'))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: per type and day the mean value and number of events."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", day.alias("frame")).agg(
        F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n")
    )


SERIES = """series AS (
  SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS frame, round(avg(value), 6) AS value, count(*) AS n
  FROM events GROUP BY 1, 2)"""
