"""Tables in other tools' layouts, CSV and JSON records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinescape.functions.scalars import ratio

#: Column names of the per-object layout, by ours.
OBJECT_NAMES = {
    "area": "AreaShape_Area", "eccentricity": "AreaShape_Eccentricity", "solidity": "AreaShape_Solidity",
    "circularity": "AreaShape_FormFactor", "aspect_ratio": "AreaShape_AspectRatio", "orientation": "AreaShape_Orientation",
}
_OURS = [(re.compile(p, re.IGNORECASE), n) for p, n in (
    ("eccentricity", "eccentricity"), ("solidity", "solidity"), ("form_?factor|circularity", "circularity"),
    ("aspect_?ratio", "aspect_ratio"), ("orientation", "orientation"), ("(^|_)area$", "area"), ("frame|imagenumber", "frame"),
)]


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header under an explicit schema; ``inf`` is infinite, a blank null."""
    return spark.read.schema(schema).csv(path, header=True, positiveInf="inf", negativeInf="-inf", nanValue="nan")


def write_table(df: DataFrame, path: str, format: str = "parquet", order: tuple[str, ...] = ()) -> None:
    """Refuses a path that exists; rows go by ``order`` over the files, where it is given."""
    df = df.orderBy(*order) if order else df
    df.write.mode("errorifexists").format(format).options(**({"header": True} if format == "csv" else {})).save(path)


def per_object(shapes: DataFrame, order: list[str]) -> DataFrame:
    """The per-object layout: ImageNumber from 1, ObjectNumber by place in ``order`` over the table."""
    at = F.row_number().over(Window.partitionBy("frame").orderBy(*order))
    before = shapes.groupBy("frame").agg(F.count("*").alias("n"))
    start = before.select("frame", (F.sum("n").over(Window.orderBy("frame")) - F.col("n")).alias("start"))  # frames only
    placed = shapes.join(start, "frame").withColumn("ObjectNumber", (at + F.col("start")).cast("long"))
    return placed.select(
        (F.col("frame") + 1).cast("long").alias("ImageNumber"), "ObjectNumber",
        *(F.col(c).alias(n) for c, n in OBJECT_NAMES.items() if c in shapes.columns),
    )


def network_table(frames: DataFrame) -> DataFrame:
    """The network layout: eight fixed columns, unknown ones null."""
    have = {c: F.col(c) for c in frames.columns}
    names = {
        "Frame": ("frame", "long"), "Individuals": ("objects", "long"), "Networks": ("networks", "long"),
        "Mean_Branch_Length": ("branch_length", "double"), "Median_Branch_Length": ("median_branch_length", "double"),
        "Mean_Network_Size": ("branches", "double"), "Footprint": ("area", "double"), "Mean_Summed_Length": ("length", "double"),
    }
    return frames.select(*(have.get(c, F.lit(None)).cast(k).alias(n) for n, (c, k) in names.items()))


def per_frame(shapes: DataFrame) -> DataFrame:
    """The per-frame layout: total, mean and number of areas, mean aspect ratio and solidity."""
    return shapes.groupBy("frame").agg(
        F.sum("area").alias("total_area"), F.avg("area").alias("mean_area"), F.count("area").alias("objects"),
        F.avg("aspect_ratio").alias("mean_aspect_ratio"), F.avg("solidity").alias("mean_solidity"),
    )


def renamed(table: DataFrame) -> DataFrame:
    """Another tool's object table under our names, by patterns; the first match of a name stays."""
    taken, out = set(), []
    for c in table.columns:
        name = next((n for p, n in _OURS if p.search(c) and n not in taken), c)
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return table.select(*out)


def records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def object_sizes(pixels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return pixels.where(F.col(label) > 0).groupBy(*by, label).agg(F.count("*").alias("size"))


def mean_size(pixels: DataFrame, by: list[str]) -> DataFrame:
    sizes = object_sizes(pixels, by)
    return sizes.groupBy(*by).agg(ratio(F.sum("size"), F.count("*")).alias("mean_size"), F.count("*").alias("objects"))
