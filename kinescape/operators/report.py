"""Tables of frames, samples and replicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescape.operators.motion import check_unique

_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def frame_report(
    frames: DataFrame, shapes: DataFrame, speeds: DataFrame, metrics: list[str], kinds: list[str],
    overlap: DataFrame | None = None, by: tuple[str, ...] = ("frame",),
) -> DataFrame:
    """One row for each frame of ``frames``: per kind the means of ``metrics``, the number of objects
    (0 without any) and the mean speed; then overlap. Keys are unique by aggregation."""
    by = list(by)
    wide = [F.avg(F.when(F.col("kind") == k, F.col(m))).alias(f"{k}_{m}") for k in kinds for m in metrics]
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds]
    told = shapes.groupBy(*by).agg(*wide, *counts)
    fast = speeds.groupBy(*by).agg(*(F.max(F.when(F.col("kind") == k, F.col("mean_speed"))).alias(f"{k}_mean_speed") for k in kinds))
    out = frames.select(*by).distinct().join(told, by, "left").join(fast, by, "left")
    out = out.na.fill(0, [f"{k}_count" for k in kinds])
    return out if overlap is None else out.join(overlap, by, "left")


def chained(tables: dict[str, DataFrame], by: str = "frame") -> DataFrame:
    """Rows of the frames that all tables hold; a column of several tables is named after each of them."""
    held = [c for t in tables.values() for c in t.columns if c != by]
    out = None
    for name, table in tables.items():
        own = table.select(by, *(F.col(c).alias(f"{c}_{name}" if held.count(c) > 1 else c) for c in table.columns if c != by))
        out = own if out is None else out.join(own, by)
    return out


def sample_report(report: DataFrame, sample: str, replicate: str | None, drop: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One row: the mean of every numeric column over frames."""
    means = [F.avg(c).alias(c) for c, k in report.dtypes if k in _NUMBERS and c not in drop]
    return report.agg(*means, F.count("*").alias("frames")).select(
        "*", F.lit(sample).alias("sample_id"), F.lit(replicate).cast("string").alias("replicate_id"), F.lit("frame mean").alias("analysis_unit")
    )


def replicate_report(samples: DataFrame, replicate: str = "replicate_id", sample: str = "sample_id", drop: tuple[str, ...] = ("frames",)) -> DataFrame:
    """Means of the numeric columns over each replicate's samples; ids must be known and samples unique."""
    if not samples.where(F.col(replicate).isNull() | F.col(sample).isNull()).isEmpty():
        raise ValueError("every sample needs its own id and its replicate's")
    check_unique(samples, sample)
    means = [F.avg(c).alias(c) for c, k in samples.dtypes if k in _NUMBERS and c not in (*drop, replicate, sample)]
    return samples.groupBy(replicate).agg(*means, F.count("*").alias("samples"))


def preview(table: DataFrame, rows: int = 200, columns: int = 20, shown: int = 3) -> dict:
    """Columns and a few rows of a table, bounded in both directions."""
    head = table.select(*(F.col(f"`{c}`") for c in table.columns[:columns])).limit(rows)
    return {"columns": head.columns, "rows": head.count(), "first": [r.asDict() for r in head.take(shown)]}
