"""Overlap of two channels over pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescape.functions.scalars import ratio, ratio_or_zero


def pearson(a: Column, b: Column) -> Column:
    """Null where either side is constant or there are fewer than two rows."""
    return F.when(
        (F.count("*") > 1) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)),
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)),
    )


def check_pixels(pixels: DataFrame, *values: str) -> None:
    """Raise on null, non-finite or negative intensities, or on no pixels at all."""
    bad = [F.count_if(F.col(v).isNull() | F.isnan(v) | (F.abs(F.col(v)) == float("inf")) | (F.col(v) < 0)) for v in values]
    told = pixels.agg(F.count("*"), *bad).first()
    if not told[0]:
        raise ValueError("the region holds no pixel")
    if any(told[1:]):
        raise ValueError("intensities must be finite and not negative")


def less_background(pixels: DataFrame, percentile: float, by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Intensities less their group's exact percentile (0 to 100, linear), 0 at least."""
    lows = pixels.groupBy(*by).agg(*(F.percentile(v, percentile / 100).alias(f"__{v}") for v in values))
    out = pixels.join(lows, list(by))
    for v in values:
        out = out.withColumn(v, F.greatest(F.col(v) - F.col(f"__{v}"), F.lit(0.0)))
    return out.drop(*(f"__{v}" for v in values))


def overlap(
    pixels: DataFrame, by: tuple[str, ...] = ("frame",), a: str = "a", b: str = "b", mask_a: str = "in_a", mask_b: str = "in_b"
) -> DataFrame:
    """Metrics of each group in one aggregation; undefined ones are null.

    Manders m1 is the share of a's intensity within its mask that lies in both masks.
    """
    x, y, p, q = F.col(a), F.col(b), F.col(mask_a), F.col(mask_b)
    both = p & q
    part = lambda v, m: F.sum(F.when(m, v).otherwise(0.0))
    return pixels.groupBy(*by).agg(
        ratio(F.count_if(both), F.count_if(p | q)).alias("jaccard"),
        ratio(part(x, both), part(x, p)).alias("manders_m1"),
        ratio(part(y, both), part(y, q)).alias("manders_m2"),
        pearson(x, y).alias("pearson"),
        ratio(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"),
        F.count("*").alias("roi_pixels"),
        F.count_if(both).alias("overlap_pixels"),
        F.count_if(p).alias("a_pixels"),
        F.count_if(q).alias("b_pixels"),
    )


def legacy_overlap(
    pixels: DataFrame, by: tuple[str, ...] = ("frame",), a: str = "a", b: str = "b", mask_a: str = "in_a", mask_b: str = "in_b"
) -> DataFrame:
    """The earlier metrics: Manders over the other's mask and all intensity, 0 where undefined, percent overlap."""
    x, y, p, q = F.col(a), F.col(b), F.col(mask_a), F.col(mask_b)
    part = lambda v, m: F.sum(F.when(m, v).otherwise(0.0))
    shared = ratio_or_zero(F.count_if(p & q), F.count_if(p | q))
    return pixels.groupBy(*by).agg(
        shared.alias("jaccard"),
        (100.0 * shared).alias("overlap_percent"),
        ratio_or_zero(part(x, q), F.sum(x)).alias("manders_m1"),
        ratio_or_zero(part(y, p), F.sum(y)).alias("manders_m2"),
        F.coalesce(pearson(x, y), F.lit(0.0)).alias("pearson"),
        ratio_or_zero(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine"),
        F.sum(x).alias("a_total"),
        F.sum(y).alias("b_total"),
    )


def within(pixels: DataFrame, region: DataFrame, *keys: str) -> DataFrame:
    """Pixels of a region of interest: keys (frame), y, x, or y, x alone for all frames."""
    on = [c for c in (*keys, "y", "x") if c in region.columns]
    return pixels.join(region.select(*on).distinct(), on, "left_semi")


def otsu(pixels: DataFrame, by: tuple[str, ...], value: str, bins: int = 256, factor: float = 1.0) -> DataFrame:
    """Threshold of the greatest between-class variance, by bin centres, times ``factor``.

    A constant group has its value. Histograms are pre-aggregated; windows run over bins only.
    """
    from pyspark.sql import Window

    span = pixels.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(bins - 1)).cast("int")
    counts = pixels.join(span, list(by)).groupBy(*by, "lo", "hi", F.coalesce(at, F.lit(0)).alias("bin")).agg(
        F.count("*").cast("double").alias("n")
    )
    counts = counts.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    up = Window.partitionBy(*by).orderBy("bin")
    group = Window.partitionBy(*by)
    below = counts.select(
        *by, "lo", "hi", "bin", "centre",
        F.sum("n").over(up).alias("w1"),
        F.sum(F.col("n") * F.col("centre")).over(up).alias("s1"),
        F.sum("n").over(group).alias("w"),
        F.sum(F.col("n") * F.col("centre")).over(group).alias("s"),
    )
    w2 = F.col("w") - F.col("w1")
    apart = F.try_divide(F.col("s1"), F.col("w1")) - F.try_divide(F.col("s") - F.col("s1"), w2)
    scored = below.withColumn("score", F.coalesce(F.col("w1") * w2 * apart * apart, F.lit(-1.0)))
    best = scored.groupBy(*by).agg(
        F.max_by("centre", F.struct("score", -F.col("bin"))).alias("t"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    return best.select(
        *by, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("t") * factor).alias("threshold")
    )
