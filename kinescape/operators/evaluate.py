"""Scores of masks against references, sweeps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescape.functions.scalars import ratio_or_zero


def mask_scores(pixels: DataFrame, by: list[str], found: str = "found", truth: str = "truth") -> DataFrame:
    """Dice, IoU, precision, recall, F1 of each group; 0 where undefined."""
    f, t = F.col(found), F.col(truth)
    tp, fp, fn = F.count_if(f & t), F.count_if(f & ~t), F.count_if(~f & t)
    return scored(pixels.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))


def scored(counts: DataFrame) -> DataFrame:
    """Counts tp, fp, fn with dice, iou, precision, recall, f1; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    dice = ratio_or_zero(2 * tp, 2 * tp + fp + fn)
    return counts.select(
        "*", dice.alias("dice"), ratio_or_zero(tp, tp + fp + fn).alias("iou"),
        ratio_or_zero(tp, tp + fp).alias("precision"), ratio_or_zero(tp, tp + fn).alias("recall"), dice.alias("f1"),
    )


def threshold_sweep(pixels: DataFrame, value: str, truth: str, thresholds: list[float], by: list[str]) -> DataFrame:
    """Scores of ``value`` > threshold for each threshold; pixels are read once, counted per threshold."""
    each = pixels.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    return mask_scores(each.withColumn("found", F.col(value) > F.col("threshold")), [*by, "threshold"], "found", truth)


def flat_report(scores: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """category, metric, value with a row for each metric."""
    doubles = scores.select(F.col(category).cast("string").alias("category"), *(F.col(m).cast("double").alias(m) for m in metrics))
    return doubles.unpivot(["category"], metrics, "metric", "value")
