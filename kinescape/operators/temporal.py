"""Series over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinescape.functions.scalars import ratio, ratio_or_zero


def autocorrelation(series: DataFrame, value: str, by: list[str], order: str, lags: int) -> DataFrame:
    """by, lag, acf for lags 0 to ``lags`` (below the series' length), by place in the order.

    Mean-centred, over the sum of squares; 0 throughout for a constant series. One equi-join
    of places with shifted places.
    """
    group = Window.partitionBy(*by)
    placed = series.select(
        *by, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).alias("t"),
        (F.col(value) - F.avg(value).over(group)).alias("v"), F.count("*").over(group).alias("len"),
    )
    shifted = placed.select(*by, "t", F.col("v").alias("w"))
    lagged = placed.select(*by, "t", "v", "len", F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    lagged = lagged.where("lag < len").withColumn("at", F.col("t")).withColumn("t", F.col("t") + F.col("lag"))
    sums = lagged.join(shifted, [*by, "t"]).groupBy(*by, "lag").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    total = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(group)
    return sums.select(*by, F.col("lag").cast("long").alias("lag"), ratio_or_zero(F.col("s"), total).alias("acf"))


def change_points(series: DataFrame, value: str, by: list[str], order: str, threshold: float = 2.0) -> DataFrame:
    """Places where the size of the difference's z-score is a strict inner peak of at least ``threshold``."""
    run, group = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    diffs = series.select(*by, order, (F.col(value) - F.lag(value).over(run)).alias("d")).where("d IS NOT NULL")
    spread = F.stddev_pop("d").over(group)
    scored = diffs.withColumn("z", F.abs(ratio(F.col("d") - F.avg("d").over(group), spread)))
    around = scored.withColumn("before", F.lag("z").over(run)).withColumn("after", F.lead("z").over(run))
    return around.where((F.col("z") >= threshold) & (F.col("z") > F.col("before")) & (F.col("z") > F.col("after"))).select(*by, order, "z")


def stability(series: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Population deviation over the mean; 0 where the mean is 0."""
    return series.groupBy(*by).agg(ratio_or_zero(F.stddev_pop(value), F.avg(value)).alias("stability"), F.count("*").alias("n"))


def middle(frames: DataFrame, by: list[str], order: str) -> DataFrame:
    """The middle (n div 2, from 0) of the sorted distinct values of each group."""
    some = frames.select(*by, order).distinct()
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    return some.select(*by, order, at.alias("at"), n.alias("n")).where(F.col("at") == F.expr("n div 2")).select(*by, order)


def elongation(classes: DataFrame, by: list[str], kind: str = "morphology") -> DataFrame:
    """Numbers of Elongated and Punctate objects and the share of the former among both."""
    got = classes.groupBy(*by).agg(
        F.count_if(F.col(kind) == "Elongated").alias("elongated"), F.count_if(F.col(kind) == "Punctate").alias("punctate")
    )
    return got.withColumn("ratio", ratio(F.col("elongated"), F.col("elongated") + F.col("punctate")))
