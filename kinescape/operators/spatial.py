"""Point patterns: nearest neighbours, pair counts, links within a gate.

Points meet in blocks of a quantile grid, as arrays, so no pair is a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinescape.functions.scalars import ratio, ratio_or_zero


#: Points of a block, and quantiles that part a group's points into strips and a strip's into cells.
BLOCK, CUTS = 512, 32
#: Points of one place that stand in one row.
HELD = 4096


def _around(places: DataFrame, size: float, spread: int) -> DataFrame:
    """Places with the grid cell cx, cy; with ``spread`` also in the cells around."""
    out = places.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    if spread:
        steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-spread, spread + 1) for j in range(-spread, spread + 1)))
        out = out.withColumn("s", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("s.i")).withColumn("cy", F.col("cy") + F.col("s.j")).drop("s")
    return out


def places(points: DataFrame, by: list[str]) -> DataFrame:
    """by, x, y, held (array of structs of the other columns): a row for at most ``HELD`` points of one place."""
    rest = [c for c in points.columns if c not in (*by, "x", "y")]
    part = F.floor((F.row_number().over(Window.partitionBy(*by, "x", "y").orderBy(*rest)) - 1) / HELD)
    got = points.withColumn("part", part).groupBy(*by, "x", "y", "part").agg(F.collect_list(F.struct(*rest)).alias("held"))
    return got.drop("part")


def near_places(left: DataFrame, right: DataFrame, reach: float, by: list[str]) -> DataFrame:
    """Pairs of places (by, x, y and other columns) no further apart than ``reach``: by, the left's
    columns, the right's after o_, distance.

    An equi-join on grid cells as wide as the reach, then the exact distance. Sides are sorted
    and merged: as nine cells hold a place, a broadcast side would fill the driver.
    """
    size = float(reach)
    keys = [*by, "cx", "cy"]
    theirs = _around(right, size, 1)
    theirs = theirs.select(*keys, *(F.col(c).alias(f"o_{c}") for c in theirs.columns if c not in keys))
    dx, dy = F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")
    met = _around(left, size, 0).join(theirs.hint("merge"), keys).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    return met.where(F.col("distance") <= reach).drop("cx", "cy")


def _placed(points: DataFrame, by: str, others: DataFrame) -> DataFrame:
    """Points with strip and cell, by quantiles of ``others``: about as many of them in each, outliers or not."""
    steps = [i / CUTS for i in range(1, CUTS)]
    wide = F.ceil(F.sqrt(F.col("n") / BLOCK))  # strips of a group, cells of a strip
    at = lambda c: F.floor(F.size(F.filter("cuts", lambda q: q < F.col(c))) * F.least(wide, F.lit(CUTS)) / CUTS)
    group = others.groupBy(by).agg(F.percentile_approx("x", steps, 1000).alias("cuts"), F.count("*").alias("n"))
    strip = lambda d: d.join(group, by, "left").withColumn("strip", F.coalesce(at("x"), F.lit(0))).drop("cuts", "n")
    each = strip(others).groupBy(by, "strip").agg(F.percentile_approx("y", steps, 1000).alias("cuts"), F.count("*").alias("m"))
    each = each.join(group.select(by, "n"), by)
    return strip(points).join(each, [by, "strip"], "left").withColumn("cell", F.coalesce(at("y"), F.lit(0))).drop("cuts", "n", "m")


def _blocks(placed: DataFrame, by: str, point: str) -> DataFrame:
    """Blocks of at most about ``BLOCK`` points of a cell: by, block, strip, cell, box, p, x, y (arrays)."""
    count = placed.groupBy(by, "strip", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64(point), F.col("parts"))
    got = placed.join(count, [by, "strip", "cell"]).groupBy(by, "strip", "cell", part.alias("part")).agg(
        F.collect_list(F.struct(F.col(point).alias("p"), "x", "y")).alias("all"),
        *(f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in ((0, F.min), (1, F.max))),
    )
    return got.select(
        by, F.struct("strip", "cell", "part").alias("block"), "strip", "cell", "x0", "x1", "y0", "y1",
        F.col("all.p").alias("p"), F.col("all.x").alias("x"), F.col("all.y").alias("y"),
    )


def _apart(a: str, b: str, near: bool) -> Column:
    """Least or greatest distance between the boxes of two blocks (columns ax0, ... and bx0, ...)."""
    gaps = []
    for c in ("x", "y"):
        one, two = F.col(f"{a}{c}0") - F.col(f"{b}{c}1"), F.col(f"{b}{c}0") - F.col(f"{a}{c}1")
        gaps.append(F.greatest(one, two, F.lit(0.0)) if near else F.greatest(-one, -two))
    return F.hypot(*gaps)


def _as(df: DataFrame, name: str, by: str) -> DataFrame:
    return df.select(by, *(F.col(c).alias(f"{name}{c}") for c in df.columns if c != by))


def nearest(points: DataFrame, others: DataFrame, by: str = "frame", point: str = "point_id", same: bool = False) -> DataFrame:
    """by, point_id, distance to the nearest of ``others`` in the group; none where there is no other.

    Points meet in blocks of a quantile grid. First those of a point's own cell are tried; the
    greatest distance found in a block then tells which other blocks can hold a nearer one. A
    point far from all costs its block more, not its whole group. Equal ids are the same point
    if ``same``.
    """
    theirs = _blocks(_placed(others.select(by, point, "x", "y"), by, others), by, point)
    mine = theirs if same else _blocks(_placed(points.select(by, point, "x", "y"), by, others), by, point)
    kind, name = dict(points.dtypes)[point], dict(points.dtypes)[by]

    def least(pairs: DataFrame) -> DataFrame:
        """by, p, d of the points of the a-block and their nearest of the b-blocks."""
        schema = f"`{by}` {name}, p {kind}, d double"

        def run(batches):
            for batch in batches:
                found = []
                for g, p, x, y, q, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    far = np.hypot(np.subtract.outer(x, u), np.subtract.outer(y, v))
                    if same:
                        far[np.equal.outer(p, q)] = np.inf
                    found.append(pa.table({by: [g] * len(p), "p": p, "d": far.min(axis=1)}))
                if found:
                    yield from pa.concat_tables(found).cast(target).to_batches()

        target = to_arrow_schema(pairs.sparkSession.createDataFrame([], schema).schema)
        return pairs.select(by, "ap", "ax", "ay", "bp", "bx", "by").mapInArrow(run, schema).groupBy(by, "p").agg(F.min("d").alias("d"))

    here = (F.col("astrip") == F.col("bstrip")) & (F.col("acell") == F.col("bcell"))
    # as an equi-join on the cell, so blocks of one cell alone meet
    first = least(_as(mine, "a", by).withColumns({"strip": F.col("astrip"), "cell": F.col("acell")}).join(
        _as(theirs, "b", by).withColumns({"strip": F.col("bstrip"), "cell": F.col("bcell")}), [by, "strip", "cell"]))
    reach = mine.select(by, "block", F.explode("p").alias("p")).join(first, [by, "p"], "left")
    reach = reach.groupBy(by, F.col("block").alias("ablock")).agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("reach"))
    boxes = lambda d, n: _as(d.drop("p", "x", "y"), n, by)
    wanted = boxes(mine, "a").join(reach, [by, "ablock"]).join(boxes(theirs, "b"), by).where(~here).where(_apart("a", "b", True) <= F.col("reach"))
    wanted = wanted.select(by, "ablock", "bblock")
    more = least(wanted.join(_as(mine, "a", by), [by, "ablock"]).join(_as(theirs, "b", by), [by, "bblock"]))
    both = first.unionByName(more).groupBy(by, "p").agg(F.min("d").alias("d")).where(F.col("d") < float("inf"))
    return both.select(by, F.col("p").alias(point), F.col("d").alias("distance"))


def pairs_within(points: DataFrame, others: DataFrame, reach: float, by: str = "frame", digits: int | None = None) -> DataFrame:
    """All pairs of a group no further apart than ``reach``: p columns, o columns (x2, y2), distance.

    Places meet, not points: a distance is told once for all points of two places, and rounded
    where ``digits`` are given. Pairs are the last step, and nothing is dealt out after it.
    """
    met = near_places(places(points, [by]), places(others, [by]), reach, [by])
    if digits is not None:
        met = met.withColumn("distance", F.round("distance", digits))
    spread = met.withColumn("p", F.explode("held")).withColumn("o", F.explode("o_held"))
    own = [c for c in points.columns if c not in (by, "x", "y")]
    theirs = [c for c in others.columns if c not in (by, "x", "y")]
    return spread.select(
        by, "x", "y", *(F.col(f"p.{c}") for c in own), *(F.col(f"o.{c}").alias(f"o_{c}") for c in theirs),
        F.col("o_x").alias("x2"), F.col("o_y").alias("y2"), "distance",
    )


def ripley(points: DataFrame, radii: list[float], area: Column | float, by: str = "frame", point: str = "point_id") -> DataFrame:
    """K of each group and radius: area / n^2 * ordered pairs no further apart than it.

    Places meet in blocks, each two blocks once, weighted by the points there, and give a row for
    each radius that first holds some of their pairs; two blocks between whose boxes no radius
    changes are counted whole. No edge correction; 0 for fewer than two points.
    """
    radii = sorted(float(r) for r in radii)
    steps = F.array(*map(F.lit, radii))
    n = points.groupBy(by).agg(F.count("*").alias("n"))
    spots = points.groupBy(by, "x", "y").agg(F.count("*").alias("w")).withColumn("spot", F.struct("w", "x", "y"))
    held = _blocks(_placed(spots.select(by, "spot", "x", "y"), by, spots), by, "spot").withColumn("p", F.col("p.w"))
    held = held.withColumn("n", F.aggregate("p", F.lit(0).cast("long"), lambda s, w: s + w))
    boxes = [_as(held.drop("p", "x", "y"), name, by) for name in "ab"]
    at = lambda near: F.size(F.filter(steps, lambda r: r < _apart("a", "b", near)))
    met = boxes[0].join(boxes[1], by).where(F.col("ablock") <= F.col("bblock")).withColumns({"i": at(True), "last": at(False)})
    met = met.where(F.col("i") < len(radii))
    same = F.col("ablock") == F.col("bblock")
    whole = met.where((F.col("i") == F.col("last")) & ~same).select(by, "i", (2 * F.col("an") * F.col("bn")).cast("long").alias("pairs"))
    rest = met.where((F.col("i") != F.col("last")) | same).select(by, "ablock", "bblock")
    rest = rest.join(_as(held, "a", by).hint("merge"), [by, "ablock"]).join(_as(held, "b", by).hint("merge"), [by, "bblock"])
    rest = rest.select(by, same.alias("same"), "ap", "ax", "ay", "bp", "bx", "by")
    schema = f"`{by}` {dict(points.dtypes)[by]}, i int, pairs long"
    target = to_arrow_schema(points.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            found = []
            for g, one, n1, x, y, n2, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                far = np.sqrt(np.subtract.outer(x, u) ** 2 + np.subtract.outer(y, v) ** 2)
                pairs = np.outer(n1, n2).astype(float)  # sums of whole numbers, exact below 2^53
                if one:
                    np.fill_diagonal(pairs, np.multiply(n1, np.subtract(n1, 1)))
                else:
                    pairs *= 2
                count = np.bincount(np.searchsorted(radii, far.ravel()), pairs.ravel(), len(radii) + 1)[: len(radii)].astype(np.int64)
                some = np.flatnonzero(count)
                found.append(pa.table({by: [g] * len(some), "i": some, "pairs": count[some]}))
            if found:
                yield from pa.concat_tables(found, promote_options="permissive").cast(target).to_batches()

    counted = rest.mapInArrow(run, schema).unionByName(whole).groupBy(by, "i").agg(F.sum("pairs").alias("pairs"))
    grid = n.select(by, "n", F.posexplode(steps).alias("i", "radius")).join(counted, [by, "i"], "left")
    total = F.sum(F.coalesce("pairs", F.lit(0))).over(Window.partitionBy(by).orderBy("i"))
    spread = area if isinstance(area, Column) else F.lit(float(area))
    k = F.when(F.col("n") < 2, 0.0).otherwise(spread / (F.col("n") * F.col("n")) * F.col("total"))
    return grid.withColumn("total", total).select(by, "radius", k.alias("k"))


def radii_for(area: float, count: int = 50) -> list[float]:
    """Evenly spaced from 0 to a quarter of the square root of the area."""
    return [math.sqrt(area) / 4 * i / (count - 1) for i in range(count)]


def field_area(points: DataFrame) -> DataFrame:
    """Bounding box of all centres."""
    return points.agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))


def clark_evans(points: DataFrame, area: float, by: str = "frame", point: str = "point_id") -> DataFrame:
    """Mean nearest distance over the one expected of random points, for groups of two or more."""
    near = nearest(points, points, by, point, same=True)
    got = near.groupBy(by).agg(F.avg("distance").alias("mean"), F.count("*").alias("n"))
    return got.select(by, "n", (F.col("mean") / (0.5 * F.sqrt(F.lit(float(area)) / F.col("n")) + F.lit(1e-12))).alias("r"))


def spatial_summary(within_a: DataFrame, within_b: DataFrame, between: DataFrame) -> DataFrame:
    """Mean distances within either population and between them, 0 where there are none."""
    means = [d.agg(F.coalesce(F.avg("distance"), F.lit(0.0)).alias(n)) for d, n in ((within_a, "mean_a"), (within_b, "mean_b"), (between, "mean_between"))]
    return means[0].crossJoin(means[1]).crossJoin(means[2])  # three single rows


def evaluate_points(truth: DataFrame, found: DataFrame, reach: float, by: str = "frame", point: str = "point_id") -> DataFrame:
    """Per group: found points with a truth in reach, those without, truths without a found point."""
    hits = nearest(found, truth, by, point).where(F.col("distance") <= reach)
    seen = nearest(truth, found, by, point).where(F.col("distance") <= reach)
    count = lambda d, n: d.groupBy(by).agg(F.count("*").alias(n))
    joined = (
        count(truth, "truths").join(count(found, "predictions"), by, "full").join(count(hits, "correct"), by, "left").join(count(seen, "seen"), by, "left")
        .na.fill(0, ["truths", "predictions", "correct", "seen"])
    )
    return joined.select(
        by, "truths", "predictions", "correct",
        (F.col("predictions") - F.col("correct")).alias("false_positives"),
        (F.col("truths") - F.col("seen")).alias("false_negatives"),
        ratio_or_zero(F.col("seen"), F.col("truths")).alias("recall"),
        ratio(F.col("correct"), F.col("predictions")).alias("precision"),
    )
