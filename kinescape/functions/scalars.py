"""Scalar expressions. Undefined values are null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def circularity(area: Column, perimeter: Column) -> Column:
    return ratio(4 * math.pi * area, perimeter * perimeter)


def legacy_circularity(area: Column, perimeter: Column) -> Column:
    """With a small constant below and 1 as the most."""
    return F.least(F.lit(1.0), 4 * math.pi * area / (perimeter * perimeter + F.lit(1e-9)))


def aspect_ratio(major: Column, minor: Column) -> Column:
    return ratio(major, minor)


def floored(value: Column, least: float) -> Column:
    """0 where the value is below ``least``; null stays null."""
    return F.when(value < least, 0.0).otherwise(value)


def min_max(value: Column, *by: str) -> Column:
    """Scaled to 0..1 within each group of ``by``."""
    group = Window.partitionBy(*by)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return (value - low) / (high - low + F.lit(1e-12))


def morphology(
    eccentricity: Column,
    area_um2: Column | None = None,
    elongated: float = 0.8,
    punctate: float = 0.6,
    least_elongated: float | None = None,
    least_punctate: float | None = None,
) -> Column:
    """Elongated, Punctate or Intermediate; an unset area gate passes, a null area fails a set one."""

    def gate(least: float | None) -> Column:
        return F.lit(True) if least is None else F.coalesce(area_um2 >= least, F.lit(False))

    return (
        F.when((eccentricity >= elongated) & gate(least_elongated), "Elongated")
        .when((eccentricity <= punctate) & gate(least_punctate), "Punctate")
        .otherwise("Intermediate")
    )


def fragmentation(objects: Column, area: Column) -> Column:
    """Objects a thousand pixels of area, 0 without area."""
    return ratio_or_zero(1000.0 * objects, area)


def connectivity(branches: Column, ends: Column) -> Column:
    return branches / (ends + 1.0)


def bound(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of ``values``, each of which is computed once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f)[0]


def integral(f: Callable[[Column], Column], low: Column, high: Column, pieces: int = 400) -> Column:
    """Simpson's rule over an even number of equal pieces; null where a bound is null."""

    def summed(at: Column) -> Column:
        def added(total: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == pieces), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return total + weight * f(at["low"] + i * at["step"])

        return at["step"] / 3 * F.aggregate(F.sequence(F.lit(0), F.lit(pieces)), F.lit(0.0), added)

    return bound(summed, low=low, step=(high - low) / pieces)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by the density up to ten deviations further."""

    def tail(of: Column) -> Column:
        beyond = integral(lambda v: F.exp(-v * v / 2), of["x"], of["x"] + 10.0)
        return F.when(of["x"].isNotNull(), F.least(F.lit(1.0), math.sqrt(2.0 / math.pi) * beyond))

    return bound(tail, x=F.abs(z))


def student_tail(t: Column, freedom: Column) -> Column:
    """Two-sided tail of Student's t distribution, for at least one degree of freedom, whole or not.

    With t = sqrt(freedom) * tan(a) the density is a power of cos(a); a = pi/2 - s*s smooths its
    end. The part left out lies ten deviations further.
    """

    def tail(of: Column) -> Column:
        def beyond(left: Column) -> Column:
            nearest = F.sqrt(F.greatest(left - 10.0 / F.sqrt(of["free"]), F.lit(0.0)))
            return integral(lambda s: 2.0 * s * F.pow(F.sin(s * s), of["free"] - 1.0), nearest, F.sqrt(left))

        share = ratio(beyond(of["left"]), beyond(F.lit(math.pi / 2)))
        return F.when(of["left"].isNotNull(), F.least(F.lit(1.0), share))

    free = F.when(freedom >= 1, freedom)
    return bound(tail, left=math.pi / 2 - F.atan(F.abs(t) / F.sqrt(free)), free=free)
