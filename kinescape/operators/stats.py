"""Rank and group statistics as aggregations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescape.functions.scalars import normal_tail, ratio, student_tail
from kinescape.operators.overlap import pearson


#: Ranges of each octave of values, so that no group is sorted in one task.
PIECES = 1 << 14


def _range(value: Column) -> Column:
    """Number of a value's range: greater values have no lesser number. It depends on the value alone."""
    v = value.cast("double")
    size = F.abs(v)
    octave = F.floor(F.log2(size)).cast("double")
    # a line within each octave, from octave to octave + 1; the least octave of doubles is -1074
    place = F.floor(PIECES * F.signum(v) * (1100.0 + octave + size / F.pow(F.lit(2.0), octave)))
    last = 4096 * PIECES
    infinite = F.when(v > 0, last).otherwise(-last)
    return F.when(F.isnan(v), 2 * last).when(size == float("inf"), infinite).when(v == 0, 0).otherwise(place).cast("long")


def _told(df: DataFrame, value: str, by: tuple[str, ...], name: str) -> tuple[list[Column], list[str], DataFrame]:
    """Columns that stand for ``by``, their names, and a row for each group and value ``__v`` with ``name``."""
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)] or [F.lit(0).alias("__k0")]
    names = [f"__k{i}" for i in range(max(len(by), 1))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("ties"))
    told = _below(counts, names, "__v")
    return keys, names, told.select(*names, "__v", F.struct("below", "ties").alias(name))


def _below(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts (by, value, ties) with ``below``, the rows of the group with a lesser value: the sum over ranges."""
    placed = counts.withColumn("range", _range(F.col(value)))
    held = placed.groupBy(*by, "range").agg(F.sum("ties").alias("n"))
    before = held.select(*by, "range", (F.sum("n").over(Window.partitionBy(*by).orderBy("range")) - F.col("n")).alias("before"))
    own = F.sum("ties").over(Window.partitionBy(*by, "range").orderBy(value)) - F.col("ties")
    told = placed.withColumn("own", own).join(before, [*by, "range"])
    return told.withColumn("below", F.col("own") + F.col("before")).drop("own", "before", "range")


def standing(df: DataFrame, value: str, by: tuple[str, ...] = (), name: str | None = None) -> DataFrame:
    """Rows with ``name``: a struct of below and ties, the rows of the group with a lesser and with an equal value.

    Equal values are counted first. Each octave of values is cut into ``PIECES`` fixed ranges,
    which are summed over on their own; what the ranges before hold is added from a table of
    a row for each range that a group uses. Null values stand nowhere.
    """
    return standings(df, by, **{value: name or f"{value}_standing"})


def standings(df: DataFrame, by: tuple[str, ...], **named: str) -> DataFrame:
    """As :func:`standing` for several values, each counted from ``df`` itself."""
    out = df
    for value, name in named.items():
        keys, names, told = _told(df, value, by, name)
        out = out.select("*", *keys, F.col(value).alias("__v")).join(told, [*names, "__v"], "left").drop(*names, "__v")
    return out


def average_rank(standing: str) -> Column:
    """Mean of the ranks that ties share, from :func:`standing`."""
    return F.col(f"{standing}.below") + (F.col(f"{standing}.ties") + 1) / F.lit(2.0)


def spearman(df: DataFrame, variables: list[str], by: tuple[str, ...] = (), least: int = 3, digits: int | None = None) -> DataFrame:
    """var_a, var_b, rho, n of each pair over rows where both are known; null below ``least`` rows."""
    pairs = F.array(
        *(
            F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(a).cast("double").alias("p"), F.col(b).cast("double").alias("q"))
            for a, b in combinations(variables, 2)
        )
    )
    long = df.select(*by, F.explode(pairs).alias("v")).select(*by, "v.*").where("p IS NOT NULL AND q IS NOT NULL")
    keys = (*by, "var_a", "var_b")
    # rows of equal values are one; a struct of keys is equal where they are null
    cells = long.groupBy(F.struct(*keys).alias("g"), "p", "q").agg(F.count("*").alias("n"))
    total = cells.groupBy("g").agg(F.sum("n").alias("all"))
    ranked = cells
    for c in "pq":
        told = _below(cells.groupBy("g", c).agg(F.sum("n").alias("ties")), ["g"], c)
        # a rank from the mean of all ranks
        ranked = ranked.join(told.select("g", c, (F.col("below") + F.col("ties") / F.lit(2.0)).alias(f"at_{c}")), ["g", c])
    ranked = ranked.join(total, "g").select("g", "n", *((F.col(f"at_{c}") - F.col("all") / 2).alias(c) for c in "pq"))
    of = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    varied = (F.min("p") < F.max("p")) & (F.min("q") < F.max("q"))
    got = ranked.groupBy("g").agg(
        F.when(varied, F.try_divide(of("p", "q"), F.sqrt(of("p", "p")) * F.sqrt(of("q", "q")))).alias("rho"), F.sum("n").alias("n")
    ).select("g.*", "rho", "n")
    rho = F.when(F.col("n") >= least, F.col("rho"))
    return got.withColumn("rho", F.round(rho, digits) + F.lit(0.0) if digits is not None else rho)


def pair_counts(df: DataFrame, variables: list[str]) -> DataFrame:
    """Rows in which both variables are known, of each pair; one pass, zeros included."""
    cells = [
        F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))
        for a in variables
        for b in variables
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value with a row for each metric."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def five_numbers(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, median, extremes, quartiles and count of each group and metric."""
    known = long_form(df, by, metrics).where("value IS NOT NULL").select(F.struct(*by, "metric").alias("g"), "value")
    group = known.groupBy("g").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("*").alias("n"),
    )
    placed = _below(known.groupBy("g", "value").agg(F.count("*").alias("ties")), ["g"], "value").join(group.select("g", "n"), "g")
    shares, picked = {"q1": 0.25, "median": 0.5, "q3": 0.75}, []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(share)
        for end, k in (("low", F.floor(at)), ("high", F.ceil(at))):
            picked.append(F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("ties")), F.col("value"))).alias(f"{name}_{end}"))
    got = group.join(placed.groupBy("g").agg(*picked), "g")

    def between(name: str) -> Column:
        at, low, high = (F.col("n") - 1) * F.lit(shares[name]), F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return got.select("g.*", "mean", "std", between("median"), "min", "max", between("q1"), between("q3"), "n")


def two_populations(df: DataFrame, kind: str, first: str, second: str, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """Mann-Whitney U with rank-biserial effect, Cohen's d in two forms, t statistics, of each metric.

    p is the normal approximation with tie correction; p_adjusted multiplies by the number of
    metrics, 1 at most. welch_p and student_p are two-sided. Undefined values are null.
    """
    known = long_form(df.where(F.col(kind).isin(first, second)), [kind], metrics).where("value IS NOT NULL")
    a, b = F.col(kind) == first, F.col(kind) == second
    of = lambda f, m, c: f(F.when(m, F.col(c)))
    # ranks come from counts of values, so that no row meets the table of ranks
    counts = known.groupBy("metric", "value").agg(F.count("*").alias("ties"), F.count_if(a).alias("in_a"), F.count_if(b).alias("in_b"))
    ties = F.col("ties").cast("double")
    ranks = _below(counts, ["metric"], "value").groupBy("metric").agg(
        F.sum("in_a").cast("double").alias("n1"), F.sum("in_b").cast("double").alias("n2"),
        F.sum(F.col("in_a") * (F.col("below") + (ties + 1) / 2)).alias("r1"), F.sum(ties * (ties * ties - 1.0)).alias("tied"),
    )
    got = known.groupBy("metric").agg(
        of(F.avg, a, "value").alias("mean1"), of(F.avg, b, "value").alias("mean2"),
        of(F.var_samp, a, "value").alias("v1"), of(F.var_samp, b, "value").alias("v2"),
    ).join(ranks, "metric").where("n1 > 0 AND n2 > 0")
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(ratio(F.col("tied"), n * (n - 1)), F.lit(0.0))))
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n - 2))
    apart = F.col("mean1") - F.col("mean2")
    e1, e2 = v1 / n1, v2 / n2
    welch, student = ratio(apart, F.sqrt(e1 + e2)), ratio(apart, pooled * F.sqrt(1 / n1 + 1 / n2))
    freedom = ratio((e1 + e2) * (e1 + e2), ratio(e1 * e1, n1 - 1) + ratio(e2 * e2, n2 - 1))
    out = got.select(
        "metric", n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"),
        (1 - ratio(2 * u, n1 * n2)).alias("rank_biserial"),
        ratio(apart, pooled).alias("cohens_d"),
        (apart / (F.sqrt((v1 + v2) / 2) + F.lit(1e-12))).alias("cohens_d_plain"),
        welch.alias("welch_t"), student.alias("student_t"),
        student_tail(welch, freedom).alias("welch_p"), student_tail(student, n - 2).alias("student_p"),
        normal_tail(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.nullif(spread, F.lit(0.0))).alias("p"),
    )
    m = F.count("p").over(Window.partitionBy())
    adjusted = F.least(F.col("p") * m, F.lit(1.0))
    return out.withColumn("p_adjusted", F.when(F.col("p").isNotNull(), adjusted)).withColumn(
        "significant", F.when(F.col("p_adjusted") < alpha, "Yes").otherwise("No")
    )


def ecdf(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Each known value with the share of values up to it."""
    known = df.where(F.col(value).isNotNull())
    names = [F.col(k).alias(f"__g{i}") for i, k in enumerate(by)] or [F.lit(0).alias("__g0")]
    totals = known.groupBy(*names).agg(F.count("*").alias("__n"))
    held = standing(known.select(*by, value), value, by, "__at").select("*", *names).join(totals, [f"__g{i}" for i in range(len(names))])
    return held.select(*by, value, ratio(F.col("__at.below") + F.col("__at.ties"), F.col("__n")).alias("share"))


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 30) -> DataFrame:
    """Counts of equal bins from the least to the greatest value of each group; the last is closed."""
    span = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = df.where(F.col(value).isNotNull()).join(span, by)
    at = F.floor(F.try_divide((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    return joined.groupBy(*by, F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def tool_comparison(ours: DataFrame, theirs: DataFrame, metrics: list[str], order: str) -> DataFrame:
    """Two tables paired by their place in ``order``, metric by metric, after nulls are dropped.

    Mean and sample deviation of either, Spearman of the paired prefix with its two-sided p by
    Student's t, and the difference of means in percent; a metric with fewer than three pairs is left out.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        long = standing(long_form(df, [order], metrics).where("value IS NOT NULL"), order, ("metric",), "place")
        # rows of one place follow each other
        at = F.col("place.below") + F.row_number().over(Window.partitionBy("metric", order).orderBy("value"))
        return long.select("metric", at.alias("at"), F.col("value").alias(name))

    pairs = placed(ours, "a").join(placed(theirs, "b"), ["metric", "at"])
    ranked = standings(pairs, ("metric",), a="at_a", b="at_b")
    ranked = ranked.withColumn("p", average_rank("at_a")).withColumn("q", average_rank("at_b"))
    got = ranked.groupBy("metric").agg(
        F.avg("a").alias("mean_a"), F.stddev_samp("a").alias("std_a"), F.avg("b").alias("mean_b"),
        F.stddev_samp("b").alias("std_b"), pearson(F.col("p"), F.col("q")).alias("rho"), F.count("*").alias("n"),
    ).where("n >= 3")
    free = F.col("n").cast("double") - 2
    rho = F.col("rho")
    # full agreement leaves no tail; a column of its own, before names are taken by rounded values
    tail = F.when(F.abs(rho) >= 1, 0.0).otherwise(student_tail(rho * F.sqrt(free / ((1 - rho) * (1 + rho))), free))
    return got.withColumn("p", tail).select(
        "metric", *(F.round(c, 4).alias(c) for c in ("mean_a", "std_a", "mean_b", "std_b", "rho")), F.round("p", 6).alias("p"), "n",
        F.round(ratio(100 * (F.col("mean_b") - F.col("mean_a")), F.col("mean_a")), 2).alias("percent_difference"),
    )
