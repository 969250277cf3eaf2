"""Group and rank statistics from counts of values: no buffer of a group, no rows that meet the table of ranks."""

import numpy as np
import pandas as pd
import pytest

from kinescape.operators import stats


@pytest.fixture
def table(spark):
    draw = np.random.default_rng(9)
    kinds = draw.choice(np.array(["p", "q"]), 200)
    rows = [(k, float(a), None if b == 7 else float(b), float(c)) for k, a, b, c in zip(kinds, *draw.integers(-3, 8, (2, 200)), draw.normal(size=200), strict=True)]
    rows.append((None, 2.5, 1.0, None))
    return spark.createDataFrame(rows, "kind string, a double, b double, c double"), pd.DataFrame(rows, columns=["kind", "a", "b", "c"])


def test_five_numbers_from_counts(table):
    df, plain = table
    got = stats.five_numbers(df, ["kind"], ["a", "b", "c"])
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.kind, r.metric): r for r in got.collect()}
    assert len(rows) == 8 and rows[None, "a"].q1 == rows[None, "a"].median == 2.5 and rows[None, "a"].std is None
    for kind in "pq":
        for m in "abc":
            v, r = plain.loc[plain.kind == kind, m].dropna(), rows[kind, m]
            assert [r.q1, r.median, r.q3] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])))
            assert (r["mean"], r["std"], r["min"], r["max"], r["n"]) == pytest.approx((v.mean(), v.std(), v.min(), v.max(), len(v)))


@pytest.fixture
def no_row_ranks(monkeypatch):
    def refused(*args, **named):
        raise AssertionError("rows meet the table of ranks")

    for name in ("standing", "standings"):
        monkeypatch.setattr(stats, name, refused)


def test_populations_from_counts(table, no_row_ranks):
    df, plain = table
    for r in stats.two_populations(df, "kind", "p", "q", ["a", "b", "c"]).collect():
        one, two = (plain.loc[plain.kind == k, r.metric].dropna().to_numpy() for k in "pq")
        u = (one[:, None] > two).sum() + (one[:, None] == two).sum() / 2
        pooled = np.sqrt(((len(one) - 1) * one.var(ddof=1) + (len(two) - 1) * two.var(ddof=1)) / (len(one) + len(two) - 2))
        assert (r.n1, r.n2, r.u) == (len(one), len(two), u)
        assert r.cohens_d == pytest.approx((one.mean() - two.mean()) / pooled)


def test_rank_correlation_from_counts(table, no_row_ranks):
    df, plain = table
    got = {(r.kind, r.var_a, r.var_b): r for r in stats.spearman(df, ["a", "b", "c"], ("kind",)).collect()}
    assert len(got) == 7 and (got[None, "a", "b"].rho, got[None, "a", "b"].n) == (None, 1)
    for kind in "pq":
        for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
            both = plain.loc[plain.kind == kind, [x, y]].dropna().rank()
            assert got[kind, x, y].n == len(both) and got[kind, x, y].rho == pytest.approx(both[x].corr(both[y]))
