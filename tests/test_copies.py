"""Many points of one place, and steps whose cost may not grow with the pairs among them."""

import numpy as np
import pandas as pd
import pytest

from kinescape.config import LinkSettings
from kinescape.kernels import matching
from kinescape.operators import linking, spatial


def points(spark, frames):
    rows = [("m", f, i, float(x), float(y)) for f, now in enumerate(frames) for i, (y, x) in enumerate(now)]
    return spark.createDataFrame(rows, "movie string, frame int, ordinal int, x double, y double")


def crowd(seed=3, n=40):
    draw = np.random.default_rng(seed)
    return [[tuple(p) for p in draw.integers(0, 6, (n, 2))] for _ in range(3)]


def plain_edges(frames, gate):
    out = []
    for f in range(1, len(frames)):
        near = [(a, b, float(np.hypot(p[0] - q[0], p[1] - q[1]))) for a, p in enumerate(frames[f - 1]) for b, q in enumerate(frames[f])]
        near = [e for e in near if e[2] <= gate]
        out += [(f, a, b, d, sum(e[0] == a for e in near), sum(e[1] == b for e in near)) for a, b, d in near]
    return sorted(out)


def test_candidates_are_counted_without_a_broadcast_or_pairs_dealt_out(spark):
    frames = crowd()
    got = linking.candidates(points(spark, frames), 2.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("hashpartitioning(movie") == plan.count("Exchange hash")
    rows = sorted((r.frame, r.a, r.b, r.distance, r.n_a, r.n_b) for r in got.collect())
    assert rows == [pytest.approx(e) for e in plain_edges(frames, 2.0)]


def test_nearest_links_of_copies_without_a_broadcast(spark):
    frames = crowd(4)
    got = linking.nearest_link(points(spark, frames), 2.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    best = {}
    for f, a, b, d, *_ in plain_edges(frames, 2.0):
        best[f, a] = min(best.get((f, a), (np.inf, 0)), (d, b))
    assert {(r.frame, r.a): (r.distance, r.b) for r in got.collect()} == best


def test_more_points_of_a_place_than_a_row_holds(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HELD", 3)
    df = spark.createDataFrame([("f", i, 1.0, 1.0) for i in range(8)], "frame string, point_id long, x double, y double")
    got = spatial.pairs_within(df, df, 1.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.point_id, r.o_point_id) for r in got.collect()} == {(i, j) for i in range(8) for j in range(8)}


@pytest.mark.parametrize("alone", [0.1, 0.4, 5.0])
def test_shares_cost_as_much_as_links_one_by_one(alone):
    draw = np.random.default_rng(6)
    for _ in range(40):
        n, m = draw.integers(1, 5, 2)
        i, j = np.nonzero(draw.random((n, m)) < 0.7)
        many, room, cost = draw.integers(1, 5, n), draw.integers(1, 5, m), draw.integers(0, 9, len(i)) / 8
        flow = matching.shares(i, j, cost, alone, many, room)
        assert (np.bincount(i, flow, n) <= many).all() and (np.bincount(j, flow, m) <= room).all()
        a, b = np.repeat(np.arange(n), many), np.repeat(np.arange(m), room)
        price = {(p, q): c for p, q, c in zip(i, j, cost, strict=True)}
        each = [(u, v, price[a[u], b[v]]) for u in range(len(a)) for v in range(len(b)) if (a[u], b[v]) in price]
        u, v, c = (np.array(x) for x in zip(*each, strict=True)) if each else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        one = matching.cheapest(u, v, c, alone)
        assert (flow * cost).sum() - 2 * alone * flow.sum() == pytest.approx(c[one].sum() - 2 * alone * one.sum())


@pytest.fixture
def edges_met(monkeypatch):
    """Edges that solvers met."""
    met, plain = [], matching.shares

    def counted(i, *rest):
        met.append(len(i))
        return plain(i, *rest)

    for module in (matching, linking):
        monkeypatch.setattr(module, "shares", counted)
    return met


@pytest.mark.parametrize("choose", [linking.most_links, linking.least_cost])
def test_copies_meet_the_solver_as_one_end(edges_met, choose):
    before, now = np.repeat([[0.0, 0.0], [0.0, 2.0]], 500, axis=0), np.repeat([[0.0, 1.0], [0.0, 3.0]], [700, 300], axis=0)
    got = linking.settle(before, now, choose, 4.0)
    assert sum(edges_met) == 4
    assert sorted(got["a"]) == sorted(got["b"]) == list(range(1000)) and got["distance"].sum() == 500 + 200 + 300
    assert set(got["n_a"]) == {1000} and set(got["other"]) == {1.0}


def test_tracks_of_copies_step_as_one_end(edges_met):
    rows = pd.DataFrame([(f, i, float(f), 0.0) for f in range(3) for i in range(2000)], columns=["frame", "ordinal", "x", "y"])
    got = linking.walk(rows, LinkSettings(gate=3.0, gap=1, prediction=0.5))
    assert sum(edges_met) == 2 and got.track_id.nunique() == 2000
    assert (got.track_id == got.ordinal).all() and set(got.previous_count[got.frame > 0]) == {2000}


def test_linked_copies(spark):
    got = linking.link_adjacent(points(spark, [[(0, 0)] * 3, [(0, 1)] * 2, [(0, 2)]]), 3.0).toPandas().sort_values(["frame", "ordinal"])
    assert list(got.track_id) == [0, 1, 2, 0, 1, 0] and list(got.current_count) == [0, 0, 0, 3, 3, 2]
    assert list(got.link_status) == ["start"] * 3 + ["ambiguous"] * 3 and list(got.previous_count) == [0, 0, 0, 2, 2, 1]


def test_ripley_meets_places_and_weighs_their_points(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 4)
    draw = np.random.default_rng(8)
    at = draw.integers(0, 5, (90, 2)).astype(float)
    df = spark.createDataFrame([("f", i, *p) for i, p in enumerate(at.tolist())], "frame string, point_id long, x double, y double")
    met, plain = [], spatial._blocks
    monkeypatch.setattr(spatial, "_blocks", lambda placed, *rest: met.append(placed.count()) or plain(placed, *rest))
    got = spatial.ripley(df, [0.0, 1.0, 2.0, 3.5], 25.0).orderBy("radius").toPandas().k.tolist()
    far = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))[~np.eye(90, dtype=bool)]
    assert got == pytest.approx([25.0 / 90**2 * (far <= r).sum() for r in (0.0, 1.0, 2.0, 3.5)])
    assert met == [len(np.unique(at, axis=0))]
