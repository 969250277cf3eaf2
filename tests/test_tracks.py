import numpy as np
import pandas as pd
import pytest

from kinescape.config import Calibration, LinkSettings
from kinescape.kernels import matching
from kinescape.operators import linking, motion


def points(spark, frames):
    rows = [("m", f, i, float(x), float(y)) for f, now in enumerate(frames) for i, (y, x) in enumerate(now)]
    return spark.createDataFrame(rows, "movie string, frame int, ordinal int, x double, y double")


def told(df):
    return df.toPandas().sort_values(["frame", "ordinal"], ignore_index=True)


def test_identity_survives_another_order(spark):
    got = told(linking.link_adjacent(points(spark, [[(5, 5), (30, 30)], [(30, 31), (5, 6)]]), 3.0))
    last = got[got.frame == 1].set_index("track_id")
    assert last.loc[0].x == 6 and last.loc[1].x == 31


def test_a_tied_merge_is_one_ambiguous_link_without_a_step(spark):
    tracks = linking.link_adjacent(points(spark, [[(10, 10), (10, 12)], [(10, 11)]]), 3.0)
    got = told(tracks)
    assert list(got.link_status) == ["start", "start", "ambiguous"] and got.current_count.iloc[2] == 2
    walked = motion.steps(tracks, ("movie", "track_id"))
    assert walked.where("accepted").count() == 0


def test_out_of_reach_and_back_again_are_new_tracks(spark):
    assert told(linking.link_adjacent(points(spark, [[(0, 0)], [(0, 20)]]), 3.0)).track_id.nunique() == 2
    back = told(linking.link_adjacent(points(spark, [[(2, 2)], [], [(2, 2)]]), 15.0))
    assert list(back.track_id) == [0, 1]


def test_calibrated_path(spark):
    tracks = linking.link_adjacent(points(spark, [[(0, 0)], [(0, 3)], [(4, 3)]]), 5.0)
    c = Calibration(pixel_um=0.5, frame_s=2.0, source="test")
    row = motion.summary(motion.steps(tracks, ("movie", "track_id"), c), ("movie", "track_id"), c).first()
    assert (row.path_length, row.net_displacement, row.mean_speed, row.speed_unit) == (3.5, 2.5, 0.875, "um/s")
    plain = motion.summary(motion.steps(tracks, ("movie", "track_id")), ("movie", "track_id")).first()
    assert plain.mean_speed == 3.5 and plain.speed_unit == "px/frame"


def test_particle_margin(spark):
    near = [[(10, 10), (10, 15)], [(10, 10.2), (10, 15.2)]]
    for got in (linking.link_particles(points(spark, near)), linking.link_adjacent(points(spark, near), 6.0, margin=0.5)):
        last = told(got).query("frame == 1")
        assert list(last.link_status) == ["matched", "matched"] and list(last.current_count) == [2, 2]
    tied = told(linking.link_particles(points(spark, [[(10, 10), (10, 12)], [(10, 11)]])))
    assert tied.link_status.iloc[2] == "ambiguous"


def test_gap_and_prediction(spark):
    gone = points(spark, [[(10, 10)], [], [(10, 12)]])
    assert told(linking.link_particles(gone)).track_id.nunique() == 2
    one = told(linking.link_particles(gone, LinkSettings(gap=1)))
    assert one.track_id.nunique() == 1 and one.link_status.iloc[-1] == "gap"
    crossing = points(spark, [[(10, 5), (10, 15)], [(10, 8), (10, 12)], [(10, 11), (10, 9)]])
    ahead = told(linking.link_particles(crossing, LinkSettings(prediction=1.0)))
    assert ahead.query("frame == 2 and track_id == 0").x.item() == 11


def test_two_movers_in_changing_order(spark):
    frames = []
    for f in range(5):
        now = [(10, 10 + f), (30, 30 - f)]
        frames.append(now if f % 2 == 0 else now[::-1])
    tracks = linking.link_particles(points(spark, frames))
    got = motion.summary(motion.steps(tracks, ("movie", "track_id")), ("movie", "track_id")).toPandas()
    assert list(got.mean_speed) == [1.0, 1.0]


def test_parallel_and_ordered_particle_linkers_agree(spark):
    draw = np.random.default_rng(5)
    frames = [[tuple(p) for p in draw.uniform(0, 40, (12, 2))] for _ in range(8)]
    a = told(linking.link_particles(points(spark, frames)))
    b = told(linking.link_adjacent(points(spark, frames), 6.0, margin=0.5))
    assert list(a.track_id) == list(b.track_id) and list(a.link_status) == list(b.link_status)


def least_total(cost, alone):
    """The least cost of all one-to-one choices of a matrix with inf where there is no edge, by trying all."""
    if not cost.shape[0]:
        return alone * cost.shape[1]
    best = alone + least_total(cost[1:], alone)
    for j in range(cost.shape[1]):
        if np.isfinite(cost[0, j]):
            best = min(best, cost[0, j] + least_total(np.delete(cost[1:], j, axis=1), alone))
    return best


@pytest.mark.parametrize("alone", [0.1, 0.4, 5.0])
def test_sparse_solver_matches_all_choices(alone):
    draw = np.random.default_rng(2)
    for _ in range(60):
        n, m = draw.integers(1, 6, 2)
        cost = np.where(draw.random((n, m)) < 0.6, draw.integers(0, 12, (n, m)) / 8, np.inf)
        i, j = np.nonzero(np.isfinite(cost))
        chosen = matching.cheapest(i, j, cost[i, j], alone)
        a, b = i[chosen], j[chosen]
        assert len(set(a)) == len(a) and len(set(b)) == len(b)
        assert cost[a, b].sum() + alone * (n + m - 2 * len(a)) == pytest.approx(least_total(cost, alone))


def test_near_pairs_and_runners_up_match_plain_search():
    draw = np.random.default_rng(4)
    a, b = draw.uniform(-20, 20, (60, 2)), draw.uniform(-20, 20, (50, 2))
    far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    i, j, d = matching.near_pairs(a, b, 6.0)
    assert [*zip(i, j, strict=True)] == [*zip(*np.nonzero(far <= 6.0), strict=True)] and d == pytest.approx(far[i, j])
    got = matching.runner_up(i, d)
    assert got.tolist() == [min([d[k] for k in range(len(i)) if i[k] == i[e] and k != e], default=np.inf) for e in range(len(i))]
    assert len(matching.near_pairs(a, b[:0], 6.0)[0]) == 0


def test_most_links_come_first():
    # one short link against two longer ones
    i, j, distance = np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([1.0, 5.0, 4.0])
    assert matching.cheapest(i, j, *linking.most_links(distance, 4, 5.0)).tolist() == [False, True, True]
    assert matching.cheapest(i, j, *linking.least_cost(distance, 4, 6.0)).tolist() == [True, False, False]


def test_duplicate_rows_are_refused(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1)], "track_id int, frame int")
    with pytest.raises(ValueError, match="unique"):
        motion.check_unique(rows, "track_id", "frame")


def test_short_tracks_vanish(spark):
    rows = pd.DataFrame({"track_id": [0, 0, 0, 1], "frame": [0, 1, 2, 0]})
    assert motion.retained(spark.createDataFrame(rows), 3, "track_id").select("track_id").distinct().count() == 1
