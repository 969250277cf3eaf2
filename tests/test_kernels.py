import math

import numpy as np
import pytest

from kinescape.config import MaskSettings, SpotSettings
from kinescape.kernels import filters, morphology, regions, segment


def squares(frame, shift=1, at=(8, 8), value=1000.0, size=7, shape=(40, 40)):
    image = np.zeros(shape)
    image[at[0] : at[0] + size, at[1] + shift * frame : at[1] + size + shift * frame] = value
    return image


def test_moving_square_has_its_known_measures():
    for frame in range(4):
        labels, level = segment.mask(squares(frame), MaskSettings())
        assert level == 1.5625
        (only,) = regions.measured(labels)
        assert (only["x"], only["y"], only["area"], only["contour_area"]) == (11 + frame, 11, 45, 44.5)
        assert only["contour_length"] == pytest.approx(16 + 12 * math.sqrt(0.5), abs=1e-12)
        assert only["circularity"] == pytest.approx(0.9327380137253712, abs=1e-12)
        assert (only["eccentricity"], only["solidity"], only["aspect_ratio"]) == (0, 1, 1)


def spot_frame(frame):
    y, x = np.mgrid[0:64, 0:64]
    one = 300 * np.exp(-((y - 20) ** 2 + (x - 20 - frame) ** 2) / 4.5)
    two = 200 * np.exp(-((y - 44) ** 2 + (x - 44) ** 2) / 4.5)
    return (100 + one + two).astype(np.float32)


def test_two_spots_have_their_known_noise_and_centres():
    got = segment.spots(spot_frame(0))
    assert got.noise == pytest.approx(0.06992407834898115, abs=1e-12)
    assert got.level == pytest.approx(0.20977223504694345, abs=1e-12) and len(got.centres) == 2
    assert got.centres[0] == pytest.approx([19.999999955152507] * 2, abs=1e-9)
    assert [m["area"] for m in regions.measured(got.labels)] == [21, 21]


def test_scaled_and_lifted_intensities_leave_spots_alone():
    image = spot_frame(1).astype(float)
    a, b = segment.spots(image), segment.spots(3 * image + 20)
    assert (a.labels == b.labels).all() and np.allclose(a.centres, b.centres)


def test_flat_frames_have_no_objects():
    assert len(segment.spots(np.full((32, 32), 100.0)).centres) == 0
    assert segment.mask(np.full((8, 8), 3.0), MaskSettings())[1] == 3.0


@pytest.mark.parametrize("bad", [np.full((3, 3), np.nan), -np.ones((3, 3)), np.ones(3), np.zeros((0, 4))])
def test_bad_frames_are_refused(bad):
    with pytest.raises(ValueError):
        segment.mask(bad, MaskSettings())


def test_size_filter_keeps_the_larger_square():
    image = np.zeros((20, 20))
    image[3:5, 3:5] = image[10:13, 10:13] = 30
    labels, _ = segment.mask(image, MaskSettings(least_pixels=5, opening=0))
    assert (labels > 0).sum() == 9


@pytest.mark.parametrize("mask", [np.ones((2, 2), bool), np.ones((7, 9), bool), np.eye(6, dtype=bool)])
def test_circularity_lies_between_0_and_1(mask):
    area, length = regions.contour(mask)
    assert 0 < 4 * math.pi * area / length**2 <= 1


def test_a_hole_lessens_area_and_lengthens_the_contour():
    whole = np.ones((15, 15), bool)
    holed = whole.copy()
    holed[5:10, 5:10] = False
    a, b = regions.contour(whole), regions.contour(holed)
    assert b[0] < a[0] and b[1] > a[1]


def test_components_match_a_plain_fill():
    draw = np.random.default_rng(1)
    for _ in range(30):
        mask = draw.random((9, 11)) < 0.4
        labels = morphology.components(mask)
        seen, name = np.zeros(mask.shape, int), 0
        for y, x in np.argwhere(mask):
            if seen[y, x]:
                continue
            name += 1
            stack = [(y, x)]
            seen[y, x] = name
            while stack:
                i, j = stack.pop()
                for p in range(max(i - 1, 0), min(i + 2, 9)):
                    for q in range(max(j - 1, 0), min(j + 2, 11)):
                        if mask[p, q] and not seen[p, q]:
                            seen[p, q] = name
                            stack.append((p, q))
        assert (labels == seen).all()


@pytest.mark.parametrize("backend", sorted(segment.BACKENDS))
def test_every_backend_finds_a_bright_block(backend):
    image = np.random.default_rng(0).normal(10, 1, (64, 64)).clip(0)
    image[15:35, 15:35] += 40
    assert (segment.segment(image, backend) > 0).any()


def test_unknown_backend_is_named():
    with pytest.raises(ValueError, match="otsu"):
        segment.segment(np.eye(4), "magic")


def test_drift_sign():
    image = np.random.default_rng(19).normal(100, 10, (48, 48)).clip(0)
    y, x, _ = segment.drift(image, np.roll(image, (2, -3), (0, 1)))
    assert (y, x) == pytest.approx((-2, 3), abs=0.1)
    assert segment.drift(image, np.ones((48, 48))) is None


def test_thinning_keeps_a_line():
    mask = np.zeros((9, 20), bool)
    mask[3:6, 2:18] = True
    length, branches, ends = morphology.skeleton_counts(morphology.thinned(mask))
    assert 10 <= length <= 16 and branches == 0 and ends == 2


def test_constant_and_two_level_otsu():
    assert filters.otsu(np.full((3, 3), 4.0)) == 4.0
    assert 1 < filters.otsu(np.array([[1.0, 1, 9, 9]])) < 9


def test_spot_settings_are_checked():
    with pytest.raises(ValueError):
        SpotSettings(sigma=6.0)
    with pytest.raises(ValueError):
        MaskSettings(block=30)


def test_crofton_length_of_a_pixel_and_a_large_disk():
    assert regions.crofton(np.ones((1, 1), bool)) == pytest.approx(math.pi / 2 * (1 + math.sqrt(0.5)))
    y, x = np.mgrid[-40:41, -40:41]
    assert regions.crofton(y * y + x * x <= 35**2) == pytest.approx(2 * math.pi * 35, rel=0.03)
