"""Thresholding methods of many small frames."""

import numpy as np
import pytest

from kinescape.kernels import morphology
from kinescape.operators import movies
from kinescape.sources.frames import from_array


@pytest.mark.parametrize("radius", [0, 3, 9, 10, 25])
def test_disks_wider_than_the_image_are_not_walked(radius, monkeypatch):
    image = np.random.default_rng(1).random((8, 8))
    y, x = np.mgrid[:8, :8]
    near = (y.ravel()[:, None] - y.ravel()) ** 2 + (x.ravel()[:, None] - x.ravel()) ** 2 <= radius**2
    low, high = (np.array([f(image.ravel()[n]) for n in near]).reshape(8, 8) for f in (np.min, np.max))
    if radius >= 10:  # the diagonal has 9.9
        monkeypatch.delattr(morphology, "disk")
    assert (morphology.erode(image, radius) == low).all() and (morphology.dilate(image, radius) == high).all()


def test_backends_in_one_pass_equal_each_alone(spark):
    movie = np.random.default_rng(2).random((3, 8, 8, 1))
    frames = from_array(spark, "m", movie)
    names, settings = ("otsu", "sauvola", "niblack", "local_mean", "subtracted"), {"least": 2, "opening": 0, "border_free": False}
    got = movies.backend_pixels(frames, names, **settings)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    want = {(b, r.frame): sum(v > 0 for v in r.labels) for b in names for r in movies.backend_frames(frames, b, **settings).collect()}
    assert {(r.backend, r.frame): r.pixels for r in got.collect()} == want
