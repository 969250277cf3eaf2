"""Frames whose objects are known."""

from __future__ import annotations

import numpy as np

from kinescape.kernels import filters


def known_discs(
    image: np.ndarray | None = None, shape: tuple[int, int] = (512, 512), count: int = 30, radii: tuple[int, int] = (3, 9), seed: int = 0
) -> np.ndarray:
    """A truth mask: the strict Otsu mask of an image, or without one ``count`` discs at random places."""
    if image is not None:
        return np.asarray(image, float) > filters.otsu(image)
    draw = np.random.default_rng(seed)
    centres = draw.integers(0, shape, (count, 2))
    reach = draw.integers(radii[0], radii[1], count, endpoint=True)
    y, x = (np.arange(n) for n in shape)
    # a row of the plane meets a disc where the column lies within its half chord
    half = reach[:, None] ** 2 - (y[None, :] - centres[:, :1]) ** 2
    across = (x[None, :] - centres[:, 1:]) ** 2
    return (half[:, :, None] >= across[:, None, :]).any(axis=0)
