"""Measures of labelled regions: moments, hulls, contours."""

from __future__ import annotations

import math

import numpy as np


def contour(mask: np.ndarray) -> tuple[float, float]:
    """Area and length of the half-level contours of a mask, from a table of its 2 by 2 squares.

    A contour runs through the middles of the sides of each square, cutting a corner by a
    half-diagonal. Diagonal pixels are joined. Holes lessen the area and lengthen the contour.
    """
    wide = np.pad(mask.astype(int), 1)
    a, b, c, d = wide[:-1, :-1], wide[:-1, 1:], wide[1:, :-1], wide[1:, 1:]
    n = a + b + c + d
    diagonal = (n == 2) & (a == d)
    # area of the inside in a square by its number of inside corners
    area = 0.125 * (n == 1).sum() + 0.5 * ((n == 2) & ~diagonal).sum() + 0.75 * diagonal.sum() + 0.875 * (n == 3).sum() + (n == 4).sum()
    half = math.sqrt(0.5)
    length = half * ((n == 1).sum() + (n == 3).sum()) + 1.0 * ((n == 2) & ~diagonal).sum() + 2 * half * diagonal.sum()
    return float(area), float(length)


def crofton(mask: np.ndarray) -> float:
    """Length of the border by Crofton's formula: crossings of lines in four directions."""
    wide = np.pad(mask.astype(np.int8), 1)
    across = sum(int((a != b).sum()) for a, b in ((wide[:, 1:], wide[:, :-1]), (wide[1:], wide[:-1])))
    aslant = sum(int((a != b).sum()) for a, b in ((wide[1:, 1:], wide[:-1, :-1]), (wide[1:, :-1], wide[:-1, 1:])))
    return math.pi / 8 * (across + aslant / math.sqrt(2))


def hull_area(mask: np.ndarray) -> int:
    """Pixels whose centres lie in the convex hull of the region's pixels, taken with their half-way edges."""
    ys, xs = np.nonzero(mask)
    around = np.array([(0, -0.5), (0, 0.5), (-0.5, 0), (0.5, 0)])
    points = sorted({(float(y + i), float(x + j)) for y, x in zip(ys, xs, strict=True) for i, j in around})

    def half(run):
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(points) + half(points[::-1])
    gy, gx = np.mgrid[0 : mask.shape[0], 0 : mask.shape[1]]
    inside = np.ones(mask.shape, bool)
    for (y0, x0), (y1, x1) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside &= (y1 - y0) * (gx - x0) - (x1 - x0) * (gy - y0) >= -1e-9
    return int(inside.sum())


def moments(mask: np.ndarray) -> dict[str, float | None]:
    """Area, centre, axes, eccentricity, orientation from second central moments (a pixel is a unit square)."""
    ys, xs = np.nonzero(mask)
    y, x = ys.mean(), xs.mean()
    yy, xx = ((ys - y) ** 2).mean() + 1 / 12, ((xs - x) ** 2).mean() + 1 / 12
    xy = ((ys - y) * (xs - x)).mean()
    spread = math.sqrt(4 * xy * xy + (yy - xx) ** 2)
    high, low = (yy + xx + spread) / 2, max((yy + xx - spread) / 2, 0.0)
    if yy == xx:
        turn = math.pi / 4 if xy < 0 else -math.pi / 4
    else:
        turn = 0.5 * math.atan2(2 * xy, yy - xx)
    return {
        "area": float(len(ys)), "y": float(y), "x": float(x), "major": 4 * math.sqrt(high), "minor": 4 * math.sqrt(low),
        "eccentricity": math.sqrt(max(1 - low / high, 0.0)) if high else 0.0, "orientation": turn,
    }


def measured(labels: np.ndarray) -> list[dict]:
    """One record for each label: moments, solidity, contour and circularity; undefined values are None."""
    out = []
    for name in np.unique(labels[labels > 0]):
        ys, xs = np.nonzero(labels == name)
        y0, x0 = ys.min(), xs.min()
        mask = labels[y0 : ys.max() + 1, x0 : xs.max() + 1] == name
        m = moments(mask)
        area, length = contour(mask)
        out.append({
            "label": int(name), "x": m["x"] + x0, "y": m["y"] + y0, "area": m["area"], "contour_area": area, "contour_length": length,
            "circularity": 4 * math.pi * area / length**2 if length > 0 else None, "crofton_length": crofton(mask), "eccentricity": m["eccentricity"],
            "solidity": m["area"] / max(hull_area(mask), 1), "aspect_ratio": m["major"] / m["minor"] if m["minor"] else None,
            "orientation": m["orientation"],
        })
    return out
