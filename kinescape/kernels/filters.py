"""Smoothing and local thresholds. Borders are mirrored with the edge pixel repeated."""

from __future__ import annotations

import numpy as np


def mirrored(size: int, radius: int) -> np.ndarray:
    """Indexes of a row with ``radius`` mirrored places on either side."""
    at = np.arange(-radius, size + radius) % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def along(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a symmetric window along an axis."""
    radius = len(weights) // 2
    wide = np.take(image, mirrored(image.shape[axis], radius), axis=axis)
    n = image.shape[axis]
    out = np.zeros(image.shape)
    for i, w in enumerate(weights):
        out += w * (wide[i : i + n] if axis == 0 else wide[:, i : i + n])
    return out


def gaussian_weights(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    at = np.arange(-radius, radius + 1)
    base = np.exp(-0.5 * (at / sigma) ** 2)
    base /= base.sum()
    return base if order == 0 else base * (at**2 / sigma**4 - 1 / sigma**2)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    w = gaussian_weights(sigma)
    return along(along(np.asarray(image, float), w, 0), w, 1)


def laplacian_of_gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    image = np.asarray(image, float)
    w, second = gaussian_weights(sigma), gaussian_weights(sigma, 2)
    return along(along(image, second, 0), w, 1) + along(along(image, w, 0), second, 1)


def otsu(image: np.ndarray, bins: int = 256) -> float:
    """Threshold of the greatest between-class variance, by bin centres; the first among equals."""
    values = np.asarray(image, float).ravel()
    if values.min() == values.max():
        return float(values[0])
    counts, edges = np.histogram(values, bins)
    centres = (edges[:-1] + edges[1:]) / 2
    low, mass = np.cumsum(counts), np.cumsum(counts * centres)
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        score = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    return float(centres[int(np.nanargmax(np.where(high > 0, score, np.nan)))])


def window_moments(image: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over square windows, by summed-area tables."""
    size += 1 - size % 2
    r = size // 2
    image = np.asarray(image, float)
    wide = image[np.ix_(mirrored(image.shape[0], r), mirrored(image.shape[1], r))]

    def mean(a: np.ndarray) -> np.ndarray:
        table = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        total = table[size:, size:] - table[:-size, size:] - table[size:, :-size] + table[:-size, :-size]
        return total / size**2

    centre = mean(wide)
    return centre, np.sqrt(np.maximum(mean(wide * wide) - centre**2, 0))


def sauvola(image: np.ndarray, size: int = 25, k: float = 0.2) -> np.ndarray:
    """Sauvola and Pietikainen (2000), with half the image's span as the dynamic range."""
    mean, spread = window_moments(image, size)
    half = np.ptp(image) / 2
    return mean * (1 + k * ((spread / half if half else 0.0) - 1))


def niblack(image: np.ndarray, size: int = 25, k: float = 0.2) -> np.ndarray:
    """Niblack (1986)."""
    mean, spread = window_moments(image, size)
    return mean - k * spread


def local_mean(image: np.ndarray, block: int = 31, offset: float = 0.0) -> np.ndarray:
    """Gaussian-weighted local mean less an offset; the width follows the block."""
    return gaussian(image, (block - 1) / 6) - offset
