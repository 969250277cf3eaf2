"""Binary and grey morphology, components, thinning, watershed."""

from __future__ import annotations

import heapq

import numpy as np


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets no further from the centre than ``radius``."""
    r = range(-radius, radius + 1)
    return [(i, j) for i in r for j in r if i * i + j * j <= radius * radius]


def _moved(image: np.ndarray, offsets, fill, pick) -> np.ndarray:
    r = max((max(abs(i), abs(j)) for i, j in offsets), default=0)
    h, w = image.shape
    wide = np.full((h + 2 * r, w + 2 * r), fill, image.dtype)
    wide[r : r + h, r : r + w] = image
    out = np.full(image.shape, fill, image.dtype)
    for i, j in offsets:
        out = pick(out, wide[r + i : r + i + h, r + j : r + j + w])
    return out


def covers(radius: int, shape: tuple[int, ...]) -> bool:
    """Whether a disk around any pixel holds the whole image."""
    return sum((n - 1) ** 2 for n in shape) <= radius * radius


def erode(image: np.ndarray, radius: int) -> np.ndarray:
    """Least value under the disk; places outside the image do not count."""
    if covers(radius, image.shape):
        return np.full_like(image, image.min())
    top = True if image.dtype == bool else np.inf
    return _moved(image, disk(radius), top, np.logical_and if image.dtype == bool else np.minimum)


def dilate(image: np.ndarray, radius: int) -> np.ndarray:
    if covers(radius, image.shape):
        return np.full_like(image, image.max())
    low = False if image.dtype == bool else -np.inf
    return _moved(image, disk(radius), low, np.logical_or if image.dtype == bool else np.maximum)


def opened(image: np.ndarray, radius: int) -> np.ndarray:
    return dilate(erode(image, radius), radius) if radius else image


def top_hat(image: np.ndarray, radius: int) -> np.ndarray:
    """The image less its opening."""
    image = np.asarray(image, float)
    return image - opened(image, radius)


def components(mask: np.ndarray) -> np.ndarray:
    """Parts of a mask with 8 neighbours, numbered from 1 in raster order of their first pixel."""
    h, w = mask.shape
    root = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        low = _moved(root, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], h * w, np.minimum)
        low = np.where(mask, low, h * w)
        # a pixel's root points at its own root's least neighbour
        flat = np.append(low.ravel(), h * w)
        flat = np.minimum(flat, flat[flat])
        low = flat[:-1].reshape(h, w)
        if (low == root).all():
            break
        root = low
    names, number = np.unique(root, return_inverse=True)
    number = number.reshape(h, w) + 1
    return np.where(mask, number, 0)


def border_free(labels: np.ndarray) -> np.ndarray:
    """Without labels that have a pixel on the border."""
    edge = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    return np.where(np.isin(labels, edge), 0, labels)


def sized(labels: np.ndarray, least: int) -> np.ndarray:
    """Without labels of fewer than ``least`` pixels."""
    counts = np.bincount(labels.ravel())
    return np.where((labels > 0) & (counts[labels] >= least), labels, 0)


def thinned(mask: np.ndarray) -> np.ndarray:
    """Skeleton by Zhang and Suen (1984)."""
    image = np.pad(mask.astype(bool), 1)
    while True:
        before = image.copy()
        for turn in (0, 1):
            n = [np.roll(image, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(x.astype(int) for x in n)
            steps = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            if turn == 0:
                open_ = ~(n[0] & n[2] & n[4]) & ~(n[2] & n[4] & n[6])
            else:
                open_ = ~(n[0] & n[2] & n[6]) & ~(n[0] & n[4] & n[6])
            image = image & ~((count >= 2) & (count <= 6) & (steps == 1) & open_)
            image[0] = image[-1] = image[:, 0] = image[:, -1] = False
        if (image == before).all():
            return image[1:-1, 1:-1]


def skeleton_counts(skeleton: np.ndarray) -> tuple[int, int, int]:
    """Length in pixels, branch points (over two neighbours) and end points (one)."""
    wide = np.pad(skeleton.astype(int), 1)
    h, w = skeleton.shape
    around = sum(wide[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)) - skeleton
    return int(skeleton.sum()), int((skeleton & (around > 2)).sum()), int((skeleton & (around == 1)).sum())


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flooding from markers in order of height, then of arrival (Meyer), over 4 neighbours within the mask."""
    labels = np.where(mask, markers, 0)
    heap = [(height[y, x], i, y, x) for i, (y, x) in enumerate(np.argwhere(labels > 0).tolist())]
    heapq.heapify(heap)
    age = len(heap)
    h, w = height.shape
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for i, j in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= i < h and 0 <= j < w and mask[i, j] and not labels[i, j]:
                labels[i, j] = labels[y, x]
                heapq.heappush(heap, (height[i, j], age, i, j))
                age += 1
    return labels


def peaks(response: np.ndarray, apart: int, least: float) -> np.ndarray:
    """Places over ``least`` that are the greatest within ``apart`` pixels either way, highest first.

    Of peaks closer to each other than that, the highest stays (the first in raster order of equals).
    """
    offsets = [(i, j) for i in range(-apart, apart + 1) for j in range(-apart, apart + 1)]
    top = _moved(np.asarray(response, float), offsets, -np.inf, np.maximum)
    found = np.argwhere((response == top) & (response > least))
    order = np.argsort(-response[tuple(found.T)], kind="stable") if len(found) else []
    kept: list[np.ndarray] = []
    for p in found[order]:
        if all(np.abs(p - q).max() > apart for q in kept):
            kept.append(p)
    return np.array(kept, int).reshape(-1, 2)
