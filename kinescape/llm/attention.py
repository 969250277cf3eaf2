"""A small causal self-attention model in numpy: probabilities, gradients, training.

Every subword id is a place, described by itself and the id before it. The network attends over
the places of a window and predicts the next id in two softmaxes, a class of ids and the id
within its class. Both add what the network says to the logarithm of counted pairs (direct
connections, set from counts); the weights of the network are trained. A text is one start, its
ids and one end; windows overlap by half, and the last half of a window's places is scored, so
each id is scored once with half a window behind it at least.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np

#: Places of a window and its step; sizes of a word's vector, the hidden layer and the classes.
WINDOW, STEP, WIDTH, HIDDEN, CLASSES = 32, 16, 16, 32, 64
#: Ids of own embedding, by falling count; the rest share so many rows. After them the start.
OWN, SHARED = 4096, 1024
#: Ids whose pairs are counted each on its own; ids whose following counts make classes.
PAIRED, LEADERS = 2048, 256
#: Share of each seen pair's count that goes to the ids' own frequency.
DISCOUNT = 0.75
#: Classes of the ids that have no place among the most frequent; steps of a stretch that trains together.
RARE, RUN = 8, 8
#: Steps whose classes are scored at once.
SCORED = 128
_HALF, _SCALE = WIDTH // 2, np.float32(WIDTH**-0.5)
_QUERY, _KEY, _VALUE = (slice(i * WIDTH, (i + 1) * WIDTH) for i in range(3))
_MASKED, _MOST = np.float32(-1e9), np.float32(40)
_BACK = np.arange(WINDOW - STEP, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_NEAR = np.clip(_BACK, 0, WINDOW - 1)
#: Places a scored place may not see: what comes after it; in a text's first window also all before.
_AHEAD = np.where(_BACK < 0, _MASKED, np.float32(0))
_FIRST = np.where((_BACK < 0) | (np.arange(WINDOW) < WINDOW - STEP), _MASKED, np.float32(0)).astype(np.float32)


def ranked(counts: np.ndarray, most: int) -> np.ndarray:
    """Place of each of the ``most`` greatest counts, -1 for all others."""
    out = np.full(len(counts), -1, np.int64)
    order = np.argsort(-counts, kind="stable")[:most]
    out[order] = np.arange(len(order))
    return out


@dataclass
class Vocabulary:
    """Embedding row, class and log10 share within the class of each id, and log10 counts of pairs.

    The id after the last is the end of a run of ids.
    """

    row: np.ndarray
    group: np.ndarray
    inner: np.ndarray
    place: np.ndarray  # of an id among the paired ones, the end last; -1
    pairs: np.ndarray  # log10 of what follows: paired ids by paired ids and the end
    follow: np.ndarray  # log10 of an id's or the end's own share of all that follows
    spare: np.ndarray  # log10 of the weight of that share after each paired id

    @property
    def end(self) -> int:
        return len(self.group) - 1

    @classmethod
    def made(cls, firsts: np.ndarray, follows: np.ndarray, pairs: np.ndarray, after: np.ndarray, lasts: np.ndarray) -> "Vocabulary":
        """From counts of ids to be predicted (with the end), of following ids (with the end), of pairs of
        paired ids and, last, of all that followed each, of ids by the id before, and of ids before others."""
        size = len(firsts) - 1
        known = ranked(firsts[:size] + lasts, OWN)
        row = np.where(known >= 0, known, OWN + np.arange(size) * 2654435761 % SHARED).astype(np.int32)
        group = _grouped(firsts, after)
        sums = np.bincount(group, weights=firsts + 1.0, minlength=CLASSES)
        share = (follows + 1.0) / (follows.sum() + len(follows))
        counts, total = pairs[:, :-1].astype(np.float64), np.maximum(pairs[:, -1:], 1).astype(np.float64)
        seen = np.minimum(counts, DISCOUNT)
        spare = 1 - (counts - seen).sum(axis=1, keepdims=True) / total
        place = paired(follows, lasts)
        column = np.empty(counts.shape[1])
        column[place[place >= 0]] = share[np.flatnonzero(place >= 0)]
        told = np.log10((counts - seen) / total + spare * column[None, : counts.shape[1]])
        return cls(
            row, group.astype(np.int32), np.log10((firsts + 1.0) / sums[group]).astype(np.float32), place,
            told.astype(np.float32), np.log10(share).astype(np.float32), np.log10(spare[:, 0]).astype(np.float32),
        )

    def tails(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By counts alone, log10 probability of each run's ids after the first and of its end; 0 for no ids."""
        if not len(ids):
            return np.zeros(len(sizes))
        ends = np.cumsum(sizes)
        after = np.append(ids[1:], 0).astype(np.int64)
        after[ends[sizes > 0] - 1] = self.end
        p, q = self.place[ids], self.place[after]
        p = np.where(p == len(self.spare), -1, p)
        steps = self.follow[after].astype(np.float64) + np.where(p >= 0, self.spare[p], 0)
        both = (p >= 0) & (q >= 0)
        steps[both] = self.pairs[p[both], q[both]]
        past = np.concatenate([[0.0], np.cumsum(steps)])
        return past[ends] - past[ends - sizes]


@dataclass
class Cells:
    """What the softmax within a class runs over, and what counts of pairs add to either softmax.

    A cell is one of the most frequent ids or the end, alone, or rare ids of a class together, whose
    shares in it are fixed. Cells lie in order of class, those of paired ids first in each.
    """

    cell: np.ndarray  # of each id and the end
    share: np.ndarray  # log10 of each id's share in its cell
    cuts: np.ndarray  # where each class's cells begin
    lead: np.ndarray  # of each id its row in the tables below; the last row is of all ids that are not paired
    classes: np.ndarray  # log probability of each class after each row's id
    pairs: list[np.ndarray]  # of each class the log probability of its paired cells after each row's id
    spare: np.ndarray  # log weight of the shares of all other cells, for each row
    alone: np.ndarray  # log share of each cell

    @cached_property
    def spans(self) -> list[slice]:
        """The cells of each class."""
        cuts = self.cuts.tolist()
        return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.cuts)

    @classmethod
    def made(cls, words: Vocabulary, counts: np.ndarray) -> "Cells":
        own = ranked(counts, OWN + 1)
        own = np.where(counts > 0, own, -1)
        own[words.end] = OWN + 1 if own[words.end] < 0 else own[words.end]
        near = words.place >= 0
        # rare ids share cells by rank within their class, paired ones never
        falling = np.empty(len(counts), np.int64)
        falling[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        mixed = OWN + 2 + falling * SHARED // len(counts)
        kind = np.where(near, np.arange(len(counts)), np.where(own >= 0, len(counts) + own, 2 * len(counts) + OWN + 2 + mixed))
        order = np.lexsort((kind, words.group))
        new = np.append(True, (np.diff(kind[order]) != 0) | (np.diff(words.group[order]) != 0))
        cell = np.empty(len(counts), np.int64)
        cell[order] = np.cumsum(new) - 1
        group, paired_cell = words.group[order][new], near[order][new]
        weight = 10.0 ** words.follow.astype(np.float64)
        alone = np.bincount(cell, weights=weight)
        told = np.empty((len(words.spare) + 1, int(near.sum())))
        at = cell[near]
        rank = np.argsort(at)  # paired columns in order of cells
        column = words.place[near][rank]
        told[:-1], told[-1] = words.pairs[:, column], np.log10(alone[at[rank]])
        told *= np.log(10)
        spare = np.append(words.spare, 0) * np.log(10)
        rest = np.bincount(group[~paired_cell], weights=alone[~paired_cell], minlength=CLASSES)
        classes = np.exp(spare)[:, None] * rest
        pairs, belongs = [], group[at[rank]]
        for c in range(CLASSES):
            part = told[:, belongs == c]
            classes[:, c] += np.exp(part).sum(axis=1)
            pairs.append(np.ascontiguousarray(part, np.float32))
        lead = np.where(near, words.place, -1)[:-1]
        return cls(
            cell.astype(np.int32), (words.follow - np.log10(alone[cell])).astype(np.float32), np.searchsorted(group, np.arange(CLASSES + 1)),
            np.where(lead >= 0, lead, len(words.spare)).astype(np.int32), np.log(np.maximum(classes, 1e-30)).astype(np.float32),
            pairs, spare.astype(np.float32), np.log(alone).astype(np.float32),
        )

    def counted(self, z: np.ndarray, c: int, lead: np.ndarray) -> None:
        """Add to the scores of a class's cells what counts say after the rows of the ids before."""
        near = self.pairs[c]
        m = near.shape[1]
        if m == z.shape[1]:
            z += near.take(lead, axis=0)
            return
        z[:, m:] += self.alone[self.cuts[c] + m : self.cuts[c + 1]]
        if m:  # else the same for all cells of the class
            z[:, :m] += near.take(lead, axis=0)
            z[:, m:] += self.spare.take(lead)[:, None]

    def dealt(self, wanted: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Places that want something in order of class; each class with its first and past-the-last of them."""
        order = np.argsort(wanted.astype(np.int8), kind="stable")
        cuts = np.cumsum(np.bincount(wanted + 1, minlength=CLASSES + 1)).tolist()
        parts = [(c, lo - cuts[0], hi - cuts[0]) for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        return order[cuts[0] :], parts

    def lines(self, parts: list[tuple[int, int, int]]) -> list[int]:
        """Where each class's scores begin, and the last end, when those of all lie in one line."""
        sizes = self.sizes.tolist()
        return [0, *accumulate((hi - lo) * sizes[c] for c, lo, hi in parts)]

    def flat(self, group: np.ndarray, cell: np.ndarray, parts: list[tuple[int, int, int]], lines: list[int]) -> np.ndarray:
        """Where in that line the wanted cell of each place lies, of places in order of class."""
        own = np.zeros(CLASSES, np.int64)
        some = [c for c, *_ in parts]
        own[some] = np.array(lines[:-1]) - np.array([lo for _, lo, _ in parts]) * self.sizes[some] - self.cuts[some]
        return np.arange(len(group)) * self.sizes.take(group) + own.take(group) + cell


def paired(follows: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Place of each paired id, and of the end (the last of ``follows``) after all of them; -1."""
    size = len(follows) - 1
    place = ranked(follows[:size] + lasts, min(PAIRED, size))
    return np.append(place, min(PAIRED, size))


def _grouped(firsts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Classes: of ids as frequent as paired ones, and of the others with an own row, by what they follow
    (k-means of square roots, classes of either about as large), of the rest by count.

    A place costs as many scores as the wanted id's class has cells, so either has classes by the root of
    its ids times its share of the counts, which makes the mean least.
    """
    order = np.argsort(-firsts, kind="stable")
    rows = min(int((firsts > 0).sum()), OWN, len(after))
    share = np.sqrt(after[:rows] / np.maximum(after[:rows].sum(axis=1, keepdims=True), 1))
    cuts = np.unique([0, min(PAIRED, rows), rows])
    group, used = np.empty(len(order), np.int64), 0
    for lo, hi, classes in zip(cuts[:-1], cuts[1:], _dealt_classes(firsts[order[:rows]], cuts), strict=True):
        group[order[lo:hi]] = used + _clustered(share[lo:hi], classes)
        used += classes
    rest = order[rows:]
    group[rest] = CLASSES - RARE + np.arange(len(rest)) * RARE // max(len(rest), 1)
    return group


def _dealt_classes(counts: np.ndarray, cuts: np.ndarray) -> list[int]:
    """How many classes the ids between two cuts have: one at least, no more than there are ids."""
    sizes = np.diff(cuts)
    if not len(sizes):
        return []
    wish = np.sqrt(sizes * np.add.reduceat(counts.astype(np.float64), cuts[:-1]))
    out = np.ones(len(sizes), np.int64)
    for _ in range(min(CLASSES - RARE, int(sizes.sum())) - len(sizes)):
        out[np.where(out < sizes, wish / out, -1).argmax()] += 1
    return out.tolist()


def _clustered(share: np.ndarray, wanted: int) -> np.ndarray:
    """Class of each row by k-means; a class that is full leaves a row to the next nearest."""
    rows = len(share)
    centres = share[np.linspace(0, rows - 1, wanted).astype(int)]
    for _ in range(12):
        near = (share @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        sizes = np.bincount(near, minlength=wanted)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, share)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    likes = np.argsort(0.5 * (centres * centres).sum(axis=1) - share @ centres.T, axis=1, kind="stable")
    room = np.full(wanted, -(-rows * 5 // (4 * wanted)))
    for i, first in enumerate(likes):
        near[i] = first[np.flatnonzero(room[first])[0]]
        room[near[i]] -= 1
    return near


def fresh() -> dict[str, np.ndarray]:
    """Starting weights."""
    draw = np.random.default_rng(11)
    normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
    return {
        "head": normal(OWN + SHARED + 1, _HALF, scale=0.3),
        "tail": normal(OWN + SHARED + 1, _HALF, scale=0.3),
        "query": normal(WIDTH, WIDTH, scale=0.25),
        "key": normal(WIDTH, WIDTH, scale=0.25),
        "value": normal(WIDTH, WIDTH, scale=0.25),
        "place": np.zeros((1, WINDOW), np.float32),
        "inner": normal(2 * WIDTH, HIDDEN, scale=0.2),
        "bias": np.zeros((1, HIDDEN), np.float32),
        "out": normal(HIDDEN, CLASSES, scale=0.05),
        "level": np.zeros((1, CLASSES), np.float32),
        "cells": np.zeros((OWN + 2 + SHARED + RARE, WIDTH), np.float32),
    }


@dataclass
class Stream:
    """Places of texts, each padded to a multiple of the step: embedding rows of the id seen there and of
    the one before, class of the one to come (-1 where there is none), whether a step begins its text,
    and, where the softmax within classes is asked for too, the cell of the one to come and the
    row of counts of the id seen."""

    head: np.ndarray
    tail: np.ndarray
    wanted: np.ndarray
    begins: np.ndarray
    cell: np.ndarray | None = None
    lead: np.ndarray | None = None

    def windows(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the windows that score the given steps, and which of them begin a text."""
        at = np.maximum(steps[:, None] * STEP - (WINDOW - STEP) + np.arange(WINDOW), 0)
        return self.head.take(at), self.tail.take(at), self.begins.take(steps)

    def runs(self, starts: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """As ``windows``, of ``RUN`` steps from each of the given ones, with a step before; the places they
        score, and what each wants."""
        steps = starts[:, None] + np.arange(RUN)
        past = steps >= len(self.begins)
        steps[past] = len(self.begins) - 1
        at = np.concatenate([np.maximum(starts[:, None] - 1, 0), steps], axis=1)[:, :, None] * STEP + np.arange(STEP)
        own = at[:, 1:].ravel()
        wanted = np.where(np.repeat(past.ravel(), STEP), -1, self.wanted.take(own))
        at = at.reshape(len(starts), -1)
        return (self.head.take(at), self.tail.take(at), self.begins.take(steps)), own, wanted


def _attended(q, k, v, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.matmul(q, k.swapaxes(-1, -2))
    s += place[0][_NEAR]
    np.clip(s, -_MOST, _MOST, out=s)  # in place of taking off the greatest
    s += _AHEAD
    if first.any():
        s[first] += _FIRST
    np.exp(s, out=s)
    s /= _sums(s)
    return s, np.matmul(s, v)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept, as a product with ones."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(*x.shape[:-1], 1)


def _windows(x: np.ndarray) -> np.ndarray:
    """Of runs of steps (runs, steps, places, width) each step with the one before it, as a view."""
    runs, steps, _, width = x.shape
    return np.lib.stride_tricks.as_strided(x, (runs, steps - 1, WINDOW, width), x.strides)


def _unwindowed(d: np.ndarray, to: np.ndarray) -> None:
    """Set gradients of runs' steps to those from their windows."""
    to[:, :-1] = d[:, :, :STEP]
    to[:, -1] = 0
    to[:, 1:] += d[:, :, STEP:]


def forward(p: dict[str, np.ndarray], head: np.ndarray, tail: np.ndarray, first: np.ndarray, level: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Batched masked attention of windows, or of runs of steps after one that is only seen, and the classes' scores.

    ``level`` are scores of the classes that counts add.
    """
    n = len(head)
    x = np.concatenate([p["head"].take(head.ravel(), axis=0), p["tail"].take(tail.ravel(), axis=0)], axis=1)
    turn = np.concatenate([p["query"] * _SCALE, p["key"], p["value"]], axis=1)
    every = (x @ turn).reshape(n, -1, STEP, 3 * WIDTH)
    q, k, v = every[:, 1:, :, _QUERY], _windows(every[..., _KEY]), _windows(every[..., _VALUE])
    a, context = _attended(q, k, v, p["place"], first.reshape(q.shape[:2]))
    joined = np.concatenate([x.reshape(n, -1, STEP, WIDTH)[:, 1:], context], axis=3).reshape(-1, 2 * WIDTH)
    h = joined @ p["inner"]
    h += p["bias"]
    h /= np.abs(h) + 1
    # bounded by the hidden layer's range, so no maximum need be taken off
    z = h @ p["out"]
    z += p["level"]
    if level is not None:
        z += level
    return {"x": x, "turn": turn, "q": q, "k": k, "v": v, "a": a, "joined": joined, "h": h, "z": z, "e": np.exp(z)}


def _within(p, cells: Cells, h: np.ndarray, wanted: np.ndarray, cell: np.ndarray, lead: np.ndarray):
    """Summed log probability of the wanted cells in their classes; gradients of it less the chances' weighted
    mean: of the cells' weights, and of the hidden layer at the places of the given order."""
    order, parts = cells.dealt(wanted)
    h, lead, group, cell = h[:, :WIDTH].take(order, axis=0), lead.take(order), wanted.take(order), cell.take(order)
    lines = cells.lines(parts)
    at, line = cells.flat(group, cell, parts, lines), np.empty(lines[-1], h.dtype)
    own = np.concatenate([p["cells"], np.ones_like(p["cells"][:, :1])], axis=1)
    views, both = [], np.empty((len(h), WIDTH + 1), h.dtype)
    for (c, lo, hi), a, b in zip(parts, lines[:-1], lines[1:], strict=True):
        z, mine, cuts = line[a:b].reshape(hi - lo, -1), slice(lo, hi), cells.spans[c]
        np.matmul(h[mine], own[cuts, :WIDTH].T, out=z)
        cells.counted(z, c, lead[mine])
        views.append((z, mine, cuts))
    told = line.take(at)
    np.exp(line, out=line)
    for e, mine, cuts in views:
        np.matmul(e, own[cuts], out=both[mine])
    sums = both[:, WIDTH:]
    line[at] -= sums[:, 0]
    h /= sums
    g = np.zeros_like(p["cells"])
    for e, mine, cuts in views:
        np.matmul(e.T, h[mine], out=g[cuts])
    dealt = both[:, :WIDTH] / sums
    dealt -= p["cells"].take(cell, axis=0)
    return float((told - np.log(sums[:, 0])).sum()), g, order, dealt


def _gradients(p, head, tail, first, wanted, cells: Cells | None = None, cell=None, lead=None) -> tuple[float, dict]:
    """As ``gradients``; of the embeddings, those of heads above those of tails, only the rows seen and their gradients."""
    f = forward(p, head, tail, first, None if cells is None else cells.classes.take(lead, axis=0))
    e, h = f["e"], f["h"]
    sums = _sums(e)
    at = np.flatnonzero(wanted >= 0)
    n = max(len(at), 1)
    mine = at * CLASSES + wanted.take(at)
    loss = float((f["z"].reshape(-1).take(mine) - np.log(sums[:, 0].take(at))).sum())
    e.reshape(-1)[mine] -= sums[:, 0].take(at)
    # the sums' and the mean's divisors go to the narrower side of each product
    pace = ((wanted >= 0)[:, None] / (n * sums)).astype(h.dtype)
    g = {"out": (h * pace).T @ e, "level": pace.T @ e}
    dh = e @ p["out"].T
    dh *= pace
    if cells is not None:
        told, g["cells"], order, dealt = _within(p, cells, h, wanted, cell, lead)
        loss += told
        g["cells"] *= np.float32(1 / n)
        dealt *= np.float32(1 / n)
        every = np.zeros((len(dh), WIDTH), dh.dtype)
        every[order] = dealt
        dh[:, :WIDTH] += every
    slope = 1 - np.abs(h)
    slope *= slope
    dh *= slope
    g["inner"], g["bias"] = f["joined"].T @ dh, np.ones((1, len(dh)), dh.dtype) @ dh
    a, runs = f["a"], len(head)
    dj = (dh @ p["inner"].T).reshape(*a.shape[:3], 2 * WIDTH)
    dc = dj[..., WIDTH:]
    ds = np.matmul(dc, f["v"].swapaxes(2, 3))
    ds -= _sums(ds * a)
    ds *= a
    g["place"] = np.bincount(_NEAR.ravel(), weights=ds.reshape(-1, _NEAR.size).sum(axis=0), minlength=WINDOW)[None].astype(dh.dtype)
    turned = np.empty((runs, a.shape[1] + 1, STEP, 3 * WIDTH), dh.dtype)
    turned[:, 0, :, _QUERY] = 0
    turned[:, 1:, :, _QUERY] = np.matmul(ds, f["k"])
    _unwindowed(np.matmul(ds.swapaxes(2, 3), f["q"]), turned[..., _KEY])
    _unwindowed(np.matmul(a.swapaxes(2, 3), dc), turned[..., _VALUE])
    turned = turned.reshape(-1, 3 * WIDTH)
    turn = f["x"].T @ turned
    g["query"], g["key"], g["value"] = turn[:, _QUERY] * _SCALE, turn[:, _KEY], turn[:, _VALUE]
    dx = turned @ f["turn"].T
    dx.reshape(runs, -1, STEP, WIDTH)[:, 1:] += dj[..., :WIDTH]
    rows = np.stack([head.ravel(), tail.ravel() + len(p["head"])], axis=1, dtype=np.int16, casting="same_kind").ravel()
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return -loss / n, g | {"seen": (rows.take(begins), np.add.reduceat(dx.reshape(-1, _HALF).take(order, axis=0), begins, axis=0))}


def gradients(p, head, tail, first, wanted, cells: Cells | None = None, cell=None, lead=None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the places that want a class, and the gradient of every weight.

    With ``cells``, the loss of the wanted cell within its class too.
    """
    loss, g = _gradients(p, head, tail, first, wanted, cells, cell, lead)
    rows, part = g.pop("seen")
    both = np.zeros((2 * len(p["head"]), _HALF), part.dtype)
    both[rows] = part
    g["head"], g["tail"] = np.split(both, 2)
    g.setdefault("cells", np.zeros_like(p["cells"]))
    return loss, g


class Learner:
    """Adam over batches of windows; the steps of embeddings and cells go without momentum.

    The squares of an embedding row that a batch does not see fade when it is next seen.
    """

    def __init__(self, p: dict[str, np.ndarray], rate: float, cells: Cells | None = None):
        self.p, self.cells = {k: v.copy() for k, v in p.items()}, cells
        self.names = [k for k in p if k not in ("head", "tail", "cells")]
        self.flat = np.concatenate([p[k].ravel() for k in self.names])  # the others' weights lie in one line
        at = 0
        for k in self.names:
            self.p[k] = self.flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        self.one, self.two = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.both = np.concatenate([p["head"], p["tail"]])
        self.p["head"], self.p["tail"] = np.split(self.both, 2)
        self.squares, self.last, self.of_cells = np.zeros_like(self.both), np.zeros(len(self.both), np.int64), np.zeros_like(p["cells"])
        self.rate, self.t, self.loss, self.places = rate, 0, 0.0, 0

    def learn(self, stream: Stream, batch: int = 128) -> None:
        """One pass over all windows of a stream, in stretches, in an order that depends on their number alone."""
        starts = np.random.default_rng(len(stream.begins)).permutation(np.arange(0, len(stream.begins), RUN))
        most = max(1, batch // RUN)
        for at in range(0, len(starts), most):
            seen, own, wanted = stream.runs(starts[at : at + most])
            counted = () if self.cells is None else (self.cells, stream.cell.take(own), stream.lead.take(own))
            loss, g = _gradients(self.p, *seen, wanted, *counted)
            n = int((wanted >= 0).sum())
            self.loss, self.places, self.t = self.loss + n * loss, self.places + n, self.t + 1
            d = np.concatenate([g[k].ravel() for k in self.names])
            self.one += np.float32(0.1) * (d - self.one)
            self._step(self.flat, self.one / np.float32(1 - 0.9**self.t), d, self.two)
            if "cells" in g:
                d = g["cells"]
                self._step(self.p["cells"], d, d.copy(), self.of_cells)
            rows, d = g["seen"]
            two = self.squares.take(rows, axis=0)
            two *= (0.99 ** (self.t - 1 - self.last.take(rows)))[:, None].astype(two.dtype)
            some = self.both.take(rows, axis=0)
            self._step(some, d, d.copy(), two)
            self.both[rows], self.squares[rows], self.last[rows] = some, two, self.t

    def _step(self, p: np.ndarray, one: np.ndarray, d: np.ndarray, two: np.ndarray) -> None:
        """Move the weights by the means ``one``, whose place is used up as that of the gradient ``d``, over the
        roots of the mean squares ``two``."""
        least = np.sqrt(1 - 0.99**self.t)
        d *= d
        d *= np.float32(0.01)
        two *= np.float32(0.99)
        two += d
        np.sqrt(two, out=d)
        d += np.float32(1e-8 * least)
        one /= d
        one *= np.float32(self.rate * least)
        p -= one


class Scorer:
    """The model ready for scoring: what depends on a word alone is projected once for each row."""

    def __init__(self, p: dict[str, np.ndarray], cells: Cells | None = None):
        self.p, self.cells = p, cells
        self.parts = []
        for name, at in (("head", 0), ("tail", _HALF)):
            e, own = p[name], slice(at, at + _HALF)
            self.parts.append(
                np.concatenate([e @ p["query"][own] * _SCALE, e @ p["key"][own], e @ p["value"][own], e @ p["inner"][own]], axis=1)
            )
        self.parts[0][:, 3 * WIDTH :] += p["bias"]
        self.level = p["level"] if cells is None else cells.classes + p["level"]

    def classes(self, stream: Stream, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the classes at each place of the steps lo to hi, the logarithm of their exponentials' sum, the hidden layer."""
        before = max(lo - 1, 0)
        own = slice(before * STEP, hi * STEP)
        seen = self.parts[0].take(stream.head[own], axis=0)
        seen += self.parts[1].take(stream.tail[own], axis=0)
        seen = seen.reshape(1, -1, STEP, 3 * WIDTH + HIDDEN)
        if lo == 0:  # the first window of all sees nothing before
            seen = np.concatenate([seen[:, :1], seen], axis=1)
        k, v = (_windows(seen[..., own]) for own in (_KEY, _VALUE))
        _, context = _attended(seen[:, 1:, :, _QUERY], k, v, self.p["place"], stream.begins[None, lo:hi])
        h = context.reshape(-1, WIDTH) @ self.p["inner"][WIDTH:]
        h += seen[0, 1:, :, 3 * WIDTH :].reshape(-1, HIDDEN)
        h /= np.abs(h) + 1
        z = h @ self.p["out"]
        z += self.level if self.cells is None else self.level.take(stream.lead[lo * STEP : hi * STEP], axis=0)
        return z, np.log(_sums(np.exp(z))[:, 0]), h

    def within(self, h: np.ndarray, wanted: np.ndarray, cell: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each wanted cell within its class; 0 where nothing is wanted."""
        order, parts = self.cells.dealt(wanted)
        lines = self.cells.lines(parts)
        at = self.cells.flat(wanted.take(order), cell.take(order), parts, lines)
        h, lead = h.take(order, axis=0), lead.take(order)
        told, sums = np.empty_like(h[:, 0]), np.empty_like(h[:, 0])
        for (c, lo, hi), begin in zip(parts, lines, strict=False):
            own = self.p["cells"][self.cells.spans[c]]
            e = h[lo:hi] @ own.T
            self.cells.counted(e, c, lead[lo:hi])
            told[lo:hi] = e.reshape(-1).take(at[lo:hi] - begin)
            np.exp(e, out=e)
            sums[lo:hi] = _sums(e)[:, 0]
        out = np.zeros(len(wanted), np.float32)
        out[order] = told - np.log(sums)
        return out

    def log10(self, stream: Stream, steps: int = 1024) -> np.ndarray:
        """log10 probability of the class that each place wants, and with cells of the cell in it; 0 where it wants none."""
        out = np.zeros(len(stream.wanted), np.float32)
        for lo in range(0, len(stream.begins), steps):
            hi, hidden = min(lo + steps, len(stream.begins)), []
            for a in range(lo, hi, SCORED):
                b = min(a + SCORED, hi)
                z, total, h = self.classes(stream, a, b)
                wanted = stream.wanted[a * STEP : b * STEP]
                mine = np.arange(0, z.size, CLASSES) + np.maximum(wanted, 0)
                out[a * STEP : b * STEP] = np.where(wanted >= 0, z.reshape(-1).take(mine) - total, 0)
                hidden.append(h[:, :WIDTH])
            if self.cells is not None:
                at = slice(lo * STEP, hi * STEP)
                out[at] += self.within(np.concatenate(hidden), stream.wanted[at], stream.cell[at], stream.lead[at])
        out *= np.float32(np.log10(np.e))
        return out
