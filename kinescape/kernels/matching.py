"""Matching of points one to one over sparse candidate edges, and tracks that go on from frame to frame."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import product

import numpy as np

from kinescape.config import LinkSettings


def near_pairs(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of ``a`` and j of ``b`` (y, x) no further apart than ``reach``, by i and j, and how far they are.

    Points meet in grid cells as wide as the reach, and the eight around.
    """
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    both = np.floor(np.concatenate([a, b]) / (reach * (1 + 1e-9))).astype(np.int64)
    both -= both.min(axis=0) - 1
    wide = int(both[:, 1].max()) + 2
    code = both[:, 0] * wide + both[:, 1]
    mine, order = code[: len(a)], np.argsort(code[len(a) :], kind="stable")
    theirs = code[len(a) :][order]
    ends = []
    for dy, dx in product((-1, 0, 1), repeat=2):
        want = mine + dy * wide + dx
        first, last = np.searchsorted(theirs, want), np.searchsorted(theirs, want, side="right")
        size = last - first
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        ends.append((np.repeat(np.arange(len(a)), size), order[place]))
    i, j = map(np.concatenate, zip(*ends, strict=True))
    far = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
    keep = np.flatnonzero(far <= reach)
    keep = keep[np.lexsort((j[keep], i[keep]))]
    return i[keep], j[keep], far[keep]


def cheapest(i: np.ndarray, j: np.ndarray, cost: np.ndarray, alone: float) -> np.ndarray:
    """Which edges belong to the one-to-one choice of least cost; every end without an edge costs ``alone``."""
    one = np.ones(max(int(i.max(initial=-1)), int(j.max(initial=-1))) + 1, np.int64)
    return shares(i, j, cost, alone, one, one) > 0


def shares(i: np.ndarray, j: np.ndarray, cost: np.ndarray, alone: float, many: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many links each edge holds in the choice of least cost, where row i stands for ``many[i]``
    equal ends and column j for ``room[j]``; every end without a link costs ``alone``.

    Shortest augmenting paths over the edges with potentials; a path carries as many links as it
    can, so equal ends are settled at once. A link saves two lone ends, so a row's end that stays
    alone costs twice ``alone`` and columns nothing. Among equals a row rather stays alone, and
    smaller columns come first.
    """
    rows, row = np.unique(i, return_inverse=True)
    columns, column = np.unique(j, return_inverse=True)
    edges: list[list[tuple[int, float, int]]] = [[] for _ in rows]
    for e, (r, c, w) in enumerate(zip(row.tolist(), column.tolist(), cost.tolist(), strict=True)):
        edges[r].append((c, w, e))
    free = room[columns].tolist()
    up, down = [0.0] * len(rows), [0.0] * len(columns)
    held: list[dict[int, int]] = [{} for _ in columns]  # of each column its rows, and the edge between
    flow = [0] * len(i)
    infinite = float("inf")
    for start, waiting in enumerate(many[rows].tolist()):
        while waiting:
            length: dict[int, float] = {}
            before: dict[int, tuple[int, int]] = {}  # of a column the row and edge that lead to it
            settled: dict[int, float] = {}
            reached: dict[int, tuple[float, int]] = {start: (0.0, -1)}  # of a row its distance and the column that leads to it
            heap: list[tuple[float, int]] = []
            fresh, base, rest, stays = [start], 0.0, infinite, -1
            while True:
                for at in fresh:
                    if base + 2 * alone - up[at] < rest:
                        rest, stays = base + 2 * alone - up[at], at
                    lead = base - up[at]
                    for c, w, e in edges[at]:
                        d = lead + w - down[c]
                        if d < length.get(c, infinite) and c not in settled:
                            length[c], before[c] = d, (at, e)
                            heapq.heappush(heap, (d, c))
                while heap and heap[0][1] in settled:
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= rest:
                    end, goal, last = rest, -1, stays
                    break
                base, c = heapq.heappop(heap)
                if free[c]:
                    end, goal, last = base, c, -1
                    break
                settled[c] = base
                fresh = [r for r in held[c] if r not in reached]
                for r in fresh:
                    reached[r] = (base, c)
            for r, (d, _) in reached.items():
                up[r] += end - d
            for c, d in settled.items():
                down[c] -= end - d
            # back from the goal, or from the row that stays alone: links to make and to undo
            made, undone, r = [], [], last
            if goal >= 0:
                r, e = before[goal]
                made.append((goal, r, e))
            while r != start:
                c = reached[r][1]
                undone.append((c, r, held[c][r]))
                r, e = before[c]
                made.append((c, r, e))
            size = min([waiting, *([free[goal]] if goal >= 0 else []), *(flow[e] for _, _, e in undone)])
            for c, r, e in undone:
                flow[e] -= size
                if not flow[e]:
                    del held[c][r]
            for c, r, e in made:
                flow[e] += size
                held[c][r] = e
            if goal >= 0:
                free[goal] -= size
            waiting -= size
    return np.array(flow, np.int64)


@dataclass
class Alike:
    """Rows of a table by the distinct ones among them, in order of their first: ``first`` rows, how
    ``many`` each stands for, and each row's distinct one (``of``)."""

    first: np.ndarray
    many: np.ndarray
    of: np.ndarray

    @classmethod
    def among(cls, *columns: np.ndarray) -> "Alike":
        table = np.column_stack([np.asarray(c, float) for c in columns]) + 0.0
        order = np.lexsort(table.T[::-1])  # stable, so the first of equals stands first
        held = table[order]
        new = np.append(True, (held[1:] != held[:-1]).any(axis=1))[: len(order)]
        lead = order[new]
        named = np.argsort(np.argsort(lead))
        of = np.empty(len(order), np.int64)
        of[order] = named[np.cumsum(new) - 1]
        return cls(np.sort(lead), np.bincount(of, minlength=len(lead)), of)

    def dealt(self, group: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows, ``size`` of each named group, the earliest first and by ``other``; one after the other as named."""
        order = np.lexsort((other, group))
        total = np.cumsum(size[order])
        lead = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])[: len(order)])
        ahead = np.empty(len(order), np.int64)
        ahead[order] = total - size[order] - np.repeat((total - size[order])[lead], np.diff(lead, append=len(order)))
        members = np.argsort(self.of, kind="stable")
        base = np.cumsum(self.many) - self.many
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return members[np.repeat(base[group] + ahead, size) + within]


def others(a: Alike, b: Alike, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For a link over each edge of distinct ends, the least value of another edge of one of its two ends."""
    least = np.minimum(runner_up(i, value), runner_up(j, value))
    return np.where((a.many[i] > 1) | (b.many[j] > 1), np.minimum(least, value), least)


def runner_up(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each edge the least value of the other edges of its group; infinite without any."""
    out = np.full(len(value), np.inf)
    order = np.lexsort((value, group))
    held, names = value[order], group[order]
    first = np.append(True, names[1:] != names[:-1])[: len(order)]
    lead = np.flatnonzero(first)
    out[order] = np.repeat(held[lead], np.diff(lead, append=len(order)))
    more = lead[np.diff(lead, append=len(order)) > 1]
    out[order[lead]] = np.inf
    out[order[more]] = held[more + 1]
    return out


@dataclass
class Live:
    """Tracks that may go on, by number: where and when each was seen last, and its speed."""

    track: np.ndarray
    frame: np.ndarray
    place: np.ndarray
    speed: np.ndarray

    @classmethod
    def none(cls) -> "Live":
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros((0, 2)))

    def only(self, keep: np.ndarray) -> "Live":
        return Live(self.track[keep], self.frame[keep], self.place[keep], self.speed[keep])

    def __add__(self, other: "Live") -> "Live":
        own = vars(self)
        both = Live(*(np.concatenate([own[k], v]) for k, v in vars(other).items()))
        return both.only(np.argsort(both.track, kind="stable"))


#: Columns that :func:`advance` tells of each point.
TOLD = ("track_id", "link_status", "link_distance", "previous_count", "current_count", "gap_frames", "prediction_error", "assignment_margin")


def advance(live: Live, frame: int, here: np.ndarray, s: LinkSettings, count: int, opening: bool) -> tuple[Live, dict[str, np.ndarray]]:
    """One frame more: the tracks that may go on after it, and ``TOLD`` of each of its points (y, x).

    New tracks are numbered from ``count``; ``opening`` says that the movie begins here. Edges
    join a track and a point that lie within the gate, widened by the frames waited, of both the
    last and the predicted place. The choice is by squared shares of the gate. Tracks of one
    place, speed and frame are one end of edges, and so are points of one place.
    """
    live = live.only(frame - live.frame <= s.gap + 1)
    tracks, spots = Alike.among(live.place, live.speed, live.frame), Alike.among(here)
    lone, there = live.only(tracks.first), here[spots.first]
    wait = frame - lone.frame
    reach = s.gate * wait.astype(float)
    i, j, far = near_pairs(lone.place, there, reach.max(initial=s.gate))
    miss = np.sqrt(((lone.place + lone.speed * (s.prediction * wait)[:, None])[i] - there[j]) ** 2 @ np.ones(2))
    near = np.flatnonzero((far <= reach[i]) & (miss <= reach[i]))
    i, j, far, miss = i[near], j[near], far[near], miss[near]
    size = shares(i, j, (miss / reach[i]) ** 2, 0.5, tracks.many, spots.many)
    used = np.flatnonzero(size)
    links = np.repeat(used, size[used])
    a, b = tracks.dealt(i[used], j[used], size[used]), spots.dealt(j[used], i[used], size[used])
    far_link, miss_link, margin = far[links], miss[links], others(tracks, spots, i, j, miss)[links] - miss[links]
    clear = margin > s.margin
    wait = frame - live.frame
    n_track = np.bincount(i, weights=spots.many[j], minlength=len(tracks.first)).astype(np.int64)
    n_spot = np.bincount(j, weights=tracks.many[i], minlength=len(spots.first)).astype(np.int64)
    old = np.zeros(len(here), bool)
    old[b] = True
    out = {name: np.full(len(here), np.nan) for name in ("link_distance", "prediction_error", "assignment_margin")}
    for name, values in (("link_distance", far_link), ("prediction_error", miss_link), ("assignment_margin", margin)):
        out[name][b] = values
    zeros = np.zeros(len(here), np.int64)
    out |= {"track_id": zeros.copy(), "previous_count": zeros.copy(), "gap_frames": zeros.copy()}
    out["track_id"][b], out["track_id"][~old] = live.track[a], count + np.arange(int((~old).sum()))
    out["previous_count"][b] = n_track[tracks.of[a]]
    out["current_count"] = n_spot[spots.of]
    out["gap_frames"][b] = wait[a]
    status = np.where(old, "ambiguous", "start" if opening else "birth_or_unmatched").astype(object)
    status[b[clear]] = np.where(wait[a[clear]] == 1, "matched", "gap")
    speed = np.zeros((len(here), 2))
    speed[b[clear]] = (here[b[clear]] - live.place[a[clear]]) / wait[a[clear], None]
    missed = np.ones(len(live.track), bool)
    missed[a] = False
    seen = Live(out["track_id"], np.full(len(here), frame, np.int64), here, speed)
    return live.only(missed) + seen, out | {"link_status": status}
