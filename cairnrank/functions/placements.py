"""Poses of many candidates on one query at once: which meet the anchors, and which of them scores best.

Scores are bounded in single precision, positions are doubles. What a bound leaves open is named, so that the caller can
settle those few candidates pose by pose with the kernels of ``geometry``: nothing is decided by an estimate.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np

from cairnrank.functions import geometry as G

#: How overlaps are measured here.
HOW = {"sigma": 1.0, "cutoff": 4.5}
#: Candidates placed at once; poses whose Gaussian values are held at once, so that they stay in the cache;
#: poses off the anchors that are tried by their features before all are.
ROWS, HELD, TRIED = 128, 320, 6
#: Squared lengths this near to a limit are left open; error of a score by single precision, generously, for squared lengths up to WIDE.
NEAR, SINGLE, WIDE = 1e-8, 3e-5, 150.0


@dataclass
class Prepared:
    """Candidates of the same types whose features are their shape: points (n, points, 3), centroids, frames and self overlaps (2, n)."""

    points: np.ndarray
    types: np.ndarray
    middle: np.ndarray
    frame: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, types, how: dict) -> Prepared:
        types = np.asarray(types)
        own = np.array([(G.self_overlap(p, **how), G.self_overlap(p, None, types, **how)) for p in points]).T.reshape(2, -1)
        return cls(points, types, points.mean(axis=1), G.frames(points), own)

    def __getitem__(self, at: np.ndarray) -> Prepared:
        return Prepared(self.points[at], self.types, self.middle[at], self.frame[at], self.own[:, at])


class Placer:
    """A query, its undirected anchors of distinct types and the least score that each of them must get."""

    def __init__(self, query: G.Overlay, anchors: tuple, least: float, tolerance: float = 2.0, samples: int = 6, most: int = 512):
        self.query, self.least, self.tolerance, self.most = query, least, tolerance, most
        self.points, self.kinds = G.cloud(anchors[0]), np.asarray(anchors[1])
        self.turns = 2 * np.pi * np.arange(samples) / samples
        self.middle, frame = query.shape.mean(axis=0), G.frames(query.shape[None])[0]
        self.still = self._sides(self.middle, np.eye(3)[None])
        self.signed = self._sides(self.middle, frame * G.SIGNS[:, None, :])
        self.blocks: dict[bytes, list] = {}
        self.pairs = []
        for i, j in combinations(query.anchors, 2) if most else ():
            middle, along = (query.features[i] + query.features[j]) / 2, query.features[j] - query.features[i]
            if np.linalg.norm(along) > 1e-12:
                self.pairs.append((i, j, along, self._sides(middle, G.about(along, self.turns))))

    def _sides(self, origin: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(turns, points, 5): left sides of Gaussians of the query and of the anchors about an origin, turned back."""
        query, anchors = (np.stack([G.halves((p - origin) @ t)[0] for t in turns]) for p in (self.query.shape, self.points))
        return (query / 2).astype(np.float32), anchors

    @staticmethod
    def suits(query: G.Overlay, anchors: tuple, least: float, policy: str, tolerance: float = 2.0, samples: int = 6, most: int = 512) -> bool:
        """Whether each anchor takes its nearest feature whatever the others do, and a pose that may meet all does."""
        kinds = np.asarray(anchors[1]).tolist()
        return (
            policy == "all" and len(set(kinds)) == len(kinds) > 0 and not np.any(np.asarray(anchors[3]) != G.NONE) and min(anchors[4]) > 0 and 1e-4 < least <= 1 and tolerance >= 0 and samples > 0 and most >= 0
            and query.how == HOW and G.same_points(query.shape, query.features) and len(query.shape) > 0 and bool((query.weights >= 0).all())
        )

    def outcomes(self, rows: Prepared, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """By candidate: whether a pose meets all anchors, whether the one that scores best does, a score, and what is open.

        Poses that can't change the answer aren't scored: where a pose off the anchors is known to score more than those on
        them, and their bound is under ``floor``. Returns the floor too, which rises with the scores found: the best score
        of all is over it, and the candidates that may have it are those whose score here isn't under it by more than SINGLE.
        """
        n = len(rows.points)
        met, passed, high, open_ = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n), np.zeros(n, bool)
        for low in (*range(0, min(n, 4)), *range(4, n, ROWS)):  # a few to raise the floor
            at = slice(low, low + 1 if low < 4 else low + ROWS)
            met[at], passed[at], high[at], open_[at], floor = self._some(rows[at], floor)
        return met, passed, high, open_, floor

    def _some(self, rows: Prepared, floor: float) -> tuple:
        n, q = len(rows.points), self.query
        own = np.stack([0.95 * q.own[k] + 0.05 * rows.own[j] for k, j in ((0, 0), (2, 1))])
        scale = np.divide(0.5, own, out=np.zeros_like(own), where=own > 0)
        weights = q._sums(rows.points.shape[1], rows.types, True)[0][[0, 2]].astype(np.float32)
        cut = weights.sum(axis=1) * np.exp(-4.5 * 4.5 / 2)  # a pair beyond the cutoff counts as if it were within
        slack = cut @ scale + 2 * SINGLE
        # the kernel without a cutoff is positive definite, so an overlap is at most the geometric mean of the self overlaps
        more = float(max(cut[0], cut[1] * q.weights.max(initial=1)))
        form, color = (scale[r] * np.sqrt((q.own[k] + more) * (rows.own[r] + more)) + SINGLE for r, k in ((0, 0), (1, 2)))
        best = np.full((2, n), -np.inf)  # of poses that don't meet all anchors, and of those that do
        open_, met, seeds = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        groups = self._groups(rows, open_, seeds)
        for g in groups:
            met[g.whose[g.hit.any(axis=0)]] = True

        def scored(g: _Group, t: np.ndarray, k: np.ndarray) -> None:
            for turn in np.unique(t).tolist():
                own = k[t == turn]
                for low in range(0, len(own), HELD):
                    at = own[low : low + HELD]
                    value = g.left[turn] @ g.right[:, :, at].reshape(5, -1)
                    np.exp(value, out=value)
                    of, good = g.whose[at], g.hit[turn, at]
                    score = ((weights @ value.reshape(-1, len(at))) * scale[:, of]).sum(axis=0)
                    for kind in (0, 1):
                        some = good == bool(kind)
                        np.maximum.at(best[kind], of[some], score[some])

        for g in groups:  # axis seeds, and poses on the anchors
            scored(g, *np.nonzero((g.hit | g.axes) & met[g.whose]))
        beaten = lambda: best[0] > best[1] + slack
        left = met & ~(beaten() & (form + color < floor))
        part = [self._tints(g, rows.types, left, scale[1]) for g in groups if not g.axes]
        if part and sum(len(x[0]) for x in part):  # other poses by their features first, then those that may matter
            of, tint = (np.concatenate(x) for x in zip(*((g.whose[k], tint) for g, (_, k, tint) in zip(groups[2:], part, strict=True)), strict=True))
            order = np.lexsort((-tint, of))
            ids, nth = of[order], np.empty(len(of), np.int64)
            nth[order] = np.arange(len(of)) - np.searchsorted(ids, ids)
            done = (tint + form[of] >= floor - SINGLE) | (~beaten()[of] & (nth < TRIED))
            for again in (False, True):
                take = (~done & ~beaten()[of]) if again else done
                low = 0
                for g, (t, k, _) in zip(groups[2:], part, strict=True):
                    at = take[low : (low := low + len(t))]
                    scored(g, t[at], k[at])
        high = best.max(axis=0)
        if (met & ~open_).any():
            floor = max(floor, float((high - slack)[met & ~open_].max()))
        open_ |= (seeds > self.most) | ~(own > 0).all(axis=0)
        open_[met] |= (best[1, met] >= best[0, met] - slack[met]) & (best[1, met] <= best[0, met] + slack[met])
        return met, met & (best[1] > best[0]), high, open_, floor

    def _tints(self, g: _Group, types: np.ndarray, left: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Poses (turns, placements) off the anchors of the candidates ``left``, and what their features add to the score."""
        if (key := types.tobytes()) not in self.blocks:
            kinds = [(np.flatnonzero(self.query.types == kind), np.flatnonzero(types == kind)) for kind in np.unique(types).tolist()]
            self.blocks[key] = [(mine, theirs, np.repeat(self.query.weights[mine], len(theirs)).astype(np.float32)) for mine, theirs in kinds if len(mine)]
        sel, turns = np.flatnonzero(left[g.whose]), len(g.left)
        out = np.zeros((turns, len(sel)))
        for low in range(0, len(sel), HELD):
            at = sel[low : low + HELD]
            right = g.right[:, :, at]
            for mine, theirs, w in self.blocks[key]:
                value = g.left[:, mine].reshape(-1, 5) @ right[:, theirs].reshape(5, -1)
                np.exp(value, out=value)
                out[:, low : low + HELD] += np.matmul(w, value.reshape(turns, len(w), -1))
        t, k = np.nonzero(~g.hit[:, sel])
        return t, sel[k], out[t, k] * scale[g.whose[sel[k]]]

    def _groups(self, rows: Prepared, open_: np.ndarray, seeds: np.ndarray) -> list[_Group]:
        """Placements by no turn, by the axes, and by each anchor pair."""
        n, about = len(rows.points), rows.points - rows.middle[:, None]
        every, near = range(len(self.points)), self.tolerance**2 / 4 < -2 * np.log(self.least) - NEAR
        out = [
            self._group(self.still, about.transpose(2, 1, 0), np.arange(n), rows.types, every, open_, True),
            self._group(self.signed, np.matmul(about, rows.frame).transpose(2, 1, 0), np.arange(n), rows.types, every, open_, True),
        ]
        flat, q = np.ascontiguousarray(rows.points.transpose(2, 1, 0)), self.query
        for i, j, along, sides in self.pairs if rows.points.shape[1] > 1 else ():
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(rows.types == q.types[i]), np.flatnonzero(rows.types == q.types[j]), indexing="ij"))
            a, b = a[a != b], b[a != b]
            long, span = np.linalg.norm(along), rows.points[:, b] - rows.points[:, a]
            short = np.sqrt((span * span).sum(axis=2))
            open_ |= ((np.abs(np.abs(short - long) - self.tolerance) < NEAR) | (np.minimum(short, long) < NEAR)).any(axis=1)
            whose, k = np.nonzero((np.minimum(short, long) > 1e-12) & (np.abs(short - long) <= self.tolerance))
            seeds += np.bincount(whose, minlength=n) * len(self.turns)
            turn = G.between(span[whose, k], along).transpose(1, 2, 0)
            x = flat[:, :, whose] - ((rows.points[whose, a[k]] + rows.points[whose, b[k]]) / 2).T[:, None]
            # an end of the pair lies within half the tolerance of its anchor, which may be near enough whatever the turn
            ask = [x for x in every if not (near and any(self.kinds[x] == q.types[e] and np.array_equal(self.points[x], q.features[e]) for e in (i, j)))]
            placed = np.stack([turn[r, 0] * x[0] + turn[r, 1] * x[1] + turn[r, 2] * x[2] for r in range(3)])
            out.append(self._group(sides, placed, whose, rows.types, ask, open_, False))
        return out

    def _group(self, sides: tuple, placed: np.ndarray, whose: np.ndarray, types: np.ndarray, ask, open_: np.ndarray, axes: bool) -> _Group:
        """Points (3, points, placements) before their turns; whether each anchor asked for has a feature of its type as near as the least score wants it."""
        left, anchors = sides
        right = np.concatenate([placed, np.ones((1, *placed.shape[1:])), (placed[0] ** 2 + placed[1] ** 2 + placed[2] ** 2)[None]])
        open_[whose[right[4].max(axis=0) > WIDE + 2 * left[..., 3].min()]] = True
        limit, hit = 2 * np.log(self.least), np.ones((len(left), len(whose)), bool)
        for k in ask:
            own = np.flatnonzero(types == self.kinds[k])
            if not len(own):
                hit[:] = False
                continue
            nearest = (anchors[:, k] @ right[:, own].reshape(5, -1)).reshape(len(left), len(own), -1).max(axis=1)  # minus squared distances
            edge = np.abs(nearest - limit) < NEAR
            if edge.any():
                open_[whose[edge.any(axis=0)]] = True
            hit &= nearest >= limit
        return _Group(left, right.astype(np.float32), whose, hit, axes)


@dataclass
class _Group:
    """Placements that share their turns: sides of Gaussians, whose they are, and which poses meet all anchors (turns, placements)."""

    left: np.ndarray
    right: np.ndarray
    whose: np.ndarray
    hit: np.ndarray
    axes: bool
