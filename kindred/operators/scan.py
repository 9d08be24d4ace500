"""Best items of a group of users by one pass over a catalogue in a task.

A group of users meets a tile of items in one matrix product of single precision, whose error is
bounded. What the bound does not rule out is scored again in double precision, and only those scores
decide: the lists are the ones that all scores in double precision give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

from kindred.operators.selection import SCORE_DIGITS, ListSpec

# Users and items of one product, and items whose greatest score is kept.
GROUP, TILE, PART = 256, 2048, 256
# Scores that a group keeps from round to round.
STATE = 16_000_000
# A smaller catalogue is scored whole; of others so many items tell how far down a list reaches.
LEAST, SAMPLE = 8192, 4096
_ROUNDING = 3e-12


class Stock:
    """Item vectors as they came; unit rows, at request, as doubles."""

    def __init__(self, raw: np.ndarray, unit: bool) -> None:
        self.raw = raw
        self.n, self.width = raw.shape
        self.size = np.ones((self.n, 1))
        longest = 0.0
        for at in range(0, self.n, TILE):
            size = np.linalg.norm(raw[at : at + TILE].astype(np.float64), axis=1, keepdims=True)
            longest = max(longest, float(size.max())) if np.isfinite(size).all() else math.inf
            if unit:
                self.size[at : at + TILE] = size
        self.unit = unit
        # Bounds hold for numbers that single precision can tell.
        self.bounded = longest < 1e15 and self.n > LEAST
        self.longest = 1.0 if unit else longest
        if self.bounded:
            scale = np.divide(1.0, self.size, out=np.zeros_like(self.size), where=self.size > 0)
            self.bounded = bool((scale < 1e15).all())
            self.scale = scale.astype(np.float32)
            self.sample = np.sort(np.random.default_rng(0).choice(self.n, min(SAMPLE, self.n), replace=False))

    def rows(self, at) -> np.ndarray:
        """The vectors at some places, as doubles."""
        found = self.raw[at].astype(np.float64)
        if not self.unit:
            return found
        size = self.size[at]
        return np.divide(found, size, out=np.zeros_like(found), where=size > 0)

    def single(self, at) -> np.ndarray:
        return self.raw[at].astype(np.float32, copy=False) * self.scale[at]

    def similarities(self, users: np.ndarray) -> np.ndarray:
        """All similarities of some users."""
        made = np.empty((len(users), self.n))
        for at in range(0, self.n, 4 * TILE):
            made[:, at : at + 4 * TILE] = users @ self.rows(slice(at, at + 4 * TILE)).T
        return np.round(made, SCORE_DIGITS, out=made)

    def exact(self, user: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.round(self.rows(at) @ user, SCORE_DIGITS)

    def margin(self, users: np.ndarray) -> np.ndarray:
        """What a product of single precision may be off, per user."""
        return (self.width + 8) * 2.0**-23 * self.longest * np.linalg.norm(users, axis=1) + _ROUNDING

    def can(self, users: np.ndarray) -> bool:
        return self.bounded and bool(np.isfinite(users).all()) and float(np.abs(users).max(initial=0.0)) < 1e15

    def products(self, users: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(first item, products)`` by tiles; an array is overwritten by the next."""
        held = np.empty((len(users), TILE), np.float32)
        for at in range(0, self.n, TILE):
            tile = self.single(slice(at, at + TILE))
            yield at, np.matmul(users, tile.T, out=held if len(tile) == TILE else None)

    def above(self, users: np.ndarray, at_least: np.ndarray) -> list[np.ndarray]:
        """Per user the places, in order, whose product of single precision is ``at_least`` so much."""
        whose, where = [], []
        for first, scores in self.products(users.astype(np.float32)):
            hit = (scores >= at_least[:, None]).reshape(-1)
            whole = len(hit) // 8 * 8
            words = np.flatnonzero(hit[:whole].view(np.uint64))
            word, byte = np.nonzero(hit[:whole].reshape(-1, 8)[words])
            flat = np.concatenate([words[word] * 8 + byte, np.flatnonzero(hit[whole:]) + whole])
            row, column = np.divmod(flat, scores.shape[1])
            whose.append(row.astype(np.uint16))
            where.append(column + first)
        row, column = np.concatenate(whose), np.concatenate(where)
        order = np.argsort(row, kind="stable")
        return np.split(column[order], np.searchsorted(row[order], np.arange(1, len(users))))

    def share_above(self, users: np.ndarray, value: float) -> np.ndarray:
        """The share of a sample of items whose similarity is above ``value``, per user."""
        return (users.astype(np.float32) @ self.single(self.sample).T > value).mean(axis=1)

    def nearest(self, users: np.ndarray, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Per user ``(places, similarities)`` of at least all items that the ``wanted``-th best does not beat.

        None where so many are wanted that all may be scored as well. A sample tells where to cut; what lies
        above the cut is counted, so a cut that was too high is seen and lowered.
        """
        found: list = [None] * len(users)
        known = np.sort(users.astype(np.float32) @ self.single(self.sample).T, axis=1)
        margin, m, wider = self.margin(users), len(self.sample), 1.0
        left = np.arange(len(users))
        while len(left):
            share = wider * np.maximum(wanted[left], 1) * m / self.n
            rank = np.ceil(share + 3 * np.sqrt(share) + 3).astype(np.int64)
            left, rank = left[rank < m // 4], rank[rank < m // 4]
            if not len(left):
                break
            cut = known[left, m - rank]
            again = []
            for i, edge, at in zip(left, cut, self.above(users[left], cut), strict=True):
                sims, n = self.exact(users[i], at), max(1, int(wanted[i]))
                if len(at) >= n and np.partition(sims, len(at) - n)[len(at) - n] > edge + margin[i]:
                    found[i] = (at, sims)
                else:
                    again.append(i)
            left, wider = np.array(again, np.int64), 4 * wider
        return found

    def greedy(self, spec: ListSpec, users: np.ndarray, shut: Sequence[np.ndarray]) -> list[tuple[np.ndarray, list[float]]]:
        """MMR or Max-Sum over all items but ``shut``: places and scores of the picks, per user.

        Every score is a product of the item with one query of the round, or under MMR the least of
        those of all rounds. A round keeps the greatest score of each part of the catalogue; parts that
        may hold the pick are scored again.
        """
        step = max(1, min(GROUP, STATE // self.n)) if spec.penalty == "max" else GROUP
        made = []
        for start in range(0, len(users), step):
            made += self._greedy(spec, users[start : start + step], shut[start : start + step])
        return made

    def _greedy(self, spec: ListSpec, users: np.ndarray, shut: Sequence[np.ndarray]) -> list[tuple[np.ndarray, list[float]]]:
        limit = np.array([min(spec.k, self.n - len(s)) for s in shut])
        rounds = int(limit.max(initial=0))
        picked = np.zeros((len(users), rounds), np.int64)
        mine = np.zeros((len(users), rounds, self.width))
        scores = np.zeros((len(users), rounds))
        total, margin = np.zeros(users.shape), self.margin(users)
        lowest = spec.penalty == "max"
        state = None
        closed_by, closed_at = np.repeat(np.arange(len(users)), [len(s) for s in shut]), np.concatenate(shut).astype(np.int64)
        closed = np.zeros(self.n, bool)
        for on_list in range(rounds):
            query = users
            if on_list:
                query = spec.rel * users - spec.div * (mine[:, on_list - 1] if lowest else total / on_list)
                margin = np.maximum(margin, self.margin(query))
                closed_by = np.concatenate([closed_by, np.flatnonzero(on_list <= limit)])
                closed_at = np.concatenate([closed_at, picked[on_list <= limit, on_list - 1]])
                if lowest and state is None:
                    state = np.full((len(users), self.n), np.inf, np.float32)
            order = np.argsort(closed_at, kind="stable")
            by, at = closed_by[order], closed_at[order]
            peaks = []
            for first, found in self.products(query.astype(np.float32)):
                if state is not None:
                    found = np.minimum(found, state[:, first : first + TILE], out=state[:, first : first + TILE])
                a, b = np.searchsorted(at, [first, first + found.shape[1]])
                found[by[a:b], at[a:b] - first] = -np.inf
                if found.shape[1] == TILE:
                    peaks.append(found.reshape(len(users), -1, PART).max(axis=2))
                else:
                    peaks.append(np.maximum.reduceat(found, np.arange(0, found.shape[1], PART), axis=1))
            peak = np.concatenate(peaks, axis=1)
            edge = peak.max(axis=1) - 2 * margin
            for u in np.flatnonzero(on_list < limit):
                parts = np.flatnonzero(peak[u] >= edge[u])
                rows = (parts[:, None] * PART + np.arange(PART)).ravel()
                rows = rows[: np.searchsorted(rows, self.n)]
                vectors = self.rows(rows)
                score = np.round(vectors @ users[u], SCORE_DIGITS)
                if on_list:
                    near = (vectors @ mine[u, :on_list].T).max(axis=1) if lowest else vectors @ total[u] / on_list
                    score = np.round(spec.rel * score - spec.div * near, SCORE_DIGITS)
                closed[shut[u]] = closed[picked[u, :on_list]] = True
                score[closed[rows]] = -np.inf
                closed[shut[u]] = closed[picked[u, :on_list]] = False
                best = int(np.argmax(score))
                picked[u, on_list], scores[u, on_list], mine[u, on_list] = rows[best], score[best], vectors[best]
            total += mine[:, on_list]
        return [(picked[u, : limit[u]], scores[u, : limit[u]].tolist()) for u in range(len(users))]
