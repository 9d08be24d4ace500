"""What one recommendation list is, and how it is picked from a bounded candidate set.

The functions here work on NumPy arrays of one user's candidates.  Spark decides which
rows come together; see ``search`` (small catalogue) and ``blocks`` (any catalogue).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Scores are compared after rounding to this many digits, so that a tie is a tie
# whatever the block shapes the products were computed in.
SCORE_DIGITS = 12
# Rounding must never let a bound pass over a candidate.
BOUND_SLACK = 1e-9
GRAM_ROWS = 2048


@dataclass(frozen=True)
class ListSpec:
    """One list per user.

    The order is: drop what is above ``threshold``; cut by similarity to ``pool`` (without one, a
    plain list without ``dedupe`` is cut to ``k``); one item per group with ``dedupe``; the list.
    ``taken`` says what happens to items the user already has: ``keep`` them, drop them ``before``
    the cut, or ``after`` it and before ``dedupe``.  A candidate's greedy score is
    ``rel * sim - div * penalty(sims to picked) + cov * (1 - share of its cluster)``.
    """

    method: str
    k: int | None = 30
    pool: int | None = None
    taken: str = "before"
    threshold: float | None = None
    rel: float = 1.0
    div: float = 0.0
    cov: float = 0.0
    penalty: str = "mean"
    step_by_length: bool = False
    dedupe: bool = False

    def __post_init__(self) -> None:
        """A list means the same for a catalogue of any size, so what only a small one could do is refused."""
        if self.taken not in ("keep", "before", "after"):
            raise ValueError("taken is keep, before or after")
        if self.searches_all and (self.k is None or self.cov > 0 or self.dedupe):
            raise ValueError("a greedy list over the whole catalogue needs k, and no coverage term or dedupe; set pool")

    @property
    def greedy(self) -> bool:
        return self.div > 0 or self.cov > 0

    @property
    def cut(self) -> int | None:
        """How many of the most similar items are looked at; None for all."""
        plain = not self.greedy and not self.dedupe
        return self.k if plain and self.pool is None else self.pool

    @property
    def drops_first(self) -> bool:
        """Taken items go before the cut; without a cut, before and after are the same."""
        return self.taken == "before" or (self.taken == "after" and self.cut is None)

    @property
    def searches_all(self) -> bool:
        """Greedy over the whole catalogue, not over a similarity cut."""
        return self.greedy and self.pool is None


def topk(k: int = 30) -> ListSpec:
    return ListSpec("topk", k=k)


def threshold(at_most: float = 0.8) -> ListSpec:
    return ListSpec("threshold", k=None, threshold=at_most)


def mmr(k: int = 30, lam: float = 0.5) -> ListSpec:
    return ListSpec("mmr", k=k, rel=lam, div=1 - lam, penalty="max")


def maxsum(k: int = 30, lam: float = 0.5) -> ListSpec:
    return ListSpec("maxsum", k=k, rel=lam, div=1 - lam, penalty="mean")


def xquad(k: int = 30, topn: int = 300, lam: float = 0.6) -> ListSpec:
    return ListSpec("xquad", k=k, pool=topn, taken="after", rel=lam, cov=1 - lam)


def final(k: int = 500, topn: int = 1000) -> ListSpec:
    return ListSpec(
        "final", k=k, pool=topn, taken="keep", rel=0.6, div=0.25, cov=0.15, step_by_length=True
    )


def final_untaken(k: int = 500, topn: int = 1000) -> ListSpec:
    return ListSpec(
        "final_untaken", k=k, pool=topn, taken="after", rel=0.4, div=0.25, cov=0.15,
        step_by_length=True,
    )


def baseline(k: int = 10) -> ListSpec:
    return ListSpec("baseline", k=k, dedupe=True)


def cut_then_filter(k: int | None = 10, topn: int = 100) -> ListSpec:
    return ListSpec("cut_then_filter", k=k, pool=topn, taken="after")


def best_first(scores: np.ndarray, n: int | None) -> np.ndarray:
    """Positions of the ``n`` best scores, best first; equal scores keep position order."""
    if n is not None and n < len(scores):
        edge = np.partition(scores, len(scores) - n)[len(scores) - n] if n else np.inf
        kept = np.flatnonzero(scores >= edge)
    else:
        kept = np.arange(len(scores))
    order = kept[np.argsort(-scores[kept], kind="stable")]
    return order if n is None else order[:n]


def candidates(spec: ListSpec, sims: np.ndarray, taken: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Positions of a user's candidates, most similar first; all of them in order for a list that searches all.

    ``sims`` runs over items in ``item_id`` order.
    """
    usable = np.ones(len(sims), dtype=bool)
    if spec.drops_first:
        usable &= ~taken
    if spec.threshold is not None:
        usable &= sims <= spec.threshold
    where = np.flatnonzero(usable)
    if spec.searches_all:
        return where
    found = where[best_first(sims[where], spec.cut)]
    if spec.taken == "after":
        found = found[~taken[found]]
    if spec.dedupe:
        _, first = np.unique(group[found], return_index=True)
        found = found[np.sort(first)]
    return found


def first_best(scores: np.ndarray) -> tuple[int, float]:
    """Place and value of the first of the greatest scores after rounding; only those near the greatest are rounded."""
    best = int(scores.argmax())
    peak = float(scores[best])
    if not math.isfinite(peak):
        return best, peak
    near = (scores >= peak - 2e-12 - abs(peak) * 1e-15).nonzero()[0]
    if len(near) > 1:
        best = int(near[np.argmax(np.round(scores[near], SCORE_DIGITS))])
    # As np.round, which takes longer for a single number.
    return best, round(float(scores[best]) * 10.0**SCORE_DIGITS) / 10.0**SCORE_DIGITS


def greedy_picks(
    spec: ListSpec,
    vectors: np.ndarray,
    sims: np.ndarray,
    cluster: np.ndarray | None,
    picked: np.ndarray | None = None,
    stop_below=None,
    room: int | None = None,
) -> tuple[list[int], list[float]]:
    """Greedy selection over candidate rows given in tie order.

    The overlap with the list is kept as one running maximum or sum per candidate, so
    a round costs one matrix-vector product.  ``picked`` holds vectors already on the
    list.  ``stop_below(round, vector_sum)`` returns the score that a candidate outside
    this set may still reach; the loop ends when the best one here does not beat it.
    """
    n = len(sims)
    limit = n if spec.k is None else min(spec.k, n)
    if room is not None:
        limit = min(room, n)
    before = 0 if picked is None else len(picked)
    overlap = np.full(n, -np.inf) if spec.penalty == "max" else np.zeros(n)
    for vector in () if picked is None else picked:
        near = vectors @ vector
        overlap = np.maximum(overlap, near) if spec.penalty == "max" else overlap + near
    step = 0.0
    share = None
    if spec.cov and cluster is not None:
        labels, cluster = np.unique(cluster, return_inverse=True)
        share = np.zeros(len(labels))
        members = [np.flatnonzero(cluster == c) for c in range(len(labels))]
        step = 1.0 / (limit if spec.step_by_length else (spec.k or n)) if n else 0.0
    # Where a large share of the candidates is picked, all their products cost less at once.
    gram = vectors @ vectors.T if spec.div and n <= GRAM_ROWS and 4 * limit >= n else None
    closed = np.zeros(n, dtype=bool)
    base, score = spec.rel * sims, np.empty(n)
    bonus = None if share is None else spec.cov * (1.0 - share[cluster])
    picks: list[int] = []
    scores: list[float] = []
    total = None if picked is None or not before else np.sum(picked, axis=0)
    while len(picks) < limit:
        on_list = before + len(picks)
        if on_list == 0 and spec.searches_all:
            np.copyto(score, sims)
        elif spec.div and on_list:
            near = overlap if spec.penalty == "max" else np.divide(overlap, on_list, out=score)
            np.subtract(base, np.multiply(near, spec.div, out=score), out=score)
        else:
            np.copyto(score, base)
        if bonus is not None and not (on_list == 0 and spec.searches_all):
            score += bonus
        np.copyto(score, -np.inf, where=closed)
        best, value = first_best(score)
        if stop_below is not None and value <= stop_below(len(picks), on_list, total):
            break
        picks.append(best)
        scores.append(value)
        closed[best] = True
        if spec.div:
            near = vectors @ vectors[best] if gram is None else gram[best]
            if spec.penalty == "max":
                np.maximum(overlap, near, out=overlap)
            else:
                overlap += near
            if stop_below is not None:
                total = vectors[best].copy() if total is None else total + vectors[best]
        if share is not None:
            share[cluster[best]] += step
            bonus[members[cluster[best]]] = spec.cov * (1.0 - share[cluster[best]])
    return picks, scores


def greedy_everywhere(
    spec: ListSpec, user: np.ndarray, vectors: np.ndarray, sims: np.ndarray, found: np.ndarray, pool: int = 1000
) -> tuple[np.ndarray, list[float]]:
    """MMR or Max-Sum over all of ``found``: positions and scores of the picks.

    A round takes the ``pool`` best positions by current score and picks from them while the best
    provably beats every other one: under Max-Sum a score moves by no more than the shift of the
    query ``rel * user - div * mean(picked)``; for MMR see ``greedy_lazily``.
    The first pick of a round is always the best of all, so rounds end.
    """
    if not np.isfinite(sims[found]).all():  # no bound holds for them
        picks, scores = greedy_picks(spec, vectors[found], sims[found], None)
        return found[picks], scores
    if spec.penalty == "max":
        return greedy_lazily(spec, vectors, sims, found, pool)
    open_ = np.zeros(len(sims), dtype=bool)
    open_[found] = True
    limit = min(spec.k, len(found))
    longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())) if limit else 1.0
    overlap = np.zeros(len(sims))
    picked: list[int] = []
    scores: list[float] = []
    while len(picked) < limit:
        opening = not picked
        now = sims
        if picked:
            now = np.round(spec.rel * sims - spec.div * (overlap / len(picked)), SCORE_DIGITS)
        left = np.flatnonzero(open_)
        rows = np.sort(left[best_first(now[left], 1 if opening else pool)])
        everything = len(rows) == len(left)
        edge = -np.inf if everything else float(now[rows].min())
        mine = vectors[picked]
        started = spec.rel * user - (spec.div * mine.mean(axis=0) if picked else 0)

        def outside(new, on_list, total, everything=everything, opening=opening, edge=edge, started=started):
            if new == 0 or everything:
                return -np.inf
            if opening:
                return np.inf
            return edge + longest * float(np.linalg.norm(spec.rel * user - spec.div * total / on_list - started)) + BOUND_SLACK

        at, fresh = greedy_picks(spec, vectors[rows], sims[rows], None, mine, outside, limit - len(picked))
        new = rows[at]
        picked += new.tolist()
        scores += fresh
        open_[new] = False
        if len(picked) < limit:
            overlap += vectors @ vectors[new].sum(axis=0)
    return np.array(picked, dtype=np.int64), scores


def greedy_lazily(
    spec: ListSpec, vectors: np.ndarray, sims: np.ndarray, found: np.ndarray, pool: int
) -> tuple[np.ndarray, list[float]]:
    """MMR over all of ``found``: a score can only fall as the list grows, so an old one is a bound.

    A round brings the scores of the ``pool`` best bounds up to date, ties included, and picks from
    them while the best beats every bound outside.  A round without a pick has lowered a bound, and
    once the best ones are all up to date the first of them is accepted: rounds end.  Rounds look at
    a larger pool of bounds only, as long as its best one is above all others.
    """
    limit = min(spec.k, len(found))
    if not limit:
        return np.zeros(0, dtype=np.int64), []
    first = int(found[np.argmax(sims[found])])
    picked, scores = [first], [float(sims[first])]
    bound = np.full(len(sims), -np.inf)
    bound[found] = np.round(spec.rel * sims[found] - spec.div * (vectors @ vectors[first])[found], SCORE_DIGITS)
    bound[first] = -np.inf
    while len(picked) < limit:
        hot = at_best(bound, 16 * pool)
        mine = bound[hot]
        bound[hot] = -np.inf
        beyond = float(bound.max())
        while len(picked) < limit and mine.max() > beyond:
            rows = at_best(mine, pool)
            chosen = vectors[picked]
            near = (vectors[hot[rows]] @ chosen.T).max(axis=1)
            mine[rows] = -np.inf
            edge = max(beyond, float(mine.max()))
            mine[rows] = np.round(spec.rel * sims[hot[rows]] - spec.div * near, SCORE_DIGITS)
            at, fresh = greedy_picks(
                spec, vectors[hot[rows]], sims[hot[rows]], None, chosen, lambda new, on_list, total, edge=edge: edge,
                limit - len(picked),
            )
            picked += hot[rows[at]].tolist()
            scores += fresh
            mine[rows[at]] = -np.inf
        bound[hot] = mine
    return np.array(picked, dtype=np.int64), scores


def at_best(bound: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` highest finite bounds and of all that tie with the last of them."""
    last = np.partition(bound, len(bound) - n)[len(bound) - n] if n < len(bound) else -np.inf
    return np.flatnonzero((bound >= last) & (bound > -np.inf))


def local_kmeans(vectors: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Cluster labels of one user's bounded candidate set (at most ``pool`` rows)."""
    k = min(k, len(vectors))
    if k <= 1:
        return np.zeros(len(vectors), dtype=np.int64)
    rng = np.random.default_rng(seed)
    centres = [vectors[rng.integers(len(vectors))]]
    gap = ((vectors - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = gap.sum()
        at = rng.choice(len(vectors), p=gap / total) if total > 0 else rng.integers(len(vectors))
        centres.append(vectors[at])
        gap = np.minimum(gap, ((vectors - centres[-1]) ** 2).sum(axis=1))
    middle = np.stack(centres)
    label = np.full(len(vectors), -1)
    for _ in range(rounds):
        far = (middle**2).sum(axis=1) - 2 * vectors @ middle.T
        fresh = far.argmin(axis=1)
        if (fresh == label).all():
            break
        label = fresh
        for c in range(k):
            if (label == c).any():
                middle[c] = vectors[label == c].mean(axis=0)
    return label.astype(np.int64)
