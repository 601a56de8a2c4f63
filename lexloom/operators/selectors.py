"""Selectors: greedy marginal relevance, GRASP, multi-objective search, ranking, and their budgets.

Scores and similarities are compared on a grid of 1e-10, so that engines that sum in another order
agree about ties.  Every selector returns places in document order.
"""

from __future__ import annotations

import ctypes
import random
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np

GRID = 1e10
#: Searches that evolve side by side.
TOGETHER = 64


class Budget:
    """Length control: tokens, or sentences (null or non-positive means no limit)."""

    def __init__(self, cost: np.ndarray, unit: str = "tokens", max_tokens: int | None = 100, max_sentences: int | None = None):
        self.cost = np.asarray(cost, np.int64)
        self.by_sentences = unit == "sentences"
        if self.by_sentences:
            self.limit = int(max_sentences) if max_sentences and max_sentences > 0 else 1 << 60
            self.cost = np.ones(len(self.cost), np.int64)
        else:
            self.limit = 10**9 if max_tokens is None else int(max_tokens)


def _grid(x: np.ndarray) -> np.ndarray:
    return np.round(np.asarray(x, float) * GRID) / GRID


def greedy(scores, similarity, budget: Budget, alpha: float = 0.7) -> list[int]:
    """Add the fitting sentence with the largest alpha x score - (1 - alpha) x similarity to the chosen."""
    scores = _grid(scores)
    sim = None if similarity is None else _grid(similarity)
    near, used = np.zeros(len(scores)), 0
    free, chosen = np.ones(len(scores), bool), []
    while True:
        fits = free & (used + budget.cost <= budget.limit)
        if not fits.any():
            return sorted(chosen)
        gain = alpha * scores - ((1 - alpha) * near if sim is not None and chosen else 0)
        gain = np.where(fits, np.round(gain * GRID), -np.inf)
        i = int(gain.argmax())
        chosen.append(i)
        free[i] = False
        used += int(budget.cost[i])
        if sim is not None:
            near = np.maximum(near, sim[i]) if len(chosen) > 1 else sim[i].copy()


def objective(chosen, scores, similarity, alpha: float) -> float:
    """Sum of scores less (1 - alpha) x the similarity of every pair; empty is -1e9."""
    if not len(chosen):
        return -1e9
    chosen = list(chosen)
    total = float(np.asarray(scores)[chosen].sum())
    if similarity is not None and len(chosen) > 1:
        s = np.asarray(similarity)[np.ix_(chosen, chosen)]
        total -= (1 - alpha) * float(s[np.triu_indices(len(chosen), 1)].sum())
    return total


def _construct(scores, sim, budget: Budget, alpha: float, rng: random.Random, ratio: float) -> list[int]:
    """Randomised greedy: a uniform choice among the best share of the fitting sentences."""
    near, used, chosen = np.zeros(len(scores)), 0, []
    free = np.ones(len(scores), bool)
    while True:
        fit = np.flatnonzero(free & (used + budget.cost <= budget.limit))
        if not len(fit):
            return sorted(chosen)
        gain = alpha * scores[fit] - ((1 - alpha) * near[fit] if sim is not None and chosen else 0)
        order = fit[np.argsort(-np.round(gain * GRID), kind="stable")]
        i = int(order[: max(1, int(len(fit) * ratio))][rng.randrange(max(1, int(len(fit) * ratio)))])
        chosen.append(i)
        free[i] = False
        used += int(budget.cost[i])
        if sim is not None:
            near = np.maximum(near, sim[i])


def local_search(chosen: list[int], scores, sim, budget: Budget, alpha: float, most: int = 200) -> list[int]:
    """First improving swap, else addition, else removal, until none improves by more than 1e-9."""
    if not chosen:
        return chosen
    n = len(scores)
    inside = np.zeros(n, bool)
    inside[chosen] = True
    pull = np.zeros(n) if sim is None else sim[:, chosen].sum(axis=1)
    used = int(budget.cost[chosen].sum())
    weight = 1 - alpha

    def moved(i: int, way: int) -> None:
        nonlocal pull, used
        inside[i] = way > 0
        used += way * int(budget.cost[i])
        if sim is not None:
            pull = pull + way * sim[:, i]

    for _ in range(most):
        out, held = np.flatnonzero(~inside), np.flatnonzero(inside)
        done = False
        if len(out):
            lose = scores[held] - weight * (pull[held] - (0 if sim is None else sim[held, held]))
            cross = 0 if sim is None else sim[np.ix_(held, out)]
            delta = (scores[out] - weight * pull[out])[None, :] + weight * cross - lose[:, None]
            delta = np.where(used - budget.cost[held][:, None] + budget.cost[out][None, :] <= budget.limit, delta, -1)
            better = np.argwhere(delta > 1e-9)
            if len(better):
                a, b = better[0]
                moved(int(held[a]), -1)
                moved(int(out[b]), 1)
                done = True
            else:
                gain = np.where(used + budget.cost[out] <= budget.limit, scores[out] - weight * pull[out], -1)
                better = np.flatnonzero(gain > 1e-9)
                if len(better):
                    moved(int(out[better[0]]), 1)
                    done = True
        if not done and len(held) > 1:
            drop = weight * (pull[held] - (0 if sim is None else sim[held, held])) - scores[held]
            better = np.flatnonzero(drop > 1e-9)
            if len(better):
                moved(int(held[better[0]]), -1)
                done = True
        if not done:
            break
    return np.flatnonzero(inside).tolist()


def grasp(scores, similarity, budget: Budget, alpha: float = 0.7, iters: int = 10, ratio: float = 0.3, seed: int | None = None) -> list[int]:
    """Restarts of randomised construction and local search; stops after max(3, iters // 3) stale ones."""
    scores = _grid(scores)
    sim = None if similarity is None else _grid(similarity)
    rng, best, value, stale = random.Random(seed), [], -1e18, 0
    for _ in range(iters):
        found = local_search(_construct(scores, sim, budget, alpha, rng, ratio), scores, sim, budget, alpha)
        now = objective(found, scores, sim, alpha)
        if now > value + 1e-12:
            best, value, stale = found, now, 0
        else:
            stale += 1
            if stale >= max(3, iters // 3):
                break
    return best


# ---- multi-objective search ----


def coverage(similarity: np.ndarray, chosen, method: str = "max") -> float:
    """Mean over all sentences of the largest similarity to a chosen one.

    ``set`` starts from 0 and equals ``max`` without negative similarities; ``diversity`` takes off
    0.3 x the mean similarity of two chosen ones; unknown names are ``max``.
    """
    chosen = list(chosen)
    if not chosen:
        return 0.0
    top = similarity[:, chosen].max(axis=1)
    if method == "set":
        top = np.maximum(top, 0)
    value = float(top.mean())
    if method == "diversity" and len(chosen) > 1:
        value -= 0.3 * redundancy(similarity, chosen)
    return value


def redundancy(similarity: np.ndarray, chosen) -> float:
    chosen = list(chosen)
    if len(chosen) < 2:
        return 0.0
    return float(similarity[np.ix_(chosen, chosen)][np.triu_indices(len(chosen), 1)].mean())


class _Problem:
    """Objectives (to minimise) and violation of whole populations of 0/1 vectors.

    Coverage is a running maximum over the columns, so the memory is population x sentences.
    """

    def __init__(self, scores, similarity, budget: Budget, method: str):
        self.scores, self.sim, self.budget, self.method = np.asarray(scores, float), np.asarray(similarity, float), budget, method
        self.own = np.diag(self.sim)
        # small problems take all columns at once
        self.whole = len(self.scores) <= 64

    def _top(self, x: np.ndarray) -> np.ndarray:
        """Largest similarity of every sentence to a chosen one."""
        if self.whole:
            return np.where(x[:, None, :], self.sim[None], -np.inf).max(axis=2)
        top = np.full(x.shape, -np.inf)
        for j in np.flatnonzero(x.any(axis=0)):
            rows = np.flatnonzero(x[:, j])
            top[rows] = np.maximum(top[rows], self.sim[:, j])
        return top

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dense = x.astype(float)
        size = dense.sum(axis=1)
        top = self._top(x)
        if self.method == "set":
            top = np.maximum(top, 0)
        cover = np.where(size > 0, top.mean(axis=1), 0)
        pairs = size * (size - 1) / 2
        inside = ((dense @ self.sim * dense).sum(axis=1) - dense @ self.own) / 2
        repeat = np.divide(inside, pairs, out=np.zeros(len(x)), where=pairs > 0)
        if self.method == "diversity":
            cover = cover - np.where(size > 1, 0.3 * repeat, 0)
        over = dense @ self.budget.cost - self.budget.limit
        return _grid(np.stack([-(dense @ self.scores), -cover, repeat], axis=1)), np.maximum(over, 0)


def _fronts(f: np.ndarray, over: np.ndarray, enough: int) -> np.ndarray:
    """Rank of each vector by constrained domination, until ``enough`` have one (the rest rank last)."""
    # a violation stands in for the objectives, behind every feasible value
    behind = np.abs(f).max(initial=0) + 1
    f = np.where(over[:, None] > 0, behind + over[:, None], f)
    a, b, c = np.ascontiguousarray(f.T, np.float64)
    le = a[:, None] <= a
    le &= b[:, None] <= b
    le &= c[:, None] <= c
    beats = le & ~le.T
    ahead = beats.sum(axis=0, dtype=np.int16)
    rank, level, done = np.full(len(f), np.iinfo(np.int16).max, np.int16), 0, 0
    while done < min(enough, len(f)):
        front = np.flatnonzero(ahead == 0)
        rank[front] = level
        ahead -= beats[front].sum(axis=0, dtype=np.int16)
        ahead[front] = -1
        level, done = level + 1, done + len(front)
    return rank


def _crowding(f: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Crowding distance of every vector inside its rank."""
    out = np.zeros(len(f))
    for k in range(f.shape[1]):
        order = np.lexsort((f[:, k], rank))
        value, r = f[order, k], rank[order]
        first = np.concatenate([[True], r[1:] != r[:-1]])
        edges = np.flatnonzero(first)
        last = np.append(edges[1:], len(r)) - 1
        span = np.repeat(value[last] - value[edges], np.diff(np.append(edges, len(r))))
        gap = np.zeros(len(r))
        gap[1:-1] = np.divide(value[2:] - value[:-2], span[1:-1], out=np.zeros(max(0, len(r) - 2)), where=span[1:-1] > 0)
        gap[edges] = gap[last] = np.inf
        out[order] += gap
    return out


def _keys(x: np.ndarray) -> np.ndarray:
    """A sortable key of each 0/1 vector."""
    if x.shape[1] < 63:
        return x @ (1 << np.arange(x.shape[1], dtype=np.int64))
    packed = np.ascontiguousarray(np.packbits(x, axis=1))
    return packed.view(np.dtype((np.void, packed.shape[1]))).ravel()


def _subset_table(scores, sim, cost, method: str):
    """Importance, coverage, redundancy and cost of every subset, built by doubling."""
    n = len(scores)
    importance, used, pairs, size = np.zeros(1), np.zeros(1, np.int64), np.zeros(1), np.zeros(1)
    top = np.full((n, 1), -np.inf)
    for k in range(n):
        row = np.zeros(1)
        for j in range(k):
            row = np.concatenate([row, row + sim[k, j]])
        importance = np.concatenate([importance, importance + scores[k]])
        used = np.concatenate([used, used + cost[k]])
        pairs = np.concatenate([pairs, pairs + row])
        size = np.concatenate([size, size + 1])
        top = np.concatenate([top, np.maximum(top, sim[:, [k]])], axis=1)
    if method == "set":
        top = np.maximum(top, 0)
    cover = np.where(size > 0, top.mean(axis=0), 0)
    count = size * (size - 1) / 2
    repeat = np.divide(pairs, count, out=np.zeros(len(pairs)), where=count > 0)
    if method == "diversity":
        cover = cover - np.where(size > 1, 0.3 * repeat, 0)
    return importance, cover, repeat, used


def best_subset(scores, similarity, budget: Budget, weights=(1.0, 0.8, 0.7), method: str = "max") -> list[int]:
    """The feasible subset with the largest weighted value, by valuing all of them: the measure of :func:`nsga2`."""
    scores, sim = np.asarray(scores, float), np.asarray(similarity, float)
    n, (wi, wc, wr) = len(scores), weights
    if not n:
        return []
    importance, cover, repeat, used = _subset_table(scores, sim, budget.cost, method)
    value = np.round((wi * importance + wc * cover - wr * repeat) * GRID)
    value[used > budget.limit] = -np.inf
    best = int(value.argmax())
    return [k for k in range(n) if best >> k & 1]


def nsga2(scores, similarity, budget: Budget, weights=(1.0, 0.8, 0.7), method: str = "max", seed: int = 0, pop_size: int = 100, n_gen: int = 100) -> list[int]:
    """The feasible vector of the last front with the largest weighted importance, coverage, redundancy.

    Evolutionary search: random binary start, tournaments by rank and crowding, two-point crossover
    (0.9), bit flips (1/n), no duplicates.  Where no more different vectors exist than the
    population holds, they are the population and nothing can evolve.
    """
    scores, sim = np.asarray(scores, float), np.asarray(similarity, float)
    n, (wi, wc, wr) = len(scores), weights
    if n == 0:
        return []
    rng = np.random.default_rng(seed)
    problem = _Problem(scores, sim, budget, method)
    if n < 30 and 1 << n <= pop_size:
        x, n_gen = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool), 0
    else:
        x = rng.random((pop_size, n)) < 0.5
        x = x[np.unique(_keys(x), return_index=True)[1]]
    f, over = problem.values(x)
    rank = _fronts(f, over, len(x))
    crowd = _crowding(f, rank)
    place = np.arange(n)
    for _ in range(n_gen):
        a, b, cut, cross, flips = (d[0] for d in _draws(rng.random(pop_size * (7 + n))[None], pop_size, np.array([len(x)])))
        first = (rank[a] < rank[b]) | (rank[a] == rank[b]) & (crowd[a] >= crowd[b])
        parents = x[np.where(first, a, b)]
        left, right = parents[:pop_size], parents[pop_size:]
        low, high = cut.min(axis=0)[:, None], cut.max(axis=0)[:, None]
        middle = (place >= low) & (place < high) & (cross[:, None] < 0.9)
        child = np.where(middle, right, left) ^ (flips < 1 / n)
        merged = np.concatenate([x, child])
        fresh = np.sort(np.unique(_keys(merged), return_index=True)[1])[len(x) :]
        merged, (new_f, new_over) = np.concatenate([x, merged[fresh]]), problem.values(merged[fresh])
        f, over = np.concatenate([f, new_f]), np.concatenate([over, new_over])
        rank = _fronts(f, over, pop_size)
        crowd = _crowding(f, rank)
        keep = np.lexsort((-crowd, rank))[:pop_size]
        x, f, over, rank, crowd = merged[keep], f[keep], over[keep], rank[keep], crowd[keep]
    front = (rank == 0) & (over <= 0)
    if not front.any():
        return []
    value = np.round((-wi * f[:, 0] - wc * f[:, 1] - wr * f[:, 2]) * GRID)
    value[~front] = -np.inf
    return np.flatnonzero(x[int(value.argmax())]).tolist()


def _draws(u: np.ndarray, pop: int, size: np.ndarray):
    """One generation's chance of each search (rows of numbers below 1): two rivals of each parent, two cuts, crossover and flips."""
    n = u.shape[1] // pop - 7
    rivals = (u[:, : 4 * pop] * size[:, None]).astype(np.int64)
    cuts = (u[:, 4 * pop : 6 * pop] * (n + 1)).astype(np.int64)
    return rivals[:, : 2 * pop], rivals[:, 2 * pop :], cuts.reshape(-1, 2, pop), u[:, 6 * pop : 7 * pop], u[:, 7 * pop :].reshape(-1, pop, n)


class Search(NamedTuple):
    """The arguments of :func:`nsga2`."""

    scores: np.ndarray
    similarity: np.ndarray
    budget: Budget
    weights: tuple = (1.0, 0.8, 0.7)
    method: str = "max"
    seed: int = 0
    pop_size: int = 100
    n_gen: int = 100


def nsga2_many(searches: list[Search]) -> list[list[int] | Exception]:
    """:func:`nsga2` of each search; those of one size evolve side by side, so that a generation is one pass over all."""
    _keep_memory()
    out: list = [None] * len(searches)
    groups: dict[tuple, list[int]] = {}
    for k, s in enumerate(searches):
        n = len(s.scores)
        fits = 2 * s.pop_size <= 256 and 1 << n > s.pop_size and n <= 54 and max(np.abs(s.scores).sum(), np.abs(s.similarity).max()) < 1e5
        groups.setdefault((n, s.pop_size, s.n_gen, s.method) if fits else (k,), []).append(k)
    for kind, members in groups.items():
        for at in range(0, len(members), TOGETHER):
            some = members[at : at + TOGETHER]
            if len(kind) > 1:
                try:
                    for k, found in zip(some, _Evolution([searches[k] for k in some]).run()):
                        out[k] = found
                    continue
                except (ArithmeticError, ValueError, np.linalg.LinAlgError):
                    pass  # one of them fails: let it be seen which
            for k in some:
                try:
                    out[k] = nsga2(*searches[k])
                except Exception as e:  # noqa: BLE001 - it belongs to this search
                    out[k] = e
    return out


@lru_cache(maxsize=1)
def _keep_memory() -> None:
    """Let arrays of up to 16 MB come from the heap: mapping them anew in each generation costs as much as the work."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError, TypeError):
        pass  # another C library: slower, nothing else


class _Evolution:
    """Searches of one size side by side; a vector is an integer of ``n`` bits.

    Each draws the numbers that :func:`nsga2` draws.  Slots that hold no vector (duplicates, or fewer
    vectors than ``pop_size``) rank behind all others and take no part.
    """

    def __init__(self, searches: list[Search]):
        one = searches[0]
        self.n, self.pop, self.n_gen, self.method = len(one.scores), one.pop_size, one.n_gen, one.method
        self.scores = np.array([s.scores for s in searches], float)
        self.sim = np.array([s.similarity for s in searches], float)
        self.own = np.ascontiguousarray(np.diagonal(self.sim, axis1=1, axis2=2))
        self.cost = np.array([s.budget.cost for s in searches], float)
        self.limit = np.array([[s.budget.limit] for s in searches], float)
        self.weights = np.array([s.weights for s in searches], float)
        self.rngs = [np.random.default_rng(s.seed) for s in searches]
        self.bits = np.arange(self.n)
        self.each = np.arange(len(searches))[:, None]
        # largest similarity to the members of any subset of eight columns
        self.tops = []
        for k in range(0, self.n, 8):
            table = np.full((len(searches), 256, self.n), -np.inf)
            for j in range(k, min(k + 8, self.n)):
                size = 1 << j - k
                np.maximum(table[:, :size], self.sim[:, None, :, j], out=table[:, size : 2 * size])
            self.tops.append(table.reshape(-1, self.n))
        self.slot = self.each * 256
        # the bit of each place among up to 256
        self.one = np.zeros((256, 4), np.uint64)
        self.one[np.arange(256), np.arange(256) >> 6] = np.uint64(1) << (np.arange(256) & 63).astype(np.uint64)

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Objectives (first axis) on the grid, and violation, as :class:`_Problem` has them."""
        dense = np.unpackbits(np.ascontiguousarray(x)[..., None].view(np.uint8), axis=2, count=self.n, bitorder="little").astype(float)
        size = np.bitwise_count(x).astype(float)
        top = np.take(self.tops[0], self.slot + (x & 255), axis=0)
        for k, table in enumerate(self.tops[1:], 1):
            np.maximum(top, np.take(table, self.slot + (x >> 8 * k & 255), axis=0), out=top)
        if self.method == "set":
            np.maximum(top, 0, out=top)
        cover = np.where(size > 0, top.sum(axis=2) / self.n, 0)
        pairs = size * (size - 1) / 2
        inside = dense @ self.sim
        inside *= dense
        inside = (inside.sum(axis=2) - (dense @ self.own[..., None])[..., 0]) / 2
        repeat = np.divide(inside, pairs, out=np.zeros(x.shape), where=pairs > 0)
        if self.method == "diversity":
            cover = cover - np.where(size > 1, 0.3 * repeat, 0)
        over = (dense @ self.cost[..., None])[..., 0] - self.limit
        f = np.stack([-(dense @ self.scores[..., None])[..., 0], -cover, repeat])
        f *= GRID
        return np.round(f, out=f).astype(np.int64), np.maximum(over, 0)

    def ranked(self, grid: np.ndarray, over: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank by constrained domination, until ``pop`` of each search have one, and crowding inside the ranks."""
        d, m = valid.shape
        spot, used = np.arange(m), -(-m // 64)
        row = np.arange(3 * d).reshape(3, d, 1)
        raw = grid << 8 | spot
        # no two of the slots without a vector are equal
        key = np.sort(np.where(valid, np.where(over > 0, (1 << 53) + over.astype(np.int64) << 8 | spot, raw), (1 << 54) + spot << 8 | spot), axis=-1)
        at = key & 255
        flat = (at + row * m).ravel()
        # bit sets of those not above each one in each objective
        before = np.zeros((3, d, m + 1, used), np.uint64)
        np.bitwise_or.accumulate(np.take(self.one[:, :used], at, axis=0), axis=2, out=before[:, :, 1:])
        before = before.reshape(-1, used)
        key >>= 8
        equal = np.zeros((3, d, m + 1), bool)
        np.equal(key[..., 1:], key[..., :-1], out=equal[..., 1:m])
        last = (spot + 1 + row * (m + 1)).ravel()
        tied = np.flatnonzero(equal[..., :m] | equal[..., 1:])
        upto = np.empty(3 * d * m, np.int64)
        if len(tied):
            # runs of equal values: all of them are up to each one, none below
            begin = np.flatnonzero(~equal[..., :m].ravel()[tied])
            long = np.diff(np.append(begin, len(tied)))
            below, ties = last - 1, np.zeros(3 * d * m, bool)
            last[tied], below[tied] = np.repeat(last[tied[begin + long - 1]], long), np.repeat(below[tied[begin]], long)
            ties[flat[tied]] = True
        upto[flat] = last
        upto = upto.reshape(3, -1)
        beats = np.take(before, upto[0], axis=0)
        beats &= np.take(before, upto[1], axis=0)
        beats &= np.take(before, upto[2], axis=0)
        beats = beats.reshape(d, m, used)
        beats &= ~self.one[:m, :used]
        if len(tied):
            # only these can have equals in all objectives
            some = np.flatnonzero(ties.reshape(3, -1).all(axis=0))
            if len(some):
                under = np.empty(3 * d * m, np.int64)
                under[flat] = below
                lt = np.take(before, under.reshape(3, -1)[:, some], axis=0)
                beats.reshape(-1, used)[some] &= lt[0] | lt[1] | lt[2]
        words = np.ascontiguousarray(beats.transpose(2, 0, 1))
        rank = np.where(valid, 1000, 1001)
        alive, level, left = valid.copy(), 0, np.maximum(valid.sum(axis=1) - self.pop, 0)
        mask = np.zeros((d, 32), np.uint8)
        while True:
            packed = np.packbits(alive, axis=1, bitorder="little")
            mask[:, : packed.shape[1]] = packed
            held = mask.view("<u8")
            beaten = words[0] & held[:, :1]
            for w in range(1, used):
                beaten |= words[w] & held[:, w : w + 1]
            front = alive & (beaten == 0)
            rank[front] = level
            alive &= ~front
            level += 1
            if (alive.sum(axis=1) <= left).all():
                break
        # crowding: neighbours by value inside each rank, ties by place
        raw.sort(axis=-1)
        at = raw & 255
        key = (np.take(rank, at + self.each * m) << 16 | spot << 8 | at).astype(np.int32)
        key.sort(axis=-1)
        flat = ((key & 255) + row * m).ravel()
        key >>= 16
        first = np.ones(key.shape, bool)
        np.not_equal(key[..., 1:], key[..., :-1], out=first[..., 1:])
        begin = np.flatnonzero(first)
        long = np.diff(np.append(begin, first.size))
        value = np.take(grid, flat) / GRID
        end = begin + long - 1
        span = np.repeat(value[end] - value[begin], long)
        gap = np.zeros(len(value))
        np.divide(value[2:] - value[:-2], span[1:-1], out=gap[1:-1], where=span[1:-1] > 0)
        gap[begin] = gap[end] = np.inf
        each = np.empty(3 * d * m)
        each[flat] = gap
        each = each.reshape(3, d, m)
        return rank, each[0] + each[1] + each[2]

    def run(self) -> list[list[int]]:
        n, pop, each = self.n, self.pop, self.each
        x = np.full((len(self.rngs), pop), 1 << n, np.int64)
        powers = 1 << self.bits.astype(np.int64)
        for k, rng in enumerate(self.rngs):
            held = np.unique((rng.random((pop, n)) < 0.5) @ powers)
            x[k, : len(held)] = held
        valid = x < 1 << n
        f, over = self.values(x & ((1 << n) - 1))
        rank, crowd = self.ranked(f, over, valid)
        u = np.empty((len(x), pop * (7 + n)))
        place = np.arange(2 * pop, dtype=np.int64)
        flipped = np.zeros((len(x), pop, 8), np.uint8)
        for _ in range(self.n_gen):
            for k, rng in enumerate(self.rngs):
                rng.random(out=u[k])
            a, b, cuts, cross, flips = _draws(u, pop, valid.sum(axis=1))
            a, b = a + each * pop, b + each * pop
            ra, rb = np.take(rank, a), np.take(rank, b)
            first = (ra < rb) | (ra == rb) & (np.take(crowd, a) >= np.take(crowd, b))
            parents = np.take(x, np.where(first, a, b))
            left, right = parents[:, :pop], parents[:, pop:]
            middle = np.where(cross < 0.9, (1 << np.maximum(cuts[:, 0], cuts[:, 1])) - (1 << np.minimum(cuts[:, 0], cuts[:, 1])), 0)
            flipped[..., : -(-n // 8)] = np.packbits(flips < 1 / n, axis=2, bitorder="little")
            child = (left ^ (left ^ right) & middle) ^ flipped.view(np.int64)[..., 0]
            merged = np.concatenate([x, child], axis=1)
            # the first of equal vectors stays
            key = np.sort(merged << 8 | place, axis=1)
            same = np.zeros(key.shape, bool)
            same[:, 1:] = key[:, 1:] >> 8 == key[:, :-1] >> 8
            fresh = np.empty_like(same)
            fresh.ravel()[((key & 255) + each * 2 * pop).ravel()] = ~same.ravel()
            fresh &= merged < 1 << n
            new_f, new_over = self.values(child)
            f, over = np.concatenate([f, new_f], axis=2), np.concatenate([over, new_over], axis=1)
            rank, crowd = self.ranked(f, over, fresh)
            far = np.argsort(-crowd, axis=1, kind="stable")
            keep = np.take(far, each * 2 * pop + (np.sort(np.take(rank, far + each * 2 * pop) << 8 | place, axis=1)[:, :pop] & 255))
            keep += each * 2 * pop
            x, valid, rank, crowd, over = (np.take(v, keep) for v in (merged, fresh, rank, crowd, over))
            f = np.take(f.reshape(3, -1), keep, axis=1)
            x[~valid] = 1 << n
        front = (rank == 0) & (over <= 0) & valid
        wi, wc, wr = self.weights.T[..., None]
        f = f / GRID
        value = np.round((-wi * f[0] - wc * f[1] - wr * f[2]) * GRID)
        value[~front] = -np.inf
        best = x[each[:, 0], value.argmax(axis=1)]
        return [np.flatnonzero(b >> self.bits & 1).tolist() if some else [] for b, some in zip(best, front.any(axis=1))]


def ranked_fill(scores, budget: Budget) -> list[int]:
    """Best first: the first N sentences, or every one that still fits into the tokens."""
    order = np.argsort(-_grid(scores), kind="stable")
    if budget.by_sentences:
        return sorted(order[: min(len(order), budget.limit)].tolist())
    used, chosen = 0, []
    for i in order.tolist():
        if used + budget.cost[i] <= budget.limit:
            used += int(budget.cost[i])
            chosen.append(i)
    return sorted(chosen)


def word_fill(scores, cost, max_words: int) -> list[int]:
    """Best first, skipping what does not fit; ties go to the later sentence."""
    order = sorted(range(len(scores)), key=lambda i: (-round(float(scores[i]) * GRID), -i))
    used, chosen = 0, []
    for i in order:
        if used + cost[i] <= max_words:
            used += cost[i]
            chosen.append(i)
    return sorted(chosen)


def near_dropped(places: list[int], similarity: np.ndarray, threshold: float) -> list[int]:
    """Keep, in order, places whose similarity to all kept ones is below the threshold."""
    kept: list[int] = []  # rows of the matrix
    for k in range(len(places)):
        if not kept or (similarity[k, kept] < threshold).all():
            kept.append(k)
    return [places[k] for k in kept]


# ---- overlap with a reference text ----


def greedy_oracle(tokens: list[list[str]], reference: list[str], cost, max_tokens: int) -> list[int]:
    """Add the sentence that raises ROUGE-1 F most (by more than 1e-12) among those that fit."""
    want = Counter(reference)
    have: Counter = Counter()
    size, used, value, chosen = 0, 0, 0.0, []
    counts = [Counter(t) for t in tokens]
    while True:
        best, at = 1e-12, -1
        for i, c in enumerate(counts):
            if i in chosen or used + cost[i] > max_tokens:
                continue
            hit = sum(min(have[t] + k, want[t]) - min(have[t], want[t]) for t, k in c.items() if t in want)
            hit += sum(min(have[t], want[t]) for t in want)
            length = size + len(tokens[i])
            p, r = hit / max(1, length), hit / max(1, len(reference))
            f = 2 * p * r / (p + r) if p + r else 0.0
            if f - value > best:
                best, at, gained = f - value, i, f
        if at < 0:
            return sorted(chosen)
        chosen.append(at)
        have += counts[at]
        size += len(tokens[at])
        used += cost[at]
        value = gained
