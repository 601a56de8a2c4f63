"""Count vectors of token sets, an R-tree over them, and the cells that make it distributable.

A token set (hashes of all runs of 10 characters) is described by

* its size and an order-free fingerprint,
* the number of its tokens in each of ``GROUPS`` hash groups, packed to four bits with the excess
  kept apart: the summed coordinate minima of two vectors, plus the smaller excess, bound the
  overlap of the two sets from above, and
* ``CELLS`` keys, each made of the first tokens of four ranges of groups.

Vectors of one high-dimensional corpus can't be split over executors by their bounding boxes: with
hundreds of dimensions nearly every point would have to be copied to every box.  So the forest of
R-trees is split by the keys: sets meet in a cell when they begin alike in four ranges of groups.
Two sets of similarity s share a cell with probability 1 - (1 - s^4)^34: 0.991 at 0.6, 0.9998 at
0.69.  A range without tokens takes the first token of another range, told by a hash, so that the
cells of small sets do not repeat each other; sets of less than ``SHORT`` tokens, for which that is
not enough, bring their tokens along and are joined exactly (:mod:`prefixes`).
"""

from __future__ import annotations

import numpy as np

from .forms import bare, bare_batch, blocks, classes, mixed, run_hashes, visible_count
from .lookalike import LEAST_VISIBLE

WIDTH = 10  # characters of a run
GROUPS, PACK = 256, 15
CELLS, RANGES = 34, 4
#: Pairs with a set of fewer tokens are found exactly.
SHORT = 150
_SALT = mixed(np.arange(1, CELLS + 1, dtype=np.uint64))


def tokens(text: str | None, least: int = LEAST_VISIBLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``text``; none for null and short values."""
    if text is None or len(text) < WIDTH:
        return np.empty(0, np.uint64)
    c = bare(text)
    if len(c) < least or visible_count(c) < least:
        return np.empty(0, np.uint64)
    return distinct(run_hashes(c, WIDTH))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting beats hashing at the size of a text)."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


class TokenSets:
    """Sizes, fingerprints and tokens of the token sets of many texts at once."""

    def __init__(self, texts: list[str | None], least: int = LEAST_VISIBLE):
        found = [self._of(texts[a:b], a, least) for a, b in blocks(texts)]
        which, n, tokens, fp_a, fp_b = zip(*found) if found else [()] * 5
        #: numbers of the texts that have tokens
        self.which = np.concatenate([np.empty(0, np.int64), *which])
        self.n = np.concatenate([np.empty(0, np.int64), *n])
        self.start = np.cumsum(self.n) - self.n
        self.tokens = np.concatenate([np.empty(0, np.uint64), *tokens])
        self.fp_a, self.fp_b = (np.concatenate([np.empty(0, np.int64), *fp]) for fp in (fp_a, fp_b))

    @staticmethod
    def _of(texts: list[str | None], first: int, least: int):
        """Numbers (from ``first`` on) of the texts with tokens, their sizes, tokens and fingerprints."""
        c, sizes = bare_batch(texts)
        table = classes()
        owner = np.repeat(np.arange(len(texts)), sizes)
        seen = np.bincount(owner[table[np.minimum(c, len(table) - 1)] != 3], minlength=len(texts))
        runs = np.where(seen >= least, np.maximum(sizes - WIDTH + 1, 0), 0)
        hashes = run_hashes(c, WIDTH)
        begin = np.cumsum(sizes) - sizes
        which = np.flatnonzero(runs)
        sets = [distinct(hashes[a : a + n]) for a, n in zip(begin[which].tolist(), runs[which].tolist())]
        n = np.array([len(t) for t in sets], np.int64)
        if not sets:
            return which, n, *[np.empty(0, kind) for kind in (np.uint64, np.int64, np.int64)]
        t, start = np.concatenate(sets), np.cumsum(n) - n
        with np.errstate(over="ignore"):
            fp_a = np.add.reduceat(t, start).astype(np.int64)
            fp_b = np.add.reduceat(mixed(t + np.uint64(0x5851F42D4C957F2D)), start).astype(np.int64)
        return which + first, n, t, fp_a, fp_b


class Sketches(TokenSets):
    """Token sets with their cell keys and packed counts."""

    def __init__(self, texts: list[str | None], least: int = LEAST_VISIBLE):
        super().__init__(texts, least)
        m, t = len(self.n), self.tokens
        own = np.repeat(np.arange(m), self.n)
        with np.errstate(over="ignore"):
            self.keys = self._keys(own)
        counts = np.bincount(own * GROUPS + (t & np.uint64(GROUPS - 1)).astype(np.int64), minlength=m * GROUPS).reshape(m, GROUPS)
        low = np.minimum(counts, PACK).astype(np.uint8)
        self.excess = (counts - low).sum(axis=1)
        self.packed = low[:, 0::2] << 4 | low[:, 1::2]

    def _keys(self, own: np.ndarray) -> np.ndarray:
        """Keys of the cells each set lies in, from the first token of each range."""
        m, places = len(self.n), CELLS * RANGES
        first = np.full((m, places), -1, np.int64)
        back = np.arange(len(self.tokens))[::-1]
        first[own[back], ((self.tokens[back] >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)] = back
        row, place = np.nonzero(first < 0)
        known, step = first.copy(), 0
        while len(row):
            # another range by a hash of the place and the try
            step += 1
            other = (mixed(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) % np.uint64(places)).astype(np.int64)
            found = known[row, other]
            first[row, place] = found
            row, place = row[found < 0], place[found < 0]
        key = np.tile(_SALT, (m, 1))
        if m:
            for k in range(RANGES):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + self.tokens[first[:, k * CELLS : (k + 1) * CELLS]])
        return key.astype(np.int64)


class GivenSets:
    """Token sets that are known already, from their bytes."""

    def __init__(self, tokens: list[bytes], fp_a: np.ndarray, fp_b: np.ndarray):
        self.which = np.arange(len(tokens))
        self.n = np.array([len(t) // 8 for t in tokens], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.tokens = np.frombuffer(b"".join(tokens), np.uint64)
        self.fp_a, self.fp_b = fp_a, fp_b


def unpacked(vectors: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), GROUPS // 2)
    out = np.empty((len(vectors), GROUPS), np.uint8)
    out[:, 0::2], out[:, 1::2] = raw >> 4, raw & 15
    return out


class CountRTree:
    """Bulk-loaded R-tree over count vectors; nodes keep coordinate maxima and the smallest size.

    The overlap of a query with any point of a node is at most the sum of the minima of the
    query's and the node's coordinates (plus the smaller excess), so a node is skipped when that
    falls short of what similarity ``threshold`` needs at the node's smallest size.
    """

    FAN = 8

    def __init__(self, counts: np.ndarray, excess: np.ndarray, sizes: np.ndarray, threshold: float):
        self.share = threshold / (1 + threshold)
        # neighbours by size and by the coarse shape of the vector share a leaf
        coarse = counts.reshape(len(counts), 8, -1).sum(axis=2, dtype=np.int64)
        self.order = np.lexsort((coarse.argmax(axis=1), sizes // max(1, int(sizes.mean() // 4) or 1)))
        level = (counts[self.order], excess[self.order], sizes[self.order])
        self.levels = [level]
        while len(level[0]) > self.FAN:
            starts = np.arange(0, len(level[0]), self.FAN)
            level = (np.maximum.reduceat(level[0], starts, axis=0), np.maximum.reduceat(level[1], starts), np.minimum.reduceat(level[2], starts))
            self.levels.append(level)

    def search(self, counts: np.ndarray, excess: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) numbers of all pairs whose bound admits the threshold."""
        top = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(counts)), top)
        v = np.tile(np.arange(top), len(counts))
        for k in range(len(self.levels) - 1, -1, -1):
            c, e, s = self.levels[k]
            fits = np.zeros(len(q), bool)
            for at in range(0, len(q), 8192):
                qs, vs = q[at : at + 8192], v[at : at + 8192]
                bound = np.minimum(counts[qs], c[vs]).sum(axis=1, dtype=np.int64) + np.minimum(excess[qs], e[vs])
                fits[at : at + 8192] = bound >= self.share * (sizes[qs] + s[vs]) - 1e-9
            q, v = q[fits], v[fits]
            if k:
                below = len(self.levels[k - 1][0])
                q = np.repeat(q, self.FAN)
                v = (v[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                q, v = q[v < below], v[v < below]
        return q, self.order[v]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Tokens in both sets divided by tokens in either."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
