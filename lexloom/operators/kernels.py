"""Per-document vector kernels: term weights, similarity, graph and centroid scores.

Pure numpy on the sentences of one document, whose vocabulary is its own.  A document without
vocabulary has zero vectors and zero similarity.  Matrices over sentence x vocabulary are built in
column slices, so that very long documents do not need them whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np

from ..functions.text import STOP_WORDS

_STOPS = frozenset(STOP_WORDS)
_NOT_WORD = re.compile(r"[^\w\s]")
_WORDS = re.compile(r"\w\w+")
#: Cells of a dense slice or block that is held at a time.
SLICE_CELLS = 1 << 22


def lower_tokens(s: str) -> list[str]:
    return s.lower().split()


def plain_tokens(s: str, stop_words: bool = True) -> list[str]:
    found = _NOT_WORD.sub(" ", s.lower()).split()
    return [t for t in found if t not in _STOPS and len(t) > 1] if stop_words else found


def with_bigrams(found: list[str], joint: str = "_") -> list[str]:
    return found + [f"{a}{joint}{b}" for a, b in zip(found, found[1:])]


def vectorizer_tokens(s: str) -> list[str]:
    return _WORDS.findall(s.lower())


def minmax(x: np.ndarray, constant: float = 0.5, eps: float = 1e-9) -> np.ndarray:
    if not len(x):
        return x
    low, high = x.min(), x.max()
    return np.full(len(x), constant) if high - low < eps else (x - low) / (high - low)


def minmax_zero(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    low, high = x.min(), x.max()
    return np.zeros(len(x)) if high - low <= 1e-12 else (x - low) / (high - low)


def over_max(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    top = x.max()
    return x / (1.0 if top == 0 else top)


def tf_isf(sentences: list[str]) -> np.ndarray:
    """Sum over a sentence's tokens of count x ln(N / (1 + sentences with it)), over the maximum."""
    counts = [Counter(lower_tokens(s)) for s in sentences]
    spread = Counter(t for c in counts for t in c)
    n = len(sentences)
    isf = {t: math.log(n / (1 + f)) for t, f in spread.items()}
    # on a grid of 1e-12, so that a sum of zero is zero in every order of summation
    return over_max(np.round([sum(k * isf[t] for t, k in c.items()) for c in counts], 12))


def tf_isf_v2(sentences: list[str], stop_words: bool = True, sublinear: bool = True, use_bigrams: bool = False) -> np.ndarray:
    """Length-normalised variant over plain tokens, rescaled to [0, 1]."""
    found = [plain_tokens(s, stop_words) for s in sentences]
    if use_bigrams:
        found = [with_bigrams(f) for f in found]
    counts = [Counter(f) for f in found]
    spread = Counter(t for c in counts for t in c)
    n = len(sentences)
    isf = {t: math.log(n / (1 + f)) for t, f in spread.items()}
    raw = [sum((1 + math.log(k) if sublinear else k) * isf[t] for t, k in c.items()) / math.sqrt(len(f)) if f else 0.0 for c, f in zip(counts, found)]
    return minmax(np.round(raw, 12))


class TermVectors:
    """Unit TF-IDF rows of a document: idf ln((1 + N) / (1 + df)) + 1, vocabulary of the document."""

    def __init__(self, sentences: list[str], pairs: bool = False, sublinear: bool = False):
        found = [vectorizer_tokens(s) for s in sentences]
        if pairs:
            found = [with_bigrams(f, " ") for f in found]
        self.n = len(sentences)
        vocabulary: dict[str, int] = {}
        rows, columns, counts = [], [], []
        for i, f in enumerate(found):
            for t, k in Counter(f).items():
                rows.append(i)
                columns.append(vocabulary.setdefault(t, len(vocabulary)))
                counts.append(k)
        self.terms = list(vocabulary)
        self.rows, self.columns = np.array(rows, np.int64), np.array(columns, np.int64)
        tf = np.array(counts, float)
        if sublinear:
            tf = 1 + np.log(tf)
        df = np.bincount(self.columns, minlength=len(self.terms)) if len(rows) else np.zeros(0)
        weights = tf * (np.log((1 + self.n) / (1 + df)) + 1)[self.columns] if len(rows) else tf
        norm = np.sqrt(np.bincount(self.rows, weights**2, minlength=self.n)) if len(rows) else np.zeros(self.n)
        self.weights = weights / norm[self.rows] if len(rows) else weights

    def similarity(self, rows=None, others=None) -> np.ndarray:
        """Cosines of the given rows (all if none are given) and the other ones."""
        rows = np.arange(self.n) if rows is None else np.asarray(rows, np.int64)
        others = rows if others is None else np.asarray(others, np.int64)
        out = np.zeros((len(rows), len(others)))
        if not len(self.rows) or not out.size:
            return out
        # only the terms of the asked rows, in column slices of a bounded size
        asked = np.full(self.n, -1)
        members = np.unique(np.concatenate([rows, others]))
        asked[members] = np.arange(len(members))
        held = np.flatnonzero(asked[self.rows] >= 0)
        if not len(held):
            return out
        held = held[np.argsort(self.columns[held], kind="stable")]
        r, w = asked[self.rows[held]], self.weights[held]
        c = np.cumsum(np.concatenate([[0], np.diff(self.columns[held]) > 0]))
        width = max(64, SLICE_CELLS // len(members))
        edges = np.searchsorted(c, np.arange(0, int(c[-1]) + 1 + width, width))
        left, right = asked[rows], asked[others]
        same = len(left) == len(members) and np.array_equal(left, right) and np.array_equal(left, np.arange(len(members)))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                x = np.zeros((len(members), int(c[b - 1]) - k * width + 1))
                x[r[a:b], c[a:b] - k * width] = w[a:b]
                out += x @ x.T if same else x[left] @ x[right].T
        return out

    def blocks(self):
        """(first row, its cosines with all rows) of bounded blocks of rows, for matrices too large to hold."""
        step = max(1, SLICE_CELLS // max(1, self.n))
        every = np.arange(self.n)
        for a in range(0, self.n, step):
            yield a, self.similarity(every[a : a + step], every)

    def times(self, v: np.ndarray) -> np.ndarray:
        """The similarity matrix times ``v``, without the matrix."""
        if not len(self.rows):
            return np.zeros(self.n)
        along = np.bincount(self.columns, self.weights * v[self.rows], minlength=len(self.terms))
        return np.bincount(self.rows, self.weights * along[self.columns], minlength=self.n)

    def row_sums(self) -> np.ndarray:
        """Sum of each row of :meth:`similarity` without forming it."""
        return self.times(np.ones(self.n))

    def to_centroid(self) -> np.ndarray:
        """Cosine of each row and the mean row."""
        if not len(self.rows):
            return np.zeros(self.n)
        total = np.bincount(self.columns, self.weights, minlength=len(self.terms)) / self.n
        dot = np.bincount(self.rows, self.weights * total[self.columns], minlength=self.n)
        length = np.sqrt(np.bincount(self.rows, self.weights**2, minlength=self.n))
        scale = length * math.sqrt(float((total**2).sum()))
        return np.divide(dot, scale, out=np.zeros(self.n), where=scale > 0)


Similar = TermVectors | np.ndarray  # term vectors, or a given symmetric matrix


def _row_sums(x: Similar) -> np.ndarray:
    return x.row_sums() if isinstance(x, TermVectors) else np.asarray(x, float).sum(axis=1)


def centrality(x: Similar) -> np.ndarray:
    """Mean similarity of a sentence to all, itself included, rescaled; of term vectors without their matrix."""
    total = _row_sums(x)
    return minmax(np.round(total / len(total), 12)) if len(total) else total


def novelty(x: Similar) -> np.ndarray:
    """One less the mean similarity to the others (self-similarity taken as 1), rescaled."""
    total = _row_sums(x)
    n = len(total)
    return minmax(np.round(1 - (total - 1) / (n - 1), 12)) if n > 1 else np.ones(n)


def thresholded(similarity: np.ndarray, threshold: float) -> np.ndarray:
    """A copy with the entries below the threshold as 0."""
    return np.where(similarity < threshold, 0.0, similarity) if threshold > 0 else similarity


def _iterated(times: Callable[[np.ndarray], np.ndarray], n: int, damping: float, most: int, eps: float) -> np.ndarray:
    total = times(np.ones(n))
    p = np.full(n, 1 / n)
    for _ in range(most):
        new = damping * times(np.divide(p, total, out=np.zeros(n), where=total > 0)) + (1 - damping) / n
        if np.abs(new - p).sum() < eps:
            return new
        p = new
    return p


def textrank(x: Similar, threshold: float = 0.0, damping: float = 0.85, most: int = 100, eps: float = 1e-6) -> np.ndarray:
    """Power iteration over the row-normalised similarity, self loops kept; empty rows lose their mass.

    Of term vectors a step without a threshold is two passes over the terms; with one, only the
    entries that reach it are held.
    """
    if not isinstance(x, TermVectors):
        m = thresholded(np.asarray(x, float), threshold)
        return _iterated(lambda v: m.T @ v, len(m), damping, most, eps) if len(m) > 1 else np.ones(len(m))
    n = x.n
    if n <= 1:
        return np.ones(n)
    if threshold <= 0:
        return _iterated(x.times, n, damping, most, eps)
    rows, columns, values = [], [], []
    for first, block in x.blocks():
        r, c = np.nonzero(block >= threshold)
        rows.append(r + first)
        columns.append(c)
        values.append(block[r, c])
    rows, columns, values = (np.concatenate(part) for part in (rows, columns, values))
    return _iterated(lambda v: np.bincount(columns, values * v[rows], minlength=n), n, damping, most, eps)


def embedding_centroid(x: np.ndarray) -> np.ndarray:
    """Cosine of each embedding and their mean; norms are padded by 1e-12."""
    mean = x.mean(axis=0)
    return (x @ mean) / ((np.linalg.norm(x, axis=1) + 1e-12) * (np.linalg.norm(mean) + 1e-12))


def ranks(values: np.ndarray) -> np.ndarray:
    """Places by falling value, ties by place."""
    return np.argsort(-np.asarray(values, float), kind="stable")
