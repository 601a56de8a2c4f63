"""The per-document plan: features, candidate pool, restriction, selection, assembly."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import selectors as S
from .arrow import evenly, per_document
from .rouge import words

Embed = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=1 << 16)
def _slot(token: str) -> tuple[int, int]:
    h = hashlib.md5(token.encode()).hexdigest()
    return int(h[:2], 16) % 64, 1 if int(h[2], 16) >= 8 else -1


def stand_in_embedding(sentences: list[str]) -> np.ndarray:
    """A deterministic hashed bag of words in 64 dimensions.  It stands in for an encoder; no model is shipped."""
    out = np.zeros((len(sentences), 64))
    for i, s in enumerate(sentences):
        for t in K.vectorizer_tokens(s):
            k, sign = _slot(t)
            out[i, k] += sign
    return out


class Encoder:
    """Sentence vectors by a model that is loaded once a worker and fed in batches.

    ``load`` returns a function from a list of texts to an array; it runs at the first use in each
    Python worker, since the loaded model is no part of what is shipped.
    """

    _loaded: dict = {}

    def __init__(self, name: str, load: Callable[[], Embed], batch: int = 16):
        self.name, self.load, self.batch = name, load, batch

    def __call__(self, sentences: list[str]) -> np.ndarray:
        if self.name not in Encoder._loaded:
            Encoder._loaded[self.name] = self.load()
        embed = Encoder._loaded[self.name]
        parts = [np.asarray(embed(sentences[k : k + self.batch])) for k in range(0, len(sentences), self.batch)]
        return np.concatenate(parts) if parts else np.zeros((0, 1))


def costs(sentences: list[str]) -> np.ndarray:
    return np.array([len(s.split()) for s in sentences], np.int64)


def features(sentences: list[str], cfg, terms: K.TermVectors | None = None) -> dict[str, np.ndarray]:
    """The six feature vectors; those without weight stay zero and are not computed."""
    n, w = len(sentences), cfg.weights
    place = np.arange(n)
    if cfg.position_version == "v2" and n > 1:
        raw = {"inverse": 1 / (1 + place), "exponential": np.exp(-cfg.position_decay * place)}.get(cfg.position_method, 1 - place / max(1, n - 1))
        position = K.over_max(raw.astype(float))
    else:
        position = np.ones(n) if n <= 1 else 1 - place / (n - 1)
    zero = np.zeros(n)
    on = {k: abs(w.get(k, 0)) > 1e-9 for k in ("graph", "centrality", "novelty")}
    if terms is None and any(on.values()):
        terms = K.TermVectors(sentences)
    central = zero
    if on["centrality"]:
        central = K.centrality(terms) if cfg.similarity else K.minmax(np.round(terms.to_centroid(), 12))
    return {
        "importance": K.tf_isf_v2(sentences, cfg.stop_words, cfg.sublinear, cfg.bigrams) if cfg.importance_version == "v2" else K.tf_isf(sentences),
        "length": K.over_max(np.minimum(costs(sentences), 40).astype(float)),
        "position": position,
        "graph": K.textrank(terms) if on["graph"] else zero,
        "centrality": central,
        "novelty": K.novelty(terms) if on["novelty"] else zero,
    }


def base_scores(sentences: list[str], cfg, terms: K.TermVectors | None = None) -> np.ndarray:
    """Features combined by the configured weights."""
    if not sentences:
        return np.zeros(0)
    found, w = features(sentences, cfg, terms), cfg.weights
    if cfg.fusion_version == "v2":
        plain = cfg.normalize == "minmax"
        ready = {k: (K.minmax(v) if plain else v) if w.get(k) else np.zeros(len(v)) for k, v in found.items()}
        total = sum(w.get(k, 0) * v for k, v in ready.items())
        for a, b, x in cfg.interactions:
            if a in ready and b in ready:
                total = total + x * ready[a] * ready[b]
        return K.minmax(total)
    return K.over_max(sum(w.get(k, 0) * v for k, v in found.items()))


class Pool:
    """Candidate sources of a document; rankings are made once and cut at any size."""

    def __init__(self, sentences, scores, cfg, terms: K.TermVectors | None = None):
        if terms is None and {"centrality", "graph", "textrank"} & set(cfg.sources):
            terms = K.TermVectors(sentences)
        self.n = len(sentences)
        self.scores = K.ranks(scores)
        self.orders = []
        for name in cfg.sources:
            if name == "score":
                self.orders.append(self.scores)
            elif name == "position":
                self.orders.append(np.arange(self.n))
            elif name == "centrality":
                self.orders.append(K.ranks(np.round(terms.to_centroid(), 10)))
            elif name in ("graph", "textrank"):
                self.orders.append(K.ranks(np.round(K.textrank(terms, cfg.graph_threshold if cfg.similarity else 0.0), 10)))

    def at(self, k: int) -> list[int]:
        """Union of the first ``k`` of every source, ascending."""
        k = min(max(1, k), self.n)
        found = {int(i) for order in self.orders for i in order[:k]}
        return sorted(found or {int(i) for i in self.scores[:k]})


def document_seed(seed: int | None, key) -> int:
    """A seed that depends on the configured one and the document only."""
    return zlib.crc32(f"{seed}|{key}".encode())


def _fused(sentences, scores, cfg):
    terms = K.TermVectors(sentences, pairs=True, sublinear=True)
    return cfg.w_base * K.minmax_zero(np.asarray(scores, float)) + cfg.w_semantic * K.minmax_zero(terms.to_centroid()), terms.similarity()


def _selecting(sentences, scores, similarity, cfg, key, embed: Embed = stand_in_embedding):
    """Steps of the configured selector; the second value says why another one had to step in.

    The multi-objective and the fused selector fall back to greedy if they can't run (without
    similarity, or on a numerical failure); randomised fused ones and encoders raise.
    """
    budget = S.Budget(costs(sentences), cfg.unit, cfg.max_tokens, cfg.max_sentences)
    weights = (cfg.lambda_importance, cfg.lambda_coverage, cfg.lambda_redundancy)
    seed = document_seed(cfg.seed, key)
    search = {"pop_size": cfg.pop_size, "n_gen": cfg.n_gen, "seed": seed}
    if cfg.method in ("bert", "roberta", "xlnet"):
        return S.ranked_fill(K.embedding_centroid(embed(sentences)), budget), None
    if cfg.method == "fast_grasp":
        fused, sim = _fused(sentences, scores, cfg)
        return S.grasp(fused, sim, budget, cfg.alpha, cfg.grasp_iters or 15, cfg.rcl_ratio, seed), None
    if cfg.method == "fast_nsga2":
        fused, sim = _fused(sentences, scores, cfg)
        return (yield S.Search(fused, sim, budget, weights, **search)), None
    if cfg.method == "fast":
        try:
            fused, sim = _fused(sentences, scores, cfg)
            return S.greedy(fused, sim, budget, cfg.alpha), None
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            return S.greedy(scores, None, budget, cfg.alpha), f"fast failed: {e}"
    if cfg.method == "grasp":
        return S.grasp(scores, similarity, budget, cfg.alpha, cfg.grasp_iters or 10, cfg.rcl_ratio, seed), None
    if cfg.method == "nsga2":
        if similarity is None:
            return S.greedy(scores, None, budget, cfg.alpha), "nsga2 without similarity"
        try:
            return (yield S.Search(scores, similarity, budget, weights, cfg.coverage_method, **search)), None
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as e:
            return S.greedy(scores, similarity, budget, cfg.alpha), f"nsga2 failed: {e}"
    return S.greedy(scores, similarity, budget, cfg.alpha), None


def dealt(df: DataFrame, configs: list) -> DataFrame:
    """The documents, spread evenly if one of the configurations searches."""
    return evenly(df) if any(cfg.method in ("nsga2", "fast_nsga2") for cfg in configs) else df


class Prepared:
    """What several configurations share of one document: terms, base scores by weights, pools."""

    def __init__(self, sentences: list[str] | None):
        self.sentences = [s or "" for s in sentences or ()]
        self._terms: K.TermVectors | None = None
        self._scores: dict = {}

    @property
    def terms(self) -> K.TermVectors:
        if self._terms is None:
            self._terms = K.TermVectors(self.sentences)
        return self._terms

    def scores(self, cfg) -> np.ndarray:
        mark = repr((cfg.similarity, cfg.importance_version, cfg.stop_words, cfg.sublinear, cfg.bigrams, cfg.position_version, cfg.position_method, cfg.position_decay, sorted(cfg.weights.items()), cfg.fusion_version, cfg.normalize, cfg.interactions))
        if mark not in self._scores:
            needs = any(abs(cfg.weights.get(k, 0)) > 1e-9 for k in ("graph", "centrality", "novelty"))
            self._scores[mark] = base_scores(self.sentences, cfg, self.terms if needs else None)
        return self._scores[mark]


def alone(steps):
    """The result of steps that ask for searches, one search after the other."""
    try:
        asked = next(steps)
        while True:
            try:
                found = S.nsga2(*asked)
            except Exception as e:  # noqa: BLE001 - the steps know which ones they can live with
                asked = steps.throw(e)
            else:
                asked = steps.send(found)
    except StopIteration as end:
        return end.value


def together(many: list) -> list:
    """The results of many documents' steps; the searches they wait for run side by side."""
    out, waiting = [None] * len(many), [(k, None) for k in range(len(many))]
    while waiting:
        asked = []
        for k, found in waiting:
            try:
                asked.append((k, many[k].throw(found) if isinstance(found, Exception) else many[k].send(found)))
            except StopIteration as end:
                out[k] = end.value
        waiting = [(k, found) for (k, _), found in zip(asked, S.nsga2_many([search for _, search in asked]))]
    return out


def summarize_one(key, sentences: list[str] | Prepared, reference: str | None, cfg, embed: Embed = stand_in_embedding) -> dict:
    """Summary of one document: :func:`summarizing` by itself."""
    return alone(summarizing(key, sentences, reference, cfg, embed))


def summarizing(key, sentences: list[str] | Prepared, reference: str | None, cfg, embed: Embed = stand_in_embedding):
    """Steps to the summary of one document; no sentences give no places and an empty summary.

    The similarity matrix is made over the candidates only; what scores and pools need of the whole
    document comes from row sums and products with its term vectors.
    """
    ready = sentences if isinstance(sentences, Prepared) else Prepared(sentences)
    sentences = ready.sentences
    out = {"selected_indices": [], "summary": "", "fallback_reason": None}
    n = len(sentences)
    if not n:
        return out
    scores = ready.scores(cfg)
    pool = Pool(sentences, scores, cfg, ready.terms if {"centrality", "graph", "textrank"} & set(cfg.sources) else None)
    k = cfg.k if cfg.k is not None else min(15, n)
    chosen = pool.at(k)
    if cfg.recall_target is not None:
        oracle = set(S.greedy_oracle([words(s, cfg.stemmed) for s in sentences], words(reference, cfg.stemmed), costs(sentences), cfg.max_tokens or 10**9))
        k = len(chosen)
        while oracle and len(oracle & set(chosen)) / len(oracle) < cfg.recall_target - 1e-12 and k < n:
            k = min(n, max(k + 1, -(-3 * k // 2)))
            chosen = pool.at(k)
    back = list(range(n))
    sentences_in = sentences
    if cfg.use_candidates and cfg.mode == "hard":
        back = chosen
        sentences_in = [sentences[i] for i in chosen]
        scores = scores[chosen]
    elif cfg.use_candidates:
        scores = scores.copy()
        scores[chosen] *= cfg.soft_boost
    if cfg.unit == "words":
        picked, reason = S.word_fill(scores, costs(sentences_in).tolist(), cfg.max_words), None
    else:
        similarity = None
        if cfg.similarity and cfg.method in ("greedy", "grasp", "nsga2"):
            similarity = ready.terms.similarity(back)
            if {"graph", "textrank"} & set(cfg.sources):
                similarity = K.thresholded(similarity, cfg.graph_threshold)
        picked, reason = yield from _selecting(sentences_in, scores, similarity, cfg, key, embed)
    places = sorted(back[i] for i in picked)
    return {"selected_indices": places, "summary": " ".join(sentences[i] for i in places), "fallback_reason": reason}


def summarize(df: DataFrame, cfg, embed: Embed = stand_in_embedding) -> DataFrame:
    """``id, selected_indices, summary, reference, fallback_reason`` of documents ``id, sentences, highlights``.

    One narrow pass, and no result depends on the partitioning; only documents to be searched are
    shuffled.  Documents without sentences (null lists too) have an empty selection.
    """
    reference = F.col("highlights") if "highlights" in df.columns else F.lit(None).cast("string")

    def make(row):
        found = yield from summarizing(row["id"], row["sentences"], row["reference"], cfg, embed)
        return [(row["id"], found["selected_indices"], found["summary"], row["reference"] or "", found["fallback_reason"])]

    chosen = df.select(F.col("id").cast("string").alias("id"), "sentences", reference.alias("reference"))
    return per_document(dealt(chosen, [cfg]), "id string, selected_indices array<int>, summary string, reference string, fallback_reason string", make, together)
