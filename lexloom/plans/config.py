"""Configuration of a summarisation run: every key of the query language, with its default."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass, field, replace
from typing import Any

METHODS = ("greedy", "grasp", "nsga2", "bert", "roberta", "xlnet", "fast", "fast_grasp", "fast_nsga2")
ALIASES = {"fast_fused": "fast", "tfidf_fused": "fast"}
ENCODERS = ("bert", "roberta", "xlnet")


@dataclass(frozen=True)
class Config:
    """Flat form of the nested configuration; ``Config.of`` reads the nested form."""

    similarity: bool = True
    importance_version: str = "v1"
    stop_words: bool = True
    sublinear: bool = True
    bigrams: bool = False
    position_version: str = "v1"
    position_method: str = "inverse"
    position_decay: float = 0.1
    weights: dict = field(default_factory=lambda: {"importance": 1.0, "length": 0.3, "position": 0.3, "graph": 0.0, "centrality": 0.0, "novelty": 0.0})
    fusion_version: str = "v1"
    interactions: tuple = ()
    normalize: str = "minmax"
    unit: str = "tokens"
    max_tokens: int | None = 100
    max_sentences: int | None = None
    max_words: int = 400
    alpha: float = 0.7
    use_candidates: bool = True
    k: int | None = None  # min(15, n)
    mode: str = "hard"
    sources: tuple = ("score",)
    soft_boost: float = 1.05
    recall_target: float | None = None
    stemmed: bool = True
    graph_threshold: float = 0.0
    method: str = "greedy"
    grasp_iters: int | None = None  # 10, and 15 for fast_grasp
    rcl_ratio: float = 0.3
    lambda_importance: float = 1.0
    lambda_coverage: float = 0.8
    lambda_redundancy: float = 0.7
    coverage_method: str = "max"
    pop_size: int = 100
    n_gen: int = 100
    w_base: float = 0.5
    w_semantic: float = 0.5
    seed: int | None = None
    stage: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "method", ALIASES.get(self.method, self.method))
        if self.method not in METHODS:
            raise ValueError(f"unknown selector {self.method!r}")
        if self.stage == "stage2" and self.method in ENCODERS:
            raise ValueError("an encoder can't be the selector of the second stage")

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    @staticmethod
    def of(tree: dict[str, Any] | None) -> Config:
        """From the nested form; keys without a reader are reported and ignored."""
        tree = dict(tree or {})
        vectors = str((tree.get("representations") or {}).get("method", "tfidf")).lower()
        if vectors != "tfidf":
            raise ValueError(f"unknown sentence vectors {vectors!r}: tfidf is the only kind")
        out: dict[str, Any] = {}
        for path, name in _PATHS.items():
            node: Any = tree
            for part in path.split("."):
                node = node.get(part) if isinstance(node, dict) else None
            if node is not None:
                out[name] = tuple(node) if name == "sources" else tuple(map(tuple, node)) if name == "interactions" else node
        weights = dict(Config().weights)
        weights["importance"] = out.get("lambda_importance", 1.0)
        weights.update((tree.get("features") or {}).get("weights") or {})
        out["weights"] = {k: float(v) for k, v in weights.items()}
        if "method" in out:
            out["method"] = str(out["method"]).lower()
        for path in _leaves(tree):
            if path not in _PATHS and not path.startswith("features.weights.") and path not in _SILENT:
                warnings.warn(f"configuration key {path} has no effect", stacklevel=2)
        return Config(**out)

    def tree(self) -> dict:
        return dataclasses.asdict(self)


# The keys of the nested form.
_PATHS = {
    "representations.use": "similarity", "features.tf_isf.version": "importance_version", "features.tf_isf.use_stopwords": "stop_words",
    "features.tf_isf.use_sublinear_tf": "sublinear", "features.tf_isf.use_bigrams": "bigrams", "features.position.version": "position_version",
    "features.position.method": "position_method", "features.position.decay": "position_decay", "features.fusion.version": "fusion_version",
    "features.fusion.interactions": "interactions", "features.fusion.normalize": "normalize", "length_control.unit": "unit", "length_control.max_tokens": "max_tokens",
    "length_control.max_sentences": "max_sentences", "length_control.max_words": "max_words", "redundancy.lambda": "alpha",
    "candidates.use": "use_candidates", "candidates.k": "k", "candidates.mode": "mode", "candidates.sources": "sources",
    "candidates.soft_boost": "soft_boost", "candidates.recall_target": "recall_target", "graph_params.threshold": "graph_threshold",
    "optimizer.method": "method", "optimizer.pop_size": "pop_size", "optimizer.n_gen": "n_gen", "grasp.iters": "grasp_iters",
    "grasp.rcl_ratio": "rcl_ratio", "objectives.lambda_importance": "lambda_importance", "objectives.lambda_coverage": "lambda_coverage",
    "objectives.lambda_redundancy": "lambda_redundancy", "objectives.coverage_method": "coverage_method", "fusion.w_base": "w_base",
    "fusion.w_bert": "w_semantic", "seed": "seed", "stage": "stage",
}
_SILENT = {"representations.method", "bert.model_name"}


def _leaves(node: Any, path: str = ""):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, f"{path}.{k}" if path else str(k))
    else:
        yield path


def load(path: str) -> Config:
    """Read the nested form from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config.of(yaml.safe_load(f))


_WEIGHTS = {"importance": 0.0, "length": 0.0, "position": 0.0, "graph": 0.0, "centrality": 0.0, "novelty": 0.0}
PRESETS = {
    "base": Config(weights={**_WEIGHTS, "importance": 0.8, "length": 0.2, "position": 0.2}, k=40, max_tokens=300, method="nsga2", pop_size=40, n_gen=50, seed=2024),
    "encoder": Config(method="bert", k=40, max_tokens=300, seed=2024),
    "graph": Config(weights={**_WEIGHTS, "graph": 1.0}, graph_threshold=0.2, k=40, sources=("graph",), max_tokens=300, seed=2024),
    "fusion": Config(method="fast_nsga2", max_tokens=245, max_sentences=30, lambda_coverage=2.5, lambda_redundancy=1.2, seed=2024, stage="stage2"),
    "3sent": Config(method="fast", unit="sentences", max_sentences=3, seed=2024),
    "400words": Config(unit="words", max_words=400),
}
#: Presets of the request form: (unit, limit, candidates, union cap).
REQUEST_PRESETS = {"news-3sent": ("sentences", 3, 25, 15), "duc-400": ("tokens", 400, 50, 40)}


def stage1(method: str, k: int) -> Config:
    """First stage of a request: k sentences out of a pool of k."""
    return Config(method=method, unit="sentences", max_sentences=k, k=k, seed=2024)


def stage2(method: str, unit: str, limit: int) -> Config:
    """Second stage of a request: no pool, the request's limit."""
    limits = {"max_sentences": limit} if unit == "sentences" else {"max_tokens": limit}
    return Config(method=method, unit=unit, use_candidates=False, seed=2024, **limits)
