"""Kernels, selectors, ROUGE and configuration, on literal cases and by brute force."""

import itertools
import random
import warnings

import numpy as np
import pytest

from lexloom.operators import kernels as K
from lexloom.operators import evaluation, rouge
from lexloom.operators import selectors as S
from lexloom.operators.summarize import Encoder, base_scores, summarize_one, summarizing, together
from lexloom.plans.config import PRESETS, Config
from lexloom.plans.service import python_split

DOC = [
    "Artificial intelligence changes how companies work today.",
    "Machine learning models learn patterns from large data.",
    "Deep learning is a branch of machine learning.",
    "Companies use data to train large models.",
    "The future of work depends on intelligence and data.",
]


def problem(seed, n=8):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(rng.random(n), 3), x @ x.T, rng.integers(1, 7, n)


def test_tf_isf_conventions():
    assert K.tf_isf([]).tolist() == []
    assert K.tf_isf(["one two three"]).max() == 1.0  # a negative maximum divides to 1
    both = K.tf_isf(["a b c d", "a b c d d"])
    assert both[1] > both[0] == 1.0  # order is inverted
    v2 = K.tf_isf_v2(DOC)
    assert len(v2) == 5 and v2.min() == 0 and v2.max() == 1
    assert K.tf_isf_v2(["the of and", "is it"]).tolist() == [0.5, 0.5]


def test_rescaling_conventions():
    flat = np.array([2.0, 2.0])
    assert K.minmax(flat).tolist() == [0.5, 0.5] and K.minmax_zero(flat).tolist() == [0, 0]
    assert K.minmax(np.array([10.0, 20, 30])).tolist() == [0, 0.5, 1]


def test_similarity_by_hand():
    sim = K.TermVectors(["red fox", "red fox", "blue cat", "a b"]).similarity()
    assert np.allclose(sim[0, 1], 1) and sim[0, 2] == 0 and not sim[3].any()
    assert np.allclose(K.TermVectors(DOC).row_sums(), K.TermVectors(DOC).similarity().sum(axis=1))
    idf = [np.log(5 / (1 + df)) + 1 for df in (2, 1)]
    v = K.TermVectors(["red fox", "red cat", "dog run", "sun sky"])
    assert np.isclose(v.weights[0], idf[0] / np.hypot(*idf))


def test_wide_vocabulary_is_sliced(monkeypatch):
    whole = K.TermVectors(DOC, True, True).similarity()
    linear, held = K.textrank(K.TermVectors(DOC)), K.textrank(K.TermVectors(DOC), 0.05)
    assert np.allclose(linear, K.textrank(K.TermVectors(DOC).similarity())) and np.allclose(held, K.textrank(K.TermVectors(DOC).similarity(), 0.05))
    some = K.TermVectors(DOC, True, True).similarity([3, 1], [0, 2, 3])
    assert np.allclose(some, whole[np.ix_([3, 1], [0, 2, 3])])
    monkeypatch.setattr(K, "SLICE_CELLS", 7)
    assert np.allclose(K.TermVectors(DOC, True, True).similarity(), whole)
    assert np.allclose(np.concatenate([b for _, b in K.TermVectors(DOC, True, True).blocks()]), whole)
    assert np.allclose(K.textrank(K.TermVectors(DOC), 0.05), held)


def test_graph_and_centrality():
    sim = K.TermVectors(DOC).similarity()
    p = K.textrank(sim)
    assert abs(p.sum() - 1) < 0.05 and K.textrank(np.ones((1, 1))).tolist() == [1] and K.textrank(np.zeros((0, 0))).tolist() == []
    lost = K.textrank(K.TermVectors([*DOC, "a b c"]).similarity())
    assert lost.sum() < 0.99  # an empty row loses its mass
    keep = sim.copy()
    K.textrank(sim, 0.3)
    assert (sim == keep).all()
    three = np.array([[1, 0.9, 0.1], [0.9, 1, 0.1], [0.1, 0.1, 1]])
    assert K.novelty(three)[2] > K.novelty(three)[0] and K.centrality(three)[0] > K.centrality(three)[2]


@pytest.mark.parametrize("seed", range(6))
def test_greedy_against_plain_loop(seed):
    scores, sim, cost = problem(seed)
    budget = S.Budget(cost, max_tokens=12)
    chosen, used = [], 0
    while True:
        best, at = -np.inf, -1
        for i in range(len(scores)):
            if i not in chosen and used + cost[i] <= 12:
                value = round((0.7 * scores[i] - 0.3 * max((sim[i, j] for j in chosen), default=0)) * S.GRID)
                if value > best:
                    best, at = value, i
        if at < 0:
            break
        chosen.append(at)
        used += cost[at]
    assert S.greedy(scores, sim, budget) == sorted(chosen)


@pytest.mark.parametrize("seed", range(6))
def test_searches_against_every_subset(seed):
    scores, sim, cost = problem(seed)
    budget = S.Budget(cost, max_tokens=14)
    subsets = [c for n in range(9) for c in itertools.combinations(range(8), n) if sum(cost[list(c)]) <= 14]
    for method in ("max", "diversity"):
        value = lambda c: sum(scores[list(c)]) + 0.8 * S.coverage(sim, c, method) - 0.7 * S.redundancy(sim, c)
        best = max(map(value, subsets))
        exact = S.best_subset(scores, sim, budget, method=method)
        assert np.isclose(value(exact), best)
        search = S.nsga2(scores, sim, budget, method=method, seed=3)
        assert sum(cost[search]) <= 14 and value(search) >= 0.97 * best
    found = S.grasp(scores, sim, budget, seed=1)
    assert found == S.grasp(scores, sim, budget, seed=1) and sum(cost[found]) <= 14
    best = max(S.objective(c, scores, sim, 0.7) for c in subsets)
    assert S.objective(S.greedy(scores, sim, budget), scores, sim, 0.7) <= S.objective(found, scores, sim, 0.7) + 1e-9 <= best + 2e-9


def test_population_values_equal_single_ones():
    scores, sim, cost = problem(1)
    x = np.array([[1, 0, 1, 0, 0, 1, 0, 0], [0] * 8, [0, 1] + [0] * 6], bool)
    f, over = S._Problem(scores, sim, S.Budget(cost, max_tokens=5), "diversity").values(x)
    for row, vector, extra in zip(f, x, over):
        c = np.flatnonzero(vector)
        assert np.allclose(row, [-scores[c].sum(), -S.coverage(sim, c, "diversity"), S.redundancy(sim, c)]) and extra == max(0, cost[c].sum() - 5)


def test_budgets_and_fills():
    scores = [0.5, 0.8, 0.6, 0.7, 0.4]
    assert S.greedy(scores, None, S.Budget([2, 9, 3, 2, 2], max_tokens=5)) == [2, 3]
    assert S.greedy(scores, None, S.Budget([9] * 5, unit="sentences", max_sentences=2)) == [1, 3]
    assert S.greedy(scores, None, S.Budget([1] * 5, unit="sentences", max_sentences=0)) == [0, 1, 2, 3, 4]
    assert S.greedy(scores, None, S.Budget([9] * 5, max_tokens=5)) == [] == S.greedy([], None, S.Budget([]))
    assert S.word_fill([5, 4, 3, 2], [5, 4, 3, 2], 8) == [0, 2]
    assert S.word_fill([1, 1], [3, 3], 3) == [1]
    assert S.near_dropped([0, 2, 4], np.array([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]]), 0.95) == [0, 4]


def test_documents():
    one = summarize_one("d", DOC, "", Config(max_tokens=30, use_candidates=False))
    assert one["summary"] == " ".join(DOC[i] for i in one["selected_indices"])
    for method in ("greedy", "grasp", "nsga2", "bert", "fast", "fast_grasp", "fast_nsga2"):
        cfg = Config(method=method, max_tokens=30, seed=1)
        assert summarize_one("d", [], "", cfg)["selected_indices"] == [] == summarize_one("d", None, "", cfg)["selected_indices"]
        assert summarize_one("d", ["only one sentence"], "", cfg)["selected_indices"] == [0]
        found = summarize_one("d", DOC, "", cfg)["selected_indices"]
        assert found == sorted(set(found)) and sum(len(DOC[i].split()) for i in found) <= 30
    assert summarize_one("d", DOC, "", Config(method="nsga2", similarity=False))["fallback_reason"]
    graph = PRESETS["graph"].with_(weights={**PRESETS["graph"].weights, "centrality": 0.5, "novelty": 0.5})
    assert len(base_scores(DOC, graph, K.TermVectors(DOC))) == 5


def test_recall_target_grows_the_pool():
    few = summarize_one("d", DOC, DOC[3] + " " + DOC[4], Config(k=1, max_tokens=100))
    more = summarize_one("d", DOC, DOC[3] + " " + DOC[4], Config(k=1, max_tokens=100, recall_target=1.0))
    assert len(few["selected_indices"]) == 1 < len(more["selected_indices"])


def test_rouge():
    assert rouge.scores("", None) == (0, 0, 0) and rouge.scores("running dogs", "runs dog run")[0] > 0.7
    a, b = rouge.words("the cat sat on the mat"), rouge.words("the cat the mat sat")
    assert rouge.common_length(a, b) == 4
    rng = random.Random(2)
    for _ in range(50):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert rouge.common_length(x, y) == table[-1][-1]
    known = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "adjustable": "adjust", "sky": "sky", "controll": "control", "agreed": "agre"}
    assert {w: rouge.stem(w) for w in known} == known


def test_greedy_oracle():
    words = [rouge.words(s, False) for s in DOC]
    assert S.greedy_oracle(words, words[1] + words[3], [8, 8, 8, 8, 9], 16) == [1, 3]


def test_configuration():
    cfg = Config.of({"features": {"weights": {"graph": 1.0}}, "candidates": {"k": 5, "sources": ["graph"]}, "optimizer": {"method": "tfidf_fused"}, "objectives": {"lambda_importance": 2}})
    assert cfg.method == "fast" and cfg.k == 5 and cfg.weights["graph"] == 1 and cfg.weights["importance"] == 2
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        Config.of({"redundancy": {"method": "mmr"}})
    assert "redundancy.method" in str(seen[0].message)
    with pytest.raises(ValueError):
        Config(method="three_stage")
    with pytest.raises(ValueError):
        Config(method="bert", stage="stage2")


def test_plain_split():
    assert python_split("One. Two!Three? 四。五！ ... x") == ["One.", "Two!", "Three?", "四。", "五！", ".", ".", ".", "x"]
    assert python_split(None) == [] == python_split("  ")


def test_published_stems():
    pairs = "dies:die dying:die skies:sky sky:sky news:news flies:fli cries:cri possibly:possibl rationally:ration archeology:archeolog caresses:caress ponies:poni agreed:agre hopping:hop filing:file relational:relat triplicate:triplic electrical:electr adjustment:adjust innings:inning proceed:proceed tied:tie enjoy:enjoy happy:happi controlling:control feed:feed".split()
    for word, want in (p.split(":") for p in pairs):
        assert rouge.stem(word) == want, word


def test_encoder_loads_once_and_batches():
    calls = []

    def load():
        calls.append("load")
        return lambda texts: (calls.append(len(texts)), np.ones((len(texts), 2)))[1]

    encoder = Encoder("test", load, batch=2)
    assert encoder(DOC).shape == (5, 2) and encoder([]).shape[0] == 0 and calls == ["load", 2, 2, 1]


def test_fallbacks_are_named(monkeypatch):
    def fail(*_, **__):
        raise FloatingPointError("no")

    monkeypatch.setattr(S, "nsga2", fail)
    assert summarize_one("d", DOC, "", Config(method="nsga2"))["fallback_reason"] == "nsga2 failed: no"
    with pytest.raises(FloatingPointError):
        summarize_one("d", DOC, "", Config(method="fast_nsga2"))


@pytest.mark.parametrize("method", ["max", "set", "diversity"])
def test_searches_side_by_side_are_the_single_ones(method):
    """Searches of several sizes, with ties, empty similarities and budgets that nothing fits."""
    asked = []
    for seed in range(18):
        rng = np.random.default_rng(seed)
        n = (2, 8, 15, 23)[seed % 4]
        v = rng.random((n, 6)) * (rng.random((n, 6)) < (0.0, 0.3, 1.0)[seed % 3])
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
        limit = (0, 60, 10**9)[seed // 4 % 3]
        asked.append(S.Search(np.round(rng.random(n), 2), v @ v.T, S.Budget(rng.integers(1, 30, n), max_tokens=limit), method=method, seed=seed, pop_size=30, n_gen=15))
    asked += [S.Search(np.zeros(0), np.zeros((0, 0)), S.Budget([])), asked[1]._replace(scores=np.full(8, np.nan)), asked[2]._replace(similarity=np.zeros((2, 2)))]
    found = S.nsga2_many(asked)
    assert found[:-1] == [S.nsga2(*a) for a in asked[:-1]] and found[6] and isinstance(found[-1], ValueError)


def test_documents_together_are_the_single_ones():
    docs = [[f"word{k} is {j} of {k * j} many words here" for j in range(3 + k)] for k in range(9)] + [[], ["one"]]
    for method in ("nsga2", "fast_nsga2", "grasp"):
        cfg = Config(method=method, seed=5, k=18, max_tokens=40, pop_size=20, n_gen=10)
        assert together([summarizing(k, d, "", cfg) for k, d in enumerate(docs)]) == [summarize_one(k, d, "", cfg) for k, d in enumerate(docs)]


def test_settings_with_the_same_members_search_once():
    """Four settings of which two keep the same members: two searches, the values of four single settings."""
    row = {"id": "d", "sentences": [f"word{j} and {j * j} many words{j % 5} stand here" for j in range(14)], "highlights": "word3 and many words2"}
    settings = [{"k1": a, "k2": 4, "cap": c, "method": "fast_nsga2", "w_base": 0.5, "alpha": 0.7} for a in (4, 6) for c in (12, 15)]
    finals = [Config(method="fast_nsga2", unit="sentences", max_sentences=3, use_candidates=False, seed=5, pop_size=20, n_gen=5) for _ in settings]

    def run(some):
        steps, asked, found = evaluation._grid_steps(row, [settings[k] for k in some], [finals[k] for k in some], lambda ready, side, k: list(range(side, 2 * k, 2)), None), 0, None
        while True:
            try:
                search = steps.send(found)
            except StopIteration as end:
                return asked, end.value
            asked, found = asked + 1, S.nsga2(*search)

    asked, values = run([0, 1, 2, 3])
    assert asked == 2
    assert [v[1:] for v in values] == [run([k])[1][0][1:] for k in range(4)] and [v[0] for v in values] == [0, 1, 2, 3]
