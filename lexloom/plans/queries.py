"""The registered queries of the core operators; each reads whole tables of a scale directory."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from ..functions import scores as C
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import features as O
from ..operators import fusion as U
from ..operators import kernels as K
from ..operators import selectors as S
from ..operators.arrow import per_document
from ..operators.summarize import Pool, base_scores, costs, features, summarize, summarize_one
from ..sources import formats
from ..sources.tables import read_table, scratch, spread
from ..streaming import read_documents, summarize_stream
from .config import PRESETS, Config, stage1
from .service import Request, handle, health, legacy_request, payload_of, register_functions, two_stage

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _texts(spark, d):
    return spread(read_table(spark, d, "documents").select("doc_id", "text"))


def _docs(spark, d):
    return O.documents(_texts(spark, d))


def _processed(spark, d):
    """Processed records, the last of each id."""
    rows = read_table(spark, d, "processed").select("id", "sentences", "highlights")
    return spread(U.last_by_id(rows, ["sentences", "highlights"], ["sentences", "highlights"]))


def _stage1_runs(spark, d, n=3):
    """The first ``n`` first-stage runs that keep ten sentences; ``runs`` does not grow."""
    rows = read_table(spark, d, "runs").where("stage_name = 'stage1' AND keep_k = 10").orderBy("run_no").limit(n).collect()
    return [r.run_id for r in rows]


def _view(spark, d, run_id):
    """The last predictions of one run for each id."""
    rows = read_table(spark, d, "predictions").where(F.col("run_id") == run_id)
    return U.last_by_id(rows, ["written_at", "pred_id"], ["selected_indices"])


def _as_ids(docs):
    return docs.select(F.col("doc_id").cast("string").alias("id"), "sentences", F.array_join(F.slice("sentences", 1, 3), " ").alias("highlights"))


# ---- text ----


@query
def sentence_split(spark, d):
    return O.long_form(_texts(spark, d), T.split_sentences(F.col("text")), "sentence")


@query
def token_count(spark, d):
    return _texts(spark, d).select("doc_id", T.count_tokens(F.col("text")).cast("bigint").alias("n_tokens"))


@query
def min_token_filter(spark, d):
    return O.long_form(_docs(spark, d), F.col("sentences"), "sentence")


@query
def max_sentence_cap(spark, d):
    """The first five kept sentences; the cap is the operator's parameter."""
    return O.long_form(O.documents(_texts(spark, d), most=5), F.col("sentences"), "sentence")


@query
def tokens_v2(spark, d):
    return O.long_form(_docs(spark, d), F.transform("sentences", lambda s: F.array_join(T.plain_tokens(s, True), " ")), "tokens")


@query
def bigrams(spark, d):
    return O.long_form(_docs(spark, d), F.transform("sentences", lambda s: F.array_join(T.bigrams(T.plain_tokens(s, True)), " ")), "bigrams")


@query
def vectorizer_tokens(spark, d):
    return O.long_form(_docs(spark, d), F.transform("sentences", lambda s: F.array_join(T.vectorizer_tokens(s), " ")), "tokens")


@query
def separator_clean(spark, d):
    """Articles with separators as spaces, and highlights without a leading dash."""
    rows = read_table(spark, d, "articles")
    return rows.select("row_id", T.without_separators(F.col("article")).alias("article"), T.without_dash(F.col("highlights")).alias("highlights"))


@query
def report_sentences(spark, d):
    """Sentences of all reports of an article in one list, short ones kept."""
    rows = spread(read_table(spark, d, "articles").select("row_id", "article"))
    reports = F.split(F.coalesce("article", F.lit("")), r"\|{5}")
    return O.long_form(rows.withColumnRenamed("row_id", "doc_id"), F.flatten(F.transform(reports, T.split_sentences)), "sentence")


@query
def summary_assembly(spark, d):
    """The valid selected sentences of every prediction, joined in document order."""
    rows = read_table(spark, d, "predictions").select("pred_id", "id", "selected_indices")
    joined = rows.join(_processed(spark, d).select("id", "sentences"), "id")
    places = F.array_sort(F.array_distinct(T.within(F.coalesce("selected_indices", F.expr("CAST(array() AS array<int>)")), F.size("sentences"))))
    return joined.select("pred_id", F.coalesce(T.joined(F.col("sentences"), places), F.lit("")).alias("assembled"))


# ---- features ----


@query
def tf_isf_v1(spark, d):
    return O.kernel_scores(_docs(spark, d), "score", K.tf_isf)


@query
def tf_isf_v2(spark, d):
    return O.kernel_scores(_docs(spark, d), "score", K.tf_isf_v2)


@query
def tf_isf_v2_bigrams(spark, d):
    return O.kernel_scores(_docs(spark, d), "score", lambda s: K.tf_isf_v2(s, use_bigrams=True))


def _rounded(docs, values):
    return O.long_form(docs, values, "score").withColumn("score", F.round("score", 6))


@query
def length_score(spark, d):
    return _rounded(O.with_lengths(_docs(spark, d)), C.length_scores(F.col("n_tokens")))


@query
def position_v1(spark, d):
    return _rounded(_docs(spark, d), C.position_scores(F.size("sentences")))


@query
def position_inverse(spark, d):
    return _rounded(_docs(spark, d), C.position_scores(F.size("sentences"), "inverse"))


@query
def position_exponential(spark, d):
    return _rounded(_docs(spark, d), C.position_scores(F.size("sentences"), "exponential"))


@query
def base_scores_v1(spark, d):
    return _rounded(O.base_scores_v1(_docs(spark, d)), F.col("score"))


@query
def base_scores_v2_interactions(spark, d):
    return _rounded(O.base_scores_v2(_docs(spark, d)), F.col("score"))


def _token_counts(spark, d):
    docs = O.with_lengths(_docs(spark, d))
    return docs, F.transform("n_tokens", lambda n: n.cast("double"))


@query
def minmax_half(spark, d):
    docs, n = _token_counts(spark, d)
    return _rounded(docs, C.minmax(n))


@query
def minmax_zero(spark, d):
    docs, n = _token_counts(spark, d)
    return _rounded(docs, C.minmax_zero(n))


@query
def minmax_unit(spark, d):
    docs, n = _token_counts(spark, d)
    return _rounded(docs, C.minmax_unit(n))


@query
def zscore(spark, d):
    docs, n = _token_counts(spark, d)
    return _rounded(docs, C.zscore(n))


@query
def feature_dump(spark, d):
    """Base scores and number of sentences of every processed record."""
    rows = _processed(spark, d).select("id", F.filter("sentences", lambda s: s.isNotNull()).alias("sentences")).where("sentences IS NOT NULL")
    keyed = rows.withColumn("doc_id", F.col("id"))
    dumped = O.feature_dump(keyed, "id")
    return dumped.select("id", F.array_join(F.transform("base_scores", lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",").alias("base_scores"), F.col("n_sentences").cast("bigint").alias("n_sentences"))


# ---- vectors and graph ----


@query
def tfidf_weights(spark, d):
    return O.term_weights(_docs(spark, d))


@query
def tfidf_bigram_sublinear(spark, d):
    return O.term_weights(_docs(spark, d), pairs=True, sublinear=True)


@query
def pairwise_cosine(spark, d):
    """Similarity of each sentence to the most similar other one of its document."""
    return O.kernel_scores(_docs(spark, d), "score", O.nearest_similarity)


@query
def centroid_cosine(spark, d):
    return O.kernel_scores(_docs(spark, d), "score", lambda s: K.TermVectors(s, True, True).to_centroid())


@query
def centrality(spark, d):
    """From row sums in linear form; the matrix is never made."""
    return O.kernel_scores(_docs(spark, d), "score", lambda s: K.centrality(K.TermVectors(s)))


@query
def novelty(spark, d):
    return O.kernel_scores(_docs(spark, d), "score", lambda s: K.novelty(K.TermVectors(s)))


@query
def textrank(spark, d):
    return O.kernel_scores(_docs(spark, d), "score", lambda s: K.textrank(K.TermVectors(s)))


@query
def textrank_threshold(spark, d):
    return O.kernel_scores(_docs(spark, d), "score", lambda s: K.textrank(K.TermVectors(s), 0.2))


@query
def textrank_steps(spark, d):
    """Eight steps of the iteration, without early stop."""
    return O.kernel_scores(_docs(spark, d), "score", lambda s: K.textrank(K.TermVectors(s), most=8, eps=0.0))


@query
def embedding_centroid_rank(spark, d):
    rows = read_table(spark, d, "embeddings")
    return O.group_embedding_rank(rows).select("label", "vec_id", F.round("score", 5).alias("score"))


# ---- candidates ----


def _places(docs, places):
    return docs.select("doc_id", F.explode(F.transform(places, lambda i: i.cast("bigint"))).alias("pos"))


@query
def topk_score(spark, d):
    docs = O.base_scores_v1(_docs(spark, d))
    return _places(docs, C.top_k(F.transform("score", lambda x: F.round(x, 9)), 5))


@query
def topk_position(spark, d):
    return _places(_docs(spark, d), C.top_k(C.position_scores(F.size("sentences")), 5))


def _kernel_places(docs, pick):
    def make(row):
        s = row["sentences"] or []
        return [(row["doc_id"], int(i)) for i in pick(s)] if s else []

    return per_document(docs.select("doc_id", "sentences"), "doc_id bigint, pos bigint", make)


@query
def topk_centrality(spark, d):
    return _kernel_places(_docs(spark, d), lambda s: sorted(K.ranks(np.round(K.TermVectors(s).to_centroid(), 9))[:5].tolist()))


@query
def topk_graph(spark, d):
    return _kernel_places(_docs(spark, d), lambda s: sorted(K.ranks(np.round(K.textrank(K.TermVectors(s), 0.2), 10))[:5].tolist()))


@query
def candidate_union(spark, d):
    """Union of the best five by score, by position and by centrality."""
    cfg = Config(sources=("score", "position", "centrality"))

    def pick(s):
        return Pool(s, np.round(base_scores(s, cfg), 9), cfg).at(5)

    return _kernel_places(_docs(spark, d), pick)


@query
def soft_boost(spark, d):
    docs = O.base_scores_v1(_docs(spark, d))
    rounded = F.transform("score", lambda x: F.round(x, 9))
    return _rounded(docs, C.boosted(F.col("score"), C.top_k(rounded, 5)))


@query
def oracle_candidates(spark, d):
    """Greedy ROUGE-1 oracle (stemmed) against the first three sentences, 60 tokens."""
    def pick(s):
        words = [E.rouge.words(x) for x in s]
        return S.greedy_oracle(words, [w for x in words[:3] for w in x], costs(s), 60)

    return _kernel_places(_docs(spark, d), pick)


@query
def recall_target(spark, d):
    """Pools grow until they hold four fifths of the oracle's sentences."""
    found = summarize(_as_ids(_docs(spark, d)), Config(k=3, recall_target=0.8))
    return found.select("id", F.array_join("selected_indices", ",").alias("places"), "summary")


@query
def weight_gates(spark, d):
    """Base scores with a graph weight too small to count and an importance weight of zero."""
    cfg = Config(weights={"importance": 0.0, "length": 1.0, "position": 1.0, "graph": 1e-10})
    return O.kernel_scores(_docs(spark, d), "score", lambda s: base_scores(s, cfg) + 1e-9)  # off the ties of rounding


@query
def centroid_centrality(spark, d):
    """Centrality without a similarity matrix."""
    cfg = Config(similarity=False, weights={"centrality": 1.0})
    return O.kernel_scores(_docs(spark, d), "score", lambda s: features(s, cfg)["centrality"])


# ---- length control ----


@query
def trim_tokens(spark, d):
    return _places(O.with_lengths(_docs(spark, d)), C.trim_budget(F.col("n_tokens"), 100))


@query
def trim_sentences(spark, d):
    return O.long_form(O.documents(_texts(spark, d), most=3), F.col("sentences"), "sentence")


@query
def word_budget_fill(spark, d):
    """Best scores first, skipping what does not fit into 100 words; ties to the later sentence."""
    docs = O.base_scores_v1(_docs(spark, d))
    marked = F.transform("score", lambda x, i: F.struct((-F.round(x, 9)).alias("s"), (-i).alias("i")))
    order = F.transform(F.array_sort(marked), lambda x: -x["i"])
    return _places(docs, C.fill_budget(order, F.col("n_tokens"), 100))


# ---- selectors ----


def _selection(spark, d, cfg):
    return summarize(_as_ids(_docs(spark, d)), cfg).select("id", F.array_join("selected_indices", ",").alias("places"), "summary")


@query
def greedy_mmr_tokens(spark, d):
    return _selection(spark, d, Config())


@query
def greedy_mmr_sentences(spark, d):
    return _selection(spark, d, Config(unit="sentences", max_sentences=3))


@query
def grasp(spark, d):
    return _selection(spark, d, Config(method="grasp", seed=2024))


@query
def nsga2_max(spark, d):
    return _selection(spark, d, Config(method="nsga2", seed=2024))


@query
def nsga2_diversity(spark, d):
    return _selection(spark, d, Config(method="nsga2", coverage_method="diversity", seed=2024))


@query
def fast_fused(spark, d):
    return _selection(spark, d, Config(method="fast"))


@query
def fast_grasp(spark, d):
    return _selection(spark, d, Config(method="fast_grasp", seed=2024))


@query
def fast_nsga2(spark, d):
    return _selection(spark, d, PRESETS["fusion"])


@query
def encoder_rank(spark, d):
    """Ranking by embeddings of a hashed stand-in for the encoder."""
    return _selection(spark, d, PRESETS["encoder"])


@query
def graph_preset(spark, d):
    return _selection(spark, d, PRESETS["graph"])


@query
def words_preset(spark, d):
    return _selection(spark, d, PRESETS["400words"])


@query
def grasp_plain(spark, d):
    """GRASP with a candidate list of one: construction and local search without chance."""
    return _selection(spark, d, Config(method="grasp", rcl_ratio=0.0, seed=2024))


@query
def fast_grasp_plain(spark, d):
    return _selection(spark, d, Config(method="fast_grasp", rcl_ratio=0.0, seed=2024))


@query
def nsga2_small_pool(spark, d):
    """Pools of six: the population holds every subset, so the best of the front is known."""
    return _selection(spark, d, Config(method="nsga2", k=6, coverage_method="set", seed=2024))


@query
def nsga2_diversity_small_pool(spark, d):
    return _selection(spark, d, Config(method="nsga2", k=6, coverage_method="diversity", seed=2024))


@query
def fast_nsga2_small_pool(spark, d):
    return _selection(spark, d, PRESETS["fusion"].with_(k=6))


@query
def nsga2_base_preset(spark, d):
    """The first benchmark view: pools of 40, 300 tokens."""
    return _selection(spark, d, PRESETS["base"])


@query
def fallback_without_similarity(spark, d):
    """The multi-objective selector steps back to greedy where there is no similarity."""
    found = summarize(_as_ids(_docs(spark, d)), Config(method="nsga2", similarity=False))
    return found.select("id", F.array_join("selected_indices", ",").alias("places"), "summary", "fallback_reason")


@query
def grasp_objective(spark, d):
    """Objective of the first ten sentences under the base scores."""
    def make(row):
        s = row["sentences"] or []
        if not s:
            return []
        lead = range(min(10, len(s)))
        return [(row["doc_id"], round(S.objective(lead, base_scores(s, Config()), K.TermVectors(s).similarity(lead), 0.7) + 1e-9, 6))]

    return per_document(_docs(spark, d), "doc_id bigint, value double", make)


@query
def coverage_of_lead(spark, d):
    """Coverage of each kind, and redundancy, of every second sentence."""
    def make(row):
        s = row["sentences"] or []
        if not s:
            return []
        sim, lead = K.TermVectors(s).similarity(), list(range(0, len(s), 2))
        return [(row["doc_id"], *(round(S.coverage(sim, lead, m), 6) for m in ("max", "set", "diversity")), round(S.redundancy(sim, lead), 6))]

    return per_document(_docs(spark, d), "doc_id bigint, coverage double, coverage_set double, coverage_diversity double, redundancy double", make)


# ---- fusion ----

def _three(spark, d, first=None):
    docs = _processed(spark, d).select("id", F.filter("sentences", lambda s: s.isNotNull()).alias("sentences")).where("sentences IS NOT NULL")
    return U.union_views(docs, [_view(spark, d, r) for r in _stage1_runs(spark, d)], first)


@query
def union_views(spark, d):
    return _three(spark, d).select("id", F.explode(F.col("orig_indices").cast("array<bigint>")).alias("pos"))


@query
def union_first_k(spark, d):
    """Only the first two places of each view."""
    return _three(spark, d, [2, 2, 2]).select("id", F.explode(F.col("orig_indices").cast("array<bigint>")).alias("pos"))


@query
def union_capped(spark, d):
    return U.capped(_three(spark, d), 4).select("id", F.explode(F.col("orig_indices").cast("array<bigint>")).alias("pos"))


@query
def ordered_union(spark, d):
    joined, names = _processed(spark, d).select("id"), []
    for k, r in enumerate(_stage1_runs(spark, d, 2)):
        joined = joined.join(_view(spark, d, r).withColumnRenamed("selected_indices", f"v{k}"), "id", "left")
        names.append(F.col(f"v{k}"))
    return joined.select("id", F.array_join(U.ordered_union(names, 6), ",").alias("places"))


@query
def near_dup_drop(spark, d):
    return U.near_dropped(_three(spark, d), 0.9).select("id", F.explode(F.col("orig_indices").cast("array<bigint>")).alias("pos"))


@query
def union_documents(spark, d):
    """The sentences of every union document."""
    united = U.sub_lists(_three(spark, d))
    return united.select("id", F.array_join(F.transform("sentences", lambda s: F.coalesce(s, F.lit(""))), " | ").alias("members"))


@query
def fusion_fast(spark, d):
    """Three stored views, near-duplicates dropped, cap, and the fused greedy selection over the union document."""
    united = U.sub_lists(U.capped(U.near_dropped(_three(spark, d)), 6))
    final = summarize(united.withColumn("highlights", F.lit("")), Config(method="fast", max_tokens=60, use_candidates=False))
    return final.select("id", F.array_join("selected_indices", ",").alias("places"), "summary")


def _scored_docs(spark, d):
    return _processed(spark, d).where("sentences IS NOT NULL")


@query
def three_view_benchmark(spark, d):
    """The benchmark of three own views (multi-objective, encoder, graph), their union and the final selection."""
    found = E.view_pipeline(_scored_docs(spark, d), [PRESETS["base"], PRESETS["encoder"], PRESETS["graph"]], PRESETS["fusion"].with_(use_candidates=False))
    return found.select("id", *(F.array_join(c, ",").alias(c) for c in ("view0", "view1", "view2", "union", "selected_indices")), "summary")


@query
def three_view_metrics(spark, d):
    """ROUGE of the three-view benchmark."""
    found = E.view_pipeline(_scored_docs(spark, d), [PRESETS["base"], PRESETS["encoder"], PRESETS["graph"]], PRESETS["fusion"].with_(use_candidates=False))
    return E.metric_rows(E.rouge_mean(E.rouge_rows(found, "id")))


@query
def two_base_routes(spark, d):
    """Two metaheuristic first stages instead of an encoder, united, and the fused selection."""
    routes = [Config(method=m, unit="sentences", max_sentences=10, k=10, seed=2024) for m in ("grasp", "nsga2")]
    found = E.view_pipeline(_scored_docs(spark, d), routes, Config(method="fast", unit="sentences", max_sentences=3, use_candidates=False), cap=15)
    return found.select("id", *(F.array_join(c, ",").alias(c) for c in ("view0", "view1", "union", "selected_indices")), "summary")


@query
def fusion_pipeline(spark, d):
    """Three views, near-duplicates dropped, cap, and the final selection over the union document."""
    united = U.sub_lists(U.capped(U.near_dropped(_three(spark, d)), 100))
    final = summarize(united.withColumn("highlights", F.lit("")), PRESETS["fusion"])
    return final.select("id", "selected_indices", "summary")


@query
def service_two_stage(spark, d):
    """The request plan over every article."""
    rows = spread(read_table(spark, d, "articles").select("row_id", "article"))
    reports = F.split(F.coalesce("article", F.lit("")), r"\|{5}")
    docs = rows.select(F.col("row_id").cast("string").alias("id"), F.flatten(F.transform(reports, T.split_sentences)).alias("sentences"))
    request = Request(["-"], ["greedy"], ["bert"], max_sentences=3)
    return two_stage(docs, request).select("id", F.array_join("selected_indices", ",").alias("places"), F.array_join("candidate_indices", ",").alias("candidates"), "summary")


# ---- evaluation ----


def _predictions(spark, d):
    return spread(read_table(spark, d, "predictions").select("pred_id", "run_id", "summary", "reference"))


@query
def rouge1(spark, d):
    return E.ngram_f(_predictions(spark, d), "pred_id", 1)


@query
def rouge2(spark, d):
    return E.ngram_f(_predictions(spark, d), "pred_id", 2)


@query
def rouge_stemmed(spark, d):
    return E.rouge_rows(_predictions(spark, d), "pred_id")


def _scored_runs(spark, d):
    return E.rouge_rows(_predictions(spark, d), "pred_id", keep=("run_id",))


@query
def rouge_mean(spark, d):
    return E.rouge_mean(_scored_runs(spark, d), "run_id")


@query
def rouge1_mean(spark, d):
    """Sum (in millionths) and count of unstemmed ROUGE-1 by run."""
    scored = E.ngram_f(_predictions(spark, d), "pred_id", 1, keep=("run_id",))
    return scored.groupBy("run_id").agg(F.sum(F.round(F.col("rouge1") * 1_000_000).cast("bigint")).alias("micro"), F.count(F.lit(1)).alias("n"))


@query
def metric_rows(spark, d):
    return E.metric_rows(E.rouge_mean(E.rouge_rows(_predictions(spark, d), "pred_id")))


@query
def metrics_file(spark, d):
    """The metrics written to a file and read back."""
    path = scratch(spark, "metrics")
    formats.write_metrics(metric_rows(spark, d), path)
    return formats.read_metrics(spark, path)


@query
def best_runs(spark, d):
    """The ten best runs by mean ROUGE; the ten are the report's own limit."""
    return formats.best_runs(E.rouge_mean(_scored_runs(spark, d), "run_id"))


@query
def selector_grid(spark, d):
    """Mean ROUGE of the fused selector by weight and trade-off, straight on the records."""
    configs = [({"w_base": w, "alpha": a}, Config(method="fast", unit="sentences", max_sentences=3, w_base=w, w_semantic=1 - w, alpha=a)) for w in (0.3, 0.7) for a in (0.5, 0.7)]
    return E.grid(_scored_docs(spark, d), configs)


def _settings(**values):
    """Every combination of the values."""
    names = list(values)
    return [dict(zip(names, x)) for x in itertools.product(*values.values())]


@query
def grid_fusion(spark, d):
    """The whole grid: views of k1 and k2 sentences, cap, final method, weights and trade-off."""
    return E.fusion_grid(_scored_docs(spark, d), _settings(k1=[5, 10], k2=[5, 10], cap=[8, 15], method=["fast", "fast_grasp", "fast_nsga2"], w_base=[0.5], alpha=[0.7]))


def _two_stored(spark, d):
    runs = _stage1_runs(spark, d, 2)
    docs = _scored_docs(spark, d)
    for k in range(2):
        if k < len(runs):
            docs = docs.join(_view(spark, d, runs[k]).withColumnRenamed("selected_indices", f"view{k}"), "id", "left")
        else:
            docs = docs.withColumn(f"view{k}", F.lit(None).cast("array<int>"))
    return docs


@query
def stage2_grid(spark, d):
    """Second-stage settings over the union of two stored views, near-duplicates dropped."""
    return E.fusion_grid(_two_stored(spark, d), _settings(k1=[10], k2=[10], cap=[4, 8], method=["fast"], w_base=[0.3, 0.7], alpha=[0.5, 0.9]))


def _split_docs(spark, d):
    rows = spread(read_table(spark, d, "articles").select(F.col("row_id").alias("id"), "article", "highlights", formats.split_name(F.col("split_name")).alias("split")))
    ready = rows.where("split IN ('train', 'validation', 'test')")
    kept = T.first_sentences(T.at_least(T.split_sentences(F.col("article"))), 25)
    return ready.select(F.col("id").cast("string").alias("id"), kept.alias("sentences"), F.coalesce("highlights", F.lit("")).alias("highlights"), "split")


@query
def selectors_by_split(spark, d):
    """The benchmark of selectors by split: every article, two deterministic selectors."""
    configs = [({"method": "greedy"}, Config(unit="sentences", max_sentences=3)), ({"method": "fast"}, Config(method="fast", unit="sentences", max_sentences=3))]
    return E.grid(_split_docs(spark, d), configs, "split")


@query
def randomized_selectors_by_split(spark, d):
    """The same benchmark with the searching selectors."""
    configs = [({"method": m}, Config(method=m, unit="sentences", max_sentences=3, seed=2024)) for m in ("grasp", "nsga2", "fast_grasp", "fast_nsga2")]
    return E.grid(_split_docs(spark, d), configs, "split")


@query
def timed_two_phases(spark, d):
    """Select, write, read back and evaluate with timers; the seconds are left out, since they differ."""
    rows = E.timed_run(_scored_docs(spark, d), Config(unit="sentences", max_sentences=3), scratch(spark, "timed"))
    return rows.where("metric LIKE 'rouge%'")


@query
def tune_with_skip(spark, d):
    """A tuning run twice over: the second time finished settings are skipped."""
    path = scratch(spark, "tune")
    configs = {f"k{k}": Config(unit="sentences", max_sentences=k) for k in (1, 3)}
    first = E.tune(_scored_docs(spark, d), {"k1": configs["k1"]}, path)
    second = E.tune(_scored_docs(spark, d), configs, path)
    names = spark.createDataFrame([(n, n in first, n in second) for n in configs], "name string, ran_first boolean, ran_second boolean")
    metrics = None
    for n in configs:
        one = formats.read_metrics(spark, f"{path}/{n}/metrics").where("metric = 'rouge1'").select(F.lit(n).alias("name"), F.col("value").alias("rouge1"))
        metrics = one if metrics is None else metrics.unionByName(one)
    return names.join(metrics, "name")


@query
def rerank_fuse(spark, d):
    """The predictions of an id as candidates: fused order of length and count scores."""
    rows = read_table(spark, d, "predictions").where("id IS NOT NULL AND summary IS NOT NULL")
    one = F.struct("pred_id", "summary", F.col("selected_indices").alias("indices"), F.coalesce(F.size("selected_indices"), F.lit(0)).cast("double").alias("base_score"), F.length("summary").cast("double").alias("ce"))
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    return E.rerank(grouped, 0.7, 0.3).select("id", F.array_join("rerank_order", ",").alias("rerank_order"), "summary")


def _word_overlap(texts, summaries):
    """A scorer for tests: distinct lower-case words of the summary that the text holds."""
    return [float(len(set(b.lower().split()) & set(a.lower().split()))) for a, b in zip(texts, summaries)]


@query
def rerank_files(spark, d):
    """Candidates read from JSON lines, scored by word overlap with the reference, and reranked."""
    rows = read_table(spark, d, "predictions").where("id IS NOT NULL AND summary IS NOT NULL")
    one = F.struct("pred_id", "summary", F.col("selected_indices").alias("indices"), F.coalesce(F.size("selected_indices"), F.lit(0)).cast("double").alias("base_score"))
    grouped = rows.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("c"), F.min("reference").alias("article"))
    path = scratch(spark, "candidates")
    formats.write_jsonl(grouped.select("id", "article", F.transform("c", lambda x: F.struct(x["summary"].alias("summary"), x["indices"].alias("indices"), x["base_score"].alias("base_score"))).alias("candidates")), path)
    found = E.rerank_job(formats.read_jsonl(spark, path, formats.CANDIDATES), scorer=_word_overlap, w_ce=0.6, w_base=0.4, normalize="none")
    return found.select("id", F.array_join("rerank_order", ",").alias("rerank_order"), "summary")


# ---- tables ----


@query
def csv_scan(spark, d):
    """Articles through a CSV file with quotes and line breaks in its fields."""
    path = scratch(spark, "articles-csv")
    rows = read_table(spark, d, "articles").select(F.col("row_id").cast("string").alias("id"), "article", "highlights")
    formats.write_csv(rows, path)
    back = formats.read_csv(spark, path)
    return back.select("id", F.coalesce("article", F.lit("")).alias("article"), F.coalesce("highlights", F.lit("")).alias("highlights"))


@query
def jsonl_scan(spark, d):
    """Processed records through JSON lines."""
    path = scratch(spark, "processed-jsonl")
    formats.write_jsonl(read_table(spark, d, "processed").select("id", "sentences", "highlights"), path)
    back = formats.read_jsonl(spark, path)
    return back.select("id", F.size("sentences").cast("bigint").alias("n"), F.array_join("sentences", "\n").alias("joined"), "highlights")


@query
def tagged_scan(spark, d):
    """Topic folders with tagged files, one topic for each language of the small language table."""
    root = scratch(spark, "topics")
    for r in read_table(spark, d, "languages").collect() if formats.exists(spark, f"{d}/languages.parquet") else []:
        formats.write_text(spark, f"{root}/{r.lang}/b.S", f"<DOC><TEXT><s n='2'> {r.lang_title} </s></TEXT><s>outside</s></DOC>")
        formats.write_text(spark, f"{root}/{r.lang}/a.S", f"<TEXT>\n<s n='1'>{r.lang}</s>\n<s>again</s></TEXT>")
        if r.lang > "e":
            formats.write_text(spark, f"{root}/{r.lang}.A", f" {r.lang_title}\n")
    return formats.tagged_topics(spark, root)


@query
def run_sidecars(spark, d):
    """A run's predictions and its sidecars, written and read back."""
    path = scratch(spark, "run")
    rows = read_table(spark, d, "runs").select(F.col("run_id").alias("id"), F.array("run_no").alias("selected_indices"), F.col("selector").alias("summary"), F.col("stage_name").alias("reference"))
    formats.write_run(rows, path, {"method": "greedy", "k": 3})
    told = spark.read.parquet(f"{path}/_run_metadata").select(F.get_json_object("config", "$.method").alias("method"), (F.col("select_seconds") >= 0).alias("timed"))
    side = spark.read.text(f"{path}/config_used.json", wholetext=True).select(F.get_json_object("value", "$.k").alias("k"))
    return formats.read_jsonl(spark, f"{path}/predictions.jsonl", formats.PREDICTIONS).select("id", "summary", F.array_join("selected_indices", ",").alias("places")).crossJoin(told).crossJoin(side)


@query
def run_layouts(spark, d):
    """Stage, method and sizes out of run folder names."""
    name = F.when(F.col("stage_name") == "stage1", F.format_string("tune1-%s-k%d-20240101-101010", "selector", "keep_k")).otherwise(F.format_string("fast2-fast_grasp-k1%d-k2%d-cap%d-20240101-101010-x", "run_no", "keep_k", "max_tokens"))
    return formats.run_layout(read_table(spark, d, "runs").select(name.alias("name")))


@query
def summary_files(spark, d):
    """Run summaries of several CSV files with different columns, found by a pattern."""
    root = scratch(spark, "summaries")
    runs = read_table(spark, d, "runs")
    formats.write_csv(runs.where("stage_name = 'stage1'").select("run_id", "selector", "keep_k"), f"{root}/tune_summary_1.csv")
    formats.write_csv(runs.where("stage_name <> 'stage1'").select("run_id", "max_tokens"), f"{root}/tune_summary_2.csv")
    return formats.read_summaries(spark, f"{root}/tune_summary_*.csv")


@query
def split_files(spark, d):
    """Files of the splits found by any of their names."""
    root = scratch(spark, "splits")
    rows = read_table(spark, d, "articles").select(F.col("row_id").cast("string").alias("id"), formats.split_name(F.col("split_name")).alias("split"))
    for split, file in (("train", "train"), ("validation", "dev.jsonl"), ("test", "test/test.jsonl")):
        formats.write_jsonl(rows.where(F.col("split") == split), f"{root}/{file}")
    found = None
    for split in ("train", "validation", "test"):
        one = formats.read_jsonl(spark, formats.split_path(spark, root, split), "id string, split string").withColumn("wanted", F.lit(split))
        found = one if found is None else found.unionByName(one)
    return found


@query
def dashed_documents(spark, d):
    """Reports of an article as documents parted by lines of dashes."""
    rows = read_table(spark, d, "articles").select("row_id", F.replace("article", F.lit("|||||"), F.lit("\n-----\n")).alias("text"))
    return rows.select("row_id", F.posexplode(T.dashed_documents(F.col("text"))).alias("pos", "document")).withColumn("pos", F.col("pos").cast("bigint"))


@query
def stage1_configs(spark, d):
    """First-stage configurations generated for the stored runs (a table that does not grow)."""
    known = [r for r in read_table(spark, d, "runs").where("stage_name = 'stage1'").collect()]
    made = [(r.run_id, stage1(r.selector, r.keep_k)) for r in known]
    return spark.createDataFrame([(n, c.method, c.unit, c.max_sentences, c.k, c.use_candidates) for n, c in made], "run_id string, method string, unit string, max_sentences int, k int, use_candidates boolean")


@query
def yaml_configs(spark, d):
    """Nested configurations through YAML files."""
    import yaml

    root, out = scratch(spark, "configs"), []
    for r in read_table(spark, d, "runs").where("selector NOT IN ('bert', 'xlnet')").collect():
        tree = {"optimizer": {"method": r.selector}, "length_control": {"unit": "tokens", "max_tokens": r.max_tokens}, "candidates": {"k": r.keep_k, "sources": ["score", "position"]}, "seed": r.seed}
        formats.write_text(spark, f"{root}/{r.run_id}.yaml", yaml.safe_dump(tree))
        text = spark.read.text(f"{root}/{r.run_id}.yaml", wholetext=True).first()[0]
        c = Config.of(yaml.safe_load(text))
        out.append((r.run_id, c.method, c.max_tokens, c.k, ",".join(c.sources), c.seed))
    return spark.createDataFrame(out, "run_id string, method string, max_tokens int, k int, sources string, seed int")


@query
def sample_then_limit(spark, d):
    """Half of the articles by a seeded hash, and the first hundred of these; the hundred are the operator's limit."""
    rows = read_table(spark, d, "articles").select(F.col("row_id").alias("id"), "article", "highlights")
    return formats.preprocess(rows, share=0.5, limit=100).select("id", F.size("sentences").cast("bigint").alias("n_sentences"), "highlights")


@query
def hub_limit(spark, d):
    """The first fifty rows of a multi-report set; the fifty are the operator's limit."""
    rows = read_table(spark, d, "articles").select("row_id", "article", "highlights")
    return formats.hub_rows(rows, "test", 50, "article", "highlights", "row_id").select("id", F.array_join("sentences", "\n").alias("kept"), "highlights")


@query
def sql_functions(spark, d):
    """The registered SQL functions over whole tables."""
    register_functions(spark)
    read_table(spark, d, "predictions").createOrReplaceTempView("lexloom_predictions")
    return spark.sql("SELECT pred_id, count_tokens(summary) AS n_tokens, array_join(split_sentences(summary), '|') AS sentences, round(rouge_f(summary, reference), 6) AS rouge1 FROM lexloom_predictions")


@query
def sentence_token_function(spark, d):
    """The table function of sentence tokens, joined laterally."""
    register_functions(spark)
    read_table(spark, d, "predictions").createOrReplaceTempView("lexloom_predictions")
    return spark.sql("SELECT p.pred_id, CAST(t.pos AS BIGINT) AS pos, t.token FROM lexloom_predictions p, LATERAL sentence_tokens(p.summary) t")


@query
def streamed_summaries(spark, d):
    """Documents through a stream of JSON lines to summaries in parquet."""
    root = scratch(spark, "stream")
    formats.write_jsonl(_as_ids(_docs(spark, d)), f"{root}/in")
    summarize_stream(read_documents(spark, f"{root}/in"), Config(), f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("id", F.array_join("selected_indices", ",").alias("places"), "summary")


@query
def service_answers(spark, d):
    """Whole answers of the request surface to the request presets, over texts of the small language table."""
    out = []
    known = read_table(spark, d, "languages").orderBy("lang").collect() if formats.exists(spark, f"{d}/languages.parquet") else []
    for r in known:
        text = f"{r.lang_title} comes first. A second sentence stands here.\n---\nThe code is {r.lang}!"
        status, body = handle(spark, {**payload_of("news-3sent", text), "reference": r.lang_title})
        out.append((r.lang, status, body["summary"], len(body["candidate_indices"]), round(body["metrics"]["rouge1"], 6)))
    bad = handle(spark, {"documents": []})[0]
    legacy = legacy_request({"text": "A b c.", "unit": "tokens", "limit": 100})
    return spark.createDataFrame([(*x, bad, legacy.limit, health()["status"]) for x in out], "lang string, status int, summary string, n_candidates int, rouge1 double, bad_status int, legacy_limit int, health string")


@query
def split_70_20_10(spark, d):
    return formats.split_rows(read_table(spark, d, "articles").select("row_id"), "row_id")


@query
def sample_n(spark, d):
    """A seeded sample of a hundred rows."""
    return formats.sample_n(read_table(spark, d, "articles").select("row_id"), "row_id", 100)


@query
def jsonl_to_csv(spark, d):
    rows = read_table(spark, d, "predictions").select("pred_id", F.col("summary").alias("article"), "reference", F.lit(None).cast("string").alias("highlights"))
    return formats.as_csv_rows(rows.withColumnRenamed("pred_id", "id")).withColumnRenamed("id", "pred_id")


@query
def run_summary_union(spark, d):
    runs = read_table(spark, d, "runs")
    return formats.union_summaries([runs.where("stage_name = 'stage1'").select("run_id", "selector", "keep_k"), runs.where("stage_name <> 'stage1'").select("run_id", "max_tokens")])


@query
def hub_rows(spark, d):
    rows = spread(read_table(spark, d, "articles").select("row_id", "article", "highlights"))
    return formats.hub_rows(rows, "train", 0, "article", "highlights", "row_id").select("id", F.array_join("sentences", "\n").alias("kept"), "highlights")


@query
def preprocessed(spark, d):
    rows = spread(read_table(spark, d, "articles").select(F.col("row_id").alias("id"), "article", "highlights"))
    return formats.preprocess(rows, most=25).select("id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join("sentences", "\n").alias("kept"), "highlights")


__all__ = ["QUERIES", "summarize_one"]
