"""Evaluation: ROUGE per row and by group, grids of configurations, reranking."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config, stage1
from . import kernels as K
from . import rouge
from . import selectors as S
from .arrow import per_document
from .summarize import Encoder, Prepared, dealt, stand_in_embedding, summarize, summarize_one, summarizing, together


def rouge_rows(df: DataFrame, key: str, predicted: str = "summary", reference: str = "reference", stemmed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, rouge1, rouge2, rougeL`` of every row; null texts count as empty.

    ``keep`` carries columns along, so that means by group need no join back.
    """
    names = [key, *keep]

    def make(row):
        return [(*(row[f"c{k}"] for k in range(len(names))), *(round(x, 6) for x in rouge.scores(row["p"], row["r"], stemmed)))]

    chosen = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(names)), F.col(predicted).alias("p"), F.col(reference).alias("r"))
    kinds = dict(df.dtypes)
    found = per_document(chosen, ", ".join(f"c{k} {kinds[c]}" for k, c in enumerate(names)) + ", rouge1 double, rouge2 double, rougeL double", make)
    return found.withColumnsRenamed({f"c{k}": c for k, c in enumerate(names)})


def rouge_mean(scored: DataFrame, *group: str) -> DataFrame:
    """Mean scores, by group if one is given; no rows give zero."""
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")]
    return scored.groupBy(*group).agg(*means) if group else scored.agg(*means)


def metric_rows(means: DataFrame) -> DataFrame:
    """``metric, value`` rows of one row of means."""
    return means.select(F.expr("stack(3, 'rouge1', rouge1, 'rouge2', rouge2, 'rougeL', rougeL) AS (metric, value)"))


def ngram_f(df: DataFrame, key: str, n: int, predicted: str = "summary", reference: str = "reference", keep: tuple[str, ...] = ()) -> DataFrame:
    """Unstemmed ROUGE-n F as columns only: clipped counts by sorted runs inside the row."""

    def grams(c):
        words = F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
        if n == 1:
            return words
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))

    both = df.select(key, *keep, grams(predicted).alias("p"), grams(reference).alias("r"))
    # an n-gram repeated k times becomes k numbered ones, so the clipped overlap is an intersection
    numbered = lambda c: F.transform(F.array_sort(c), lambda g: g)
    ready = both.select(key, *keep, numbered("p").alias("p"), numbered("r").alias("r"))

    def marked(c):
        start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("k"), F.expr("CAST(array() AS array<string>)").alias("out"))

        def step(a, g):
            k = F.when(a["g"] == g, a["k"] + 1).otherwise(F.lit(1))
            return F.struct(g.alias("g"), k.alias("k"), F.array_append(a["out"], F.concat_ws(" #", g, k.cast("string"))).alias("out"))

        return F.aggregate(c, start, step, lambda a: a["out"])

    hit = F.size(F.array_intersect(marked("p"), marked("r")))
    p, r = hit / F.greatest(F.size("p"), F.lit(1)), hit / F.greatest(F.size("r"), F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return ready.select(key, *keep, F.round(f, 6).alias(f"rouge{n}"))


def _labelled(scored: DataFrame, labels: list[dict], *group: str) -> DataFrame:
    """Means by configuration (and group), with the configuration's labels as string columns."""
    names = list(labels[0]) if labels else []
    shown = F.create_map(*(x for k, label in enumerate(labels) for x in (F.lit(k), F.array(*(F.lit(str(label[n])) for n in names)))))
    means = rouge_mean(scored, *group, "config")
    return means.select(*group, *(F.get(shown[F.col("config")], k).alias(n) for k, n in enumerate(names)), "rouge1", "rouge2", "rougeL")


_SCORED = "config int, rouge1 double, rouge2 double, rougeL double"


def _rounded(k: int, summary: str, reference: str | None) -> tuple:
    return (k, *(round(x, 6) for x in rouge.scores(summary, reference)))


def grid(docs: DataFrame, configs: list[tuple[dict, object]], group: str | None = None) -> DataFrame:
    """Mean ROUGE of every configuration over all documents ``id, sentences, highlights``, by group if one is given.

    One pass over the documents runs all configurations of a document side by side, and what they
    share of it (terms, base scores) is made once.
    """

    def make(row):
        ready = Prepared(row["sentences"])
        out = []
        for k, (_, cfg) in enumerate(configs):
            found = yield from summarizing(row["id"], ready, row["highlights"], cfg)
            out.append((row["grp"], *_rounded(k, found["summary"], row["highlights"])))
        return out

    chosen = docs.select("id", "sentences", "highlights", (F.col(group) if group else F.lit(None)).cast("string").alias("grp"))
    scored = per_document(dealt(chosen, [cfg for _, cfg in configs]), "grp string, " + _SCORED, make, together)
    if group:
        scored = scored.withColumnRenamed("grp", group)
    return _labelled(scored, [label for label, _ in configs], *([group] if group else []))


def united_places(views: list[list[int] | None], firsts: list[int | None], n: int) -> list[int]:
    """Distinct valid places of the views' first ones, ascending."""
    return sorted({i for v, k in zip(views, firsts) for i in (v or [])[:k] if i is not None and 0 <= i < n})


def reduced(ready: Prepared, places: list[int], dedup: float | None, cap: int | None) -> list[int]:
    """The places without near-duplicates, and of these the ``cap`` with the best base scores of the whole document."""
    if dedup and len(places) > 1:
        sim = K.TermVectors([ready.sentences[i] for i in places], pairs=True, sublinear=True).similarity()
        places = S.near_dropped(places, np.round(sim, 10), dedup)
    if cap and len(places) > cap:
        scores = np.round(ready.scores(Config()), 10)
        places = sorted(sorted(places, key=lambda i: (-scores[i], i))[:cap])
    return places


def _grid_steps(row, settings: list[dict], finals: list, view: Callable, dedup: float | None):
    """Steps to the ROUGE of every setting for one document; ``view`` gives the places of a side's k.

    Settings that differ in k1, k2 or cap often leave the same members: these share one sub-list, and
    with the same final method one selection and one value.
    """
    ready, cuts, lists, selected, valued, out = Prepared(row["sentences"]), {}, {}, {}, {}, []
    for k, (s, cfg) in enumerate(zip(settings, finals)):
        cut = (s["k1"], s["k2"], s["cap"])
        if cut not in cuts:
            places = united_places([view(ready, 0, s["k1"]), view(ready, 1, s["k2"])], [None, None], len(ready.sentences))
            cuts[cut] = tuple(reduced(ready, places, dedup, s["cap"]))
        places = cuts[cut]
        if places not in lists:
            lists[places] = Prepared([ready.sentences[i] for i in places])
        final = (places, s["method"], s["w_base"], s["alpha"])
        if final not in selected:
            selected[final] = (yield from summarizing(row["id"], lists[places], None, cfg))["summary"]
        summary = selected[final]
        if summary not in valued:
            valued[summary] = _rounded(k, summary, row["highlights"])[1:]
        out.append((k, *valued[summary]))
    return out


def fusion_grid(docs: DataFrame, settings: list[dict], base: str = "greedy", encoder: str = "bert", unit: str = "sentences", limit: int = 3, dedup: float | None = 0.95, seed: int = 2024) -> DataFrame:
    """Mean ROUGE of every setting ``k1, k2, cap, method, w_base, alpha`` over documents ``id, sentences, highlights``.

    The two views are the base selector with ``k1`` sentences and the encoder with ``k2``; documents
    that have ``view0`` and ``view1`` bring their own, cut to ``k1`` and ``k2`` places.  ``w_base``
    leaves 1 - w_base to the semantic score.  One pass: views are made once for each k, settings with
    the same union share its sub-list and selections, and all share the document's terms and scores.
    """
    limits = {"max_sentences": limit} if unit == "sentences" else {"max_tokens": limit}
    finals = [Config(method=s["method"], unit=unit, use_candidates=False, w_base=s["w_base"], w_semantic=1 - s["w_base"], alpha=s["alpha"], seed=seed, **limits) for s in settings]
    given = {"view0", "view1"} <= set(docs.columns)

    def make(row):
        views = {}

        def view(ready: Prepared, side: int, k: int) -> list[int]:
            if given:
                return (row[f"view{side}"] or [])[:k]
            if (side, k) not in views:
                views[side, k] = summarize_one(row["id"], ready, None, stage1(encoder if side else base, k))["selected_indices"]
            return views[side, k]

        return _grid_steps(row, settings, finals, view, dedup)

    chosen = docs.select("id", "sentences", "highlights", *(["view0", "view1"] if given else []))
    return _labelled(per_document(dealt(chosen, finals), _SCORED, make, together), settings)


def view_pipeline(docs: DataFrame, stages: list, last, cap: int | None = 100, dedup: float | None = None, embed=stand_in_embedding) -> DataFrame:
    """First-stage views of each document, their union, and the final selection: ``id, view0.., union, selected_indices, summary, reference``.

    Two base routes or three views (base, encoder, graph), all in one pass over ``id, sentences, highlights``.
    """

    def make(row):
        ready = Prepared(row["sentences"])
        views = []
        for cfg in stages:
            found = yield from summarizing(row["id"], ready, row["highlights"], cfg, embed)
            views.append(found["selected_indices"])
        union = reduced(ready, united_places(views, [None] * len(views), len(ready.sentences)), dedup, cap)
        found = yield from summarizing(row["id"], [ready.sentences[i] for i in union], None, last, embed)
        return [(row["id"], *views, union, [union[i] for i in found["selected_indices"]], found["summary"], row["highlights"] or "")]

    schema = "id string, " + ", ".join(f"view{k} array<int>" for k in range(len(stages))) + ", union array<int>, selected_indices array<int>, summary string, reference string"
    chosen = docs.select(F.col("id").cast("string").alias("id"), "sentences", "highlights")
    return per_document(dealt(chosen, [*stages, last]), schema, make, together)


def timed(phases: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, float]]:
    """Seconds of each phase, run in order."""
    out = []
    for name, run in phases:
        began = time.perf_counter()
        run()
        out.append((name, time.perf_counter() - began))
    return out


def timed_run(docs: DataFrame, cfg, path: str) -> DataFrame:
    """Select, write and evaluate with the seconds of each phase: ``metric, value``."""
    from ..sources import formats

    spark = docs.sparkSession
    kept: dict = {}

    def evaluate():
        kept["means"] = metric_rows(rouge_mean(rouge_rows(formats.read_jsonl(spark, f"{path}/predictions.jsonl", formats.PREDICTIONS), "id"))).collect()

    phases = timed([("select", lambda: formats.write_run(summarize(docs, cfg).drop("fallback_reason"), path, cfg.tree())), ("evaluate", evaluate)])
    rows = [(r.metric, r.value) for r in kept["means"]] + [(f"seconds_{name}", s) for name, s in phases]
    return spark.createDataFrame(rows, "metric string, value double")


def tune(docs: DataFrame, configs: dict[str, object], path: str) -> list[str]:
    """Run each named configuration into its folder unless it is complete there; names of those that ran."""
    from ..sources import formats

    ran = []
    for name, cfg in configs.items():
        if not formats.exists(docs.sparkSession, f"{path}/{name}/metrics/_SUCCESS"):
            formats.write_metrics(timed_run(docs, cfg, f"{path}/{name}"), f"{path}/{name}/metrics")
            ran.append(name)
    return ran


def rerank(df: DataFrame, w_ce: float = 1.0, w_base: float = 0.0, normalize: str = "minmax") -> DataFrame:
    """Order of the candidates ``array<struct<summary, indices, base_score, ce>>`` of each row.

    Scores are normalised within the row, fused and sorted falling, ties by place; the best comes
    first.  A missing cross-encoder score is 0.  Rows without candidates have an empty result.
    """
    from ..functions import scores as C

    rescale = {"minmax": C.minmax_unit, "zscore": C.zscore}.get(normalize, lambda c: c)
    base = F.transform("candidates", lambda c: F.coalesce(c["base_score"].cast("double"), F.lit(0.0)))
    ce = F.transform("candidates", lambda c: F.coalesce(c["ce"].cast("double"), F.lit(0.0)))
    fused = F.zip_with(rescale(ce), rescale(base), lambda a, b: F.round(a * w_ce + b * w_base, 10))
    order = C.ranked(fused)
    best = F.get("candidates", F.get(order, F.lit(0)))
    return df.select("id", order.alias("rerank_order"), F.coalesce(best["summary"], F.lit("")).alias("summary"), F.coalesce(best["indices"], F.expr("CAST(array() AS array<int>)")).alias("selected_indices"))


Scorer = Callable[[list[str], list[str]], list[float]]


def no_cross_encoder(texts: list[str], summaries: list[str]) -> list[float]:
    """The scorer without a model: every pair scores 0."""
    return [0.0] * len(texts)


class CrossEncoder:
    """A scorer of (text, summary) pairs whose model is loaded once a worker; no model is shipped."""

    def __init__(self, load: Callable[[], Scorer] | None = None, batch: int = 16):
        self.encoder = Encoder("cross-encoder", lambda: self._pairs(load), batch)

    @staticmethod
    def _pairs(load):
        if load is None:
            raise NotImplementedError("give the function that loads a cross-encoder")
        model = load()
        return lambda pairs: np.asarray(model([a for a, _ in pairs], [b for _, b in pairs]), float)

    def __call__(self, texts: list[str], summaries: list[str]) -> list[float]:
        return self.encoder(list(zip(texts, summaries))).ravel().tolist() if texts else []


def rerank_job(df: DataFrame, enabled: bool = True, scorer: Scorer = no_cross_encoder, w_ce: float = 1.0, w_base: float = 0.0, normalize: str = "minmax") -> DataFrame:
    """Rerank ``id, article or document, candidates`` by a scorer; an error if reranking is switched off.

    A missing text is empty; rows without candidates have an empty result.
    """
    if not enabled:
        raise ValueError("reranking is disabled in the configuration")

    def make(row):
        found = row["candidates"] or []
        ce = scorer([row["text"] or ""] * len(found), [c["summary"] or "" for c in found])
        return [(row["id"], [(c["summary"], c["indices"], c["base_score"], float(x)) for c, x in zip(found, ce)])]

    text = F.coalesce(*(F.col(c) for c in ("article", "document") if c in df.columns), F.lit(""))
    scored = per_document(df.select("id", text.alias("text"), "candidates"), "id string, candidates array<struct<summary:string,indices:array<int>,base_score:double,ce:double>>", make)
    return rerank(scored, w_ce, w_base, normalize)


def abstract(df: DataFrame, load: Callable[[], Callable[..., list[str]]] | None, id_column: str = "id", text_column: str = "article", beams: int = 4, most_in: int = 1024, most_out: int = 128, batch: int = 16) -> DataFrame:
    """``id, summary`` by an abstractive model that ``load`` makes once a worker; no model is shipped.

    The model gets a list of texts and ``beams, most_in, most_out``.
    """
    if load is None:
        raise NotImplementedError("give the function that loads an abstractive model")

    def run(batches):
        model = load()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            found = [x for k in range(0, len(texts), batch) for x in model(texts[k : k + batch], beams=beams, most_in=most_in, most_out=most_out)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["id", "summary"])

    return df.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id string, summary string")
