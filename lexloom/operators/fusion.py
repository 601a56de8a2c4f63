"""Fusion of views of a document: last row per id, union of selections, cap, sub-list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import kernels as K
from . import selectors as S
from .arrow import per_document

_NONE = "CAST(array() AS array<int>)"


def last_by_id(df: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each id by ``order``; null ids are dropped.

    An aggregate with map-side combine, so a hot id costs one row a task.
    """
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return df.where("id IS NOT NULL").groupBy("id").agg(best.alias("last")).select("id", "last.*")


def union_places(views: list[Column], n: Column, first: list[int | None] | None = None) -> Column:
    """Distinct places of several selections, ascending, within range; ``first`` cuts each view.

    Selections are in document order, so the first k of a view are its first k by position.
    """
    cuts = first or [None] * len(views)
    ready = [F.coalesce(v if k is None else F.slice(v, 1, k), F.expr(_NONE)) for v, k in zip(views, cuts)]
    return F.array_sort(F.array_distinct(T.within(F.concat(*ready), n)))


def union_views(docs: DataFrame, views: list[DataFrame], first: list[int | None] | None = None) -> DataFrame:
    """``id, sentences, orig_indices``: documents left-joined with their selections, one equi-join a view."""
    joined = docs
    for k, v in enumerate(views):
        joined = joined.join(v.select("id", F.col("selected_indices").alias(f"view{k}")), "id", "left")
    places = union_places([F.col(f"view{k}") for k in range(len(views))], F.size("sentences"), first)
    return joined.select("id", "sentences", places.alias("orig_indices"))


def ordered_union(views: list[Column], cap: int) -> Column:
    """First occurrences in the order of the views, cut at ``cap``."""
    return F.slice(F.array_distinct(F.concat(*(F.coalesce(v, F.expr(_NONE)) for v in views))), 1, cap)


def capped(united: DataFrame, cap: int, rank_by: str = "score") -> DataFrame:
    """Keep the ``cap`` members with the best base score over the whole document (or most words)."""
    if rank_by == "words":
        scored = united.withColumn("score", F.transform("sentences", lambda s: T.count_tokens(s).cast("double")))
    else:
        scored = _with_scores(united)
    pool = F.transform("orig_indices", lambda i: F.struct((-F.get("score", i)).alias("s"), i.alias("i")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(pool), 1, cap), lambda x: x["i"]))
    return scored.select("id", "sentences", best.alias("orig_indices"))


def _with_scores(united: DataFrame) -> DataFrame:
    from .summarize import costs

    def make(row):
        s = row["sentences"] or []
        n = len(s)
        score = np.zeros(0)
        if n:
            place = np.ones(1) if n == 1 else 1 - np.arange(n) / (n - 1)
            length = K.over_max(np.minimum(costs(s), 40).astype(float))
            score = K.over_max(K.tf_isf(s) + 0.3 * length + 0.3 * place)
        return [(row["id"], s, row["orig_indices"], np.round(score, 10).tolist())]

    return per_document(united.select("id", "sentences", "orig_indices"), "id string, sentences array<string>, orig_indices array<int>, score array<double>", make)


def near_dropped(united: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Drop members too similar to an earlier kept one, by 1-2-gram cosine on the sub-list."""

    def make(row):
        s, places = row["sentences"] or [], row["orig_indices"] or []
        if len(places) > 1:
            sim = np.round(K.TermVectors([s[i] or "" for i in places], pairs=True, sublinear=True).similarity(), 10)
            places = S.near_dropped(places, sim, threshold)
        return [(row["id"], s, places)]

    return per_document(united.select("id", "sentences", "orig_indices"), "id string, sentences array<string>, orig_indices array<int>", make)


def sub_lists(united: DataFrame) -> DataFrame:
    """The union document: its sentences are the members, ``orig_indices`` keeps their places."""
    return united.select("id", F.transform("orig_indices", lambda i: F.get("sentences", i)).alias("sentences"), "orig_indices")


def three_views(docs: DataFrame, views: list[DataFrame], first=None, dedup: float | None = None, cap: int | None = None, rank_by: str = "score") -> DataFrame:
    """Second-stage input: union, near-duplicates dropped, cap, sub-list."""
    united = union_views(docs, views, first)
    if dedup:
        united = near_dropped(united, dedup)
    if cap:
        united = capped(united, cap, rank_by)
    return sub_lists(united)
