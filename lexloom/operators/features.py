"""Sentence features as DataFrame operators; every one is narrow (a document is one row)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as C
from ..functions import text as T
from . import kernels as K
from .arrow import per_document


def documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 3, most: int | None = None) -> DataFrame:
    """``doc_id, sentences`` of raw texts: split, short sentences dropped, optionally cut off.

    Null and empty texts keep their row with an empty list.
    """
    kept = T.first_sentences(T.at_least(T.split_sentences(F.col(f"`{text_column}`")), least), most)
    return df.select(F.col(f"`{id_column}`").alias("doc_id"), kept.alias("sentences"))


def long_form(df: DataFrame, values: Column, name: str) -> DataFrame:
    """One row per element: ``doc_id, pos, <name>``."""
    return df.select("doc_id", F.posexplode(values).alias("pos", name)).withColumn("pos", F.col("pos").cast("bigint"))


def with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_tokens", F.transform("sentences", lambda s: T.count_tokens(s)))


def kernel_scores(docs: DataFrame, name: str, kernel: Callable[[list[str]], np.ndarray], digits: int = 6) -> DataFrame:
    """``doc_id, pos, <name>`` of a kernel that scores the sentences of a document."""

    def make(row):
        s = row["sentences"] or []
        return [(row["doc_id"], k, round(float(x), digits) + 0.0) for k, x in enumerate(kernel(s))] if s else []

    return per_document(docs.select("doc_id", "sentences"), f"doc_id bigint, pos bigint, {name} double", make)


def kernel_array(docs: DataFrame, name: str, kernel: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The documents with a parallel array of scores."""

    def make(row):
        s = row["sentences"] or []
        return [(row["doc_id"], s, kernel(s).tolist() if s else [])]

    kind = dict(docs.dtypes)["doc_id"]
    return per_document(docs.select("doc_id", "sentences"), f"doc_id {kind}, sentences array<string>, {name} array<double>", make)


def base_parts(docs: DataFrame) -> DataFrame:
    """Importance (kernel), length and position (columns) of every sentence, as parallel arrays."""
    scored = with_lengths(kernel_array(docs, "importance", K.tf_isf))
    n = F.size("sentences")
    return scored.select("doc_id", "sentences", "n_tokens", "importance", C.length_scores(F.col("n_tokens")).alias("length"), C.position_scores(n).alias("position"))


V1_WEIGHTS = {"importance": 1.0, "length": 0.3, "position": 0.3}


def base_scores_v1(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The documents with ``n_tokens`` and the combined ``score`` of each sentence."""
    parts = base_parts(docs)
    features = {k: F.col(k) for k in ("importance", "length", "position")}
    return parts.select("doc_id", "sentences", "n_tokens", C.combine_v1(features, weights or V1_WEIGHTS).alias("score"))


def base_scores_v2(docs: DataFrame, weights: dict | None = None, interactions=(("importance", "position", 0.5),)) -> DataFrame:
    """The second fusion: rescaled features, weighted products, rescaled again."""
    parts = base_parts(docs)
    features = {k: F.col(k) for k in ("importance", "length", "position")}
    return parts.select("doc_id", "sentences", C.combine_v2(features, weights or V1_WEIGHTS, interactions).alias("score"))


def feature_dump(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id, base_scores, n_sentences`` per document."""
    return base_scores_v1(docs).select(F.col("doc_id").alias(id_column), F.col("score").alias("base_scores"), F.size("sentences").alias("n_sentences"))


def term_weights(docs: DataFrame, pairs: bool = False, sublinear: bool = False) -> DataFrame:
    """Sentence-term matrix in long form: ``doc_id, pos, term, weight``."""

    def make(row):
        v = K.TermVectors(row["sentences"] or [], pairs, sublinear)
        return [(row["doc_id"], int(i), v.terms[c], round(float(w), 6)) for i, c, w in zip(v.rows, v.columns, v.weights)]

    return per_document(docs.select("doc_id", "sentences"), "doc_id bigint, pos bigint, term string, weight double", make)


def nearest_similarity(sentences: list[str]) -> np.ndarray:
    """Similarity of each sentence to the most similar other one; 0 for a lone sentence."""
    if len(sentences) < 2:
        return np.zeros(len(sentences))
    out = []
    for first, block in K.TermVectors(sentences).blocks():
        here = np.arange(len(block))
        block[here, first + here] = -1
        out.append(block.max(axis=1))
    return np.concatenate(out)


def group_embedding_rank(df: DataFrame, group: str = "label", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``group, key, score``: cosine of each embedding and the mean of its group.

    Sums are combined on the map side, per Arrow batch and then per group, so a hot group costs one
    partial row a batch.  A group's mean joins back on the group; rows with a null vector or group
    are left out.
    """
    import pyarrow as pa

    rows = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("key"), F.col(group).cast("bigint").alias("grp"), F.col(vector).cast("array<double>").alias("v"))

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("grp").to_numpy()
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
            names, back = np.unique(g, return_inverse=True)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, back, x)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(back)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["grp", "n", "total"])

    parts = rows.select("grp", "v").mapInArrow(partial, "grp bigint, n bigint, total array<double>")
    summed = parts.select("grp", "n", F.posexplode("total").alias("d", "x")).groupBy("grp", "d").agg((F.sum("x") / F.sum("n")).alias("m"))
    means = summed.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    score = dot(F.col("v"), F.col("mean")) / ((F.sqrt(dot(F.col("v"), F.col("v"))) + 1e-12) * (F.sqrt(dot(F.col("mean"), F.col("mean"))) + 1e-12))
    return rows.join(means, "grp").select(F.col("grp").alias(group), F.col("key").alias(key), score.alias("score"))
