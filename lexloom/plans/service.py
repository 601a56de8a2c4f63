"""The request surface: validation, two-stage orchestration, and SQL functions."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import kernels as K
from ..operators import rouge
from ..operators.arrow import per_document
from ..operators.summarize import Prepared, summarize_one
from .config import ENCODERS, REQUEST_PRESETS, stage1, stage2

STAGE1, STAGE2 = ("greedy", "grasp", "nsga2"), ("fast", "fast_grasp", "fast_nsga2", "greedy")


def health() -> dict:
    return {"status": "ok"}


@dataclass
class Request:
    """A validated request; the unit decides which limit is required, the other one is dropped."""

    documents: list[str]
    algorithms: list[str]
    encoders: list[str] = field(default_factory=list)
    candidate_k: int = 25
    method: str = "fast"
    union_cap: int = 15
    unit: str = "sentences"
    max_sentences: int | None = None
    max_tokens: int | None = None
    reference: str | None = None

    def __post_init__(self):
        def need(ok, what):
            if not ok:
                raise ValueError(what)

        need(len(self.documents) >= 1, "at least one document is required")
        need(len(self.algorithms) >= 1 and set(self.algorithms) <= set(STAGE1), "unknown or missing first-stage algorithm")
        need(set(self.encoders) <= set(ENCODERS), "unknown encoder")
        need(self.method in STAGE2, "unknown second-stage method")
        need(self.candidate_k >= 1 and self.union_cap >= 1, "candidate_k and union_cap start at 1")
        need(self.unit in ("sentences", "tokens"), "unit is sentences or tokens")
        if self.unit == "sentences":
            need(self.max_sentences is not None and self.max_sentences >= 1, "max_sentences is required when the unit is sentences")
            self.max_tokens = None
        else:
            need(self.max_tokens is not None and self.max_tokens >= 10, "max_tokens is required when the unit is tokens")
            self.max_sentences = None

    @property
    def limit(self) -> int:
        return self.max_sentences if self.unit == "sentences" else self.max_tokens

    @staticmethod
    def of(body: dict) -> Request:
        """From the nested wire form."""
        one, two, length = body.get("stage1") or {}, body.get("stage2") or {}, body.get("length_control") or {}
        return Request(
            list(body.get("documents") or []), list(one.get("algorithms") or []), list(one.get("llms") or []), int(one.get("candidate_k", 25)),
            two.get("method", "fast"), int(two.get("union_cap", 15)), length.get("unit", ""), length.get("max_sentences"), length.get("max_tokens"), body.get("reference"),
        )


def payload_of(preset: str, text: str, algorithm: str = "greedy", encoder: str | None = None) -> dict:
    """The wire form of a preset for a text with documents parted by lines of dashes."""
    unit, limit, k, cap = REQUEST_PRESETS[preset]
    parts = [p.strip() for p in re.split(r"\n-{3,}\n", text)]
    return {
        "documents": [p for p in parts if p],
        "stage1": {"algorithms": [algorithm], "llms": [encoder] if encoder else [], "candidate_k": k},
        "stage2": {"method": "fast", "union_cap": cap},
        "length_control": {"unit": unit, f"max_{unit}": limit},
    }


def legacy_request(body: dict) -> Request:
    """A request of the earlier flat form: one text, and token limits as sentences of 20 tokens.

    Keys: ``text`` (documents parted by lines of dashes) or ``documents``, ``base`` and ``llm`` (names
    of the first-stage selectors), ``k``, ``method``, ``cap``, ``unit``, ``limit``.
    """
    documents = body.get("documents") or [p for p in (x.strip() for x in re.split(r"\n-{3,}\n", body.get("text") or "")) if p]
    limit = int(body.get("limit") or 3)
    if body.get("unit") == "tokens":
        limit = max(1, limit // 20)
    encoder = body.get("llm")
    return Request(list(documents), [body.get("base") or "greedy"], [encoder] if encoder else [], int(body.get("k") or 25), body.get("method") or "fast", int(body.get("cap") or 15), "sentences", limit, reference=body.get("reference"))


def request_documents(df: DataFrame, texts: str = "documents") -> DataFrame:
    """Sentences of all documents of a request in one list; short sentences stay."""
    return df.withColumn("sentences", F.flatten(F.transform(texts, T.split_sentences)))


def two_stage(df: DataFrame, request: Request) -> DataFrame:
    """Both stages over documents ``id, sentences``: the plan of a request for any number of rows.

    One narrow pass runs the stages of a document one behind the other, so repeated ids stay rows
    of their own.  Selections come back in the order of the union, base first, which need not be
    document order.
    """
    names = ["base", *request.encoders]
    stages = [stage1(m, request.candidate_k) for m in (request.algorithms[0], *request.encoders)]
    last = stage2(request.method, request.unit, request.limit)

    def make(row):
        ready = Prepared(row["sentences"])
        views = [summarize_one(row["id"], ready, None, cfg)["selected_indices"] for cfg in stages]
        union = list(dict.fromkeys(i for v in views for i in v))[: request.union_cap]
        final = summarize_one(row["id"], [ready.sentences[i] for i in union], None, last)["selected_indices"]
        places = [union[i] for i in final]
        text = lambda at: " ".join(ready.sentences[i] for i in at)
        return [(row["id"], text(places), places, union, *views, text(views[0]), row["sentences"])]

    schema = "id string, summary string, selected_indices array<int>, candidate_indices array<int>, " + ", ".join(f"`{n}` array<int>" for n in names) + ", base_summary string, sentences array<string>"
    return per_document(df.select(F.col("id").cast("string").alias("id"), "sentences"), schema, make)


def answer(spark: SparkSession, body: dict) -> dict:
    """Answer one request; invalid ones raise ValueError."""
    request = Request.of(body)
    began = time.perf_counter()
    one = request_documents(spark.createDataFrame([("doc", request.documents)], "id string, documents array<string>")).select("id", "sentences")
    row = two_stage(one, request).first()
    if not row["sentences"]:
        raise ValueError("the documents hold no sentence")
    pick = lambda places: [row["sentences"][i] for i in places]
    stage = lambda name, places: {"method": name, "selected_indices": places, "sentences": pick(places), "summary": " ".join(pick(places))}
    metrics = None
    if request.reference:
        metrics = dict(zip(("rouge1", "rouge2", "rougeL"), rouge.scores(row["summary"], request.reference)))
    return {
        "summary": row["summary"], "sentences": pick(row["selected_indices"]), "selected_indices": row["selected_indices"], "candidate_indices": row["candidate_indices"],
        "stage1_base": stage(request.algorithms[0], row["base"]), "stage1_llms": [stage(e, row[e]) for e in request.encoders],
        "metrics": metrics, "timing": {"seconds": time.perf_counter() - began},
    }


def handle(spark: SparkSession, body: dict) -> tuple[int, dict]:
    """Status and body: 400 for an invalid request, 500 for any other failure."""
    try:
        return 200, answer(spark, body)
    except ValueError as e:
        return 400, {"detail": str(e)}
    except Exception as e:  # noqa: BLE001
        return 500, {"detail": str(e)}


def register_functions(spark: SparkSession) -> None:
    """SQL functions: count_tokens, split_sentences, summarize_sentences, textrank, rouge_f, sentence_tokens."""
    from .config import Config

    # plain SQL expressions where columns can say it: they stay inside code generation
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION split_sentences(x STRING) RETURNS ARRAY<STRING> RETURN {T.SQL_SPLIT.format('x')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(x STRING) RETURNS INT RETURN {T.SQL_COUNT.format('x')}")

    @F.pandas_udf("array<double>")
    def textrank(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda s: K.textrank(K.TermVectors(list(s))).tolist() if s is not None and len(s) else [])

    @F.pandas_udf("double")
    def rouge_f(predicted: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([rouge.scores(a, b)[0] for a, b in zip(predicted, reference)])

    @F.pandas_udf("selected_indices array<int>, summary string")
    def summarize_sentences(sentences: pd.Series, method: pd.Series) -> pd.DataFrame:
        found = [summarize_one("row", list(s) if s is not None else [], None, Config(method=m)) for s, m in zip(sentences, method)]
        return pd.DataFrame({k: [f[k] for f in found] for k in ("selected_indices", "summary")})

    @F.udtf(returnType="pos int, token string")
    class SentenceTokens:
        def eval(self, sentence: str):
            for k, t in enumerate(K.vectorizer_tokens(sentence or "")):
                yield k, t

    for f in (textrank, rouge_f, summarize_sentences):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("sentence_tokens", SentenceTokens)


def python_split(text: str | None) -> list[str]:
    """The sentence split of :func:`text.split_sentences` for a single value."""
    plain = " ".join((text or "").split())
    return [p.strip() for p in re.split(r"(?<=[.!?。！？]) *", plain) if p.strip()]
