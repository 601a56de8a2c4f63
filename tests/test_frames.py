"""DataFrame operators on small fixtures: nulls, empty tables, ties, clashing columns."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom.functions import scores as C
from lexloom.functions import text as T
from lexloom.operators import evaluation, features, fusion
from lexloom.operators import kernels as K
from lexloom.operators.summarize import summarize
from lexloom.plans import registry, service
from lexloom.plans.config import Config
from lexloom.sources import formats
from lexloom.streaming import read_documents, summarize_stream

TEXTS = [None, "", "   ", "...", "one sentence without an end", "A b c d. E f g h! 你好。世界 很 大！ x", "The cat sat here. The cat sat here. The cat sat here."]


def test_text_columns(spark):
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, pos int")
    rows = df.select("doc_id", T.split_sentences(F.col("text")).alias("s"), T.count_tokens(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r.s for r in rows] == [service.python_split(t) for t in TEXTS]
    assert [r.n for r in rows] == [len((t or "").split()) for t in TEXTS]
    kept = features.documents(df).orderBy("doc_id").collect()
    assert [len(r.sentences) for r in kept] == [0, 0, 0, 0, 1, 3, 3]
    assert features.documents(df.limit(0)).count() == 0


def test_columns_equal_kernels(spark):
    lists = [[3.0, 1.0, 2.0, 2.0], [1.0], [], [2.0, 2.0], [-1.0, -2.0]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<double>")
    got = df.select("k", C.minmax(F.col("v")).alias("a"), C.minmax_zero(F.col("v")).alias("b"), C.over_max(F.col("v")).alias("c"), C.ranked(F.col("v")).alias("d"), C.zscore(F.col("v")).alias("e")).orderBy("k").collect()
    import numpy as np

    for r, v in zip(got, lists):
        x = np.array(v)
        assert np.allclose(r.a, K.minmax(x)) and np.allclose(r.b, K.minmax_zero(x)) and np.allclose(r.c, K.over_max(x)) and r.d == K.ranks(x).tolist()
        assert not len(v) or abs(sum(r.e)) < 1e-9


def test_budget_columns(spark):
    df = spark.createDataFrame([([5, 4, 3, 2],)], "cost array<int>")
    row = df.select(C.fill_budget(F.expr("array(0,1,2,3)"), F.col("cost"), 8).alias("a"), C.trim_budget(F.col("cost"), 9).alias("b"), C.trim_budget(F.col("cost"), 1).alias("c"), C.boosted(F.expr("array(1.0D,2.0D)"), F.expr("array(1)")).alias("d")).first()
    assert row.a == [0, 2] and row.b == [0, 1] and row.c == [] and row.d == [1.0, 2.1]


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    """Tables of the test layout, small and dirty."""
    d = tmp_path_factory.mktemp("sf")
    docs = [(k, t, "en", "s", 1, "train", None) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, split_name string, crawled_at timestamp").write.parquet(f"{d}/documents.parquet")
    arts = [(k, f"train_{k % 3}", t, "- Summary of it", "train", "s", None, None) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(arts, "row_id bigint, id string, article string, highlights string, split_name string, source string, published_at timestamp, loaded_at timestamp").write.parquet(f"{d}/articles.parquet")
    proc = [("a", ["One two three.", "Four five six.", "One two three."], "One two"), ("a", ["Later wins here."], "z"), ("b", [], ""), ("c", None, None), (None, ["No id here."], "")]
    spark.createDataFrame(proc, "id string, sentences array<string>, highlights string").write.parquet(f"{d}/processed.parquet")
    preds = [(1, "greedy-k10-stage1", "a", [2, 0, 0, 99], "one two", "One two three", None), (2, "nsga2-k10-stage1", "a", None, None, "x", None), (3, "fast-k10-stage1", "zz", [0], "", None, None), (4, "greedy-k10-stage1", "b", [], "b", "b", None)]
    spark.createDataFrame(preds, "pred_id bigint, run_id string, id string, selected_indices array<int>, summary string, reference string, written_at timestamp").write.parquet(f"{d}/predictions.parquet")
    spark.createDataFrame([(0, "greedy-k10-stage1", "greedy", "stage1", 10, 100, 1), (1, "x", "fast", "stage2", 3, 245, 2)], "run_no int, run_id string, selector string, stage_name string, keep_k int, max_tokens int, seed int").write.parquet(f"{d}/runs.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [1.0, 1.0], None)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([("en", "English"), ("fr", "French")], "lang string, lang_title string").write.parquet(f"{d}/languages.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_every_query_on_dirty_tables(spark, small, name):
    rows = registry.queries()[name](spark, small).collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for t in ("documents", "articles", "processed", "predictions", "runs", "embeddings", "languages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet/*.parquet')")
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    shown = lambda v: f"{v + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else "[" + ",".join(map(shown, v)) + "]" if isinstance(v, list) else str(v)
    want = sorted([shown(dict(zip(names, r))[c]) for c in sorted(names)] for r in found.fetchall())
    assert sorted([shown(r[c]) for c in sorted(names)] for r in rows) == want


def test_union_forms(spark):
    docs = spark.createDataFrame([("a", ["s0 x y", "s1 x y", "s2 x y"]), ("b", [])], "id string, sentences array<string>")
    one = spark.createDataFrame([("a", [2, 0]), ("q", [1])], "id string, selected_indices array<int>")
    two = spark.createDataFrame([("a", [1, 7, -1])], "id string, selected_indices array<int>")
    united = {r.id: r.orig_indices for r in fusion.union_views(docs, [one, two]).collect()}
    assert united == {"a": [0, 1, 2], "b": []}
    sub = {r.id: (r.sentences, r.orig_indices) for r in fusion.three_views(docs, [one, two], dedup=0.95, cap=2, rank_by="words").collect()}
    assert sub["a"][1] == [0, 1] and sub["a"][0] == ["s0 x y", "s1 x y"]


def test_rerank(spark):
    df = spark.createDataFrame([("a", [("x", [1], 0.2, 0.9), ("y", [2], 0.8, 0.1)]), ("b", [])], "id string, candidates array<struct<summary:string,indices:array<int>,base_score:double,ce:double>>")
    rows = {r.id: r for r in evaluation.rerank(df, 0.0, 1.0).collect()}
    assert rows["a"].rerank_order == [1, 0] and rows["a"].summary == "y" and rows["b"].summary == "" and rows["b"].selected_indices == []


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame([(str(k), [f"word{k} is {j} of many words here" for j in range(20)], "word") for k in range(12)], "id string, sentences array<string>, highlights string")
    for method in ("grasp", "nsga2"):
        cfg = Config(method=method, seed=5, k=18, max_tokens=40, pop_size=20, n_gen=10)
        a, b = ({r.id: r.selected_indices for r in summarize(docs.repartition(n), cfg).collect()} for n in (1, 5))
        assert a == b


def test_files(spark, tmp_path):
    raw = spark.createDataFrame([("1", 'He said "one, two".\nNext line here now.', None), ("2", None, "h")], formats.RAW)
    formats.write_csv(raw, f"{tmp_path}/raw")
    back = formats.read_csv(spark, f"{tmp_path}/raw")
    assert {r.id: r.article for r in back.collect()} == {"1": 'He said "one, two".\nNext line here now.', "2": None}
    ready = formats.preprocess(back)
    formats.write_jsonl(ready, f"{tmp_path}/ready")
    assert {r.id: len(r.sentences) for r in formats.read_jsonl(spark, f"{tmp_path}/ready").collect()} == {"1": 2, "2": 0}
    topic = tmp_path / "duc" / "d01"
    topic.mkdir(parents=True)
    (topic / "b.S").write_text('<DOC><TEXT><s n="1"> Second file. </s></TEXT></DOC>')
    (topic / "a.S").write_text('<TEXT>\n<s n="1">First one.</s> <s n="2">And two.</s></TEXT><s>no</s>')
    (tmp_path / "duc" / "d01.A").write_text("The summary.\n")
    row = formats.tagged_topics(spark, f"{tmp_path}/duc").first()
    assert (row.id, row.article, row.highlights) == ("d01", "First one. And two.\nSecond file.", "The summary.")
    names = spark.createDataFrame([("tune1-grasp-k20-20240101-101010",), ("tune2-fused-k15-k22-cap9-wb0.5-a0.7-20240101-101010",), ("fast2-fast_grasp-k13-k24-cap7-20240101-101010-x",), ("other",)], "name string")
    assert [(r.stage, r.method, r.k1, r.k2, r.cap) for r in formats.run_layout(names).collect()] == [("stage1", "grasp", 20, None, None), ("stage2", "fused", 5, 2, 9), ("stage2", "fast_grasp", 3, 4, 7), (None,) * 5]
    metrics = spark.createDataFrame([("rouge1", 0.5)], "metric string, value double")
    formats.write_metrics(metrics, f"{tmp_path}/m", {"seconds": 1.25})
    assert {r.metric: r.value for r in formats.read_metrics(spark, f"{tmp_path}/m").collect()} == {"rouge1": 0.5, "seconds": 1.25}
    formats.write_run(ready, f"{tmp_path}/run", {"k": 1})
    assert json.load(open(f"{tmp_path}/run/config_used.json")) == {"k": 1}
    (tmp_path / "valid.jsonl").write_text("")
    assert formats.split_path(spark, str(tmp_path), "validation").endswith("valid.jsonl") and formats.split_path(spark, str(tmp_path), "nope") is None
    with pytest.raises(ValueError):
        formats.sample_n(ready, "id", 1, 0.5)
    assert formats.sample_n(ready, "id", 1).count() == 1 and formats.sample_n(ready, "id", share=1.0).count() == 2


def test_service(spark):
    assert service.health() == {"status": "ok"}
    text = "The cat sat on the mat. Dogs bark at night loudly.\n---\nBirds fly south in winter. Fish swim in the sea. Cats chase birds."
    body = {**service.payload_of("news-3sent", text, "greedy", "bert"), "reference": "Cats chase birds."}
    status, out = service.handle(spark, body)
    assert status == 200 and len(out["selected_indices"]) == 3 and set(out["selected_indices"]) <= set(out["candidate_indices"]) and out["metrics"]["rouge1"] > 0
    assert service.handle(spark, {"documents": []})[0] == 400
    assert service.handle(spark, {**body, "documents": ["  "]})[0] == 400
    assert service.handle(spark, {**body, "length_control": {"unit": "tokens"}})[0] == 400


def test_service_passes_keep_repeated_ids(spark):
    docs = spark.createDataFrame([("a", ["One two three.", "Four five six."]), ("a", ["Other words stand here."]), ("b", None)], "id string, sentences array<string>")
    rows = service.two_stage(docs, service.Request(["-"], ["greedy"], ["bert"], max_sentences=1)).collect()
    assert sorted((r.id, len(r.selected_indices)) for r in rows) == [("a", 1), ("a", 1), ("b", 0)]
    flat = service.legacy_request({"text": "A b.\n----\nC d.", "unit": "tokens", "limit": 60, "llm": "bert"})
    assert flat.documents == ["A b.", "C d."] and flat.max_sentences == 3 and flat.encoders == ["bert"]


def test_models_are_asked_for(spark):
    df = spark.createDataFrame([("a", "text")], "id string, article string")
    with pytest.raises(NotImplementedError):
        evaluation.abstract(df, None)
    made = evaluation.abstract(df, lambda: lambda texts, beams, most_in, most_out: [f"{t} {beams} {most_in} {most_out}" for t in texts])
    assert made.first().summary == "text 4 1024 128"
    pairs = spark.createDataFrame([("a", "x", [("s", [1], 0.5), ("t", [2], 0.1)]), ("b", None, None)], "id string, article string, candidates array<struct<summary:string,indices:array<int>,base_score:double>>")
    with pytest.raises(ValueError):
        evaluation.rerank_job(pairs, enabled=False)
    with pytest.raises(NotImplementedError):
        evaluation.CrossEncoder()(["a"], ["b"])
    scorer = evaluation.CrossEncoder(lambda: lambda texts, sums: [float(len(s) + (s == "t")) for s in sums])
    assert {r.id: r.rerank_order for r in evaluation.rerank_job(pairs, scorer=scorer).collect()} == {"a": [1, 0], "b": []}


def test_cluster_needs_a_shared_folder(spark):
    from lexloom.sources import tables

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(RuntimeError):
        tables.shared_folder(Far)


def test_sql_functions(spark):
    service.register_functions(spark)
    row = spark.sql("SELECT split_sentences('A b. C d!') s, count_tokens('a b c') n, rouge_f('a cat', 'a cat') r, size(textrank(array('red fox', 'red cat'))) k, summarize_sentences(array('one two', 'three four'), 'greedy').summary z").first()
    assert (row.s, row.n, row.r, row.k, row.z) == (["A b.", "C d!"], 3, 1.0, 2, "one two three four")
    assert spark.sql("SELECT token FROM sentence_tokens('Red fox')").count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "1", "sentences": ["One two three.", "Four five six."], "highlights": ""}\n')
    summarize_stream(read_documents(spark, f"{tmp_path}/in"), Config(), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination(60)
    assert [r.selected_indices for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [[0, 1]]


def test_searched_documents_reach_all_cores(spark):
    """Rows that lie in one split (a large file with few row groups) are searched on every core."""
    rows = spark.range(0, 64, numPartitions=8).where("id < 8").selectExpr("CAST(id AS string) AS id", "array('a b c', 'd e', concat('f', id)) AS sentences")
    assert rows.rdd.getNumPartitions() == 8
    found = summarize(rows, Config(method="nsga2", seed=1, pop_size=4, n_gen=2))
    assert sum(len(part) > 0 for part in found.rdd.glom().collect()) >= 4
    assert summarize(rows, Config()).rdd.getNumPartitions() == 8


def test_views_with_a_search_reach_all_cores(spark):
    """Every pass with a search in one of its steps deals its documents, those without one do not."""
    rows = spark.range(0, 64, numPartitions=8).where("id < 8").selectExpr("CAST(id AS string) AS id", "array('a b c', 'd e', concat('f', id)) AS sentences", "'a b' AS highlights")
    search = Config(method="nsga2", seed=1, pop_size=4, n_gen=2)
    for stages, last in (([search], Config()), ([Config()], search)):
        found = evaluation.view_pipeline(rows, stages, last)
        assert sum(len(part) > 0 for part in found.rdd.glom().collect()) >= 4
    assert evaluation.view_pipeline(rows, [Config()], Config()).rdd.getNumPartitions() == 8
