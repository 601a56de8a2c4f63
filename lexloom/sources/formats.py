"""File sources and sinks: CSV, JSON lines, tagged topic folders, metrics and run sidecars."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RAW = "id string, article string, highlights string"
PROCESSED = "id string, sentences array<string>, highlights string"
PREDICTIONS = "id string, selected_indices array<int>, summary string, reference string"
FEATURES = "id string, base_scores array<double>, n_sentences int"
CANDIDATES = "id string, article string, document string, candidates array<struct<summary:string,indices:array<int>,base_score:double>>, reference string, highlights string"
TUNING = "base_optimizer string, k1 string, k2 string, cap string, method string, w_bert string, alpha string, rouge1 string, rouge2 string, rougeL string, pred string"


def read_csv(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """A CSV with a header; quoted fields may span lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = PROCESSED) -> DataFrame:
    """JSON lines by a given schema (never inferred); blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def preprocess(raw: DataFrame, least: int = 3, most: int | None = None, n: int | None = None, share: float | None = None, limit: int | None = None, seed: int = 2024) -> DataFrame:
    """``id, sentences, highlights`` of raw rows; missing texts are empty.

    Rows may be sampled (a number or a share), and then the first ``limit`` by id taken.
    """
    raw = sample_n(raw, "id", n, share, seed)
    raw = raw.orderBy("id").limit(limit) if limit else raw
    kept = T.first_sentences(T.at_least(T.split_sentences(F.col("article")), least), most)
    return raw.select(F.col("id").cast("string").alias("id"), kept.alias("sentences"), F.coalesce("highlights", F.lit("")).alias("highlights"))


def hub_rows(raw: DataFrame, split: str, limit: int = 0, document: str = "document", summary: str = "summary", key: str = "row") -> DataFrame:
    """Rows of a multi-report set: separators become spaces, ids are ``<split>_<n>``.

    ``key`` numbers the rows; a limit of 0 means all.
    """
    rows = raw.orderBy(key).limit(limit) if limit else raw
    kept = T.at_least(T.split_sentences(T.without_separators(F.col(document))))
    return rows.select(F.concat_ws("_", F.lit(split), F.col(key).cast("string")).alias("id"), kept.alias("sentences"), T.without_dash(F.trim(F.coalesce(F.col(summary), F.lit("")))).alias("highlights"))


def tagged_topics(spark: SparkSession, root: str) -> DataFrame:
    """``id, article, highlights`` of topic folders ``<root>/<topic>/*.S`` with summaries ``<root>/<topic>.A``.

    The sentence elements inside each TEXT block are joined by spaces, the documents of a topic by
    line feeds in the order of their file names; a missing summary is empty.
    """
    files = spark.read.text(f"{root}/*/*.S", wholetext=True).withColumn("path", F.input_file_name())
    body = F.regexp_extract("value", r"(?s)<TEXT>(.*?)</TEXT>", 1)
    parts = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<s.*?>(.*?)</s>"), F.lit(1)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    pieces = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("id"), "path", F.array_join(parts, " ").alias("text"), F.col("value").rlike(r"(?s)<TEXT>.*?</TEXT>").alias("has"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("has"), F.struct("path", "text"))))
    topics = pieces.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("article"))
    if matches(spark, f"{root}/*.A"):
        notes = spark.read.text(f"{root}/*.A", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.A$", 1).alias("id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("highlights"))
        topics = topics.join(notes, "id", "left")
    else:
        topics = topics.withColumn("highlights", F.lit(None).cast("string"))
    return topics.select("id", "article", F.coalesce("highlights", F.lit("")).alias("highlights"))


def as_csv_rows(df: DataFrame) -> DataFrame:
    """``id, article, reference`` of JSON-lines rows: reference, else highlights, else empty."""
    has = set(df.columns)
    options = [F.nullif(F.col(c), F.lit("")) for c in ("reference", "highlights") if c in has]
    article = F.coalesce(F.col("article"), F.lit("")) if "article" in has else F.lit("")
    return df.select("id", article.alias("article"), F.coalesce(*options, F.lit("")).alias("reference"))


def write_metrics(metrics: DataFrame, path: str, seconds: dict[str, float] | None = None) -> None:
    """``metric, value`` with six decimals; times may be added."""
    rows = metrics
    for name, value in (seconds or {}).items():
        rows = rows.unionByName(metrics.sparkSession.createDataFrame([(name, float(value))], "metric string, value double"))
    write_csv(rows.select("metric", F.format_string("%.6f", "value").alias("value")), path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "metric string, value double")


def union_summaries(frames: list[DataFrame]) -> DataFrame:
    """Run summaries with different columns under each other; what is missing is empty."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in whole.columns))


def best_runs(summary: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` runs with the best ROUGE-1, then ROUGE-2, then ROUGE-L."""
    return summary.orderBy(*(F.col(c).cast("double").desc() for c in ("rouge1", "rouge2", "rougeL")), *(c for c in summary.columns if c.startswith("run"))).limit(n)


def _mark(key: str, seed: int):
    """A seeded hash of the key that every engine can compute: hexadecimal MD5 of ``seed|key``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def sample_n(df: DataFrame, key: str, n: int | None = None, share: float | None = None, seed: int = 2024) -> DataFrame:
    """``n`` rows, or about a share of the rows, by a seeded hash of the key; both is an error, none keeps all."""
    if n is not None and share is not None:
        raise ValueError("give a number of rows or a share, not both")
    if n is not None:
        return df.orderBy(_mark(key, seed), key).limit(n)
    if share is None or share >= 1:
        return df
    return df.where(F.substring(_mark(key, seed), 1, 8) < f"{int(share * (1 << 32)):08x}")


def split_rows(df: DataFrame, key: str, shares: tuple[float, float] = (0.7, 0.2), seed: int = 2024) -> DataFrame:
    """The rows with ``split``: exact shares of a seeded shuffle, truncated; the rest is test.

    Rows are ranged by the hash, each range is numbered on its own, and the few counts of the
    ranges give the offsets, so no task orders the whole table.
    """
    from pyspark.sql import Window

    from .tables import settled

    marked = df.withColumn("_h", _mark(key, seed))
    ranged = settled(marked.repartitionByRange("_h", key).sortWithinPartitions("_h", key).withColumn("_p", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ranged.groupBy("_p").count().collect()}  # one row for each range
    start, offsets = 0, {}
    for p in sorted(counts):
        offsets[p] = start
        start += counts[p]
    shift = F.create_map(*(F.lit(x) for p, o in offsets.items() for x in (p, o)))[F.col("_p")] if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) - 1 + shift
    first, second = int(start * shares[0]), int(start * shares[0]) + int(start * shares[1])
    name = F.when(place < first, "train").when(place < second, "validation").otherwise("test")
    return ranged.withColumn("split", name).drop("_h", "_p")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p, fs = _path(spark, path)
    return fs.exists(p)


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted."""
    p, fs = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or ()))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on the path's own file system."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Run summaries of all CSV files that match the pattern under each other, whatever columns each has."""
    return union_summaries([spark.read.option("header", True).csv(p) for p in matches(spark, pattern)])


def split_name(name):
    """train, validation, test or another split's name without outer spaces and case; null is none."""
    plain = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    return F.when(plain == "training", "train").when(plain.isin("valid", "val", "dev"), "validation").otherwise(plain)


def split_path(spark: SparkSession, root: str, split: str) -> str | None:
    """The file or folder of a split under ``root``, by any of its names, nested or not."""
    names = {"validation": ["validation", "valid", "val", "dev"]}.get(split, [split])
    for name in names:
        for path in (f"{root}/{name}.jsonl", f"{root}/{name}.csv", f"{root}/{name}/{name}.jsonl", f"{root}/{name}/{name}.csv", f"{root}/{name}"):
            if exists(spark, path):
                return path
    return None


# Layouts of run folder names.
RUN_NAMES = {
    "stage1": r"^tune1-(greedy|grasp|nsga2|bert)-k(\d+)-(\d{8}-\d{6})$",
    "stage2": r"^tune2-(bert|fused)-k1(\d+)-k2(\d+)-cap(\d+)(?:-wb([0-9.]+)-a([0-9.]+))?-(\d{8}-\d{6})$",
    "fast2": r"^fast2-([a-z_]+)-k1(\d+)-k2(\d+)-cap(\d+)-(\d{8}-\d{6}).*$",
}


def run_layout(df: DataFrame, name: str = "name") -> DataFrame:
    """``name, stage, method, k1, k2, cap, stamp`` of run folder names; others have null fields."""
    part = lambda kind, group: F.nullif(F.regexp_extract(name, RUN_NAMES[kind], group), F.lit(""))
    one, two, fast = (F.col(name).rlike(RUN_NAMES[k]) for k in RUN_NAMES)
    return df.select(
        name, F.when(one, "stage1").when(two | fast, "stage2").alias("stage"),
        F.coalesce(part("stage1", 1), part("stage2", 1), part("fast2", 1)).alias("method"),
        F.coalesce(part("stage1", 2), part("stage2", 2), part("fast2", 2)).cast("int").alias("k1"),
        F.coalesce(part("stage2", 3), part("fast2", 3)).cast("int").alias("k2"),
        F.coalesce(part("stage2", 4), part("fast2", 4)).cast("int").alias("cap"),
        F.coalesce(part("stage1", 3), part("stage2", 7), part("fast2", 5)).alias("stamp"),
    )


def run_stamp() -> str:
    return time.strftime("%Y%m%d-%H%M%S")


def write_run(df: DataFrame, path: str, config: dict) -> float:
    """Write predictions with their configuration and the seconds it took beside them.

    The sidecars are small files on the path's own file system; ``_run_metadata`` holds the same as
    a table of one row.
    """
    spark = df.sparkSession
    began = time.perf_counter()
    write_jsonl(df, f"{path}/predictions.jsonl")
    took = time.perf_counter() - began
    told = json.dumps(config, ensure_ascii=False, indent=2, default=str)
    write_text(spark, f"{path}/config_used.json", told)
    write_text(spark, f"{path}/time_select_seconds.txt", f"{took:.6f}")
    spark.createDataFrame([(run_stamp(), told, took)], "stamp string, config string, select_seconds double").coalesce(1).write.mode("overwrite").parquet(f"{path}/_run_metadata")
    return took
