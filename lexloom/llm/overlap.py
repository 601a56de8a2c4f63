"""Records of evaluation splits that also stand, exactly or almost, in the training split.

1. The rarest passages of all values of both fields (:mod:`prefixes`) route evaluation values and
   training texts to each other, so that every pair that can reach the threshold meets.  Values
   with equal token sets collapse first, so mass copies cost one representative.
2. Evaluation values are put into shards.  Each shard builds Aho-Corasick automata over the
   passages (every second run of 10 characters) of its normalised evaluation values and scans every
   training text routed to the shard once, against all of the shard's values.
3. Values with enough matched passages are held against the text exactly.
4. The coverage of an evaluation value unites its runs that stand in any training text, also in
   those that are no near-duplicates (:mod:`coverage`).

A single automaton set that every training text is scanned against would cost shards x texts,
which grows with the square of the data; routing keeps each text to the shards it can match.

Defined results: rows without a split, and values that are null or have fewer than 40 letters and
digits, are in no pair.  A pair is reported once even if both fields overlap.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.formats import split_name
from ..sources.tables import settled
from .coverage import covered
from .countvectors import WIDTH, distinct, similarity
from .forms import bare_batch, blocks, run_hashes
from .nearcopies import THRESHOLD
from .prefixes import fingerprints
from .routes import routed_pairs

FIELDS = ["article", "highlights"]
SHARD_VALUES = 16
#: Passages of one automaton; a shard with more has several.
AUTOMATON_PASSAGES = 200_000


split_of = split_name  # train, validation, test or another split's name; null is none


class _Shard:
    """Automata over passages of evaluation values: every second distinct run of each.

    A text that reaches a similarity of 0.6 holds at least 0.6 of the value's distinct runs, hence
    at least 0.2 of any half of them; so scanning for half the runs loses no pair.
    """

    def __init__(self):
        self.values: list[tuple[int, np.ndarray, int, list[int]]] = []  # id, tokens, length, places of the passages
        self.open: dict[str, list[int]] = {}
        self.automata: list = []

    def add(self, row: int, text: str, runs: np.ndarray, tokens: np.ndarray) -> None:
        number = len(self.values) << 32
        places = np.sort(np.unique(runs, return_index=True)[1])[::2].tolist()
        for k, at in enumerate(places):
            self.open.setdefault(text[at : at + WIDTH], []).append(number | k)
        self.values.append((row, tokens, len(text), places))
        if len(self.open) >= AUTOMATON_PASSAGES:
            self.close()

    def close(self) -> None:
        if self.open:
            automaton = ahocorasick.Automaton()
            for passage, owners in self.open.items():
                automaton.add_word(passage, owners)
            automaton.make_automaton()
            self.automata.append(automaton)
            self.open = {}

    def scan(self, text: str, tokens: np.ndarray, threshold: float):
        """(id, similarity, share of characters covered) of the values that reach the threshold."""
        hits: list[int] = []
        for automaton in self.automata:
            for _, owners in automaton.iter(text):
                hits += owners
        if not hits:
            return
        met = np.sort(np.array(hits, np.int64))
        met = met[np.concatenate([[True], met[1:] != met[:-1]])]
        numbers, starts = np.unique(met >> 32, return_index=True)
        for number, a, b in zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(met)]):
            row, own, length, places = self.values[number]
            if b - a < (2 * threshold - 1) * len(places):
                continue
            s = similarity(own, tokens)
            if s >= threshold:
                at = np.sort(np.array(places)[met[a:b] & 0xFFFFFFFF])
                covered = int(np.minimum(np.diff(np.append(at, at[-1] + WIDTH)), WIDTH).sum())
                yield row, s, covered / length


def _scan(threshold: float):
    schema = pa.schema([("e", pa.int64()), ("t", pa.int64()), ("similarity", pa.float64()), ("coverage", pa.float64())])

    def run(batches):
        shard_key, shard, ready = None, _Shard(), False
        for batch in batches:
            out = ([], [], [], [])
            texts, *heads = (batch.column(n).to_pylist() for n in ("text", "shard", "train", "row"))
            for first, stop in blocks(texts):
                c, sizes = bare_batch(texts[first:stop])
                whole, runs = c.tobytes().decode("utf-32-le", "surrogatepass"), run_hashes(c, WIDTH)
                begin = (np.cumsum(sizes) - sizes).tolist()
                for key, train, row, a, n in zip(*(h[first:stop] for h in heads), begin, sizes.tolist()):
                    if key != shard_key:
                        shard_key, shard, ready = key, _Shard(), False
                    own = runs[a : a + n - WIDTH + 1]
                    plain, tokens = whole[a : a + n], distinct(own)
                    if not train:
                        shard.add(row, plain, own, tokens)
                        continue
                    if not ready:
                        shard.close()
                        ready = True
                    for e, s, coverage in shard.scan(plain, tokens, threshold):
                        for store, value in zip(out, (e, row, s, coverage)):
                            store.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return run


def _tasks(df: DataFrame, shards: int) -> int:
    """Tasks of the scan: by its work, the shards, since its bytes say little about it."""
    return max(df.sparkSession.sparkContext.defaultParallelism * 2, shards // 64)


def overlaps(df: DataFrame, threshold: float = THRESHOLD, id_column: str = "row_id", split_column: str = "split_name", source_column: str = "source") -> DataFrame:
    """Pairs of an evaluation and a training row: ``eval_row, train_row, field, similarity, coverage, eval_split, source``.

    ``coverage`` is the share of the evaluation value's characters that lie in passages matched in
    this training value; :func:`coverages` unites all training values.
    """
    split = split_of(F.col(f"`{split_column}`"))
    rows = df.select(F.col(f"`{id_column}`").alias("row_id"), *FIELDS, F.col(f"`{source_column}`").alias("source"), split.alias("split")).where(split.isin("train", "validation", "test"))
    base = settled(fingerprints(rows, "row_id", FIELDS, "split"))
    # a value's id says its field too, so that both fields share the plan
    numbered = base.withColumn("row", F.col("row") * 2 + F.col("field")).withColumn("train", F.col("tag") == "train")
    # one row per distinct token set: the smallest row and the number of copies
    reps = settled(numbered.groupBy("field", "fp_a", "fp_b").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval")))
    routed = routed_pairs(rows, base.count(), "row_id", FIELDS, threshold, F.col("split") != "train", F.col("split") == "train", reps.where("copies > 1"))
    shards = max(1, -(-routed.select("e").distinct().count() // SHARD_VALUES))
    shard = F.pmod(F.xxhash64("e"), F.lit(shards))
    asked = routed.select(shard.alias("shard"), F.lit(False).alias("train"), F.col("e").alias("row")).unionByName(
        routed.select(shard.alias("shard"), F.lit(True).alias("train"), F.col("t").alias("row"))
    ).distinct()
    texts = rows.select(F.posexplode(F.array(*FIELDS)).alias("field", "text"), "row_id").where("text IS NOT NULL").select((F.col("row_id") * 2 + F.col("field")).alias("row"), "text")
    met = asked.join(texts, "row").select("shard", "train", "row", "text").repartition(_tasks(rows, shards), "shard").sortWithinPartitions("shard", "train")
    found = met.mapInArrow(_scan(threshold), "e bigint, t bigint, similarity double, coverage double").where("e <> t")
    # copies: representatives expand to the evaluation rows and the training rows they stand for
    group = ["field", "fp_a", "fp_b"]
    shared = reps.where("copies > 1").select(*group, F.col("row").alias("rep"))
    copies = numbered.join(shared, group).select("rep", "row", "train")
    same = shared.join(reps.where("copies > 1 AND in_train AND in_eval").select(*group), group, "left_semi").select(F.col("rep").alias("e"), F.col("rep").alias("t"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"))
    linked = found.unionByName(same)
    evals, trains = copies.where("NOT train").select(F.col("rep").alias("e"), F.col("row").alias("e_row")), copies.where("train").select(F.col("rep").alias("t"), F.col("row").alias("t_row"))
    wide = linked.join(evals, "e", "left").join(trains, "t", "left").select(F.coalesce("e_row", "e").alias("e"), F.coalesce("t_row", "t").alias("t"), "similarity", "coverage")
    halves = wide.select((F.shiftright("e", 1)).alias("eval_row"), (F.shiftright("t", 1)).alias("train_row"), F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("e") % 2 + 1).cast("int")).alias("field"), "similarity", "coverage")
    about = rows.where("split <> 'train'").select(F.col("row_id").alias("eval_row"), F.col("split").alias("eval_split"), "source")
    return halves.join(about, "eval_row")


def overlap_pairs(found: DataFrame) -> DataFrame:
    """``eval_split, source, row_a, row_b`` with ``row_a < row_b``, each pair once."""
    a, b = F.least("eval_row", "train_row"), F.greatest("eval_row", "train_row")
    return found.select("eval_split", "source", a.alias("row_a"), b.alias("row_b")).distinct()


def coverages(df: DataFrame, id_column: str = "row_id", split_column: str = "split_name", source_column: str = "source") -> DataFrame:
    """``eval_row, field, coverage, eval_split, source`` of every evaluation value that takes part.

    ``coverage`` is the share of its characters in runs of 10 that stand in the same field of any
    training row, united over all of them.
    """
    split = split_of(F.col(f"`{split_column}`"))
    rows = df.select(F.col(f"`{id_column}`").alias("row_id"), *FIELDS, F.col(f"`{source_column}`").alias("source"), split.alias("split")).where(split.isin("train", "validation", "test"))
    base = settled(fingerprints(rows, "row_id", FIELDS, "split"))
    shares = covered(rows, base, "row_id", FIELDS, F.col("split") != "train")
    values = base.where("tag <> 'train'").select((F.col("row") * 2 + F.col("field")).alias("row"), F.col("row").alias("eval_row"), F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1).alias("field"))
    about = rows.where("split <> 'train'").select(F.col("row_id").alias("eval_row"), F.col("split").alias("eval_split"), "source")
    return values.join(shares, "row", "left").join(about, "eval_row").select("eval_row", "field", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "eval_split", "source")


def overlap_counts(found: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Pairs, evaluation rows and training rows per evaluation split and source.

    With the coverages ``shares`` every split and source with an evaluation value is there, and
    ``mean_coverage`` is the mean over its evaluation rows, each with its better covered field.
    """
    group = ["eval_split", "source"]
    pairs = found.select(*group, "eval_row", "train_row").distinct()
    counts = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("eval_row").alias("eval_rows"), F.countDistinct("train_row").alias("train_rows"))
    if shares is None:
        return counts
    means = shares.groupBy(*group, "eval_row").agg(F.max("coverage").alias("coverage")).groupBy(*group).agg(F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    left, right = means.alias("m"), counts.alias("c")
    same = F.col("m.eval_split").eqNullSafe(F.col("c.eval_split")) & F.col("m.source").eqNullSafe(F.col("c.source"))
    zero = [F.coalesce(f"c.{n}", F.lit(0)).alias(n) for n in ("pairs", "eval_rows", "train_rows")]
    return left.join(right, same, "left").select("m.eval_split", "m.source", *zero, "mean_coverage")
