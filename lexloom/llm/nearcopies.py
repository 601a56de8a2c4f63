"""Near-duplicate records with small edits: all pairs above a similarity threshold.

1. One narrow pass makes the sketch of every value (see :mod:`countvectors`); it is written to the
   shared folder because several steps read it.
2. Values with equal token sets collapse to one representative in a map-side combined aggregate.
3. Representatives meet in cells.  A cell streams through its task; it is cut into blocks of
   ``BLOCK`` members, and every pair of blocks of a cell is its own unit of work, so a hot cell is
   spread over the cluster without a cap on its members.  Equal blocks are handled once.
4. In each unit an R-tree over the members' count vectors yields the pairs whose bound admits the
   threshold.  Pairs with a short value, which cells can miss, are found by an exact join instead.
5. The surviving pairs are verified on the texts, and representatives expand to their copies.

Defined results: null values and values with fewer than 40 letters and digits are in no pair;
repeated rows with equal values are pairs of similarity 1.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled
from .batches import map_columns
from .countvectors import CELLS, GROUPS, SHORT, CountRTree, Sketches, similarity, tokens, unpacked
from .prefixes import given_pairs

THRESHOLD = 0.6
BLOCK = 64
#: Groups that the partners of a row are dealt to for verification.
PARTS = 16


def sketches(df: DataFrame, id_column: str, fields: list[str], tag: str | None = None, least: float = THRESHOLD) -> DataFrame:
    """``row, field, tag, n, fp_a, fp_b, keys, counts, excess, tokens`` of every value with tokens.

    ``tokens`` is null but for sets small enough to be near one of less than ``SHORT`` at similarity ``least``.
    """

    def make(columns):
        for k in range(len(fields)):
            found = Sketches(columns[f"v{k}"].to_pylist())
            m = len(found.which)
            if not m:
                continue
            which = pa.array(found.which)
            keys = pa.FixedSizeListArray.from_arrays(pa.array((found.keys + np.int64(k * 0x5DEECE66D)).ravel()), CELLS).cast(pa.list_(pa.int64()))
            counts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS // 2), m, [None, pa.py_buffer(np.ascontiguousarray(found.packed))]).cast(pa.binary())
            # the tokens of short sets come along for the exact join
            short = [found.tokens[a : a + n].tobytes() if n < SHORT / least else None for a, n in zip(found.start.tolist(), found.n.tolist())]
            yield {
                "tokens": pa.array(short, pa.binary()), "row": columns["key"].take(which), "field": pa.array(np.full(m, k, np.int32)), "tag": columns["tag"].take(which), "n": found.n,
                "fp_a": found.fp_a, "fp_b": found.fp_b, "keys": keys, "counts": counts, "excess": found.excess,
            }

    chosen = df.select(
        F.col(f"`{id_column}`").alias("key"),
        (F.col(f"`{tag}`") if tag else F.lit(None)).cast("string").alias("tag"),
        *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(fields)),
    )
    schema = "row bigint, field int, tag string, n int, fp_a bigint, fp_b bigint, keys array<bigint>, counts binary, excess int, tokens binary"
    return map_columns(chosen, schema, make)


def representatives(base: DataFrame, *extra) -> DataFrame:
    """One row per distinct token set: the smallest row with its sketch, and the number of copies."""
    best = F.min(F.struct("row", "n", "keys", "counts", "excess", "tokens")).alias("best")
    grouped = base.groupBy("field", "fp_a", "fp_b").agg(best, F.count(F.lit(1)).alias("copies"), *extra)
    kept = [c for c in grouped.columns if c not in ("best",)]
    return grouped.select("best.*", *kept)


def _runs(batches):
    """Blocks of the cells of a stream sorted by key; cells of one member are dropped."""
    schema = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("last", pa.bool_()), ("members", pa.list_(pa.int64()))])
    rest_key, rest, number = None, [], 0

    def flush(out, last):
        nonlocal number
        if len(rest) > 1 or number:
            out.append((rest_key, number, last, list(rest)))
            number += 1
        rest.clear()

    for batch in batches:
        out = []
        keys, rows = batch.column("key").to_numpy(), batch.column("row").to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        stops = np.append(starts[1:], len(keys))
        # whole cells of one member inside the batch need no Python work
        busy = (stops - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
        for a, b in zip(starts[busy].tolist(), stops[busy].tolist()):
            if keys[a] != rest_key:
                flush(out, True)
                rest_key, number = int(keys[a]), 0
            for row in rows[a:b].tolist():
                if len(rest) == BLOCK:
                    flush(out, False)
                rest.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), schema.types)], schema=schema)
    out = []
    flush(out, True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def cells(reps: DataFrame) -> DataFrame:
    """Units of work ``unit, left, right``: the members of a block, and of the block it is held against.

    ``right`` is empty for a block against itself.
    """
    spread = reps.select(F.explode("keys").alias("key"), "row").repartition("key").sortWithinPartitions("key", "row")
    blocks = settled(spread.mapInArrow(_runs, "key bigint, block int, last boolean, members array<bigint>"))
    own = blocks.select(F.col("members").alias("left"), F.expr("CAST(array() AS array<bigint>)").alias("right"))
    wide = blocks.where("block > 0 OR NOT last")
    a = wide.select("key", F.col("block").alias("i"), F.col("members").alias("left"))
    b = wide.select("key", F.col("block").alias("j"), F.col("members").alias("right"))
    across = a.join(b, "key").where("i < j").select("left", "right")
    return own.unionByName(across).dropDuplicates(["left", "right"]).withColumn("unit", F.xxhash64("left", "right"))


def _join_units(threshold: float):
    """Candidate pairs of a stream sorted by unit: R-tree search inside each unit."""

    def search(sides, rows, sizes, counts, excess):
        c = unpacked(counts)
        e, s, r, right = np.array(excess), np.array(sizes), np.array(rows), np.array(sides)
        if right.any():
            tree = CountRTree(c[right], e[right], s[right], threshold)
            q, v = tree.search(c[~right], e[~right], s[~right])
            a, b = r[~right][q], r[right][v]
        else:
            tree = CountRTree(c, e, s, threshold)
            q, v = tree.search(c, e, s)
            q, v = q[q < v], v[q < v]
            a, b = r[q], r[v]
        return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]

    def run(batches):
        unit, held = None, ([], [], [], [], [])

        def done():
            a, b = search(*held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["row_a", "row_b"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("unit", "right", "row", "n", "counts", "excess")]
            for key, *rest in zip(*columns):
                if key != unit:
                    if len(held[0]) > 1:
                        yield done()
                    unit, held = key, ([], [], [], [], [])
                for store, value in zip(held, rest):
                    store.append(value)
        if len(held[0]) > 1:
            yield done()

    return run


def candidates(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs ``row_a < row_b`` of representatives that the R-trees can't exclude."""
    units = cells(reps)
    left = units.select("unit", F.lit(False).alias("right"), F.explode("left").alias("row"))
    right = units.select("unit", F.lit(True).alias("right"), F.explode("right").alias("row"))
    placed = left.unionByName(right).join(reps.select("row", "n", "counts", "excess"), "row")
    sorted_units = placed.select("unit", "right", "row", "n", "counts", "excess").repartition("unit").sortWithinPartitions("unit")
    found = sorted_units.mapInArrow(_join_units(threshold), "row_a bigint, row_b bigint")
    short = given_pairs(reps.where("tokens IS NOT NULL").select("row", "n", "fp_a", "fp_b", "tokens"), threshold)
    exact = short.select(F.shiftright(F.least("e", "t"), 1).alias("row_a"), F.shiftright(F.greatest("e", "t"), 1).alias("row_b"))
    return found.unionByName(exact).dropDuplicates(["row_a", "row_b"])


class _Recent:
    """Token sets of the values seen last."""

    def __init__(self, most: int = 256):
        self.most, self.held = most, OrderedDict()

    def of(self, row: int, text: str) -> np.ndarray:
        t = self.held.get(row)
        if t is None:
            t = self.held[row] = tokens(text)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return t


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose texts (``row``, ``text``) reach the threshold, with their ``similarity``.

    The partners of a row are dealt to ``PARTS`` groups by hash, and its text travels once to each
    group that has some, so that a row with very many partners is spread over as many tasks.
    """
    part = F.pmod(F.xxhash64("row_b"), F.lit(PARTS)).cast("int").alias("part")
    whole = pairs.select("row_a", part, "row_b")
    asked = whole.select("row_a", "part", F.col("row_b").alias("row"), F.lit(True).alias("partner")).unionByName(
        whole.select("row_a", "part", F.col("row_a").alias("row"), F.lit(False).alias("partner")).distinct()
    )
    met = asked.join(texts, "row").select("row_a", "part", "partner", "row", "text").repartition("row_a", "part").sortWithinPartitions("row_a", "part", "partner", "row")

    def run(batches):
        first, recent = None, _Recent()
        for batch in batches:
            out = ([], [], [])
            for a, partner, row, text in zip(*(batch.column(n).to_pylist() for n in ("row_a", "partner", "row", "text"))):
                if not partner:
                    first = recent.of(row, text)
                    continue
                s = similarity(first, recent.of(row, text))
                if s >= threshold:
                    for store, value in zip(out, (a, row, s)):
                        store.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["row_a", "row_b", "similarity"])

    return met.mapInArrow(run, "row_a bigint, row_b bigint, similarity double")


def _linked(df: DataFrame, id_column: str, text_column: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches, representatives, and verified pairs of representatives."""
    base = settled(sketches(df, id_column, [text_column], least=threshold))
    reps = settled(representatives(base))
    texts = df.select(F.col(f"`{id_column}`").alias("row"), F.col(f"`{text_column}`").alias("text"))
    return base, reps, verified(candidates(reps, threshold), texts, threshold)


def near_classes(df: DataFrame, id_column: str = "row_id", text_column: str = "article", threshold: float = THRESHOLD) -> DataFrame:
    """One row per text that takes part: ``row, class_id, copies, links``.

    ``class_id`` is the smallest row with an equal token set, ``copies`` the rows of that class, and
    ``links`` the other rows whose texts reach the threshold, copies included.  Nothing expands to
    pairs of copies, so a class of a third of all rows costs its rows.
    """
    base, reps, pairs = _linked(df, id_column, text_column, threshold)
    size = reps.select(F.col("row").alias("other"), F.col("copies").alias("weight"))
    both = pairs.select(F.col("row_a").alias("rep"), F.col("row_b").alias("other")).unionByName(pairs.select(F.col("row_b").alias("rep"), F.col("row_a").alias("other")))
    reached = both.join(size, "other").groupBy("rep").agg(F.sum("weight").alias("near"))
    known = reps.select("fp_a", "fp_b", F.col("row").alias("rep"), "copies").join(reached, "rep", "left")
    return base.select("row", "fp_a", "fp_b").join(known, ["fp_a", "fp_b"]).select("row", F.col("rep").alias("class_id"), "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))


def near_pairs(df: DataFrame, id_column: str = "row_id", text_column: str = "article", threshold: float = THRESHOLD) -> DataFrame:
    """Every pair of rows whose texts reach the threshold: ``row_a < row_b, similarity``."""
    base, reps, pairs = _linked(df, id_column, text_column, threshold)
    group = ["fp_a", "fp_b"]
    classes = reps.where("copies > 1").select(*group, F.col("row").alias("rep"))
    copies = base.select(*group, "row").join(classes, group).select("rep", "row")
    # a representative without copies stands for itself
    a = pairs.join(copies.select(F.col("rep").alias("row_a"), F.col("row").alias("a")), "row_a", "left")
    both = a.join(copies.select(F.col("rep").alias("row_b"), F.col("row").alias("b")), "row_b", "left")
    x, y = F.coalesce("a", "row_a"), F.coalesce("b", "row_b")
    across = both.select(F.least(x, y).alias("row_a"), F.greatest(x, y).alias("row_b"), "similarity")
    c, d = copies.select("rep", F.col("row").alias("row_a")), copies.select("rep", F.col("row").alias("row_b"))
    same = c.join(d, "rep").where("row_a < row_b").select("row_a", "row_b", F.lit(1.0).alias("similarity"))
    return across.unionByName(same)
