"""Candidates of near-duplicate token sets between two sides, without shuffling who meets whom.

Two sets that reach the threshold share one of their rarest tokens at least (the prefix filter of
:mod:`prefixes`, with one common token asked for).  Texts made of the same phrases meet too, so
meetings grow with the product of both sides; they are never written down:

1. Every set is written once to the shared folder: its prefix, 24 bits a token, and its parity sketch,
   the parity of its tokens at each of some four bits a token.  Equal sets collapse to the smallest row.
2. The asked sets go in blocks of sizes; a round holds the other sets of fitting sizes against one
   block, whose index each worker reads from the shared folder.
3. Tokens that only one of two sets has flip a bit each, so the flipped bits of two sketches are no
   more than these tokens: pairs with too many are dropped on the spot, and only the rest comes out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch, settled
from .batches import map_columns
from .countvectors import TokenSets
from .prefixes import RARITY_BITS, REPEATED_BITS, _fingerprint, least_shared, rarity, repeated_bits

#: Prefix tokens of the asked sets of one round: as many as a worker's index can hold.
ROUND_TOKENS = 8_000_000
TOKEN_BITS = 24
#: Places of the table of one step, sets of a slice x sets of the block: it stays in the cache.
TABLE = 1 << 21
#: Pairs whose sketches are held against each other in one step.
PAIRS = 1024


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of a sketch: the power of two from 3 n on, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(3 * n))).astype(np.int64)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) at a smaller width."""
    while words.shape[1] * 64 > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return np.ascontiguousarray(words)


def sketches(sets: TokenSets) -> list[bytes]:
    """The parity sketch of each set."""
    kind, out = widths(sets.n), [b""] * len(sets.n)
    for w in np.unique(kind).tolist():
        of = np.flatnonzero(kind == w)
        step = max(1, TABLE // 8 // w)
        for a in range(0, len(of), step):
            some = of[a : a + step].tolist()
            held = sets.n[some]
            low = np.concatenate([sets.tokens[x : x + n] for x, n in zip(sets.start[some].tolist(), held.tolist())]) & np.uint64(w - 1)
            parity = np.bincount(np.repeat(np.arange(len(some)) * w, held) + low.astype(np.int64), minlength=len(some) * w).astype(np.uint8) & 1
            packed, size = np.packbits(parity, bitorder="little").tobytes(), w // 8
            for k, place in enumerate(some):
                out[place] = packed[k * size : (k + 1) * size]
    return out


def prefix_bytes(sets: TokenSets, rare: np.ndarray, threshold: float, field: int) -> list[bytes]:
    """The rarest tokens of each set, 24 bits each; those of two fields differ."""
    ordered = rare[(sets.tokens >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | sets.tokens >> np.uint64(16)
    size = sets.n - least_shared(sets.n, threshold) + 1
    kept = [np.partition(ordered[a : a + n], p - 1)[:p] for a, n, p in zip(sets.start.tolist(), sets.n.tolist(), size.tolist())]
    low = np.concatenate(kept).astype("<u4") ^ np.uint32(field * 0x9E3779)
    data = low.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    ends = (np.cumsum(size) * 3).tolist()
    return [data[e - 3 * p : e] for e, p in zip(ends, size.tolist())]


def prefix_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of all rows one after the other, and how many each row has."""
    lists = column.to_pylist()
    low = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, 3)
    out = np.zeros((len(low), 4), np.uint8)
    out[:, :3] = low
    return out.view("<u4").ravel(), np.array([len(x) // 3 for x in lists], np.int64)


def _flipped(words: np.ndarray) -> np.ndarray:
    """Ones of each row of 64-bit words."""
    ones = np.bitwise_count(words)
    if ones.shape[1] < 8 or ones.shape[1] > 512:
        return ones.sum(axis=1, dtype=np.int64)
    # eight counts at a time, in four lanes of 16 bits
    eight, lanes = ones.view(np.uint64), np.uint64(0x00FF00FF00FF00FF)
    four = ((eight & lanes) + (eight >> np.uint64(8) & lanes)).sum(axis=1, dtype=np.uint64)
    return (four * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


class Block:
    """Asked sets ``row, n, tokens, sketch``, by field and size, with an index of their tokens."""

    def __init__(self, table: pa.Table, threshold: float):
        self.threshold = threshold
        row, n = table.column("row").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        order = np.lexsort((n, row & 1))
        self.row, self.n = row[order], n[order]
        self.need, self.fields = least_shared(self.n, threshold), np.searchsorted(self.row & 1, [0, 1, 2]).tolist()
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        tokens, held = prefix_tokens(table.column("tokens"))
        keys = np.sort(tokens.astype(np.uint64) << np.uint64(32) | np.repeat(rank, held))
        self.index = keys.astype(np.uint32).view(np.int32)
        tokens = (keys >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        self.start = np.zeros((1 << TOKEN_BITS) + 1, np.int32)
        self.start[tokens[edges] + 1] = np.diff(np.append(edges, len(tokens)))
        np.cumsum(self.start, out=self.start)
        # sets of one width, and their sketches at that width and half of it
        self.width, self.place, self.words = widths(self.n), np.zeros(len(self.n), np.int64), {}
        sketch = table.column("sketch").to_pylist()
        for w in np.unique(self.width).tolist():
            of = np.flatnonzero(self.width == w)
            self.place[of] = np.arange(len(of))
            whole = np.frombuffer(b"".join(sketch[k] for k in order[of].tolist()), "<u8").reshape(len(of), -1)
            self.words[w, w] = whole
            if w > 64:
                self.words[w, w // 2] = _folded(whole, w // 2)

    def _range(self, field: np.ndarray, n: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the asked sets of the field begin and end that fit the sizes."""
        low, high = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k in (0, 1):
            a, b = self.fields[k], self.fields[k + 1]
            mine = np.flatnonzero(field == k)
            low[mine] = a + np.searchsorted(self.n[a:b], need[mine])
            high[mine] = a + np.searchsorted(self.need[a:b], n[mine], "right")
        return low, np.maximum(low, high)

    def near(self, row: np.ndarray, n: np.ndarray, tokens: np.ndarray, held: np.ndarray, sketch: list[bytes]):
        """(e, t) of the pairs that may reach the threshold with the sets given."""
        out: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        n, ends, table = n.astype(np.int64), np.cumsum(held), np.zeros(max(TABLE, len(self.row)), bool)
        need, kind = least_shared(n, self.threshold), widths(n)
        low, high = self._range(row & 1, n, need)
        for w in np.unique(kind).tolist():
            of = np.flatnonzero((kind == w) & (high > low))
            of = of[np.lexsort((n[of], row[of] & 1))]
            if not len(of):
                continue
            words = np.frombuffer(b"".join(sketch[k] for k in of.tolist()), "<u8").reshape(len(of), -1)
            at_width = {w: words, **({w // 2: _folded(words, w // 2)} if w > 64 else {})}
            a = 0
            while a < len(of):
                # rows whose fitting sets, from the first to the last, fill the table
                left = int(low[of[a]])
                fits = np.maximum.accumulate(high[of[a:]]) - left
                stop = a + max(1, int(np.searchsorted(fits * np.arange(1, len(fits) + 1), TABLE, "right")))
                some, size = of[a:stop], int(fits[stop - a - 1])
                which = np.concatenate([np.arange(ends[k] - held[k], ends[k]) for k in some.tolist()])
                asked, own = tokens[which], np.repeat(np.arange(len(some)), held[some])
                begin = self.start[asked].astype(np.int64)
                count = self.start[asked + 1] - begin
                hit = np.flatnonzero(count)
                begin, count, own = begin[hit], count[hit], own[hit]
                total = np.cumsum(count)
                cuts = [0, *(np.searchsorted(total, np.arange(TABLE, int(count.sum()), TABLE)) + 1).tolist(), len(total)]
                for x, y in zip(cuts, cuts[1:]):
                    c = count[x:y]
                    met = self.index[np.arange(int(c.sum())) + np.repeat(begin[x:y] - np.cumsum(c) + c, c)]
                    inside = (met >= left) & (met < left + size)
                    table[(np.repeat(own[x:y] * size - left, c) + met)[inside]] = True
                met = np.flatnonzero(table[: len(some) * size])
                table[met] = False
                t, e = np.divmod(met, size)
                e += left
                mine = some[t]
                fits = np.flatnonzero((e >= low[mine]) & (e < high[mine]))
                t, e, mine = t[fits] + a, e[fits], mine[fits]
                most = n[mine] + self.n[e] - 2 * np.maximum(need[mine], self.need[e])
                kinds = self.width[e]
                for v in (w // 2, w, 2 * w):
                    if (v, v) not in self.words:
                        continue
                    pairs, c = np.flatnonzero(kinds == v), min(v, w)
                    theirs = self.words[v, c]
                    for x in range(0, len(pairs), PAIRS):
                        m = pairs[x : x + PAIRS]
                        m = m[_flipped(theirs[self.place[e[m]]] ^ at_width[c][t[m]]) <= most[m]]
                        m = m[self.row[e[m]] != row[mine[m]]]
                        out[0].append(self.row[e[m]])
                        out[1].append(row[mine[m]])
                a = stop
        return np.concatenate(out[0]), np.concatenate(out[1])


_HELD: dict = {}
_STORED = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("sides", pa.int32()), ("tokens", pa.binary()), ("sketch", pa.binary()), ("told", pa.int32()), ("size", pa.int32())])
_COLUMNS = "row bigint, n int, fp bigint, sides int, tokens binary, sketch binary, told int, size int"


def _block(key: str, folders: list[str], low: int, high: int, parts: int, part: int, threshold: float) -> Block:
    """The block of a round, which a worker builds once: asked sets of ``low`` to ``high`` tokens, one part of them."""
    if key not in _HELD:
        _HELD.clear()
        n, size = pads.field("n"), pads.field("size")
        chosen = (size >= low.bit_length()) & (size <= high.bit_length()) & (n >= low) & (n <= high) & (pads.field("sides") >= 2)
        tables = []
        for folder, told in zip(folders, (0, 2)):
            system, path = FileSystem.from_uri(folder if ":/" in folder else "file://" + folder)
            stored = pads.dataset(path, schema=_STORED, filesystem=system, format="parquet", partitioning=pads.partitioning(flavor="hive", schema=pa.schema([("told", pa.int32()), ("size", pa.int32())])))
            tables.append(stored.to_table(columns=["row", "n", "tokens", "sketch"], filter=chosen & (pads.field("told") == told)))
        table = pa.concat_tables(tables)
        if parts > 1:
            table = table.take(pa.array(np.flatnonzero((table.column("row").to_numpy() >> 1) % parts == part)))
        _HELD[key] = Block(table, threshold)
    return _HELD[key]


def _rounds(sizes: list[tuple[int, int]]):
    """``low, high, parts, part`` of blocks of about ``ROUND_TOKENS`` at most, from prefix tokens by set size."""
    low, total = None, 0
    for k, (n, tokens) in enumerate(sizes):
        if low is not None and total + tokens > ROUND_TOKENS:
            yield low, sizes[k - 1][0], 1, 0
            low, total = None, 0
        if tokens > ROUND_TOKENS:
            parts = -(-tokens // ROUND_TOKENS)
            yield from ((n, n, parts, part) for part in range(parts))
        else:
            low, total = n if low is None else low, total + tokens
    if low is not None:
        yield low, sizes[-1][0], 1, 0


def routed_pairs(df: DataFrame, rows: int, id_column: str, fields: list[str], threshold: float, evaluated, trained, repeated: DataFrame) -> DataFrame:
    """``e, t``: pairs of different token sets of one field, every one among them that reaches the threshold.

    ``e`` and ``t`` are ``2 row + field`` of the smallest rows with the sets; an e has a copy with the
    condition ``evaluated`` and its t one with ``trained``.  ``rows`` is about the number of values,
    ``repeated`` has the fingerprints ``fp_a, fp_b`` that more than one value has.
    """
    if threshold <= 0.5:
        raise ValueError("sketches of sets of twice the size are not held against each other")
    spark = df.sparkSession
    chosen = df.select(F.col(f"`{id_column}`").alias("key"), evaluated.alias("evaluated"), trained.alias("trained"), *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(fields)))
    rare = spark.sparkContext.broadcast(rarity(chosen, len(fields), rows))
    bits = spark.sparkContext.broadcast(repeated_bits(repeated))

    def make(columns):
        key = columns["key"].to_numpy()
        sides = np.array(columns["evaluated"].to_numpy(zero_copy_only=False), bool) * 2 + np.array(columns["trained"].to_numpy(zero_copy_only=False), bool)
        for k in range(len(fields)):
            sets = TokenSets(columns[f"v{k}"].to_pylist())
            if len(sets.which):
                fp = _fingerprint(sets.fp_a, sets.fp_b)
                yield {
                    "row": key[sets.which] * 2 + k, "n": sets.n, "fp": fp.view(np.int64), "sides": sides[sets.which], "size": np.frexp(sets.n.astype(float))[1],
                    "tokens": prefix_bytes(sets, rare.value, threshold, k), "sketch": sketches(sets), "told": bits.value[fp >> np.uint64(64 - REPEATED_BITS)],
                }

    place = scratch(spark, "sets")
    folders = [f"{place}/all", f"{place}/same"]
    map_columns(chosen, _COLUMNS, make).write.partitionBy("told", "size").parquet(folders[0])
    stored = spark.read.schema(_COLUMNS).parquet(folders[0])
    # equal sets: the smallest row stands for all of them, on either side if one of them is
    one = stored.where("told = 1").groupBy("fp", (F.col("row") % 2).alias("field"))
    same = one.agg(F.min(F.struct("row", "n", "tokens", "sketch", "size")).alias("best"), F.bit_or("sides").alias("sides"))
    same.select("best.row", "best.n", "fp", "sides", "best.tokens", "best.sketch", F.lit(2).alias("told"), "best.size").repartition(4).write.partitionBy("told", "size").parquet(folders[1])
    sets = stored.where("told = 0").unionByName(spark.read.schema(_COLUMNS).parquet(folders[1]))
    asked = sets.where("sides >= 2").groupBy("n").agg(F.sum(F.length("tokens")).alias("bytes")).orderBy("n").collect()
    found = [_round(sets, folders, threshold, *r) for r in _rounds([(r.n, r.bytes // 3) for r in asked])]
    root = spark._jvm.org.apache.hadoop.fs.Path(place)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "e bigint, t bigint")


def _round(sets: DataFrame, folders: list[str], threshold: float, low: int, high: int, parts: int, part: int) -> DataFrame:
    """The pairs of one block with the sets of the other side."""
    key = f"{folders[0]} {low} {high} {part}"
    least, most = int(least_shared(np.array([low]), threshold)[0]), int(high / threshold + 1e-9)
    others = sets.where((F.col("size") >= least.bit_length()) & (F.col("size") <= most.bit_length()) & F.col("n").between(least, most) & (F.col("sides") % 2 == 1))
    schema = pa.schema([("e", pa.int64()), ("t", pa.int64())])

    def run(batches):
        for batch in batches:
            block = _block(key, folders, low, high, parts, part, threshold)
            tokens, held = prefix_tokens(batch.column("tokens"))
            e, t = block.near(batch.column("row").to_numpy(), batch.column("n").to_numpy(), tokens, held, batch.column("sketch").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(t)], schema=schema)

    return settled(others.select("row", "n", "tokens", "sketch").mapInArrow(run, "e bigint, t bigint"))
