"""Exact candidates of near-duplicate token sets: prefix filter over the rarest tokens.

Two sets of similarity ``threshold`` share at least ``o = ceil(threshold n)`` tokens of either.  In
any common order of all tokens, the first ``n - o + l`` tokens of both then hold at least the
smaller ``l`` of the common ones.  So sets meet on these prefixes, and no pair is missed; tokens are
ordered by their count in a fixed-size sample, the rarest first, so that few others meet.

1. Prefix tokens are dealt to buckets by hash, packed by batch; a bucket collapses equal sets to
   the smallest row, and lists who meets whom on each token, if the sizes admit the threshold.
   With many buckets a set has few tokens in each, so its head there is a few bytes: the fingerprint
   that tells equal sets goes along only where a bitmap of the repeated ones asks for it.
2. The lists (deltas of row numbers) of a row are added up; who met often enough is a candidate.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_columns
from .countvectors import GivenSets, TokenSets

SAMPLE_ROWS = 2_000
RARITY_BITS = 22
#: One more common token is asked of the prefixes for so many of the smaller set.
STEP = 20
#: Every bucket repeats the heads of its sets, so buckets are as large as a task can hold.  24 bits
#: of a token are enough there: chance meetings only add candidates.
BUCKET_TOKENS = 5_000_000
LEAST_BUCKETS = 4
#: Meetings held at a time.
HELD = 4_000_000
#: Meetings written out in one step: their arrays stay in the cache.
SLICE = 1 << 16
#: Bitmap of the fingerprints that several values have.
REPEATED_BITS = 24


def fingerprints(df: DataFrame, id_column: str, fields: list[str], tag: str) -> DataFrame:
    """``row, field, tag, n, fp_a, fp_b`` of every value with tokens."""

    def make(columns):
        for k in range(len(fields)):
            found = TokenSets(columns[f"v{k}"].to_pylist())
            m = len(found.which)
            if m:
                which = pa.array(found.which)
                yield {"row": columns["key"].take(which), "field": np.full(m, k, np.int32), "tag": columns["tag"].take(which), "n": found.n, "fp_a": found.fp_a, "fp_b": found.fp_b}

    chosen = df.select(F.col(f"`{id_column}`").alias("key"), F.col(f"`{tag}`").cast("string").alias("tag"), *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(fields)))
    return map_columns(chosen, "row bigint, field int, tag string, n int, fp_a bigint, fp_b bigint", make)


def even_keys(spark, n: int, parts: int) -> np.ndarray:
    """``n`` different keys that hash partitioning deals evenly to ``parts`` partitions."""
    tried = spark.range(0, max(1000, 40 * n), numPartitions=1).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).collect()
    by: list[list[int]] = [[] for _ in range(parts)]
    for r in tried:
        by[r.p].append(r.k)
    spare = iter([k for held in by for k in held[-(-n // parts) :]])
    return np.array([by[i % parts][i // parts] if i // parts < len(by[i % parts]) else next(spare) for i in range(n)], np.int32)


def least_shared(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens that a set of ``n`` shares with any set it reaches the threshold with."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _sets(columns, field: int):
    """Token sets of one field of a batch, made of its texts or given."""
    if "tokens" in columns:
        return GivenSets(columns["tokens"].to_pylist(), columns["fp_a"].to_numpy(), columns["fp_b"].to_numpy())
    return TokenSets(columns[f"v{field}"].to_pylist())


def rarity(chosen: DataFrame, fields: int, rows: int) -> np.ndarray:
    """Counts, up to 255, of the tokens of a sample of about ``SAMPLE_ROWS`` rows by their first bits."""
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / max(1, rows)) * (1 << 20))

    def make(columns):
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for k in range(fields):
            t = _sets(columns, k).tokens
            total += np.bincount((t >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(total))
        yield {"counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]}

    total = np.zeros(1 << RARITY_BITS, np.int64)
    for r in map_columns(chosen.where(part).repartition(4), "counts binary", make).toLocalIterator():
        total += np.frombuffer(r.counts, np.uint8)
    return np.minimum(total, 255).astype(np.uint8)


def prefixes(sets: TokenSets, rare: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest tokens of each set, cut to 48 bits, and how many they are of each."""
    counts = rare[(sets.tokens >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64)
    ordered = counts << np.uint64(48) | sets.tokens >> np.uint64(16)
    shared = least_shared(sets.n, threshold)
    size = np.minimum(sets.n, sets.n - shared + 1 + sets.n // STEP)
    kept = [np.partition(ordered[a : a + n], p - 1)[:p] for a, n, p in zip(sets.start.tolist(), sets.n.tolist(), size.tolist())]
    return (np.concatenate(kept) if kept else ordered) & np.uint64((1 << 48) - 1), size


def _fingerprint(fp_a: np.ndarray, fp_b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (fp_a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ fp_b.astype(np.uint64)


def repeated_bits(repeated: DataFrame) -> np.ndarray:
    """A bitmap of the fingerprints ``fp_a, fp_b`` by their first bits; others may share a bit."""

    def make(columns):
        bits = np.zeros(1 << REPEATED_BITS, bool)
        bits[_fingerprint(columns["fp_a"].to_numpy(), columns["fp_b"].to_numpy()) >> np.uint64(64 - REPEATED_BITS)] = True
        yield {"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]}

    bits = np.zeros(1 << (REPEATED_BITS - 3), np.uint8)
    for r in map_columns(repeated.select("fp_a", "fp_b").coalesce(4), "bits binary", make).toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return np.unpackbits(bits).astype(bool)


def _packed(rows: np.ndarray, n: np.ndarray, held: np.ndarray, sides: np.ndarray, fp: np.ndarray, told: np.ndarray, tokens: np.ndarray) -> bytes:
    """Heads of sets (steps of the row, size, tokens with flags; the fingerprint where it is told), then their tokens."""
    step = np.diff(rows, prepend=0)
    numbers = np.concatenate([step << 1 ^ step >> 63, n, held << 3 | sides << 1 | told]).astype(np.uint64)
    head = zlib.compress(_varints(numbers)[0].tobytes(), 1)
    return np.array([len(rows), len(head)], np.int64).tobytes() + head + fp[told].tobytes() + tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes):
    """rows, sizes, held tokens, sides, fingerprints (0 where not told), told or not, tokens."""
    m, size = np.frombuffer(data, np.int64, 2)
    numbers = _numbers(np.frombuffer(zlib.decompress(data[16 : 16 + size]), np.uint8))
    step = numbers[:m]
    rows = np.cumsum((step >> np.uint64(1)).astype(np.int64) ^ -(step & np.uint64(1)).astype(np.int64))
    n, flags = numbers[m : 2 * m].astype(np.int64), numbers[2 * m :].astype(np.int64)
    told, fp = flags & 1 > 0, np.zeros(m, np.uint64)
    at = 16 + int(size)
    fp[told] = np.frombuffer(data, np.uint64, int(told.sum()), at)
    low = np.frombuffer(data, np.uint8, -1, at + 8 * int(told.sum())).reshape(-1, 3)
    tokens = np.zeros((len(low), 4), np.uint8)
    tokens[:, :3] = low
    return rows, n, flags >> 3, flags >> 1 & 3, fp, told, tokens.view("<u4").ravel()


def _dealt(sets: TokenSets, rows: np.ndarray, sides: np.ndarray, repeated: np.ndarray | None, rare: np.ndarray, threshold: float, buckets: int):
    """(bucket, bytes) of the prefix tokens: heads of the sets that have some, then their tokens."""
    tokens, size = prefixes(sets, rare, threshold)
    own = np.repeat(np.arange(len(size)), size)
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    tokens, own, bucket = tokens[order].astype(np.uint32), own[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    fp = _fingerprint(sets.fp_a, sets.fp_b)
    told = np.ones(len(fp), bool) if repeated is None else repeated[fp >> np.uint64(64 - REPEATED_BITS)]
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)]):
        who, held = np.unique(own[a:b], return_counts=True)
        yield int(bucket[a]), _packed(rows[who], sets.n[who], held, sides[who], fp[who], told[who], tokens[a:b])


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, seven bits each with the last one marked, and where each number ends."""
    width = np.ones(len(x), np.int64)
    long, k = np.flatnonzero(x >> np.uint64(7)), 1
    while len(long):
        width[long] += 1
        k += 1
        long = long[x[long] >> np.uint64(7 * k) > 0] if k < 10 else long[:0]
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    starts = ends - width
    out[starts] = x.astype(np.uint8) & 127
    m, k = np.flatnonzero(width > 1), 1
    while len(m):
        out[starts[m] + k] = (x[m] >> np.uint64(7 * k)).astype(np.uint8) & 127
        k += 1
        m = m[width[m] > k]
    out[ends - 1] |= 128
    return out, ends


def _numbers(b: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(b & 128)
    first = np.concatenate([[0], last[:-1] + 1])
    k = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * k).astype(np.uint64), first)


class _Bucket:
    """The sets of one bucket and who meets whom on its tokens."""

    def __init__(self, packed: list[bytes], threshold: float, sides: bool):
        row, n, held, sides_of, fp, told, tokens = (np.concatenate(x) for x in zip(*map(_unpacked, packed)))
        own = np.repeat(np.arange(len(row)), held)
        # equal sets: the smallest row stands for all of them, on either side if one of them is
        order = np.lexsort((row, fp, ~told))
        first = np.concatenate([[True], (fp[order][1:] != fp[order][:-1]) | ~told[order][1:]])
        kept = order[first]
        either = np.bitwise_or.reduceat(sides_of[order], np.flatnonzero(first))
        by_row = np.argsort(row[kept])
        place = np.full(len(row), -1)
        place[kept[by_row]] = np.arange(len(kept))
        own = place[own]
        self.rows, self.n = row[kept][by_row], n[kept][by_row]
        # on a token sets stand by size, so those that admit the threshold are neighbours
        self.by_size = np.argsort(self.n, kind="stable")
        rank = np.empty(len(self.n), np.uint64)
        rank[self.by_size] = np.arange(len(self.n), dtype=np.uint64)
        self.keys = np.sort(tokens[own >= 0].astype(np.uint64) << np.uint64(32) | rank[own[own >= 0]])
        self.evaluated, self.trained = either[by_row] & 2 > 0, either[by_row] & 1 > 0
        self.threshold, self.sides = threshold, sides

    def meetings(self):
        """Arrays of e * sets + t, a bounded number at a time."""
        m, held, size = len(self.rows), [], 0
        ordered, low = self.n[self.by_size], np.uint64(0xFFFFFFFF)
        first = np.searchsorted(ordered, self.threshold * self.n - 1e-9).astype(np.uint64)
        stop = np.searchsorted(self.threshold * ordered - 1e-9, self.n, "right").astype(np.uint64)
        theirs, own = self.keys, self.by_size[(self.keys & low).astype(np.int64)]
        if self.sides:
            asked, token = own[self.evaluated[own]], (self.keys & ~low)[self.evaluated[own]]
            theirs, own = self.keys[self.trained[own]], own[self.trained[own]]
            begin = np.searchsorted(theirs, token | first[asked])
        else:
            asked, token, begin = own, self.keys & ~low, np.arange(1, len(own) + 1)
        count = np.maximum(np.searchsorted(theirs, token | stop[asked]) - begin, 0)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        edges = [0, *(np.searchsorted(ends, np.arange(SLICE, total, SLICE)) + 1).tolist(), len(ends)]
        for a, b in zip(edges, edges[1:]):
            c = count[a:b]
            e = np.repeat(asked[a:b], c)
            t = own[np.arange(len(e)) + np.repeat(begin[a:b] - np.cumsum(c) + c, c)]
            e, t = e[e != t], t[e != t]
            held.append(e * m + t if self.sides else np.minimum(e, t) * m + np.maximum(e, t))
            size += len(e)
            if size >= HELD:
                yield np.concatenate(held)
                held, size = [], 0
        if size:
            yield np.concatenate(held)

    def lists(self):
        """e, its size, the first it met, and the others as deltas; repeated ones stay."""
        for codes in self.meetings():
            codes = np.sort(codes)
            e, t = np.divmod(codes, len(self.rows))
            t = self.rows[t].astype(np.uint64)
            edges = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            delta = np.concatenate([[np.uint64(0)], t[1:] - t[:-1]])
            delta[edges] = 0
            data, ends = _varints(delta)
            starts = ends[edges] - 1  # the delta of the first is one byte
            places = np.append(starts, len(data)).astype(np.int32)
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)])
            yield self.rows[e[edges]], self.n[e[edges]], t[edges].astype(np.int64), lists


def prefix_pairs(df: DataFrame, base: DataFrame, id_column: str, fields: list[str], threshold: float, evaluated=None, trained=None, repeated: DataFrame | None = None) -> DataFrame:
    """``e, t``: every pair of different token sets of one field that can reach the threshold.

    ``e`` and ``t`` are ``2 row + field`` of the smallest rows with the sets.  With the conditions
    ``evaluated`` and ``trained`` an e has a copy with the first and its t one with the second;
    without them e < t.  ``base`` has ``field, n`` of every value.  ``repeated`` has the fingerprints
    ``fp_a, fp_b`` that more than one value has, if these are known.
    """
    sides = evaluated is not None
    truth = F.lit(True)
    chosen = df.select(
        F.col(f"`{id_column}`").alias("key"), (evaluated if sides else truth).alias("evaluated"), (trained if sides else truth).alias("trained"),
        *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(fields)),
    )
    return _pairs(chosen, base, len(fields), threshold, sides, repeated)


def given_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``e, t``: :func:`prefix_pairs` of known sets ``row, n, fp_a, fp_b, tokens``; ids are ``2 row``."""
    truth = F.lit(True)
    chosen = sets.select(F.col("row").alias("key"), truth.alias("evaluated"), truth.alias("trained"), "tokens", "fp_a", "fp_b")
    return _pairs(chosen, sets.withColumn("field", F.lit(0)), 1, threshold, False)


def _pairs(chosen: DataFrame, base: DataFrame, fields: int, threshold: float, sides: bool, repeated: DataFrame | None = None) -> DataFrame:
    counts = {r.field: r for r in base.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")).collect()}
    buckets = [int(min(1 << 16, max(LEAST_BUCKETS, -(-int(counts[k].tokens * (1 - threshold + 1 / STEP)) // BUCKET_TOKENS)))) if k in counts else LEAST_BUCKETS for k in range(fields)]
    begin = np.cumsum([0, *buckets]).tolist()
    context = chosen.sparkSession.sparkContext
    rare = context.broadcast(rarity(chosen, fields, sum(r.rows for r in counts.values())))
    bits = context.broadcast(None if repeated is None else repeated_bits(repeated))

    parts = min(begin[-1], 4096)
    slots = even_keys(chosen.sparkSession, begin[-1], parts)

    def deal(columns):
        rows = columns["key"].to_numpy()
        e, t = (columns[n].to_numpy(zero_copy_only=False) for n in ("evaluated", "trained"))
        for k in range(fields):
            sets = _sets(columns, k)
            if len(sets.which):
                own = sets.which
                found = list(_dealt(sets, rows[own] * 2 + k, (e[own] * 2 + t[own]).astype(np.int64), bits.value, rare.value, threshold, buckets[k]))
                yield {"bucket": slots[[begin[k] + b for b, _ in found]], "data": [d for _, d in found]}

    dealt = map_columns(chosen, "bucket int, data binary", deal).repartition(parts, "bucket").sortWithinPartitions("bucket")
    schema = pa.schema([("e", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("others", pa.binary())])

    def meet(batches):
        def done(packed):
            for columns in _Bucket(packed, threshold, sides).lists():
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

        at, packed = None, []
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if bucket != at:
                    if packed:
                        yield from done(packed)
                    at, packed = bucket, []
                packed.append(data)
        if packed:
            yield from done(packed)

    met = dealt.mapInArrow(meet, "e bigint, n bigint, first bigint, others binary").repartition("e").sortWithinPartitions("e")
    pairs = pa.schema([("e", pa.int64()), ("t", pa.int64())])

    def add(batches):
        rest = None  # e, size and t of the last e, which may go on in the next batch

        def done(e, n, t):
            edges = np.concatenate([[True], e[1:] != e[:-1]])
            number = np.cumsum(edges) - 1
            low, high = int(t.min()), int(t.max())
            if (high - low + 1) * (int(number[-1]) + 1) < 1 << 62:
                codes = np.sort(number * (high - low + 1) + (t - low))
                number, t = np.divmod(codes, high - low + 1)
                t += low
            else:
                order = np.lexsort((t, number))
                number, t = number[order], t[order]
            first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (t[1:] != t[:-1])]))
            often = np.diff(np.append(first, len(t))) >= 1 + least_shared(n[edges][number[first]], threshold) // STEP
            return pa.RecordBatch.from_arrays([pa.array(e[edges][number[first[often]]]), pa.array(t[first[often]])], schema=pairs)

        for batch in batches:
            if not batch.num_rows:
                continue
            e, n, first = (batch.column(c).to_numpy() for c in ("e", "n", "first"))
            others = batch.column("others").to_pylist()
            steps = _numbers(np.frombuffer(b"".join(others), np.uint8))
            # a list begins with a delta of 0, one byte
            marks = np.frombuffer(b"".join(others), np.uint8) & 128 > 0
            sizes = np.add.reduceat(marks.astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))
            with np.errstate(over="ignore"):
                total = np.cumsum(steps)
                t = (total + np.repeat(first.astype(np.uint64) - total[np.cumsum(sizes) - sizes], sizes)).astype(np.int64)
            now = [np.repeat(e, sizes), np.repeat(n, sizes), t]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            open_ = np.searchsorted(-(now[0] == now[0][-1]).astype(np.int8)[::-1], 0)
            cut = len(now[0]) - int(open_)
            if cut:
                yield done(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
        if rest is not None:
            yield done(*rest)

    return met.mapInArrow(add, "e bigint, t bigint")
