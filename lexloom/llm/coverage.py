"""How much of each evaluation value stands in the training texts, whatever the single texts share.

The runs of 10 characters of all values are dealt to buckets by hash: those of training values
once a batch, those of evaluation values at every place.  A bucket finds the places whose run is in
any training value of the field; the places of a value, over all training texts and buckets, unite
to the characters covered.  48 bits of a run travel beside its bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_columns
from .countvectors import WIDTH
from .forms import bare_batch, classes, run_hashes
from .lookalike import LEAST_VISIBLE
from .prefixes import BUCKET_TOKENS, _numbers, _varints

_HEAD = np.dtype([("row", "<i8"), ("chars", "<i4"), ("places", "<i4")])


def _runs(texts: list[str | None]):
    """Hash, text number and place of all runs of the texts that take part, and their characters."""
    c, sizes = bare_batch(texts)
    table = classes()
    owner = np.repeat(np.arange(len(texts)), sizes)
    seen = np.bincount(owner[table[np.minimum(c, len(table) - 1)] != 3], minlength=len(texts))
    hashes = run_hashes(c, WIDTH)
    begin = np.cumsum(sizes) - sizes
    own = owner[: len(hashes)]
    place = np.arange(len(hashes)) - begin[own]
    whole = (place + WIDTH <= sizes[own]) & (seen[own] >= LEAST_VISIBLE)
    return hashes[whole], own[whole], place[whole], sizes


def _parts(order: np.ndarray, edges: np.ndarray):
    return zip(edges.tolist(), [*edges[1:].tolist(), len(order)])


def _edges(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _cut(h: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return (h >> np.uint64(16)).astype(np.uint32).tobytes() + h.astype(np.uint16).tobytes()


def _joined(b: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint32, n, at).astype(np.uint64) << np.uint64(16) | np.frombuffer(b, np.uint16, n, at + 4 * n)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.uint16)


def covered(df: DataFrame, base: DataFrame, id_column: str, fields: list[str], evaluated: Column) -> DataFrame:
    """``row, coverage``: share of characters of each evaluation value (``2 row + field``) in runs of training values.

    ``base`` has ``n`` of every value; values without any such run are left out.
    """
    tokens = base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = int(min(1 << 16, max(4, -(-int(tokens) // BUCKET_TOKENS))))

    def deal(columns):
        rows, e = columns["key"].to_numpy(), columns["evaluated"].to_numpy(zero_copy_only=False)
        for k in range(len(fields)):
            h, own, place, sizes = _runs(columns[f"v{k}"].to_pylist())
            out = ([], [], [])
            train = np.unique(h[~e[own]])
            bucket = _bucket_of(train, buckets)
            order = np.argsort(bucket, kind="stable")
            for a, b in _parts(order, _edges(bucket[order])):
                for store, value in zip(out, (int(bucket[order[a]]) * len(fields) + k, False, _cut(train[order[a:b]]))):
                    store.append(value)
            mine = e[own]
            h, own, place = h[mine], own[mine], place[mine]
            bucket = _bucket_of(h, buckets)
            order = np.argsort(bucket, kind="stable")
            for a, b in _parts(order, _edges(bucket[order])):
                o = order[a:b]
                first = _edges(own[o])
                head = np.zeros(len(first), _HEAD)
                head["row"], head["chars"], head["places"] = rows[own[o[first]]] * 2 + k, sizes[own[o[first]]], np.diff(np.append(first, len(o)))
                step = np.diff(place[o], prepend=0)
                step[first] = place[o[first]]
                data = np.int64(len(first)).tobytes() + np.int64(len(o)).tobytes() + head.tobytes() + _cut(h[o]) + _varints(step.astype(np.uint64))[0].tobytes()
                for store, value in zip(out, (int(bucket[o[0]]) * len(fields) + k, True, data)):
                    store.append(value)
            if out[0]:
                yield {"bucket": out[0], "evaluated": out[1], "data": out[2]}

    chosen = df.select(F.col(f"`{id_column}`").alias("key"), evaluated.alias("evaluated"), *(F.col(f"`{f}`").alias(f"v{k}") for k, f in enumerate(fields)))
    dealt = map_columns(chosen, "bucket int, evaluated boolean, data binary", deal).repartition(min(buckets * len(fields), 4096), "bucket").sortWithinPartitions("bucket", "evaluated")
    schema = pa.schema([("row", pa.int64()), ("chars", pa.int32()), ("places", pa.binary())])

    def find(batches):
        at, train, ready = None, [], None
        for batch in batches:
            for bucket, asked, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "evaluated", "data"))):
                if bucket != at:
                    at, train, ready = bucket, [], None
                if not asked:
                    train.append(_joined(data, 0, len(data) // 6))
                    continue
                if ready is None:
                    ready = np.unique(np.concatenate(train)) if train else np.zeros(0, np.uint64)
                    train = []
                if not len(ready):
                    continue
                m, n = np.frombuffer(data, np.int64, 2).tolist()
                head = np.frombuffer(data, _HEAD, m, 16)
                begin = 16 + m * _HEAD.itemsize
                h = _joined(data, begin, n)
                own = np.repeat(np.arange(m), head["places"])
                step = np.cumsum(_numbers(np.frombuffer(data, np.uint8, -1, begin + 6 * n)).astype(np.int64))
                starts = np.cumsum(head["places"]) - head["places"]
                place = step - np.where(starts > 0, step[starts - 1], 0)[own]
                hit = ready[np.minimum(np.searchsorted(ready, h), len(ready) - 1)] == h
                own, place = own[hit], place[hit]
                if len(own):
                    first = _edges(own)
                    step = np.diff(place, prepend=0)
                    step[first] = place[first]
                    packed, ends = _varints(step.astype(np.uint64))
                    offsets = np.append(np.where(first > 0, ends[first - 1], 0), len(packed)).astype(np.int32)
                    lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
                    yield pa.RecordBatch.from_arrays([pa.array(head["row"][own[first]]), pa.array(head["chars"][own[first]]), lists], schema=schema)

    met = dealt.mapInArrow(find, "row bigint, chars int, places binary").groupBy("row").agg(F.max("chars").alias("chars"), F.collect_list("places").alias("places"))

    def unite(columns):
        shares = []
        for chars, lists in zip(columns["chars"].to_pylist(), columns["places"].to_pylist()):
            at = np.unique(np.concatenate([np.cumsum(_numbers(np.frombuffer(x, np.uint8)).astype(np.int64)) for x in lists]))
            shares.append(float(np.minimum(np.diff(np.append(at, at[-1] + WIDTH)), WIDTH).sum() / chars))
        yield {"row": columns["row"], "coverage": shares}

    return map_columns(met, "row bigint, coverage double", unite)
