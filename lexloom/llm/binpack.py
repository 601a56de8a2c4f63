"""Filling fixed-capacity containers with documents, certified by lower bounds.

* A text longer than the capacity is cut into full containers and a rest; nothing else is cut.
* Items are dealt into partitions of about ``PARTITION_ITEMS`` by a hash of their id and packed
  best-fit decreasing.  Dual-feasible functions give a lower bound of the containers a partition
  needs; where it equals the containers used the partition is certified optimal and done.
* Partitions with a gap keep their completely filled containers and exchange the documents of the
  others: those are dealt anew into fewer, mixed partitions and packed again, round by round, as
  long as the number of containers falls.

Only the sizes travel, never the texts.  Defined results: null and empty texts have 0 tokens and
are put into a container like any other; equal sizes are ordered by id, so that the result depends
on the data alone; an empty table has no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled

PARTITION_ITEMS = 20_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; ``sizes`` must be in descending order and fit."""
    room_at: dict[int, list[int]] = {}  # free room -> containers
    rooms: list[int] = []  # distinct free rooms, ascending
    out, used = [], 0
    for size in sizes:
        k = bisect_left(rooms, size)
        if k == len(rooms):
            number, left = used, capacity - size
            used += 1
        else:
            room = rooms[k]
            stack = room_at[room]
            number, left = stack.pop(), room - size
            if not stack:
                del room_at[room], rooms[k]
        out.append(number)
        if left in room_at:
            room_at[left].append(number)
        else:
            room_at[left] = [number]
            insort(rooms, left)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of a family of dual-feasible functions.

    For a threshold ``a`` up to half the capacity, items above ``capacity - a`` count as whole
    containers, items below ``a`` as nothing, others as their size; and for a divisor ``k`` the
    rounding function floor((k + 1) x) / k, with x itself where (k + 1) x is whole.
    """
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity) if sizes.sum() else 1
    sizes = np.sort(sizes.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(sizes)])
    half = np.unique(sizes[sizes * 2 <= capacity])
    if len(half) > 512:
        half = half[np.linspace(0, len(half) - 1, 512).astype(int)]
    for a in np.concatenate([half, [0]]):
        low, high = np.searchsorted(sizes, a), np.searchsorted(sizes, capacity - a, side="right")
        whole = len(sizes) - high
        middle = int(total[high] - total[min(low, high)])
        best = max(best, whole - (-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = int((scaled[exact] * k // (k + 1)).sum()) + int((scaled[~exact] // capacity).sum() * capacity)
        best = max(best, -(-value // (k * capacity)))
    return best


def items_of(sizes: DataFrame, capacities: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``capacity_id, capacity, doc_id, piece, size``: one row per item; pieces of long texts.

    ``capacities`` is a stated set of requests; every row of ``sizes`` is an item for each.
    """
    asked = [(int(r[0]), int(r[1])) for r in capacities.select("capacity_id", "capacity_tokens").distinct().collect() if r[0] is not None and r[1]]
    wanted = F.array(*(F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in asked)) if asked else F.expr("CAST(array() AS array<struct<capacity_id:int,capacity:bigint>>)")
    each = sizes.select(F.col(f"`{id_column}`").alias("doc_id"), "n_tokens", F.explode(wanted).alias("c")).select("c.*", "doc_id", "n_tokens")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    return each.select("capacity_id", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "n_tokens").select(
        "capacity_id", "capacity", "doc_id", "piece", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("size")
    )


_SCHEMA = "capacity_id int, capacity bigint, part bigint, doc_id bigint, piece int, size bigint, bin int, fill bigint, gap int"


def _pack(table: pa.Table) -> pa.Table:
    """Pack one partition; ``gap`` is its containers above the lower bound."""
    capacity = table.column("capacity")[0].as_py()
    order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").to_numpy(), -table.column("size").to_numpy()))
    table = table.take(pa.array(order))
    sizes = table.column("size").to_numpy()
    bins = np.array(best_fit_decreasing(sizes.tolist(), capacity), np.int32)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    gap = len(fill) - lower_bound(sizes, capacity)
    columns = [table.column(n) for n in ("capacity_id", "capacity", "part", "doc_id", "piece", "size")]
    return pa.Table.from_arrays(
        [*columns, pa.array(bins), pa.array(fill[bins]), pa.array(np.full(len(bins), gap, np.int32))],
        names=["capacity_id", "capacity", "part", "doc_id", "piece", "size", "bin", "fill", "gap"],
    )


def _packed(items: DataFrame, salt: int) -> DataFrame:
    """Deal the items into partitions and pack each."""
    counts = {r[0]: r[1] for r in items.groupBy("capacity_id").count().collect()}
    parts = F.coalesce(*(F.when(F.col("capacity_id") == i, F.lit(max(1, -(-n // PARTITION_ITEMS)))) for i, n in counts.items())) if counts else F.lit(1)
    dealt = items.select("capacity_id", "capacity", F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), parts.cast("bigint")).alias("part"), "doc_id", "piece", "size")
    return settled(dealt.groupBy("capacity_id", "part").applyInArrow(_pack, _SCHEMA))


def _used(packed: DataFrame) -> dict[int, int]:
    bins = packed.groupBy("capacity_id", "part").agg((F.max("bin") + 1).alias("n")).groupBy("capacity_id").agg(F.sum("n"))
    return {r[0]: r[1] for r in bins.collect()}


def containers(sizes: DataFrame, capacities: DataFrame, rounds: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """``capacity_id, container_no, doc_id, piece, n_tokens, container_tokens, certified``.

    Container numbers are dense from 0 for each capacity.  ``certified`` says that the container
    is completely filled or belongs to a partition proven optimal.  The exchange ends when no
    capacity gets better or all partitions are certified, or after ``rounds`` if they are given.
    """
    current = _packed(items_of(sizes, capacities, id_column), 0)
    final: list[DataFrame] = []
    k = 0
    while rounds is None or k < rounds:
        k += 1
        again = (F.col("gap") > 0) & (F.col("fill") < F.col("capacity"))
        open_items = current.where(again)
        before = {r[0]: r[1] for r in open_items.groupBy("capacity_id", "part").agg(F.countDistinct("bin").alias("n")).groupBy("capacity_id").agg(F.sum("n")).collect()}
        if not before:
            break
        repacked = _packed(open_items.select("capacity_id", "capacity", "doc_id", "piece", "size"), k)
        after = _used(repacked)
        better = [c for c, n in before.items() if after[c] < n]
        if not better:
            break
        moved = F.col("capacity_id").isin(better)
        final.append(current.where(~(again & moved)).withColumn("round", F.lit(k - 1)))
        current = repacked.where(moved)
    final.append(current.withColumn("round", F.lit(k)))
    whole = final[0]
    for part in final[1:]:
        whole = whole.unionByName(part)
    return _numbered(whole)


def _numbered(whole: DataFrame) -> DataFrame:
    """Dense container numbers: offsets of the partitions (a small table) plus a dense rank inside."""
    from pyspark.sql import Window

    group = ["capacity_id", "round", "part"]
    bins = whole.groupBy(*group, "bin").agg(F.lit(1).alias("one"))
    inside = bins.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("bin")) - 1)
    counts = bins.groupBy(*group).agg(F.sum("one").alias("n"))
    start = F.sum("n").over(Window.partitionBy("capacity_id").orderBy("round", "part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group, F.coalesce(start, F.lit(0)).alias("start"))
    numbers = inside.join(offsets, group).select(*group, "bin", (F.col("start") + F.col("rank")).alias("container_no"))
    return whole.join(numbers, [*group, "bin"]).select(
        "capacity_id", "container_no", "doc_id", "piece", F.col("size").alias("n_tokens"), F.col("fill").alias("container_tokens"),
        ((F.col("fill") == F.col("capacity")) | (F.col("gap") <= 0)).alias("certified"),
    )


def usage(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens, least possible containers by volume, and unused share per capacity."""
    by = assigned.groupBy("capacity_id", "container_no").agg(F.sum("n_tokens").alias("tokens"), F.min("certified").alias("certified"))
    total = by.groupBy("capacity_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum(F.col("certified").cast("int")).alias("certified")
    )
    room = F.col("containers") * F.col("capacity_tokens")
    return total.join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id").select(
        "capacity_id", "capacity_tokens", "containers", "tokens", "certified",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("volume_bound"),
        F.round(1 - F.col("tokens") / room, 6).alias("unused_share"),
    )
