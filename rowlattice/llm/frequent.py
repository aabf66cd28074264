"""Most frequent values by external sort and run-length counting.

Each input partition is sorted (spilling, by Spark's own sorter) and written as
runs of equal values with their counts, so a value that holds a third of all
rows leaves each partition as one run. The runs are range-partitioned by
(group, value), sorted, and equal neighbours added up; each range keeps a heap
of ``k`` values a group. Memory is one batch of rows and one heap a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlattice.session import materialize, ship_package


def _bounds(columns: Sequence[pa.Array]) -> np.ndarray:
    """First rows of the runs of equal rows, nulls being equal to each other."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[0] = True
    for column in columns:
        a, b = column.slice(1), column.slice(0, n - 1)
        unequal = pc.fill_null(pc.not_equal(a, b), True)
        both_null = pc.and_(a.is_null(), b.is_null())
        unequal = pc.and_(unequal, pc.invert(both_null))
        if pa.types.is_floating(column.type):
            unequal = pc.and_(unequal, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        change[1:] |= unequal.to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the last column over equal neighbours in all other columns."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        keys, counts = batch.columns[:-1], batch.columns[-1].to_numpy(zero_copy_only=False)
        starts = _bounds(keys)
        totals = np.add.reduceat(counts, starts)
        where = pa.array(starts)
        merged = pa.RecordBatch.from_arrays([*(k.take(where) for k in keys), pa.array(totals)], names=batch.schema.names)
        carry = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if carry is not None:
        yield carry


class _Reversed:
    """Orders values the other way round, for ties in the heap."""

    __slots__ = ("value",)

    def __init__(self, value) -> None:
        self.value = value

    def __lt__(self, other: _Reversed) -> bool:
        return other.value < self.value


def heaviest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` heaviest runs of each group, and a row with the group's total.

    In: group, value, n, sorted. Out: the same and ``is_total``.
    """
    schema: pa.Schema | None = None
    group, heap, total, open_group = None, [], 0, False

    def flush() -> pa.RecordBatch:
        rows = [(group, v.value, n, False) for n, v in heap] + [(group, None, total, True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [schema.field(0).type, schema.field(1).type, pa.int64(), pa.bool_()])], names=[*schema.names[:3], "is_total"])

    for batch in runs(batches):
        schema = batch.schema
        starts = _bounds([batch.column(0)])
        counts = batch.column(2).to_numpy()
        for at, end in zip(starts, np.append(starts[1:], batch.num_rows)):
            here = batch.column(0)[int(at)].as_py()
            if not open_group or here != group:
                if open_group:
                    yield flush()
                group, heap, total, open_group = here, [], 0, True
            part = counts[at:end]
            total += int(part.sum())
            # values rise within a range, so of equal counts the first ones stay
            likely = np.flatnonzero(part > (heap[0][0] if len(heap) == k else 0))
            if len(likely) > k:
                likely = np.sort(likely[np.argsort(-part[likely], kind="stable")[:k]])
            values = batch.column(1).take(pa.array(likely + at)).to_pylist()
            for n, value in zip(part[likely].tolist(), values):
                item = (n, _Reversed(value))
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif heap[0] < item:
                    heapq.heapreplace(heap, item)
    if open_group:
        yield flush()


def frequent_values(rows: DataFrame, group: str, value: str, weight: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group with their counts.

    ``rows`` has a group, a value and the number of times it was seen there.
    Returns group, value, ``n`` and ``total`` (of all values of the group).
    The counts are exact; with ``k >= 1 / s`` every value with a share of at
    least ``s`` is among them.

    Defined results: a null value is no value and not in the total; the empty
    string is a value; a null group is a group; a weight that is null, zero
    or negative counts nothing; equal counts are settled by the smaller
    value; an empty table gives no rows; other columns are ignored.
    """
    ship_package(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    counted = rows.select(F.col(group).alias("g"), F.col(value).alias("v"), F.col(weight).cast("bigint").alias("n")).where(F.col("v").isNotNull() & (F.col("n") > 0))
    schema = f"g {kinds[group]}, v {kinds[value]}, n bigint"
    # written once: finding the ranges reads the runs a first time
    local = materialize(counted.sortWithinPartitions("g", "v").mapInArrow(runs, schema))
    ranged = local.repartitionByRange("g", "v").sortWithinPartitions("g", "v")
    kept = ranged.mapInArrow(lambda it: heaviest(it, k), schema + ", is_total boolean")
    by_group = Window.partitionBy("g")
    # at most k rows a group and range are left here
    totals = kept.withColumn("total", F.sum(F.when(F.col("is_total"), F.col("n"))).over(by_group)).where("not is_total")
    ranked = totals.withColumn("place", F.row_number().over(by_group.orderBy(F.desc("n"), F.asc("v"))))
    return ranked.where(F.col("place") <= k).select(F.col("g").alias(group), F.col("v").alias(value), "n", "total")


def once(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Each key once: redelivered rows hold the same content.

    Rows whose key is null are no redeliveries of each other: all are kept.
    """
    packed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.first(c).alias(c) for c in columns])
    return packed.select(*columns).union(rows.where(F.col(key).isNull()).select(*columns))
