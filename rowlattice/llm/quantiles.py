"""Percentiles by deterministic collapsing of sorted buffers.

A summary holds, for each level j, buffers of ``size`` values (and one that is
filling) that stand for ``2**j`` rows each. Two full buffers of a level are
merged in order and every second value makes one buffer of the next level; whether the even or the odd places are
taken alternates. A collapse at level j moves any rank by at most ``2**j``, and
n rows cause at most ``n / (size * 2**(j + 1))`` collapses there, so a rank is
off by at most ``n * levels / (2 * size)``: each summary carries the sum of its
own collapses as ``error``. Summaries are rows of a table, so those of other
partitions, days or systems are combined the same way, in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlattice.session import materialize, ship_package

#: Values in a buffer. At 2**40 rows the rank error stays below 0.2 %.
BUFFER = 8192
#: Summaries merged by one task in a round of the tree.
FAN_IN = 64
#: Groups a task holds open before it passes their summaries on.
OPEN_GROUPS = 512


class Summary:
    """Mergeable summary of a weighted multiset of numbers."""

    def __init__(self, size: int, kind: type = np.int64) -> None:
        self.size, self.kind = size, kind
        self.levels: list[list[np.ndarray]] = []
        self.held: list[int] = []
        self.n = self.error = self.turns = 0

    def put(self, level: int, values: np.ndarray) -> None:
        """Add values of one weight: they fill buffers, and two full ones are collapsed."""
        while len(self.levels) <= level:
            self.levels.append([])
            self.held.append(0)
        self.levels[level].append(values)
        self.held[level] += len(values)
        while level < len(self.levels) and self.held[level] >= 2 * self.size:
            self._collapse(level)
            level += 1

    def _collapse(self, level: int) -> None:
        """Collapse pairs of buffers of ``size`` values each until fewer than two are left."""
        flat = np.concatenate(self.levels[level])
        pairs = len(flat) // (2 * self.size)
        ordered = np.sort(flat[: pairs * 2 * self.size].reshape(pairs, -1), axis=1)
        # one pair takes the even places, the next one the odd ones
        odd = ((self.turns >> level) + np.arange(pairs)) & 1
        up = np.where(odd[:, None] == 1, ordered[:, 1::2], ordered[:, ::2]).ravel()
        self.turns ^= (pairs & 1) << level
        self.error += pairs << level
        rest = flat[pairs * 2 * self.size :]
        self.levels[level], self.held[level] = [rest], len(rest)
        if len(self.levels) == level + 1:
            self.levels.append([])
            self.held.append(0)
        self.levels[level + 1].append(up)
        self.held[level + 1] += len(up)

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Add values, each as often as its count: by the count's binary digits."""
        if counts is None:
            self.n += len(values)
            if len(values):
                self.put(0, values)
            return
        self.n += int(counts.sum())
        for bit in range(int(counts.max(initial=0)).bit_length()):
            chosen = values[(counts >> bit) & 1 == 1]
            if len(chosen):
                self.put(bit, chosen)

    def merge(self, levels: Sequence[np.ndarray], n: int, error: int) -> None:
        self.n += n
        self.error += error
        for level, values in enumerate(levels):
            if len(values):
                self.put(level, np.asarray(values, self.kind))

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(parts) if parts else np.zeros(0, self.kind) for parts in self.levels]

    def percentiles(self, pcts: Sequence[float]) -> list:
        """Smallest values that at least pct % of the rows do not exceed."""
        arrays = self.arrays()
        values = np.concatenate([*arrays, np.zeros(0, self.kind)])
        weights = np.concatenate([*(np.full(len(a), 1 << j, np.int64) for j, a in enumerate(arrays)), np.zeros(0, np.int64)])
        order = np.argsort(values, kind="stable")
        reached = np.cumsum(weights[order])
        out = []
        for pct in pcts:
            rank = max(1, -(-int(round(pct * 1_000_000)) * self.n // 100_000_000))
            at = int(np.searchsorted(reached, rank))
            out.append(values[order[min(at, len(order) - 1)]].item() if len(order) else None)
        return out


def _record(groups: list, summaries: list[Summary], kind: pa.DataType, group_type: pa.DataType, part: int) -> pa.RecordBatch:
    flat, inner, outer = [], [0], [0]
    for s in summaries:
        for values in s.arrays():
            flat.append(values)
            inner.append(inner[-1] + len(values))
        outer.append(len(inner) - 1)
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0), kind)
    lists = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), values))
    return pa.RecordBatch.from_arrays(
        [pa.array(groups, group_type), pa.array([s.n for s in summaries], pa.int64()), pa.array([s.error for s in summaries], pa.int64()), lists, pa.array([part] * len(groups), pa.int64())],
        names=["g", "n", "error", "levels", "part"],
    )


def _is_float(kind: pa.DataType) -> bool:
    return pa.types.is_floating(kind)


def build(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One summary for each group of a partition. In: g, v, w."""
    part = (context := TaskContext.get()) and context.partitionId() or 0
    open_groups: dict = {}
    group_type = kind = None
    for batch in batches:
        group_type, kind = batch.column(0).type, batch.column(1).type
        encoded = batch.column(0).dictionary_encode()
        names = encoded.dictionary.to_pylist()
        codes = encoded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
        values, counts = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0)) if len(order) else np.zeros(0, int)
        for rows in np.split(order, starts[1:]):
            if not len(rows):
                continue
            code = int(codes[rows[0]])
            name = names[code] if code < len(names) else None
            if name not in open_groups:
                if len(open_groups) >= OPEN_GROUPS:
                    yield _record(list(open_groups), list(open_groups.values()), kind, group_type, part)
                    open_groups = {}
                open_groups[name] = Summary(size, np.float64 if _is_float(kind) else np.int64)
            weights = counts[rows]
            open_groups[name].add(values[rows], None if (weights == 1).all() else weights)
    if open_groups:
        yield _record(list(open_groups), list(open_groups.values()), kind, group_type, part)


def merge_sorted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Merge the summaries of each group and part. In: sorted by part, group."""
    current, summary, group_type, kind = None, None, None, None
    for batch in batches:
        group_type, kind = batch.column(0).type, batch.column(3).type.value_type.value_type
        for row in range(batch.num_rows):
            key = (batch.column(0)[row].as_py(), batch.column(4)[row].as_py())
            if summary is None or key != current:
                if summary is not None:
                    yield _record([current[0]], [summary], kind, group_type, current[1])
                current, summary = key, Summary(size, np.float64 if _is_float(kind) else np.int64)
            levels = batch.column(3)[row].values
            arrays = [level.values.to_numpy(zero_copy_only=False) for level in levels] if levels is not None else []
            summary.merge(arrays, batch.column(1)[row].as_py(), batch.column(2)[row].as_py())
    if summary is not None:
        yield _record([current[0]], [summary], kind, group_type, current[1])


def _ask(batches: Iterator[pa.RecordBatch], pcts: Sequence[float], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = batch.column(3).type.value_type.value_type
        rows = []
        for row in range(batch.num_rows):
            summary = Summary(size, np.float64 if _is_float(kind) else np.int64)
            summary.merge([level.values.to_numpy(zero_copy_only=False) for level in batch.column(3)[row].values], batch.column(1)[row].as_py(), batch.column(2)[row].as_py())
            g = batch.column(0)[row].as_py()
            rows += [(g, p, v, summary.n, summary.error) for p, v in zip(pcts, summary.percentiles(pcts))]
        if rows:
            kinds = [batch.column(0).type, pa.float64(), kind, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["g", "pct", "value", "rows", "error"])


def summarise(rows: DataFrame, group: str, value: str, weight: str | None = None, size: int = BUFFER) -> DataFrame:
    """One summary row for each group: ``g, n, error, levels``.

    Write it to a table to combine it later with others by :func:`combine`.

    Defined results: null values and weights that are null, zero or negative
    count nothing; a null group is a group; NaN is the greatest number; a
    group without any value has no row; other columns are ignored. Integers
    are kept as bigint, all other numbers as double.
    """
    ship_package(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kind = "bigint" if kinds[value] in ("tinyint", "smallint", "int", "bigint") else "double"
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    plain = rows.select(F.col(group).alias("g"), F.col(value).cast(kind).alias("v"), w.alias("w")).where(F.col("v").isNotNull() & (F.col("w") > 0))
    built = plain.mapInArrow(lambda it: build(it, size), f"g {kinds[group]}, n bigint, error bigint, levels array<array<{kind}>>, part bigint")
    return _tree(built, size)


def combine(summaries: DataFrame, size: int = BUFFER) -> DataFrame:
    """Merge summaries of the same group, of any number of tables."""
    return _tree(summaries.withColumn("part", F.shiftrightunsigned(F.xxhash64("n", "error", "levels"), 1)), size)


def _tree(parts: DataFrame, size: int) -> DataFrame:
    """Merge by rounds; a task takes about ``FAN_IN`` summaries of a group."""
    schema = parts.schema
    parts = materialize(parts)  # as many as there were partitions and groups
    widest = parts.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    width = FAN_IN
    steps = [1]
    while width < widest:
        steps.append(width)
        width *= FAN_IN
    for step in reversed(steps):
        grouped = parts.withColumn("part", F.pmod("part", F.lit(step))).repartition("g", "part").sortWithinPartitions("part", "g")
        parts = grouped.mapInArrow(lambda it: merge_sorted(it, size), schema)
    return parts.drop("part")


def percentiles(summaries: DataFrame, pcts: Sequence[float], group: str, value: str, size: int = BUFFER) -> DataFrame:
    """Group, ``pct``, value, ``rows`` and the bound of the rank's ``error``."""
    kinds = {f.name: f.dataType.simpleString() for f in summaries.schema.fields}
    kind = kinds["levels"].removeprefix("array<array<").removesuffix(">>")
    asked = summaries.withColumn("part", F.lit(0).cast("bigint")).mapInArrow(lambda it: _ask(it, list(pcts), size), f"g {kinds['g']}, pct double, value {kind}, rows bigint, error bigint")
    return asked.select(F.col("g").alias(group), "pct", F.col("value").alias(value), "rows", "error")
