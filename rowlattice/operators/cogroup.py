"""Co-grouping of frames, key-value comparison and positional joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators.versions import quoted
from rowlattice.session import materialize


def cogroup(frames: Mapping[str, tuple[DataFrame, Sequence[str]]], names: Sequence[str] | None = None) -> DataFrame:
    """Rows of any number of frames with the same key, as one array a frame.

    ``frames`` maps a name to a frame and its key columns; keys match by
    place, null-safely, and are called as in the first frame (or ``names``).
    A frame without rows of a key has an empty array. One union and one
    shuffle serve all frames. The arrays are sorted where their type can be.
    """
    first = next(iter(frames.values()))[1]
    out_names = list(names or first)
    tagged = None
    schemas: dict[str, T.StructType] = {}
    for tag, (frame, keys) in frames.items():
        if len(keys) != len(out_names):
            raise ValueError("all frames need the same number of keys")
        schemas[tag] = frame.schema
        row = F.struct(*[F.col(quoted(c)) for c in frame.columns])
        key_columns = [F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)]
        packed = frame.select(*key_columns, *[(row if t == tag else F.lit(None).cast(f[0].schema)).alias(f"r_{i}") for i, (t, f) in enumerate(frames.items())])
        tagged = packed if tagged is None else tagged.union(packed)
    grouped = tagged.groupBy(*[f"k{i}" for i in range(len(out_names))]).agg(*[F.collect_list(f"r_{i}").alias(tag) for i, tag in enumerate(frames)])
    arrays = [F.array_sort(F.col(quoted(t))).alias(t) if _orderable(schemas[t]) else F.col(quoted(t)) for t in frames]
    return grouped.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(out_names)], *arrays)


def group_sizes(frames: Mapping[str, tuple[DataFrame, Sequence[str]]], names: Sequence[str] | None = None) -> DataFrame:
    """The keys of :func:`cogroup` and how many rows each frame has for them.

    Sizes are counted on the map side, so a key may hold any share of the rows.
    """
    names = list(names or next(iter(frames.values()))[1])
    tagged = None
    for tag, (frame, keys) in frames.items():
        one = frame.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.lit(tag).alias("__frame"))
        tagged = one if tagged is None else tagged.union(one)
    return tagged.groupBy(*[F.col(quoted(n)) for n in names]).agg(*[F.count_if(F.col("__frame") == tag).alias(tag) for tag in frames])


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def nest(group: DataFrame, key: str, parts: Mapping[str, DataFrame], part_key: str | None = None, strict: bool = False) -> DataFrame:
    """Each row of ``group`` with the rows of the other frames that have its key.

    Adds one array of structs per part, without the key column. Of several
    group rows with a key the smallest stays. Rows of a part whose key the
    group lacks are left out; ``strict`` raises if there are any.
    """
    others = [c for c in group.columns if c != key]
    out = group.groupBy(F.col(quoted(key))).agg(F.min(F.struct(*[F.col(quoted(c)) for c in others])).alias("__row")) if others else group.distinct()
    out = out.select(F.col(quoted(key)), *[F.col(f"__row.{quoted(c)}") for c in others])
    for name, part in parts.items():
        own = part_key or key
        fields = [F.col(quoted(c)) for c in part.columns if c != own]
        row = F.struct(*fields) if fields else F.struct(F.lit(True).alias("present"))
        rows = F.collect_list(row)
        packed = part.groupBy(F.col(quoted(own)).alias("__key")).agg((F.array_sort(rows) if _orderable(part.schema) else rows).alias(name))
        if strict:
            lost = packed.join(group.select(F.col(quoted(key)).alias("__k")), F.col("__key").eqNullSafe(F.col("__k")), "left_anti")
            if lost.limit(1).count():
                raise ValueError(f"{name} has keys that the group lacks")
        kind = packed.schema[name].dataType
        joined = out.join(packed, F.col(quoted(key)).eqNullSafe(F.col("__key")), "left")
        out = joined.select(*[F.col(quoted(c)) for c in out.columns], F.coalesce(F.col(quoted(name)), F.array().cast(kind)).alias(name))
    return out


def compare_measures(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Totals of measures on the left only, the right only and in common.

    One row per measure: ``left_only``, ``right_only``, ``left_common``,
    ``right_common``, ``diff`` and ``diff2`` (right minus left over common
    keys, and its square), ``n_left``, ``n_right``, ``n_common``, ``n_zero``
    (common keys without difference). Values of a key are added up first.
    """

    def totals(side: DataFrame, tag: str) -> DataFrame:
        return side.groupBy(*[F.col(quoted(k)).alias(f"{tag}k{i}") for i, k in enumerate(keys)]).agg(*[F.sum(F.col(quoted(m)).cast("double")).alias(f"{tag}m{i}") for i, m in enumerate(measures)], F.lit(True).alias(f"{tag}here"))

    a, b = totals(left, "a"), totals(right, "b")
    on = None
    for i in range(len(keys)):
        same = F.col(f"ak{i}").eqNullSafe(F.col(f"bk{i}"))
        on = same if on is None else on & same
    joined = a.join(b, on, "full_outer")
    both = F.col("ahere").isNotNull() & F.col("bhere").isNotNull()
    rows = []
    for i, m in enumerate(measures):
        x, y = F.coalesce(F.col(f"am{i}"), F.lit(0.0)), F.coalesce(F.col(f"bm{i}"), F.lit(0.0))
        rows.append(F.struct(F.lit(m).alias("measure"), x.alias("x"), y.alias("y")))
    long_form = joined.select(both.alias("both"), F.col("ahere").isNotNull().alias("has_left"), F.inline(F.array(*rows)))
    only_left, only_right, common = ~F.col("both") & F.col("has_left"), ~F.col("has_left"), F.col("both")

    def total(when, value):
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0.0))

    def count(when):
        return F.count(F.when(when, 1))

    gap = F.col("y") - F.col("x")
    return long_form.groupBy("measure").agg(
        total(only_left, F.col("x")).alias("left_only"),
        total(only_right, F.col("y")).alias("right_only"),
        total(common, F.col("x")).alias("left_common"),
        total(common, F.col("y")).alias("right_common"),
        total(common, gap).alias("diff"),
        total(common, gap * gap).alias("diff2"),
        count(only_left).alias("n_left"),
        count(only_right).alias("n_right"),
        count(common).alias("n_common"),
        count(common & (gap == 0)).alias("n_zero"),
    )


def cogroup_lists(left: Sequence, right: Sequence, left_key, right_key) -> list[tuple]:
    """In-memory co-group: (key, left items, right items), keys as first seen."""
    out: dict = {}
    for side, items, key in ((0, left, left_key), (1, right, right_key)):
        for item in items:
            out.setdefault(key(item), ([], []))[side].append(item)
    return [(k, a, b) for k, (a, b) in out.items()]


def indexed(df: DataFrame, name: str = "row_index", order: Sequence[str] | None = None) -> DataFrame:
    """Number the rows from 0: as the frame delivers them, or in an order.

    With an order, ranges of it are numbered in parallel: rows are placed by
    range, counted per partition, and numbered from the sums before.
    """
    if order:
        df = df.repartitionByRange(*[F.col(quoted(c)) for c in order]).sortWithinPartitions(*[F.col(quoted(c)) for c in order])
    # the id holds the partition and the place in it, written once for good
    marked = materialize(df.withColumn("__id", F.monotonically_increasing_id()))
    partition, place = F.shiftrightunsigned("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(partition.alias("__partition")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__partition", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # one row a partition
    joined = marked.withColumn("__in", partition).join(F.broadcast(starts), F.col("__in") == F.col("__partition"))
    return joined.select(*[F.col(quoted(c)) for c in df.columns], (F.col("__start") + place).alias(name))


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence, n: int, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group in an order that ties no two rows.

    Taken in two steps, first in ``parts`` parts of each group, so no task
    sorts a whole group.
    """
    keys = [F.col(quoted(g)) for g in group]
    part = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in df.columns]), F.lit(parts))
    near = df.withColumn("__part", part).withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).where(F.col("__place") <= n)
    return near.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= n).drop("__part", "__place")
