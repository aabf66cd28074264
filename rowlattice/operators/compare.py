"""Assertions on frames: predicates, containment, equality in and out of order."""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators.cogroup import indexed
from rowlattice.operators.versions import comparable, quoted
from rowlattice.plans.paths import ArrayIndex, FieldIndex, Root
from rowlattice.plans.schema import NoCommonField, SchemaError, compare


@dataclass(frozen=True)
class Policy:
    """What a difference of schemas means, and how many rows a report shows."""

    fail_on_missing_original: bool = True
    fail_on_missing_expected: bool = True
    fail_on_changed_type: bool = True
    fail_on_nullable: bool = False
    max_row_error: int = 10


policy = Policy()
#: Rows that an error shows where the policy sets no limit.
MAX_SHOWN = 1_000


@contextmanager
def using(**changes) -> Iterator[Policy]:
    """Another policy within a block; the old one is back after it, always."""
    global policy
    before = policy
    policy = replace(policy, **changes)
    try:
        yield policy
    finally:
        policy = before


class ValueMismatch(AssertionError):
    """The values of two frames differ."""


def _condition(predicate: str | Column) -> Column:
    return F.expr(predicate) if isinstance(predicate, str) else predicate


def violations(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows of which the predicate is false; null passes."""
    return df.where(~_condition(predicate))


def should_for_all(df: DataFrame, predicate: str | Column) -> None:
    """Fail if the predicate is false of any row; null passes."""
    rows = violations(df, predicate).limit(10).collect()
    if rows:
        raise AssertionError("Rows not matching the predicate:\n" + "\n".join(map(str, rows)))


def should_exist(df: DataFrame, predicate: str | Column) -> None:
    """Fail unless the predicate is true of some row."""
    if not df.where(_condition(predicate)).limit(1).collect():
        raise AssertionError("No row matches the predicate, for example not:\n" + "\n".join(map(str, df.limit(10).collect())))


def missing_values(df: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of ``values`` that ``df`` lacks, null-safely, each once."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    a, b = values.alias("a"), df.select(*[F.col(quoted(c)) for c in values.columns]).distinct().alias("b")
    on = None
    for c in values.columns:
        same = F.col(f"a.{quoted(c)}").eqNullSafe(F.col(f"b.{quoted(c)}").cast(kinds[c]))
        on = same if on is None else on & same
    return a.join(b, on, "left_anti").distinct()


def assert_contains(df: DataFrame, values: DataFrame | Sequence) -> None:
    if not isinstance(values, DataFrame):
        values = df.sparkSession.createDataFrame([tuple(v) if isinstance(v, (tuple, Row)) else (v,) for v in values], df.schema)
    lost = missing_values(df, values).limit(10).collect()
    if lost:
        raise AssertionError("At least one value was not in the dataset. Values not in the dataset:\n" + "\n".join(map(str, lost)))


def align(actual: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with the columns they are compared on, by the policy.

    Columns of one side only are dropped where the policy lets them be missing,
    changed types cast to the expected one where it does not mind them.
    """
    changes = compare(actual.schema, expected.schema)
    if not changes:
        return actual, expected
    forbidden = {
        "remove": policy.fail_on_missing_original,
        "add": policy.fail_on_missing_expected,
        "change_type": policy.fail_on_changed_type,
        "set_nullable": policy.fail_on_nullable,
        "set_non_nullable": policy.fail_on_nullable,
    }
    common = [c for c in actual.columns if c in expected.columns]
    if not common and (actual.columns or expected.columns):
        raise NoCommonField()
    bad = [c for c in changes if forbidden[c.kind]]
    if bad:
        raise SchemaError(bad)
    kinds = {f.name: f.dataType for f in expected.schema.fields}
    return actual.select(*[F.col(quoted(c)).cast(kinds[c]).alias(c) for c in common]), expected.select(*[F.col(quoted(c)) for c in common])


def _some_value(kind: T.DataType) -> Column:
    """A literal of a type that is no null."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_some_value(f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return (F.array() if isinstance(kind, T.ArrayType) else F.create_map()).cast(kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(datetime.datetime(1970, 1, 1)).cast(kind)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(0).cast(kind)


def set_nullable(df: DataFrame, name: str, nullable: bool) -> DataFrame:
    """The frame with one column's nullability declared otherwise.

    Said to have no nulls, the column is checked as it is read: a null there
    ends the job. Rows stay in the JVM and filters are pushed down past it.
    """
    column = F.col(quoted(name))
    if nullable:
        said = F.when(column.isNotNull(), column)  # the same, but nullable as analysed
    else:
        kind = df.schema[name].dataType
        # the last choice is never reached, but says that there is no null
        said = F.coalesce(column, F.raise_error(F.lit(f"a null in {name}")).cast(kind), _some_value(kind))
    return df.withColumn(name, said)


def order_columns(df: DataFrame) -> DataFrame:
    """The columns in the order of their names."""
    return df.select(*[F.col(quoted(c)) for c in sorted(df.columns)])


def columns_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows in which two columns differ; null equals null."""
    return df.where(~F.col(quoted(a)).eqNullSafe(F.col(quoted(b))))


def assert_columns_equal(df: DataFrame, a: str, b: str) -> None:
    rows = columns_differ(df, a, b).limit(10).collect()
    if rows:
        raise AssertionError(f"Columns {a} and {b} are different:\n" + "\n".join(map(str, rows)))


def multiset_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that are there more often on one side: the row, n_left, n_right.

    One union and one aggregate with map-side combine; null equals null.
    """
    kinds = {f.name: f.dataType for f in left.schema.fields}
    right = right.select(*[F.col(quoted(c)) for c in left.columns])
    tagged = left.withColumn("__left", F.lit(True)).union(right.withColumn("__left", F.lit(False)))
    keys = [comparable(c, kinds[c]).alias(f"k{i}") for i, c in enumerate(left.columns)]
    counted = tagged.groupBy(*keys).agg(*[F.first(F.col(quoted(c))).alias(f"v{i}") for i, c in enumerate(left.columns)], F.count(F.when(F.col("__left"), 1)).alias("n_left"), F.count(F.when(~F.col("__left"), 1)).alias("n_right"))
    found = counted.where(F.col("n_left") != F.col("n_right"))
    return found.select(*[F.col(f"v{i}").alias(c) for i, c in enumerate(left.columns)], "n_left", "n_right")


def ordered_differences(left: DataFrame, right: DataFrame, order: Sequence[str] | None = None, nan_differs: bool = False) -> DataFrame:
    """Rows that differ place by place: row_index, the left and the right row.

    Places are those in ``order``, or in which the frames deliver their rows;
    a row beyond the other side's end faces null.
    """
    a = indexed(left, "row_index", order)
    b = indexed(right.select(*[F.col(quoted(c)) for c in left.columns]), "row_index", order)
    columns = [F.col(quoted(c)) for c in left.columns]
    x = a.select("row_index", F.struct(*columns).alias("left"))
    y = b.select("row_index", F.struct(*columns).alias("right"))
    unequal = ~F.col("left").eqNullSafe(F.col("right"))
    if nan_differs:
        for f in left.schema.fields:
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                unequal = unequal | F.coalesce(F.isnan(F.col(f"left.{quoted(f.name)}")), F.lit(False))
    return x.join(y, "row_index", "full_outer").where(unequal)


@dataclass(frozen=True)
class ValueChange:
    """A difference at one place of a row: kind is add, remove or change."""

    path: FieldIndex | ArrayIndex
    kind: str
    before: object = None
    after: object = None

    def sentence(self) -> str:
        name = self.path.first_name
        if self.kind == "add":
            return f"in value at {name}, {show(self.after)} was added"
        if self.kind == "remove":
            return f"in value at {name}, {show(self.before)} was removed"
        return f"in value at {name}, {show(self.after)} was not equal to {show(self.before)}"


def show(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)) and not isinstance(value, Row):
        return "[" + ", ".join(map(show, value)) + "]"
    return str(value)


def _close(a: object, b: object, approx: float) -> bool:
    if isinstance(a, datetime.datetime) and isinstance(b, datetime.datetime):
        return abs((a - b).total_seconds() * 1000) <= approx
    if isinstance(a, float) and isinstance(b, float):
        return not (math.isnan(a) or math.isnan(b)) and (a == b or abs(a - b) <= approx)
    return a == b


def compare_values(before: object, after: object, approx: float = 0.0, at=Root()) -> list[ValueChange]:
    """The changes from one value (or row, as a dict) to another.

    Structs are gone through by name, arrays by place. With ``approx`` numbers
    and timestamps (in milliseconds) may be that far apart, and NaN differs
    from everything; without it, NaN equals NaN.
    """
    if isinstance(before, Row):
        before = before.asDict(recursive=True)
    if isinstance(after, Row):
        after = after.asDict(recursive=True)
    if before is None and after is None:
        return []
    if isinstance(before, dict) and isinstance(after, dict):
        names = [*before, *(n for n in after if n not in before)]
        return [c for n in names for c in compare_values(before.get(n), after.get(n), approx, FieldIndex(n, at))]
    if isinstance(before, list) and isinstance(after, list) and not isinstance(at, Root):
        out = []
        for i in range(max(len(before), len(after))):
            a, b = (x[i] if i < len(x) else None for x in (before, after))
            out += compare_values(a, b, approx, ArrayIndex(i, at))
        return out
    if before is None:
        return [ValueChange(at, "add", None, after)]
    if after is None:
        return [ValueChange(at, "remove", before, None)]
    both_nan = isinstance(before, float) and isinstance(after, float) and math.isnan(before) and math.isnan(after)
    same = _close(before, after, approx) if approx else both_nan or (type(before) is type(after) and before == after)
    return [] if same else [ValueChange(at, "change", before, after)]


def show_row(row: dict, changes: Sequence[ValueChange]) -> str:
    """A row with the changed fields first."""
    first = list(dict.fromkeys(c.path.first_name for c in changes if c.path.first_name in row))
    names = [*first, *(n for n in row if n not in first)]
    return "dataframe({" + ", ".join(f"{n}: {show(row[n])}" for n in names) + "})"


def report(found: Sequence[tuple[dict | None, dict | None, list[ValueChange]]], limit: int | None = None) -> str:
    """The text of an error: per row what changed, and the row on both sides."""
    blocks = []
    for left, right, changes in found[: limit or None]:
        lines = [c.sentence() for c in changes]
        lines += [show_row(r, changes) if r is not None else "no row" for r in (left, right)]
        blocks.append("\n".join(lines))
    return "The data set content is different :\n\n" + "\n\n".join(blocks) + "\n"


def assert_equal(actual: DataFrame, expected: DataFrame, *, ordered: bool = True, approx: float = 0.0, order: Sequence[str] | None = None) -> None:
    """Fail with a report unless both frames hold the same rows.

    Frames are aligned first (:func:`align`). In order, rows are compared place
    by place; otherwise as multisets. Only differing rows are collected, and
    no more than the policy shows. ``approx`` needs an order.
    """
    actual, expected = align(actual, expected)
    if not actual.columns:
        return
    if not ordered:
        found = multiset_differences(actual, expected).limit(max(1, policy.max_row_error)).collect()
        if found:
            rows = "\n".join(f"{show_row({k: v for k, v in r.asDict().items() if k not in ('n_left', 'n_right')}, [])}: {r['n_left']} and {r['n_right']} times" for r in found)
            raise ValueMismatch(f"The data set content is different :\n\n{rows}\n")
        return
    found = []
    wanted = policy.max_row_error if policy.max_row_error > 0 else MAX_SHOWN
    more = False
    for row in ordered_differences(actual, expected, order, approx > 0).orderBy("row_index").toLocalIterator():
        left, right = (None if x is None else x.asDict(recursive=True) for x in (row["left"], row["right"]))
        changes = compare_values(left or {}, right or {}, approx)
        if changes or left is None or right is None:
            if len(found) >= wanted:
                more = True
                break
            found.append((left, right, changes))
    if found:
        raise ValueMismatch(report(found) + ("\nand more rows\n" if more and policy.max_row_error <= 0 else ""))


def approx_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], approx: float, one_sided: bool = False) -> DataFrame:
    """Keys and columns whose values are further apart than ``approx``, at scale.

    Joined null-safely on the keys, which must be unique; columns that are not
    numbers or timestamps are compared exactly. One row per key and column.
    Only keys of both sides are compared; with ``one_sided``, each other key
    is a row as well, and ``side`` is left, right or, for a column, both.
    """
    if one_sided:
        left, right = left.withColumn("__here", F.lit(True)), right.withColumn("__here", F.lit(True))
    a, b = left.alias("a"), right.alias("b")
    on = None
    for k in keys:
        same = F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}"))
        on = same if on is None else on & same
    checks = []
    for f in left.schema.fields:
        if f.name in keys or f.name == "__here":
            continue
        x, y = F.col(f"a.{quoted(f.name)}"), F.col(f"b.{quoted(f.name)}")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            far = F.coalesce((F.abs(x - y) > approx) | F.isnan(x) | F.isnan(y), x.isNull() != y.isNull())
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            far = F.coalesce(F.abs(F.unix_millis(x.cast("timestamp")) - F.unix_millis(y.cast("timestamp"))) > approx, x.isNull() != y.isNull())
        else:
            far = ~x.eqNullSafe(y)
        checks.append(F.when(far, F.lit(f.name)))
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    if one_sided:
        side = F.when(F.col("b.__here").isNull(), "left").when(F.col("a.__here").isNull(), "right").otherwise("both")
        of_key = [F.when(side == "right", F.col(f"b.{quoted(k)}")).otherwise(F.col(f"a.{quoted(k)}")).alias(k) for k in keys]
        columns = F.when(side == "both", found).otherwise(F.array(F.lit(None).cast("string")))
        return a.join(b, on, "full_outer").select(*of_key, F.explode(columns).alias("column"), side.alias("side"))
    return a.join(b, on).select(*[F.col(f"a.{quoted(k)}").alias(k) for k in keys], F.explode(found).alias("column"))


def plain_value(value: object) -> object:
    """A collected value in a form that JSON can hold."""
    if isinstance(value, (datetime.date, datetime.datetime, Decimal)):
        return str(value)
    return value
