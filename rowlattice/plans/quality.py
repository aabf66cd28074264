"""Validation rules whose warnings and errors travel with the data.

A rule turns a column into a value and annotations. A :class:`QualityFrame`
keeps an ``annotations`` array beside the data through selects, filters, joins
and aggregations; all of it is columns, so Catalyst sees the whole plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators.versions import quoted

ANNOTATION = "struct<message:string,onField:string,fromFields:array<string>,isError:boolean,count:bigint>"
NAME = "annotations"


def none() -> Column:
    return F.array().cast(f"array<{ANNOTATION}>")


def annotation(message: Column | str, is_error: Column | bool, on_field: str | None = None, from_fields: Sequence[str] = ()) -> Column:
    """One note, counted once."""
    text = F.lit(message) if isinstance(message, str) else message
    error = F.lit(is_error) if isinstance(is_error, bool) else is_error
    fields = F.array(*[F.lit(f) for f in from_fields]).cast("array<string>")
    return F.struct(text.alias("message"), F.lit(on_field).cast("string").alias("onField"), fields.alias("fromFields"), error.alias("isError"), F.lit(1).cast("bigint").alias("count"))


def fuse(notes: Column) -> Column:
    """Notes that agree in all but the count become one, with the sum."""

    def same(x: Column, y: Column) -> Column:
        return x["message"].eqNullSafe(y["message"]) & x["onField"].eqNullSafe(y["onField"]) & x["fromFields"].eqNullSafe(y["fromFields"]) & x["isError"].eqNullSafe(y["isError"])

    def without_count(x: Column) -> Column:
        return F.struct(x["message"].alias("message"), x["onField"].alias("onField"), x["fromFields"].alias("fromFields"), x["isError"].alias("isError"))

    kinds = F.array_distinct(F.transform(notes, without_count))

    def summed(k: Column) -> Column:
        total = F.aggregate(F.filter(notes, lambda x: same(x, k)), F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
        return F.struct(k["message"].alias("message"), k["onField"].alias("onField"), k["fromFields"].alias("fromFields"), k["isError"].alias("isError"), total.alias("count"))

    many = F.transform(kinds, summed).cast(f"array<{ANNOTATION}>")
    return F.coalesce(F.when(F.size(notes) < 2, notes).otherwise(many), none())


def located(notes: Column, on_field: str, from_fields: Sequence[str]) -> Column:
    """The notes, said to be about an output field made of input fields."""
    fields = F.array(*[F.lit(f) for f in from_fields]).cast("array<string>")
    return F.transform(notes, lambda x: F.struct(x["message"].alias("message"), F.lit(on_field).alias("onField"), fields.alias("fromFields"), x["isError"].alias("isError"), x["count"].alias("count")))


def with_prefix(notes: Column, prefix: str) -> Column:
    """The notes with a prefix before their field, without a separator."""
    return F.transform(notes, lambda x: F.struct(x["message"].alias("message"), F.concat(F.lit(prefix), F.coalesce(x["onField"], F.lit(""))).alias("onField"), x["fromFields"].alias("fromFields"), x["isError"].alias("isError"), x["count"].alias("count")))


def has_error(notes: Column | str = NAME) -> Column:
    return F.exists(notes, lambda x: x["isError"])


def has_warning(notes: Column | str = NAME) -> Column:
    return F.exists(notes, lambda x: ~x["isError"])


@dataclass(frozen=True)
class Checked:
    """A column, the notes made on the way to it, and the fields it came from.

    ``stages`` are columns that must be there first: calls of Python.
    """

    column: Column
    notes: tuple[Column, ...] = ()
    fields: frozenset[str] = frozenset()
    stages: tuple[tuple[str, Column], ...] = ()

    def staged(self, df: DataFrame) -> DataFrame:
        for name, column in self.stages:
            if name not in df.columns:
                df = df.withColumn(name, column)
        return df

    def all_notes(self) -> Column:
        return F.concat(*self.notes) if self.notes else none()

    def map(self, f: Callable[[Column], Column]) -> Checked:
        return Checked(f(self.column), self.notes, self.fields, self.stages)

    def combine(self, other: Checked | object, f: Callable[[Column, Column], Column]) -> Checked:
        other = other if isinstance(other, Checked) else Checked(other if isinstance(other, Column) else F.lit(other))
        return Checked(f(self.column, other.column), self.notes + other.notes, self.fields | other.fields, self.stages + other.stages)

    def __add__(self, other) -> Checked:
        return self.combine(other, lambda a, b: a + b)

    def __sub__(self, other) -> Checked:
        return self.combine(other, lambda a, b: a - b)

    def __mul__(self, other) -> Checked:
        return self.combine(other, lambda a, b: a * b)

    def filter(self, condition: Callable[[Column], Column], message: str) -> Checked:
        """No value, and an error, where the condition is not true of it."""
        bad = ~F.coalesce(condition(self.column), F.lit(False)) & self.column.isNotNull()
        note = F.when(bad, F.array(annotation(message, True))).otherwise(none())
        return Checked(F.when(~bad, self.column), (*self.notes, note), self.fields, self.stages)

    def then(self, f: Callable[[Checked], Checked]) -> Checked:
        """A further check of this value; the notes of both are kept."""
        return f(self)

    def either(self) -> Column:
        """``struct(errors, value)``: the value only if there is no error."""
        errors = F.filter(self.all_notes(), lambda n: n["isError"])
        return F.struct(F.when(F.size(errors) > 0, errors).alias("errors"), F.when(F.size(errors) == 0, self.column).alias("value"))

    def result(self) -> Column:
        """``struct(value, annotations)``."""
        return F.struct(self.column.alias("value"), fuse(self.all_notes()).alias(NAME))


def read(*names: str) -> Checked | tuple[Checked, ...]:
    """Columns of the input, without notes."""
    out = tuple(Checked(F.col(quoted(n)), (), frozenset([n])) for n in names)
    return out[0] if len(out) == 1 else out


def from_warning(value: Column, message: str) -> Checked:
    """A value with a warning."""
    return Checked(value, (F.array(annotation(message, False)),))


def from_error(kind: str, message: str) -> Checked:
    """No value, and an error."""
    return Checked(F.lit(None).cast(kind), (F.array(annotation(message, True)),))


def missing_field(kind: str, name: str) -> Checked:
    return Checked(F.lit(None).cast(kind), (F.array(annotation("MISSING_VALUE", True, name, [name])),))


@dataclass(frozen=True)
class Rule:
    """A validation: (condition, message, is_error) in turn, the first that holds.

    An error takes the value away, a warning keeps it. A condition without a
    truth value does not hold. Each call makes its own notes.
    """

    cases: tuple[tuple[Callable[[Column], Column], str, bool], ...]

    def __call__(self, source: Checked | str) -> Checked:
        source = read(source) if isinstance(source, str) else source
        notes, value = none(), source.column
        for condition, message, is_error in reversed(self.cases):
            holds = F.coalesce(condition(source.column), F.lit(False))
            notes = F.when(holds, F.array(annotation(message, is_error))).otherwise(notes)
            value = F.when(holds, F.lit(None) if is_error else source.column).otherwise(value)
        return Checked(value, (*source.notes, notes), source.fields, source.stages)


def python_rule(f: Callable, returns: str) -> Callable[[Checked | str], Checked]:
    """A rule from a Python function: value -> (value, [(message, is_error)]).

    Values travel in Arrow batches; prefer :class:`Rule` where columns can say it.
    """
    kind = T._parse_datatype_string(f"value {returns}, notes array<struct<message:string,isError:boolean>>")
    call = F.udf(f, kind, useArrow=True).asNondeterministic()  # called once a row, never moved

    def apply(source: Checked | str) -> Checked:
        source = read(source) if isinstance(source, str) else source
        name = f"__rule_{uuid.uuid4().hex}"
        made = F.col(name)
        notes = F.transform(F.coalesce(made["notes"], F.array().cast("array<struct<message:string,isError:boolean>>")), lambda n: annotation(n["message"], n["isError"]))
        return Checked(made["value"], (*source.notes, notes), source.fields, (*source.stages, (name, call(source.column))))

    return apply


_registered: dict[str, set[str]] = {}


def registered(spark: SparkSession) -> set[str]:
    """Names of the rules that SQL of this application may call."""
    return _registered.setdefault(spark.sparkContext.applicationId, set())


def register_rule(spark: SparkSession, name: str, f: Callable, takes: str, returns: str) -> None:
    """Make a Python rule callable in SQL: ``name(x)`` is its value and
    ``qa_raw_name(x)`` the struct of value and annotations, of which ``name``
    is a field. Values travel in Arrow batches. In :func:`annotated_sql.sql`
    its notes travel with the rows; ``f`` must give the same for the same."""
    kind = T._parse_datatype_string(f"value {returns}, {NAME} array<{ANNOTATION}>")

    def raw(value):
        result, notes = f(value)
        return result, [(m, None, [], e, 1) for m, e in notes or ()]

    spark.udf.register(f"qa_raw_{name}", F.udf(raw, kind, useArrow=True))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quoted(name)}(x {takes}) RETURNS {returns} RETURN qa_raw_{name}(x).value")
    registered(spark).add(name.lower())


def build_result(**parts: Checked) -> Column:
    """A record of all values, or none if one is missing, with all notes.

    First comes a ``MISSING_VALUE`` for each field without value, then the
    fields' own notes, with the field's name before theirs.
    """
    there = reduce(lambda a, b: a & b, [p.column.isNotNull() for p in parts.values()])
    value = F.when(there, F.struct(*[p.column.alias(n) for n, p in parts.items()]))
    lost = [F.when(p.column.isNull(), F.array(annotation("MISSING_VALUE", True, n, [n]))).otherwise(none()) for n, p in parts.items()]
    own = [with_prefix(p.all_notes(), n) for n, p in parts.items()]
    return F.struct(value.alias("value"), F.concat(*lost, *own).alias(NAME))


class QualityFrame:
    """A frame whose rows carry annotations."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df if NAME in df.columns else df.withColumn(NAME, none())

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != NAME]

    def select(self, **columns: Checked | Column | str) -> QualityFrame:
        """New columns; the notes made for each are added to the row's."""
        notes, out, df = [F.col(NAME)], [], self.df
        for name, given in columns.items():
            checked = given if isinstance(given, Checked) else read(given) if isinstance(given, str) else Checked(given)
            df = checked.staged(df)
            # names of their own until all is resolved: a lambda would take an
            # output of the same name for the input
            out.append(checked.column.alias(f"__out{len(out)}"))
            if checked.notes:
                notes.append(located(checked.all_notes(), name, sorted(checked.fields)))
        merged = fuse(F.concat(*notes)) if len(notes) > 1 else F.col(NAME)
        return QualityFrame(df.select(*out, merged.alias("__notes")).toDF(*columns, NAME))

    def where(self, condition: Column | str) -> QualityFrame:
        return QualityFrame(self.df.where(condition))

    def union(self, other: QualityFrame) -> QualityFrame:
        return QualityFrame(self.df.unionByName(other.df))

    def order_by(self, *columns) -> QualityFrame:
        return QualityFrame(self.df.orderBy(*columns))

    def limit(self, n: int) -> QualityFrame:
        return QualityFrame(self.df.limit(n))

    def join(self, other: QualityFrame, on: str | list[str], how: str = "inner") -> QualityFrame:
        """Join on columns of the same name; the notes of both rows are kept."""
        theirs = other.df.withColumnRenamed(NAME, "__theirs")
        joined = self.df.join(theirs, on, how)
        if how in ("left_semi", "left_anti", "semi", "anti"):
            return QualityFrame(joined)
        merged = fuse(F.concat(F.coalesce(NAME, none()), F.coalesce("__theirs", none())))
        return QualityFrame(joined.withColumn(NAME, merged).drop("__theirs"))

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self, keys)

    def flagged(self) -> DataFrame:
        """The data with ``has_error`` and ``has_warning`` in place of the notes."""
        return self.df.withColumns({"has_error": has_error(), "has_warning": has_warning()}).drop(NAME)

    def to_df(self) -> DataFrame:
        return self.df


@dataclass(frozen=True)
class Grouped:
    frame: QualityFrame
    keys: tuple[str, ...]

    def agg(self, **aggregates: Column | Checked) -> QualityFrame:
        """Aggregate; a group has the notes of its rows, equal ones counted together.

        A :class:`Checked` is an aggregate whose input was checked: its notes
        are gathered from the group's rows. Notes are counted by a map-side
        combined aggregate per group and kind, so a group of any size is fine.
        """
        keys = [F.col(quoted(k)) for k in self.keys]
        notes, columns, df = [F.col(NAME)], [], self.frame.df
        for name, given in aggregates.items():
            if isinstance(given, Checked):
                df = given.staged(df)
                columns.append(given.column.alias(name))
                if given.notes:
                    notes.append(located(given.all_notes(), name, sorted(given.fields)))
            else:
                columns.append(given.alias(name))
        if not keys:
            return self._whole(df, columns, notes)
        # one pass: each row, and behind it once more for each of its notes; the
        # rows make one group of each key, and equal notes another
        note = F.col("__note")
        single = df.withColumn("__note", F.explode(F.concat(F.array(F.lit(None).cast(ANNOTATION)), *notes)))
        kind = F.when(note.isNotNull(), F.struct(*[note[c].alias(c) for c in ("message", "onField", "fromFields", "isError")])).alias("__kind")
        placed = [c.alias(f"__a{i}") for i, c in enumerate(columns)]
        counted = single.groupBy(*keys, kind).agg(F.sum(note["count"]).alias("__count"), *placed)
        totals = F.struct(F.lit(True).alias("__row"), *[F.col(f"__a{i}").alias(f"__a{i}") for i in range(len(columns))])
        found = F.struct("__kind.message", "__kind.onField", "__kind.fromFields", "__kind.isError", F.col("__count").alias("count"))
        packed = counted.groupBy(*keys).agg(F.first(F.when(F.col("__kind").isNull(), totals), True).alias("__totals"), F.array_sort(F.collect_list(F.when(F.col("__kind").isNotNull(), found))).cast(f"array<{ANNOTATION}>").alias("__notes"))
        return QualityFrame(packed.select(*keys, *[F.col(f"__totals.__a{i}").alias(n) for i, n in enumerate(aggregates)], F.col("__notes").alias(NAME)))

    @staticmethod
    def _whole(df: DataFrame, columns: list[Column], notes: list[Column]) -> QualityFrame:
        """The aggregate of all rows: one, also of none."""
        totals = df.agg(*columns)
        single = df.select(F.explode(F.concat(*notes)).alias("n")).select("n.*")
        counted = single.groupBy("message", "onField", "fromFields", "isError").agg(F.sum("count").alias("count"))
        packed = counted.agg(F.array_sort(F.collect_list(F.struct("message", "onField", "fromFields", "isError", "count"))).cast(f"array<{ANNOTATION}>").alias("__notes"))
        # one row and one row
        return QualityFrame(totals.crossJoin(F.broadcast(packed)).withColumnRenamed("__notes", NAME))
