"""Column helpers: nested arrays, duplicate names, lenses, similarity, maps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators.versions import quoted
from rowlattice.plans.paths import FieldKey, Key, Root, key

# -- arrays -----------------------------------------------------------------


def map_array(column: Column | str, f: Callable[[Column], Column]) -> Column:
    """Each element changed; a null array stays null."""
    return F.transform(column, f)


def filter_array(column: Column | str, f: Callable[[Column], Column]) -> Column:
    return F.filter(column, f)


def flat_map_array(column: Column | str, f: Callable[[Column], Column]) -> Column:
    """The arrays made of each element, one after the other."""
    return F.flatten(F.transform(column, f))


def apply(column: Column | str, f: Callable, returns: str | T.DataType | None = None) -> Column:
    """A function of a column. ``f`` builds an expression; with ``returns`` it
    is a Python function of one value, sent through Arrow in batches."""
    if returns is None:
        return f(F.col(column) if isinstance(column, str) else column)
    return F.udf(f, returns, useArrow=True)(column)


# -- columns of the same name -------------------------------------------------


def _by_place(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with names that tell its columns apart, and its own names."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), names


def coalesce_duplicates(df: DataFrame) -> DataFrame:
    """Columns of one name become their first value that is not null."""
    placed, names = _by_place(df)
    return placed.select(*[F.coalesce(*[F.col(f"c{i}") for i, n in enumerate(names) if n == name]).alias(name) for name in dict.fromkeys(names)])


def rename_duplicates(df: DataFrame) -> DataFrame:
    """Columns of one name get a number each: ``name_0``, ``name_1``, …"""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        if df.columns.count(name) > 1:
            out.append(f"{name}_{seen.setdefault(name, 0)}")
            seen[name] += 1
        else:
            out.append(name)
    return df.toDF(*out)


def move(df: DataFrame, source: str | Key, target: str | Key) -> DataFrame:
    """Rename a top-level column, given by paths."""
    a, b = (key(p) if isinstance(p, str) else p for p in (source, target))
    for path in (a, b):
        if not (isinstance(path, FieldKey) and isinstance(path.parent, Root)):
            raise ValueError(f"{path} is not a top-level field")
    if a.name not in df.columns:
        raise ValueError(f"no column {a.name}")
    return df.withColumnRenamed(a.name, b.name)


# -- lens -------------------------------------------------------------------------


def lens(df: DataFrame, matches: Callable[[str, T.DataType], bool], change: Callable[[Column, T.DataType], Column]) -> DataFrame:
    """Change every value whose path and type match; the schema stays.

    Paths are written ``a/b``, elements of arrays ``a/[]``. Structs and arrays
    are gone through; nulls stay; what lies below a changed value is changed
    first. The result is a projection.
    """

    def walk(column: Column, path: str, kind: T.DataType) -> Column | None:
        """The new column, or None where nothing below changes."""
        new = None
        if isinstance(kind, T.StructType):
            inside = [(f, walk(column.getField(f.name), f"{path}/{f.name}", f.dataType)) for f in kind.fields]
            if any(c is not None for _, c in inside):
                fields = [(column.getField(f.name) if c is None else c).alias(f.name) for f, c in inside]
                new = F.when(column.isNotNull(), F.struct(*fields))
        elif isinstance(kind, T.ArrayType):
            if walk(F.lit(None).cast(kind.elementType), f"{path}/[]", kind.elementType) is not None:
                new = F.transform(column, lambda x: walk(x, f"{path}/[]", kind.elementType))
        if matches(path, kind):
            base = column if new is None else new
            new = F.when(base.isNotNull(), change(base, kind).cast(kind))
        return new

    out = []
    for f in df.schema.fields:
        new = walk(F.col(quoted(f.name)), f.name, f.dataType)
        out.append(F.col(quoted(f.name)) if new is None else new.alias(f.name))
    return df.select(*out)


def lens_pattern(df: DataFrame, pattern: str, change: Callable[[Column, T.DataType], Column]) -> DataFrame:
    """:func:`lens` on the paths that a regular expression matches whole."""
    compiled = re.compile(pattern)
    return lens(df, lambda path, kind: compiled.fullmatch(path) is not None, change)


def transform_at(df: DataFrame, path: str | Key, change: Callable[[Column], Column]) -> DataFrame:
    """Change the values at one path, such as ``a.b[].c``."""
    parsed = key(path) if isinstance(path, str) else path
    wanted = "/".join(p.name if isinstance(p, FieldKey) else "[]" for p in parsed.parts())
    return lens(df, lambda at, kind: at == wanted, lambda c, kind: change(c))


# -- strings ----------------------------------------------------------------------


def letter_pairs(word: Column) -> Column:
    """Neighbouring pairs of characters; a word of one character is its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))
    return F.when(F.length(word) > 0, pairs).otherwise(F.array().cast("array<string>"))


def word_letter_pairs(text: Column) -> Column:
    """The pairs of all words, split at single white-space characters."""
    return F.flatten(F.transform(F.split(text, r"\s"), letter_pairs))


def dice_similarity(a: Column, b: Column) -> Column:
    """Twice the shared letter pairs over all, with multiplicity; 1 if equal.

    Two different texts without any pair have similarity 0. Null if one is.
    The time grows with the number of distinct pairs times all pairs: it is for
    names and titles, not for whole documents.
    """
    left, right = word_letter_pairs(a), word_letter_pairs(b)

    def times(pairs: Column, x: Column) -> Column:
        return F.size(F.filter(pairs, lambda y: y == x))

    shared = F.aggregate(F.array_distinct(left), F.lit(0), lambda total, x: total + F.least(times(left, x), times(right, x)))
    total = F.size(left) + F.size(right)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, 1.0).when(total == 0, 0.0).otherwise(2.0 * shared / total)


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance of two binaries, byte by byte."""
    return F.levenshtein(F.decode(a, "ISO-8859-1"), F.decode(b, "ISO-8859-1"))


def snake_case(name: str) -> str:
    """camelCase as snake_case."""
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def snake_case_column(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"(?<!^)(?=[A-Z])", "_"))


def joined_key(*columns: Column | str) -> Column:
    """Values of several columns in one string, nulls written ``null``."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in columns]
    return F.concat_ws("§", *parts)


def to_timestamp(df: DataFrame, name: str) -> Column:
    """A column of epoch milliseconds or timestamps as timestamp, by its type."""
    kind = df.schema[name].dataType
    return F.timestamp_millis(F.col(quoted(name))) if isinstance(kind, (T.LongType, T.IntegerType)) else F.col(quoted(name)).cast("timestamp")


# -- records and maps ------------------------------------------------------------


def to_map(df: DataFrame) -> Column:
    """The row as map of strings: nested names joined by dots, nulls left out.

    Names of the first level are kept, those below are put in snake case.
    """
    entries: list[Column] = []

    def walk(column: Column, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column.getField(f.name), f"{name}.{snake_case(f.name)}", f.dataType)
        else:
            text = F.to_json(F.struct(column.alias("v"))) if isinstance(kind, (T.ArrayType, T.MapType)) else column.cast("string")
            entries.extend([F.lit(name), text])

    for f in df.schema.fields:
        walk(F.col(quoted(f.name)), f.name, f.dataType)
    if not entries:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def from_map(column: Column | str, schema: T.StructType, strict: bool = False) -> Column:
    """A map of strings as struct: by name, other keys ignored.

    What is missing is null; ``strict`` raises where the field is not nullable.
    """
    entries = F.col(column) if isinstance(column, str) else column
    fields = []
    for f in schema.fields:
        value = F.try_element_at(entries, F.lit(f.name)).try_cast(f.dataType)
        if strict and not f.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"no value for {f.name}")).cast(f.dataType)).otherwise(value)
        fields.append(value.alias(f.name))
    return F.struct(*fields)
