"""A small language that maps records to records, compiled to columns.

Expressions are plain data (frozen dataclasses). :func:`compile_expr` turns
one into a Spark column over the input's schema; nothing is interpreted row by
row. A value that is absent in a record is null. Types are strict: comparing
or casting what does not fit gives an absent value, never an error. A function
whose expression fails gives an absent value as well; :func:`annotated` tells
which fields were missing and which functions failed. Over JSON texts,
``strict_nulls`` tells a null that is there from a field that is absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators.versions import quoted
from rowlattice.plans.paths import FieldKey, Key, key

DECIMAL = T.DecimalType(38, 18)
#: Names of the types that a cast knows.
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "decimal": DECIMAL, "double": T.DoubleType()}


class Expr:
    """Base of all expressions, with the language's operators as methods."""

    def as_(self, kind: str) -> Expr:
        return Cast(self, kind)

    def or_else(self, other) -> Expr:
        return OrElse(self, expr(other))

    def case_when(self, *cases: tuple, otherwise=...) -> CaseWhen:
        return CaseWhen(self, tuple((expr(a), expr(b)) for a, b in cases), None if otherwise is ... else expr(otherwise))

    def remove(self, *values) -> Expr:
        return Remove(self, tuple(expr(v) for v in values))

    def is_empty(self) -> Expr:
        return IsEmpty(self)

    def and_(self, other) -> Expr:
        return Both(self, expr(other), "and")

    def or_(self, other) -> Expr:
        return Both(self, expr(other), "or")

    def left(self, n: int) -> Expr:
        return Left(self, n)

    def size(self) -> Expr:
        return Size(self)

    def date_add(self, part: str, n) -> Expr:
        return DateAdd(self, part, expr(n))

    def date_diff(self, part: str, end) -> Expr:
        return DateDiff(self, part, expr(end))

    def first_element(self) -> Expr:
        return Element(self, 1)

    def last_element(self) -> Expr:
        return Element(self, -1)

    def select(self, path: str | Key) -> Expr:
        return Field(_fields(path), self)

    def map(self, f: Callable[[Column], Column]) -> Expr:
        return Apply((self,), f)

    def with_(self, *others) -> Inputs:
        return Inputs((self, *(expr(o) for o in others)))


@dataclass(frozen=True)
class Field(Expr):
    """A field of the record, or of another expression."""

    path: tuple[str, ...]
    of: Expr | None = None


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Null(Expr):
    """The absent value."""


@dataclass(frozen=True)
class Cast(Expr):
    source: Expr
    kind: str


@dataclass(frozen=True)
class OrElse(Expr):
    first: Expr
    second: Expr


@dataclass(frozen=True)
class CaseWhen(Expr):
    """The result whose value the source equals; the first that does."""

    source: Expr
    cases: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None

    def or_when(self, other: CaseWhen) -> CaseWhen:
        """More cases after these; the first default stays."""
        return CaseWhen(self.source, self.cases + other.cases, self.otherwise if self.otherwise is not None else other.otherwise)


@dataclass(frozen=True)
class Remove(Expr):
    source: Expr
    values: tuple[Expr, ...]


@dataclass(frozen=True)
class IsEmpty(Expr):
    source: Expr


@dataclass(frozen=True)
class Both(Expr):
    """And, or: absent if either side is."""

    a: Expr
    b: Expr
    how: str


@dataclass(frozen=True)
class Left(Expr):
    source: Expr
    n: int


@dataclass(frozen=True)
class Size(Expr):
    source: Expr


@dataclass(frozen=True)
class DateAdd(Expr):
    source: Expr
    part: str
    n: Expr


@dataclass(frozen=True)
class DateDiff(Expr):
    start: Expr
    part: str
    end: Expr


@dataclass(frozen=True)
class Element(Expr):
    source: Expr
    at: int


@dataclass(frozen=True)
class Apply(Expr):
    """A function of one or more columns; absent if an input is."""

    inputs: tuple[Expr, ...]
    f: Callable


@dataclass(frozen=True)
class Inputs:
    """Several inputs waiting for their function."""

    inputs: tuple[Expr, ...]

    def with_(self, other) -> Inputs:
        return Inputs((*self.inputs, expr(other)))

    def map(self, f: Callable[..., Column]) -> Expr:
        return Apply(self.inputs, f)


def _fields(path: str | Key) -> tuple[str, ...]:
    parsed = key(path) if isinstance(path, str) else path
    parts = parsed.parts()
    if not parts or not all(isinstance(p, FieldKey) for p in parts):
        raise ValueError(f"{path} is not a path of fields")
    return tuple(p.name for p in parts)


def _root_path(e: Field) -> tuple[str, ...] | None:
    """The path in the record, or None for a field of something made."""
    path: tuple[str, ...] = ()
    at: Expr | None = e
    while isinstance(at, Field):
        path, at = (*at.path, *path), at.of
    return path if at is None else None


def field(path: str | Key) -> Field:
    """A field of the input record, such as ``a.b``; arrays are no fields."""
    return Field(_fields(path))


def expr(value) -> Expr:
    return value if isinstance(value, Expr) else Null() if value is None else Lit(value)


# -- queries ------------------------------------------------------------------------


@dataclass(frozen=True)
class Branch:
    columns: tuple[tuple[str, Expr], ...]
    where: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Query:
    """A union of branches, each a record with conditions on the input."""

    branches: tuple[Branch, ...]

    def where(self, condition: Expr) -> Query:
        return Query(tuple(replace(b, where=(*b.where, condition)) for b in self.branches))

    and_where = where

    def union(self, other: Query) -> Query:
        return Query(self.branches + other.branches)

    def merge(self, other: Query) -> Query:
        """The columns of both; where both have a name, the other's, at its place."""
        if len(self.branches) != 1 or len(other.branches) != 1:
            raise ValueError("only single records can be merged")
        a, b = self.branches[0], other.branches[0]
        theirs = dict(b.columns)
        kept = tuple((n, e) for n, e in a.columns if n not in theirs)
        return Query((Branch(kept + b.columns, a.where + b.where),))


def record(**columns) -> Query:
    """A record of named expressions."""
    return Query((Branch(tuple((n, expr(e)) for n, e in columns.items())),))


# -- compiling -------------------------------------------------------------------------


def lower(e: Expr) -> Expr:
    """Rewrite what other expressions can say."""
    if isinstance(e, Remove):
        return CaseWhen(e.source, tuple((v, Null()) for v in e.values), e.source)
    return e


#: What an annotation says: ``missing`` (a field, by its path) or ``failed``
#: (a function, by its kind), and the output columns it is in.
NOTE = "struct<kind:string,name:string,scope:array<string>>"


@dataclass(frozen=True)
class Typed:
    """A compiled column and its type; None where it has no value of any type.

    ``gone`` is true where the value is absent: by default, where it is null.
    """

    column: Column
    kind: T.DataType | None
    gone: Column | None = None

    @property
    def absent(self) -> Column:
        return self.column.isNull() if self.gone is None else self.gone


@contextmanager
def _failing_is_null(df: DataFrame) -> Iterator[None]:
    """Expressions analysed within give null where they would end the job."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        conf.set("spark.sql.ansi.enabled", before)


def _family(kind: T.DataType | None) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "fraction"
    return "none" if kind is None else kind.typeName() if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else kind.simpleString()


def _whole_months(start: Column, end: Column) -> Column:
    """The most months that can be added to a day without passing another; the
    last day of a short month counts as any later day."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - F.when(F.add_months(start, months) > end, 1).otherwise(0)


class Compiler:
    """Compiles expressions over the schema of one frame.

    ``raw`` names a column with the whole record as a variant: then a field
    that is null there is not absent.
    """

    def __init__(self, df: DataFrame, raw: str | None = None) -> None:
        self.df, self.raw = df, raw

    def absent(self) -> Typed:
        return Typed(F.lit(None), None)

    def typed(self, column: Column, gone: Column | None = None) -> Typed:
        """A column with the type that Spark's analysis gives it."""
        with _failing_is_null(self.df):
            kind = self.df.select(column.alias("x")).schema["x"].dataType
        return Typed(F.lit(None), None, gone) if isinstance(kind, T.NullType) else Typed(column, kind, gone)

    def compile(self, e: Expr) -> Typed:
        e = lower(e)
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _field(self, e: Field) -> Typed:
        if e.of is None:
            kind: T.DataType | None = self.df.schema
            column = None
        else:
            base = self.compile(e.of)
            column, kind = base.column, base.kind
        for name in e.path:
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return self.absent()
            kind = kind[name].dataType
            column = F.col(quoted(name)) if column is None else column.getField(name)
        path = _root_path(e)
        if self.raw is None or path is None or name == self.raw:
            return Typed(column, kind)
        place = "$" + "".join("['" + n.replace("'", "\\'") + "']" for n in path)
        return Typed(column, kind, F.try_variant_get(F.col(quoted(self.raw)), place, "variant").isNull())

    def _lit(self, e: Lit) -> Typed:
        return self.typed(F.lit(e.value))

    def _null(self, e: Null) -> Typed:
        return self.absent() if self.raw is None else Typed(F.lit(None), None, F.lit(False))

    def _cast(self, e: Cast) -> Typed:
        source, kind = self.compile(e.source), TYPES[e.kind]
        have, c = _family(source.kind), source.column
        if have == "whole" and e.kind == "int":
            out = c.try_cast("int")
        elif (have == "string" and e.kind == "string") or (have == "boolean" and e.kind == "boolean"):
            out = c
        elif have == "fraction" and (e.kind == "decimal" or (e.kind == "double" and not isinstance(source.kind, T.DecimalType))):
            out = c.try_cast(kind)
        elif have == "whole" and e.kind in ("decimal", "double", "string"):
            out = c.cast(kind)
        elif have == "string" and e.kind == "int":
            out = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))
        elif have == "string" and e.kind == "decimal":
            out = c.try_cast(kind)
        elif have == "string" and e.kind == "boolean":
            out = F.when(c == "true", True).when(c == "false", False)
        elif have == "boolean" and e.kind == "string":
            out = c.cast("string")
        else:
            return Typed(F.lit(None).cast(kind), kind)
        return Typed(out, kind)

    def _orelse(self, e: OrElse) -> Typed:
        a, b = self.compile(e.first), self.compile(e.second)
        gone = a.absent & b.absent
        if a.kind is None or b.kind is None:
            known = b if a.kind is None else a
            if self.raw is None:
                return known
            empty = F.lit(None) if known.kind is None else F.lit(None).cast(known.kind)
            return Typed(F.when(a.absent, b.column if b.kind else empty).otherwise(a.column if a.kind else empty), known.kind, gone)
        mixed = a.kind != b.kind and _family(a.kind) != _family(b.kind)
        first, second = (x.column.cast("string") if mixed else x.column for x in (a, b))
        if self.raw is None:
            return Typed(F.coalesce(first, second), T.StringType()) if mixed else self.typed(F.coalesce(first, second))
        return self.typed(F.when(a.absent, second).otherwise(first), gone)

    def _equals(self, a: Typed, b: Typed) -> Column:
        """Strict equality: other types are never equal, absent equals absent."""
        if a.kind is None or b.kind is None or _family(a.kind) != _family(b.kind):
            same = a.column.isNull() & b.column.isNull()
        else:
            same = a.column.eqNullSafe(b.column)
        return same if self.raw is None else same & (a.absent == b.absent)

    def _casewhen(self, e: CaseWhen) -> Typed:
        source = self.compile(e.source)
        cases = [(self._equals(source, self.compile(value)), self.compile(result)) for value, result in e.cases]
        last = self.compile(e.otherwise) if e.otherwise is not None else self.absent()
        kinds = [r.kind for _, r in cases if r.kind is not None] + ([last.kind] if last.kind is not None else [])
        if not kinds:
            return self.absent()
        mixed = len({_family(k) for k in kinds}) > 1

        def shaped(t: Typed) -> Column:
            return F.lit(None).cast("string" if mixed else kinds[0]) if t.kind is None else t.column.cast("string") if mixed else t.column

        out, gone = shaped(last), last.absent
        for condition, result in reversed(cases):
            out = F.when(condition, shaped(result)).otherwise(out)
            gone = F.when(condition, result.absent).otherwise(gone)
        return self.typed(out, None if self.raw is None else gone)

    def _isempty(self, e: IsEmpty) -> Typed:
        source = self.compile(e.source)
        empty = source.absent
        if isinstance(source.kind, T.StringType):
            empty = empty | F.coalesce(source.column == "", F.lit(False))
        return Typed(empty, T.BooleanType())

    def _both(self, e: Both) -> Typed:
        a, b = self.compile(e.a), self.compile(e.b)
        if not isinstance(a.kind, T.BooleanType) or not isinstance(b.kind, T.BooleanType):
            return Typed(F.lit(None).cast("boolean"), T.BooleanType())
        value = a.column & b.column if e.how == "and" else a.column | b.column
        return Typed(F.when(a.column.isNotNull() & b.column.isNotNull(), value), T.BooleanType())

    def _left(self, e: Left) -> Typed:
        source = self.compile(e.source)
        return Typed(F.left(source.column.cast("string"), F.lit(e.n)), T.StringType())

    def _size(self, e: Size) -> Typed:
        source = self.compile(e.source)
        if isinstance(source.kind, T.StringType):
            return Typed(F.length(source.column), T.IntegerType())
        if isinstance(source.kind, T.ArrayType):
            return Typed(F.when(source.column.isNotNull(), F.size(source.column)), T.IntegerType())
        return Typed(F.lit(None).cast("int"), T.IntegerType())

    def _day(self, source: Typed) -> Column:
        return F.try_to_timestamp(F.left(source.column.cast("string"), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")

    def _dateadd(self, e: DateAdd) -> Typed:
        day, n = self._day(self.compile(e.source)), self.compile(e.n).column.cast("int")
        moved = {"day": lambda: F.date_add(day, n), "month": lambda: F.add_months(day, n), "year": lambda: F.add_months(day, n * 12)}.get(e.part)
        out = F.date_format(moved(), "yyyy-MM-dd") if moved else F.lit(None).cast("string")
        return Typed(out, T.StringType())

    def _datediff(self, e: DateDiff) -> Typed:
        start, end = self._day(self.compile(e.start)), self._day(self.compile(e.end))
        if e.part == "day":
            return Typed(F.datediff(end, start), T.IntegerType())
        if e.part == "month":
            return Typed(F.when(end >= start, _whole_months(start, end)).otherwise(-_whole_months(end, start)), T.IntegerType())
        return Typed(F.lit(None).cast("int"), T.IntegerType())

    def _element(self, e: Element) -> Typed:
        source = self.compile(e.source)
        if not isinstance(source.kind, T.ArrayType):
            return self.absent()
        return Typed(F.try_element_at(source.column, F.lit(e.at)), source.kind.elementType)

    def _apply(self, e: Apply) -> Typed:
        inputs = [self.compile(i) for i in e.inputs]
        if any(i.kind is None for i in inputs):
            return self.absent()
        there = inputs[0].column.isNotNull()
        for i in inputs[1:]:
            there = there & i.column.isNotNull()
        return self.typed(F.when(there, e.f(*[i.column for i in inputs])))


    # -- what happened on the way

    def notes(self, e: Expr) -> Column:
        """The annotations of an expression: only of the parts a record takes."""
        e = lower(e)
        if isinstance(e, Field):
            own = self.compile(e)
            missing = F.when(own.absent, F.array(_note("missing", ".".join(e.path)))).otherwise(_no_notes())
            if e.of is None:
                return missing
            base = self.compile(e.of)
            return F.when(base.absent, self.notes(e.of)).otherwise(F.concat(self.notes(e.of), missing))
        if isinstance(e, OrElse):
            first = self.notes(e.first)
            return F.when(self.compile(e.first).absent, F.concat(first, self.notes(e.second))).otherwise(first)
        if isinstance(e, CaseWhen):
            source, mine = self.compile(e.source), self.notes(e.source)
            out = self.notes(e.otherwise) if e.otherwise is not None else _no_notes()
            for value, result in reversed(e.cases):
                out = F.when(self._equals(source, self.compile(value)), F.concat(mine, self.notes(result))).otherwise(out)
            return out
        inputs = list(children(e))
        if not inputs:
            return _no_notes()
        # the first absent input is the last one looked at
        out = None
        for x in reversed(inputs):
            mine = self.notes(x)
            out = mine if out is None else F.when(self.compile(x).absent, mine).otherwise(F.concat(mine, out))
        if isinstance(e, (Apply, Element, DateAdd, DateDiff)):
            there = None
            for x in inputs:
                here = ~self.compile(x).absent
                there = here if there is None else there & here
            failed = there & self.compile(e).column.isNull()
            out = F.concat(out, F.when(failed, F.array(_note("failed", type(e).__name__))).otherwise(_no_notes()))
        return out

    def used(self, e: Expr, first: int = 0) -> tuple[int, Column]:
        """How many parts an expression has, and the numbers of those a record takes."""
        own = F.array(F.lit(first))
        if isinstance(e, (OrElse, CaseWhen)):
            lead = e.first if isinstance(e, OrElse) else e.source
            count, taken = self.used(lead, first + 1)
            at = first + 1 + count
            if isinstance(e, OrElse):
                more, other = self.used(e.second, at)
                return 1 + count + more, F.when(self.compile(lead).absent, F.concat(own, taken, other)).otherwise(F.concat(own, taken))
            tried, steps = taken, []
            for value, result in e.cases:
                n, looked = self.used(value, at)
                m, chosen = self.used(result, at + n)
                at += n + m
                tried = F.concat(tried, looked)
                steps.append((self._equals(self.compile(lead), self.compile(value)), F.concat(tried, chosen)))
            out = tried
            if e.otherwise is not None:
                n, rest = self.used(e.otherwise, at)
                at, out = at + n, F.concat(tried, rest)
            for condition, taken in reversed(steps):
                out = F.when(condition, taken).otherwise(out)
            return at - first, F.concat(own, out)
        at, parts = first + 1, [own]
        for x in children(e):
            n, taken = self.used(x, at)
            at += n
            parts.append(taken)
        return at - first, F.concat(*parts)


def _note(kind: str, name: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.array().cast("array<string>").alias("scope"))


def _no_notes() -> Column:
    return F.array().cast(f"array<{NOTE}>")


def _within(notes: Column, name: str) -> Column:
    """The notes, said to be in an output column."""
    return F.transform(notes, lambda n: F.struct(n["kind"].alias("kind"), n["name"].alias("name"), F.concat(F.array(F.lit(name)), n["scope"]).alias("scope")))


def compile_expr(df: DataFrame, e: Expr) -> Column:
    """The expression as a column of ``df``."""
    return Compiler(df).compile(e).column


def run(df: DataFrame, query: Query, strict: bool = False) -> DataFrame:
    """The records that a query makes of each row.

    Conditions are checked on the input. Where one is absent or no boolean the
    row makes no record; ``strict`` raises instead.
    """
    return _run(df, Compiler(df), query, strict)


def annotated(df: DataFrame, query: Query, strict: bool = False) -> DataFrame:
    """:func:`run`, and for each record its ``annotations``: missing fields and failed functions.

    Only what the record took counts: the branch of a switch that matched, a
    default that was needed. ``scope`` has the output column. A column of that
    name in the records is replaced.
    """
    return _run(df, Compiler(df), query, strict, notes=True)


def _run(df: DataFrame, compiler: Compiler, query: Query, strict: bool, notes: bool = False, gone: bool = False) -> DataFrame:
    out = None
    for branch in query.branches:
        rows = df
        for condition in branch.where:
            typed = compiler.compile(condition)
            column = typed.column if isinstance(typed.kind, T.BooleanType) else F.lit(None).cast("boolean")
            if strict:
                column = F.when(column.isNull(), F.raise_error(F.lit("a condition has no truth value")).cast("boolean")).otherwise(column)
            with _failing_is_null(df):
                rows = rows.where(column)
        columns, names, said, lost = [], [], [], []
        for name, e in branch.columns:
            if notes and name == "annotations":
                continue
            typed = compiler.compile(e)
            # a name of its own first: a lambda would take an output for an input
            columns.append((typed.column if typed.kind is not None else F.lit(None).cast("string")).alias(f"__out{len(columns)}"))
            names.append(name)
            if notes:
                said.append(_within(compiler.notes(e), name))
            if gone:
                lost.append(F.when(typed.absent, F.lit(name)))
        if notes:
            columns.append(F.concat(*said, _no_notes()).alias("__notes"))
            names.append("annotations")
        if gone:
            columns.append(F.array_compact(F.array(*lost)).alias("__gone"))
            names.append("__gone")
        with _failing_is_null(df):
            part = rows.select(*columns).toDF(*names)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def run_json(df: DataFrame, column: str, schema: str | T.StructType, query: Query, strict: bool = False, strict_nulls: bool = False) -> DataFrame:
    """:func:`run` over JSON texts of a known schema; gives JSON, absent fields left out.

    With ``strict_nulls`` a null in the text is a value: it is not empty, does
    not call for a default, and comes out as a null. A text that is no JSON
    has no field.
    """
    text = F.col(quoted(column))
    if not strict_nulls:
        parsed = df.select(F.from_json(text, schema).alias("__r")).select("__r.*")
        made = run(parsed, query, strict)
        return made.select(F.to_json(F.struct(*[F.col(quoted(c)) for c in made.columns])).alias("value"))
    parsed = df.select(F.from_json(text, schema).alias("__r"), F.try_parse_json(text).alias("__raw")).select("__r.*", "__raw")
    made = _run(parsed, Compiler(parsed, "__raw"), query, strict, gone=True)
    keep = {"ignoreNullFields": "false"}
    pairs = []
    for c in made.columns:
        if c != "__gone":
            whole = F.to_json(F.struct(F.col(quoted(c)).alias(c)), keep)
            there = ~F.array_contains("__gone", c)
            pairs.append(F.when(there, F.substring(whole, F.lit(2), F.length(whole) - 2)))
    return made.select(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("value"))


# -- looking at expressions -------------------------------------------------------------


def children(e: object) -> Iterator[Expr]:
    """The expressions directly inside, in the order they are written."""
    for f in fields(e):
        value = getattr(e, f.name)
        stack = [value]
        while stack:
            x = stack.pop(0)
            if isinstance(x, Expr):
                yield x
            elif isinstance(x, tuple):
                stack = [*x, *stack]


def walk(e: Expr, level: int = 0) -> Iterator[tuple[int, Expr]]:
    """(level, expression) of all parts, outer ones first."""
    yield level, e
    for c in children(e):
        yield from walk(c, level + 1)


def sources(e: Expr) -> list[str]:
    """The input fields that an expression reads, each once."""
    found: dict[str, None] = {}

    def visit(x: Expr) -> None:
        path, at = [], x
        while isinstance(at, Field):
            path = [*at.path, *path]
            at = at.of
        if isinstance(x, Field):
            if at is None:
                found[".".join(path)] = None
            else:
                visit(at)
            return
        for c in children(x):
            visit(c)

    visit(e)
    return list(found)


def literals(e: Expr) -> list:
    """The literal values in an expression."""
    return [x.value for _, x in walk(e) if isinstance(x, Lit)]


def listing(e: Expr) -> str:
    """The parts of an expression, one a line, numbered and indented by level."""
    lines = []
    for number, (level, x) in enumerate(walk(e)):
        detail = ".".join(x.path) if isinstance(x, Field) else repr(x.value) if isinstance(x, Lit) else ""
        lines.append(f"{number} {'  ' * level}{type(x).__name__} {detail}".rstrip())
    return "\n".join(lines)


def traced(df: DataFrame, e: Expr) -> DataFrame:
    """Which parts of an expression each row takes: ``used``.

    An array of the numbers of :func:`listing`, beside the columns of ``df``. A
    switch takes its source, the cases up to the one that matches, and that
    one's result; a default is taken where it is needed.
    """
    return df.withColumn("used", F.array_sort(Compiler(df).used(e)[1]))
