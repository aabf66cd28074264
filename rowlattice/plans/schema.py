"""Schema comparison, evolution and rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowlattice.plans.paths import ArrayKey, FieldKey, Key, Root, is_plain

KINDS = ("add", "remove", "change_type", "set_nullable", "set_non_nullable")


@dataclass(frozen=True)
class SchemaChange:
    """One step from a schema to another, at a path."""

    path: Key
    kind: str
    before: T.DataType | None = None
    after: T.DataType | None = None

    def sentence(self) -> str:
        name = self.path.first_name
        # The sentences of a report
        return {
            "add": f"Field {name} was not in the original DataFrame.",
            "remove": f"Field {name} was not in the expected DataFrame.",
            "change_type": f"Field {name} ({_name(self.before)}) was not the same datatype as expected ({_name(self.after)}).",
            "set_nullable": f"Expected field {name} to be nullable.",
            "set_non_nullable": f"Expected field {name} to be non-nullable.",
        }[self.kind]


def _name(kind: T.DataType | None) -> str:
    return kind.simpleString() if kind is not None else ""


class SchemaError(Exception):
    """Two schemas differ: one sentence for each change."""

    def __init__(self, changes: list[SchemaChange]) -> None:
        self.changes = changes
        super().__init__("\n" + "\n".join(c.sentence() for c in changes))


class NoCommonField(Exception):
    def __init__(self) -> None:
        super().__init__("No common field between the DataFrames.")


class ModificationError(Exception):
    """A change that a schema cannot take: why, and the change."""

    def __init__(self, why: str, change: SchemaChange) -> None:
        self.why, self.change = why, change
        super().__init__(f"{why} at {change.path}: {change.kind}")


def quoted_name(name: str) -> str:
    """A name as written in a path: in quotes unless it is plain."""
    return name if is_plain(name) else f'"{name}"'


def compare(left: T.StructType, right: T.StructType) -> list[SchemaChange]:
    """The changes that lead from ``left`` to ``right``.

    Fields are matched by name, at any depth of structs and arrays; those of
    the left come first, in their order, then what the right adds. Whether an
    array may hold nulls is not compared; maps are compared as a whole.
    """
    return _compare_struct(left, right, Root())


def _compare_struct(left: T.StructType, right: T.StructType, at: Key) -> list[SchemaChange]:
    theirs = {f.name: f for f in right.fields}
    ours = {f.name for f in left.fields}
    out: list[SchemaChange] = []
    for field in left.fields:
        path = FieldKey(field.name, at)
        other = theirs.get(field.name)
        if other is None:
            out.append(SchemaChange(path, "remove", before=field.dataType))
            continue
        out += _compare_type(field.dataType, other.dataType, path)
        if field.nullable != other.nullable:
            out.append(SchemaChange(path, "set_nullable" if other.nullable else "set_non_nullable"))
    return out + [SchemaChange(FieldKey(f.name, at), "add", after=f.dataType) for f in right.fields if f.name not in ours]


def _compare_type(a: T.DataType, b: T.DataType, path: Key) -> list[SchemaChange]:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return _compare_struct(a, b, path)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _compare_type(a.elementType, b.elementType, ArrayKey(path))
    return [] if a == b else [SchemaChange(path, "change_type", a, b)]


def assert_same(left: T.StructType, right: T.StructType, strict_nullability: bool = True) -> None:
    """Raise :class:`SchemaError` unless the schemas agree, in any order."""
    changes = compare(left, right)
    if not strict_nullability:
        changes = [c for c in changes if c.kind not in ("set_nullable", "set_non_nullable")]
    if changes:
        raise SchemaError(changes)


def modify(schema: T.StructType, change: SchemaChange) -> T.StructType:
    """Apply one change. Raises :class:`ModificationError` where it cannot be."""
    return _modify_struct(schema, change.path.parts(), change)


def _modify_struct(schema: T.StructType, rest: list, change: SchemaChange) -> T.StructType:
    name = rest[0].name if rest and isinstance(rest[0], FieldKey) else None
    if name is None:
        raise ModificationError("unreachable path", change)
    place = next((i for i, f in enumerate(schema.fields) if f.name == name), None)
    fields = list(schema.fields)
    if len(rest) == 1 and change.kind == "add":
        if place is not None:
            raise ModificationError("duplicated field", change)
        return T.StructType([*fields, T.StructField(name, change.after, True)])
    if place is None:
        raise ModificationError("field not found", change)
    old = fields[place]
    if len(rest) > 1:
        fields[place] = T.StructField(name, _modify_type(old.dataType, rest[1:], change), old.nullable, old.metadata)
    elif change.kind == "remove":
        del fields[place]
    elif change.kind == "change_type":
        fields[place] = T.StructField(name, change.after, old.nullable, old.metadata)
    else:
        fields[place] = T.StructField(name, old.dataType, change.kind == "set_nullable", old.metadata)
    return T.StructType(fields)


def _modify_type(kind: T.DataType, rest: list, change: SchemaChange) -> T.DataType:
    if isinstance(rest[0], ArrayKey):
        if not isinstance(kind, T.ArrayType):
            raise ModificationError("unreachable path", change)
        if len(rest) > 1:
            return T.ArrayType(_modify_type(kind.elementType, rest[1:], change), kind.containsNull)
        if change.kind != "change_type":
            raise ModificationError("unreachable path", change)
        return T.ArrayType(change.after, kind.containsNull)
    if not isinstance(kind, T.StructType):
        raise ModificationError("unreachable path", change)
    return _modify_struct(kind, rest, change)


def changes_frame(spark: SparkSession, changes: list[SchemaChange]) -> DataFrame:
    """The changes as a frame: path, kind, types before and after."""
    rows = [(str(c.path), c.kind, _name(c.before) or None, _name(c.after) or None) for c in changes]
    return spark.createDataFrame(rows, "path string, kind string, type_before string, type_after string")


#: Python names of the types in a rendered class.
_PYTHON = {
    T.BooleanType: "bool",
    T.ByteType: "int",
    T.ShortType: "int",
    T.IntegerType: "int",
    T.LongType: "int",
    T.FloatType: "float",
    T.DoubleType: "float",
    T.DecimalType: "Decimal",
    T.StringType: "str",
    T.BinaryType: "bytes",
    T.DateType: "date",
    T.TimestampType: "datetime",
    T.TimestampNTZType: "datetime",
    T.ArrayType: "list",
    T.MapType: "dict",
    T.StructType: "Row",
}


def _python_name(kind: T.DataType) -> str:
    return next((name for t, name in _PYTHON.items() if isinstance(kind, t)), "object")


def dataclass_text(schema: T.StructType, name: str) -> str:
    """A Python dataclass with one attribute per field, ``| None`` if nullable."""
    lines = ["@dataclass", f"class {name}:"]
    lines += [f"    {f.name if f.name.isidentifier() else repr(f.name)}: {_python_name(f.dataType)}{' | None' if f.nullable else ''}" for f in schema.fields]
    return "\n".join(lines if schema.fields else [*lines, "    pass"])


def one_line_class(schema: T.StructType, name: str) -> str:
    """The same on one line, every field optional."""
    return f"class {name}({', '.join(f'{f.name}: {_python_name(f.dataType)} | None' for f in schema.fields)})"


def ddl(schema: T.StructType) -> str:
    """The schema as text that a reader takes."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)


def field_names(df: DataFrame) -> list[str]:
    """The top-level field names, in order."""
    return df.schema.fieldNames()
