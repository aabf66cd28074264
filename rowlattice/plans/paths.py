"""Paths into schemas (keys, without positions) and into values (with them)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_TOKEN = re.compile(r'(?P<name>[A-Za-z_][A-Za-z0-9_]*|"[^"]*")|(?P<brackets>\[\])|(?P<dot>\.)|(?P<error>.)', re.S)
_INDEX = re.compile(r'(?P<name>[A-Za-z_][A-Za-z0-9_]*|"[^"]*")|\[(?P<at>-?\d+)\]|(?P<dot>\.)|(?P<error>.)', re.S)


class PathError(ValueError):
    """A text that is no path."""


@dataclass(frozen=True)
class Root:
    """The whole record."""

    def __str__(self) -> str:
        return ""

    def parts(self) -> list:
        return []

    def depth(self) -> int:
        return 0


@dataclass(frozen=True)
class FieldKey:
    name: str
    parent: Root | FieldKey | ArrayKey = Root()

    def __str__(self) -> str:
        own = self.name if is_plain(self.name) else f'"{self.name}"'
        before = str(self.parent)
        return f"{before}.{own}" if before else own

    def parts(self) -> list:
        return [*self.parent.parts(), self]

    @property
    def first_name(self) -> str:
        return self.parts()[0].name


@dataclass(frozen=True)
class ArrayKey:
    parent: FieldKey | ArrayKey

    def __str__(self) -> str:
        return f"{self.parent}[]"

    def parts(self) -> list:
        return [*self.parent.parts(), self]

    @property
    def first_name(self) -> str:
        return self.parts()[0].name


Key = Root | FieldKey | ArrayKey


def is_plain(name: str) -> bool:
    """Whether a field name needs no quotes."""
    return bool(_PLAIN.match(name))


def field_name(text: str) -> str:
    """The name a written name stands for: plain, or anything in double quotes."""
    if is_plain(text):
        return text
    if len(text) > 2 and text[0] == text[-1] == '"':
        return text[1:-1]
    raise PathError(f"{text!r} is not a field name")


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token: name, brackets, dot or error."""
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text)]


def key(text: str) -> Key:
    """Parse ``a.b[].c``; the empty text is the root. All bad characters are named."""
    found = tokens(text)
    bad = [t for kind, t in found if kind == "error"]
    if bad:
        raise PathError(f"{text!r}: not expected here: " + ", ".join(f"[{b}]" for b in bad))
    path: Key = Root()
    before = "start"
    for kind, token in found:
        if kind == "name" and before in ("start", "dot"):
            path = FieldKey(field_name(token), path)
        elif kind == "brackets" and before in ("name", "brackets"):
            path = ArrayKey(path)
        elif kind == "dot" and before in ("name", "brackets"):
            pass
        else:
            raise PathError(f"{text!r}: {token!r} cannot follow a {before}")
        before = kind
    if before == "dot":
        raise PathError(f"{text!r} ends in a dot")
    return path


def combine(prefix: Key, suffix: Key) -> Key:
    """The path ``suffix`` below ``prefix``."""
    path = prefix
    for part in suffix.parts():
        path = FieldKey(part.name, path) if isinstance(part, FieldKey) else ArrayKey(path)
    return path


def all_keys(path: Key) -> list[Key]:
    """The path and all above it, the shortest first."""
    return path.parts()


@dataclass(frozen=True)
class FieldIndex:
    name: str
    parent: FieldIndex | ArrayIndex | Root = Root()

    def __str__(self) -> str:
        before = str(self.parent)
        return f"{before}.{self.name}" if before else self.name

    def parts(self) -> list:
        return [*self.parent.parts(), self]

    @property
    def first_name(self) -> str:
        return self.parts()[0].name


@dataclass(frozen=True)
class ArrayIndex:
    at: int
    parent: FieldIndex | ArrayIndex

    def __str__(self) -> str:
        return f"{self.parent}[{self.at}]"

    def parts(self) -> list:
        return [*self.parent.parts(), self]

    @property
    def first_name(self) -> str:
        return self.parts()[0].name


def index(text: str) -> FieldIndex | ArrayIndex:
    """Parse ``a[1].b``; a negative position counts from the end."""
    path: FieldIndex | ArrayIndex | Root = Root()
    before = "start"
    for m in _INDEX.finditer(text):
        kind = m.lastgroup
        if kind == "name" and before in ("start", "dot"):
            path = FieldIndex(field_name(m["name"]), path)
        elif kind == "at" and before in ("name", "at"):
            path = ArrayIndex(int(m["at"]), path)
        elif not (kind == "dot" and before in ("name", "at")):
            raise PathError(f"{text!r}: {m.group()!r} cannot follow a {before}")
        before = kind
    if isinstance(path, Root) or before == "dot":
        raise PathError(f"{text!r} is not the place of a value")
    return path


def value_at(path: FieldIndex | ArrayIndex) -> Column:
    """The value at an index; null where it is out of bounds."""
    column: Column | None = None
    for part in path.parts():
        if isinstance(part, FieldIndex):
            column = F.col(f"`{part.name}`") if column is None else column.getField(part.name)
        else:
            column = F.try_element_at(column, F.lit(part.at + 1 if part.at >= 0 else part.at))
    return column


def column_at(path: Key) -> Column:
    """The values at a key: arrays on the way are gone through."""

    def below(column: Column | None, rest: list) -> Column:
        if not rest:
            return column
        part = rest[0]
        if isinstance(part, FieldKey):
            return below(F.col(f"`{part.name}`") if column is None else column.getField(part.name), rest[1:])
        return F.transform(column, lambda x: below(x, rest[1:])) if rest[1:] else column

    return below(None, path.parts())
