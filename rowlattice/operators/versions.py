"""Common ground of the snapshot operators: valid lines and ordered versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: More snapshots than this are refused: the list of versions is broadcast.
MAX_VERSIONS = 100_000


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind.fields)


def comparable(name: str, kind: T.DataType) -> Column:
    """The column in a form that can be grouped, ordered and hashed."""
    column = F.col(quoted(name))
    if isinstance(kind, T.MapType) and not has_map(kind.keyType) and not has_map(kind.valueType):
        return F.array_sort(F.map_entries(column))
    if has_map(kind):
        return F.to_json(F.struct(column))
    if isinstance(kind, T.VariantType):
        return F.to_json(column)
    return column


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_hash(columns: Sequence[Column], seed: int = 0) -> Column:
    """64-bit hash in which a null differs from every value and place."""
    parts = [F.lit(seed)]
    for c in columns:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def latest_lines(df: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]) -> DataFrame:
    """One row per key: the payload of the greatest ``order``.

    A null order sorts before all others; equal orders are settled by the
    greatest payload, so the result does not depend on row order. The
    aggregate combines on the map side, so a key that holds most of the rows
    sends at most one row per input partition.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = F.struct(*[F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(payload)])
    rank = F.struct(F.col(quoted(order)).alias("o"), *[comparable(c, kinds[c]).alias(f"v{i}") for i, c in enumerate(payload)])
    grouped = df.groupBy(*[F.col(quoted(k)) for k in keys])
    if any(has_map(kinds[c]) for c in payload):
        best = grouped.agg(F.max_by(values, rank).alias("__best"))
    else:
        best = grouped.agg(F.max(rank).alias("__best"))
    return best.select(*[F.col(quoted(k)) for k in keys], *[F.col(f"__best.v{i}").alias(c) for i, c in enumerate(payload)])


def version_list(df: DataFrame, version: str) -> list:
    """The distinct versions in order; a small list by construction."""
    found = [r[0] for r in df.select(F.col(quoted(version)).alias("v")).where(F.col("v").isNotNull()).distinct().limit(MAX_VERSIONS + 1).collect()]
    if len(found) > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} versions")
    return sorted(found)


def with_ordinal(df: DataFrame, version: str, versions: Sequence, name: str) -> DataFrame:
    """Add the place of ``version`` in ``versions``; other versions are dropped."""
    kind = next(f.dataType for f in df.schema.fields if f.name == version)
    table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(versions)], T.StructType([T.StructField("__version", kind), T.StructField(name, T.IntegerType())]))
    return df.join(F.broadcast(table), F.col(quoted(version)) == F.col("__version")).drop("__version")


def version_of(df: DataFrame, ordinal: str, versions: Sequence, kind: T.DataType, name: str) -> DataFrame:
    """The reverse of :func:`with_ordinal`."""
    table = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(versions)], T.StructType([T.StructField("__place", T.IntegerType()), T.StructField(name, kind)]))
    return df.join(F.broadcast(table), F.col(ordinal) == F.col("__place"), "left").drop("__place")
