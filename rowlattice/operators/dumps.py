"""Compaction of successive dumps into versions, and views of their history."""

from __future__ import annotations

import argparse
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators.cogroup import _orderable
from rowlattice.operators.versions import quoted

ROWS, DUMPS = "xs", "compressDumpDts"
_DUMP_ID = re.compile(r"(?:19|20)\d{6}")


def _sorted(rows: Column, kind: T.StructType) -> Column:
    return F.array_sort(rows) if _orderable(kind) else rows


#: Dumps by name, or one frame with the column that names the dump of each line.
Dumps = Mapping[str, DataFrame] | tuple[DataFrame, str]


def _tagged(dumps: Dumps, name: str, by_name: bool) -> DataFrame:
    if isinstance(dumps, tuple):
        frame, version = dumps
        return frame.where(F.col(quoted(version)).isNotNull()).select(*[F.col(quoted(c)) for c in frame.columns if c not in (name, version)], F.col(quoted(version)).alias(name))
    if not dumps:
        raise ValueError("at least one dump is needed")
    out = None
    for dump, frame in dumps.items():
        one = frame.withColumn(name, F.lit(dump))
        out = one if out is None else out.unionByName(one) if by_name else out.union(one)
    return out


def compress_flat(dumps: Dumps, name: str = "dump_date", sort_by: Sequence[str] = ()) -> DataFrame:
    """Each distinct line once, with the sorted dumps that held it.

    Columns are matched by name. Dumps that lie in one table are best given as
    the table and its column of dumps: it is read once. With ``sort_by``, lines are ordered by these
    and by their first dump.
    """
    lines = _tagged(dumps, name, by_name=True)
    columns = [c for c in lines.columns if c != name]
    packed = lines.groupBy(*[F.col(quoted(c)) for c in columns]).agg(F.array_sort(F.collect_set(F.col(quoted(name)))).alias(name))
    return packed.orderBy(*[F.col(quoted(c)) for c in sort_by], F.array_min(F.col(quoted(name)))) if sort_by else packed


def compress_grouped(dumps: Dumps, group_by: Sequence[str], name: str = "dump_date", sort_by: Sequence[str] = (), rest: str = "rest") -> DataFrame:
    """:func:`compress_flat`, then the lines of each group as an array."""
    flat = compress_flat(dumps, name)
    inside = [c for c in flat.columns if c not in group_by]
    lines = F.collect_list(F.struct(*[F.col(quoted(c)) for c in inside]))
    schema = flat.select(*[F.col(quoted(c)) for c in inside]).schema
    packed = flat.groupBy(*[F.col(quoted(c)) for c in group_by]).agg(_sorted(lines, schema).alias(rest))
    return packed.orderBy(*[F.col(quoted(c)) for c in sort_by]) if sort_by else packed


def compress(dumps: Dumps, keys: Sequence[str], ordered: bool = True) -> DataFrame:
    """One row per key: ``xs``, its distinct lines, each with ``compressDumpDts``.

    Columns are matched by place, as the dumps of one table have them.
    """
    lines = _tagged(dumps, DUMPS, by_name=False)
    packed = _pack(lines, [F.col(quoted(k)) for k in keys], [c for c in lines.columns if c not in keys and c != DUMPS], list(keys))
    return packed.orderBy(*[F.col(quoted(k)) for k in keys]) if ordered else packed


def compress_by(dumps: Dumps, group_expr: str, group_name: str = "groupByExpr") -> DataFrame:
    """As :func:`compress`, grouped by any SQL expression; the lines keep all columns."""
    lines = _tagged(dumps, DUMPS, by_name=False).withColumn(group_name, F.expr(group_expr))
    return _pack(lines, [F.col(quoted(group_name))], [c for c in lines.columns if c not in (DUMPS, group_name)], [group_name])


def _pack(lines: DataFrame, keys: list[Column], columns: list[str], names: list[str]) -> DataFrame:
    per_line = lines.groupBy(*keys, *[F.col(quoted(c)) for c in columns]).agg(F.array_sort(F.collect_set(F.col(DUMPS))).alias(DUMPS))
    fields = [F.col(quoted(c)) for c in [*columns, DUMPS]]
    schema = per_line.select(*fields).schema
    return per_line.groupBy(*[F.col(quoted(n)) for n in names]).agg(_sorted(F.collect_list(F.struct(*fields)), schema).alias(ROWS))


def unpacked(packed: DataFrame, rows: str = ROWS, dumps: str = DUMPS, name: str = "dump") -> DataFrame:
    """Each line of each dump again: the keys, the line's columns, and its dump.

    Keys without lines and lines without dumps give no row.
    """
    keys = [c for c in packed.columns if c != rows]
    columns = [c for c in packed.schema[rows].dataType.elementType.names if c != dumps]
    lines = packed.select(*[F.col(quoted(k)) for k in keys], F.explode(F.col(quoted(rows))).alias("__line"))
    return lines.select(*[F.col(quoted(k)) for k in keys], *[F.col(f"__line.{quoted(c)}").alias(c) for c in columns], F.explode(f"__line.{quoted(dumps)}").alias(name))


def changed_rows(packed: DataFrame) -> DataFrame:
    """Rows whose last column, an array, has more than one element."""
    return packed.where(F.size(F.col(quoted(packed.columns[-1]))) > 1)


def line_frequency(packed: DataFrame, keys: Sequence[str], rows: str = ROWS, dumps: str = DUMPS) -> DataFrame:
    """How many keys have how many lines in a dump: dump, n_lines, n_keys."""
    per_line = packed.select(*[F.col(quoted(k)) for k in keys], F.explode(F.col(quoted(rows))).alias("__line"))
    per_dump = per_line.select(*[F.col(quoted(k)) for k in keys], F.explode(f"__line.{quoted(dumps)}").alias("dump"))
    counted = per_dump.groupBy(*[F.col(quoted(k)) for k in keys], "dump").agg(F.count(F.lit(1)).alias("n_lines"))
    return counted.groupBy("dump", "n_lines").agg(F.count(F.lit(1)).alias("n_keys"))


def different_lines(left: DataFrame, right: DataFrame, legacy: bool = False) -> DataFrame:
    """Lines that are not exactly once on each side, with ``nbLeft`` and ``nbRight``.

    ``legacy`` leaves out lines that are once on one side and missing on the
    other, as a comparison with null counts would.
    """
    columns = left.columns
    tagged = left.withColumn("__left", F.lit(True)).union(right.withColumn("__left", F.lit(False)))
    counted = tagged.groupBy(*[F.col(quoted(c)) for c in columns]).agg(F.count(F.when(F.col("__left"), 1)).alias("nbLeft"), F.count(F.when(~F.col("__left"), 1)).alias("nbRight"))
    once_each = (F.col("nbLeft") == 1) & (F.col("nbRight") == 1)
    found = counted.where(~once_each)
    if legacy:
        found = found.where(~((F.col("nbLeft") + F.col("nbRight")) == 1))
    return found


def history_view(packed: DataFrame, keys: Sequence[str] | None = None, rows: str = ROWS, dumps: str = DUMPS) -> DataFrame:
    """Lines of each key by first dump, with what changed since the one before.

    For each line: ``minDt`` and ``maxDt`` of its dumps, those of the previous
    line, ``isInit``, and for each column whether it changed, its value and
    the one before.
    """
    keys = list(keys) if keys is not None else [c for c in packed.columns if c != rows]
    inside = packed.schema[rows].dataType.elementType.names
    columns = [c for c in inside if c != dumps]
    lines = packed.select(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)], F.explode(F.col(quoted(rows))).alias("l"))
    lines = lines.select(*[f"k{i}" for i in range(len(keys))], F.array_min(f"l.{quoted(dumps)}").alias("minDt"), F.array_max(f"l.{quoted(dumps)}").alias("maxDt"), *[F.col(f"l.{quoted(c)}").alias(f"v{i}") for i, c in enumerate(columns)])
    order = Window.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("minDt", "maxDt", *[f"v{i}" for i in range(len(columns))])
    lagged = lines.select("*", F.lag("minDt").over(order).alias("minDt_prev"), F.lag("maxDt").over(order).alias("maxDt_prev"), *[F.lag(f"v{i}").over(order).alias(f"b{i}") for i in range(len(columns))])
    started = F.col("minDt_prev").isNotNull()
    out = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)] + ["minDt", "maxDt", "minDt_prev", "maxDt_prev", (~started).alias("isInit")]
    for i, c in enumerate(columns):
        out += [(started & ~F.col(f"v{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"{c}_hasChanged"), F.col(f"v{i}").alias(c), F.col(f"b{i}").alias(f"{c}_prev")]
    return lagged.select(*out)


def history_view_sql(schema: T.StructType, table: str, rows: str = ROWS, dumps: str = DUMPS) -> str:
    """The query of :func:`history_view` as Spark SQL over a table."""
    keys = [quoted(c) for c in schema.names if c != rows]
    columns = [c for c in schema[rows].dataType.elementType.names if c != dumps]
    order = f"(PARTITION BY {', '.join(keys)} ORDER BY minDt, maxDt{''.join(f', {quoted(c)}' for c in columns)})" if keys else "(ORDER BY minDt)"
    out = [*keys, "minDt", "maxDt", "minDt_prev", "maxDt_prev", "minDt_prev IS NULL AS isInit"]
    for c in columns:
        now, before = quoted(c), quoted(f"{c}_prev")
        out += [f"minDt_prev IS NOT NULL AND NOT ({now} <=> {before}) AS {quoted(f'{c}_hasChanged')}", now, before]
    lags = "".join(f", lag({quoted(c)}) OVER w AS {quoted(f'{c}_prev')}" for c in columns)
    prefix = "".join(f"{k}, " for k in keys)
    return (
        f"WITH lines AS (SELECT {prefix}inline({quoted(rows)}) FROM {table}),\n"
        f"dated AS (SELECT *, array_min({quoted(dumps)}) AS minDt, array_max({quoted(dumps)}) AS maxDt FROM lines),\n"
        f"lagged AS (SELECT *, lag(minDt) OVER w AS minDt_prev, lag(maxDt) OVER w AS maxDt_prev{lags} FROM dated WINDOW w AS {order})\n"
        f"SELECT {', '.join(out)} FROM lagged"
    )


def dump_id(path: str) -> str:
    """The date yyyymmdd in a path; the last one if there are several."""
    found = _DUMP_ID.findall(path.replace("-", "").replace("_", "/"))
    if not found:
        raise ValueError(f"no date in {path}")
    return found[-1]


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Compact parquet dumps: ``-i in1,in2 -o out -g key1,key2``."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("-i", "--input", required=True, help="paths, separated by commas, each with a date in it")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("-g", "--group-by", required=True, help="key columns, separated by commas")
    parser.add_argument("--force-local", action="store_true", help="run in this process")
    parser.add_argument("--one-file", action="store_true", help="write a single file; only for small results")
    given = parser.parse_args(args)
    if spark is None:
        builder = SparkSession.builder.appName("compact dumps")
        spark = (builder.master("local[*]") if given.force_local else builder).getOrCreate()
    paths = given.input.split(",")
    ids = [dump_id(p) for p in paths]
    if len(set(ids)) < len(ids):
        raise ValueError(f"two inputs have the same dump date: {ids}")
    packed = compress({i: spark.read.parquet(p) for i, p in zip(ids, paths)}, given.group_by.split(","), ordered=False)
    if given.one_file:
        packed = packed.coalesce(1)
    packed.write.option("compression", "gzip").mode("overwrite").parquet(given.output)
    changed = changed_rows(spark.read.parquet(given.output)).count()
    print(f"{changed} keys have more than one version")
    return changed


if __name__ == "__main__":
    main()
