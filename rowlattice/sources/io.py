"""Readers, writers and literal frames."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowlattice.session import active_session


def json_frame(*lines: str | Mapping, spark: SparkSession | None = None) -> DataFrame:
    """A frame from JSON objects, with or without quotes around names.

    Columns come in the order of their names; whole numbers are bigint.
    """
    if not lines:
        raise ValueError("at least one JSON object is needed")
    spark = spark or active_session()
    texts = [x if isinstance(x, str) else json.dumps(x) for x in lines]
    reader = spark.read.option("allowUnquotedFieldNames", True).option("allowSingleQuotes", True)
    return reader.json(spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).rdd.map(lambda r: r[0]))


def json_files(*paths: str, spark: SparkSession | None = None) -> DataFrame:
    """The objects of one or more files of JSON lines."""
    if not paths:
        raise ValueError("at least one path is needed")
    return (spark or active_session()).read.json(list(paths))


def literal_frame(rows: Sequence, schema: str | T.StructType | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Rows given in the program, in one partition and in their order."""
    if not rows:
        raise ValueError("at least one row is needed")
    return (spark or active_session()).createDataFrame(list(rows), schema).coalesce(1)


def maps_frame(rows: Sequence[Mapping], spark: SparkSession | None = None) -> DataFrame:
    """Maps as rows of strings; the columns are all names, as first seen."""
    names = list(dict.fromkeys(k for row in rows for k in row))
    values = [tuple(None if row.get(n) is None else str(row[n]) for n in names) for row in rows]
    return (spark or active_session()).createDataFrame(values, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def csv_pair(left: str, right: str, sep: str = ";", spark: SparkSession | None = None, schema: str | T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Two CSV files with headers. Without a schema the types are inferred,
    which reads the files once more."""
    reader = (spark or active_session()).read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(left), reader.csv(right)


@dataclass(frozen=True)
class Read:
    """A reader that is put together step by step and shared safely."""

    spark: SparkSession
    options: Mapping[str, str] = field(default_factory=dict)

    def option(self, key: str, value: str) -> Read:
        return replace(self, options={**self.options, key: value})

    def parquet(self, *paths: str) -> DataFrame:
        return self.spark.read.options(**self.options).parquet(*paths)

    def text(self, *paths: str) -> DataFrame:
        return self.spark.read.options(**self.options).text(list(paths))

    def json(self, *paths: str) -> DataFrame:
        return self.spark.read.options(**self.options).json(list(paths))

    def csv(self, *paths: str) -> DataFrame:
        return self.spark.read.options(**self.options).csv(list(paths))

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query)


@dataclass(frozen=True)
class Write:
    """A writer that is put together step by step and shared safely."""

    df: DataFrame
    options: Mapping[str, str] = field(default_factory=dict)
    chosen_format: str | None = None
    chosen_mode: str = "errorifexists"

    def option(self, key: str, value: str) -> Write:
        return replace(self, options={**self.options, key: value})

    def format(self, name: str) -> Write:
        return replace(self, chosen_format=name)

    def mode(self, name: str) -> Write:
        return replace(self, chosen_mode=name)

    def _writer(self):
        writer = self.df.write.options(**self.options).mode(self.chosen_mode)
        return writer.format(self.chosen_format) if self.chosen_format else writer

    def save(self, path: str) -> None:
        self._writer().save(path)

    def parquet(self, path: str) -> None:
        self._writer().parquet(path)

    def text(self, path: str) -> None:
        self._writer().text(path)

    def cache(self) -> DataFrame:
        return cached(self.df)


def cached(df: DataFrame) -> DataFrame:
    """Cache a frame unless it is; never done unasked."""
    return df if df.is_cached else df.cache()
