"""Rules, mappings and changes on streams give what they give on tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from rowlattice.functions import columns as fn
from rowlattice.plans import mapping as mp
from rowlattice.plans import quality as qa
from rowlattice.streaming import structured


@pytest.fixture
def folder(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 5, at + datetime.timedelta(minutes=i)) for i in range(60)]
    spark.createDataFrame(rows, "id int, v int, at timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def finished(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


LARGE = qa.Rule(((lambda c: c > 3, "LARGE", True), (lambda c: c > 2, "MEDIUM", False)))


def test_projections_run_on_streams(spark, folder):
    def made(df):
        q = mp.record(id=mp.field("id"), kind=mp.field("v").case_when((1, "one"), otherwise="other")).where(mp.field("v").map(lambda v: v > 0))
        checked = qa.QualityFrame(fn.transform_at(df, "v", lambda c: c + 1)).select(id="id", v=LARGE("v")).to_df()
        return mp.run(df, q), checked

    for i, (live, still) in enumerate(zip(made(stream(spark, folder)), made(spark.read.parquet(folder)))):
        assert rows(finished(spark, live, f"projected{i}", "append")) == rows(still)


def test_annotations_per_window(spark, folder):
    def made(df):
        return structured.annotation_counts(qa.QualityFrame(df).select(at="at", v=LARGE("v")), "at", "30 minutes", "10 minutes")

    got = rows(finished(spark, made(stream(spark, folder)), "windows", "complete"))
    assert got == rows(made(spark.read.parquet(folder))) and sum(r[-1] for r in got) == 24


def test_line_counts(spark, folder):
    live = structured.line_counts(stream(spark, folder), stream(spark, folder).where("v <> 4"), ["v"], "at", "1 hour", "10 minutes")
    assert [r[1:] for r in rows(finished(spark, live, "lines", "complete"))] == [(v, 12, 12 if v < 4 else 0) for v in range(5)]


def test_changes_of_each_dump(spark, tmp_path):
    schema = "id int, d string, a string"
    out, done = {}, []
    for number, dump in enumerate(([(1, "d0", "x"), (2, "d0", "y")], [(1, "d1", "z"), (3, "d1", "y")])):
        spark.createDataFrame(dump, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "dumps"))

        def previous():
            return spark.createDataFrame(done[-1], schema) if done else None

        def sink(changes, batch):
            out[batch] = rows(changes)

        live = spark.readStream.schema(schema).parquet(str(tmp_path / "dumps"))
        structured.stream_changes(live, ["id"], "d", ["a"], previous, sink, str(tmp_path / "state")).awaitTermination(120)
        done.append(dump)
    assert out == {0: [], 1: [(1, "d1", "changed"), (2, "d1", "removed"), (3, "d1", "added")]}
    assert F is not None
