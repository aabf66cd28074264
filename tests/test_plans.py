"""Physical plans and queries: what is pushed down, what is shuffled, what runs."""

import inspect
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rowlattice import queries_core, queries_general
from rowlattice.functions import columns as fn
from rowlattice.operators import keyed_diff as kd
from rowlattice.operators.versions import latest_lines
from rowlattice.plans import mapping as mp
from rowlattice.plans import quality as qa
from rowlattice.session import maybe_broadcast, shared_dir, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_has_rows_and_every_oracle_a_query(spark, sf_dir):
    frame = queries_general.p4_found(spark, sf_dir)
    assert frame.columns == ["key", "difference"] and frame.limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_have_the_columns_asked_for(spark, sf_dir):
    wanted = {
        "p1_found": [("id", "int"), ("compressdumpdt", "string"), ("change_kind", "string")],
        "p3_found": [("id", "int"), ("mindt", "string"), ("maxdt", "string")],
        "p4_found": [("key", "string"), ("difference", "string")],
    }
    for name, kinds in wanted.items():
        assert queries_general.QUERIES[name](spark, sf_dir).dtypes == kinds


def test_diff_reads_only_what_it_compares(spark, sf_dir):
    left, right = (spark.read.parquet(f"{sf_dir}/{s}_test.parquet").select("key", "value") for s in ("left", "right"))
    text = plan(kd.sections(kd.classified(kd.paired(left, right, ["key"], unique=True))))
    assert text.count("ReadSchema: struct<key:string,value:int>") == 2
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text and "Arrow" not in text


def test_mappings_push_their_filters_down(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = mp.field("o_orderstatus").map(lambda c: c == "F")
    text = plan(mp.run(orders, mp.record(id=mp.field("o_orderkey")).where(status)))
    assert "o_orderstatus" in text.split("PushedFilters")[1] or "o_orderstatus" in text.split("DataFilters")[1]
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text and "Exchange" not in text


def test_rules_and_lenses_are_projections(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(qa.QualityFrame(lines).select(q=queries_core.QUANTITY("l_quantity")).to_df())
    assert "Exchange" not in text and "Python" not in text and "ReadSchema: struct<l_quantity:double>" in text
    packed = spark.read.parquet(f"{sf_dir}/compressed_dumps.parquet")
    assert "Exchange" not in plan(fn.transform_at(packed, "xs[].b", lambda c: c + 1))


def test_hot_keys_are_reduced_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, i, "a") for i in range(10)], "k int, o int, v string")
    text = plan(latest_lines(rows, ["k"], "o", ["v"]))
    assert text.index("Exchange hashpartitioning") < text.rindex("partial_max")


def test_grouped_annotations_collect_no_rows(spark, sf_dir):
    frame = qa.QualityFrame(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select(f="l_returnflag", q=queries_core.QUANTITY("l_quantity"))
    text = plan(frame.group_by("f").agg(n=F.count(F.lit(1))).to_df())
    # what is collected are kinds of notes, counted on the map side before
    assert "partial_sum(" in text and text.count("collect_list(") == text.count("collect_list(CASE WHEN isnotnull(__kind")
    assert text.count("FileScan") == 1 and "Join" not in text


def test_broadcasts_are_checked(spark):
    df = spark.range(3)
    assert maybe_broadcast(df, 3, 2) is df
    assert maybe_broadcast(df, 2, 2) is not df


def named_session(setting, master="local[2]"):
    conf = {"spark.checkpoint.dir": setting} if setting else {}
    context = SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"app-{setting}-{master}")
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_shared_folder_is_that_of_the_session():
    assert shared_dir(named_session("hdfs://shared/folder/")) == "hdfs://shared/folder"
    own = shared_dir(named_session(None))
    assert own.startswith("file://") and shared_dir(named_session(None)) == own
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(named_session(None, "spark://host:7077"))


@pytest.mark.parametrize("module", [kd, mp, qa, fn])
def test_public_functions_are_described(module):
    for name, f in inspect.getmembers(module, inspect.isfunction):
        if not name.startswith("_") and f.__module__ == module.__name__ and len(inspect.getsource(f).splitlines()) > 8:
            assert f.__doc__, name


def test_only_small_inputs_are_dealt_out(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small, large = spread(documents), spread(documents, least_bytes=1000)
    assert "RoundRobinPartitioning" in plan(small) and "Exchange" not in plan(large)
    assert small.count() == large.count() == documents.count()
