"""Paths, schemas, columns, dumps, co-groups, comparison, mapping, quality, effects."""

import json
import math
import random
import threading
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.functions import columns as fn
from rowlattice.operators import cogroup as cg
from rowlattice.operators import compare as cmp
from rowlattice.operators import dumps as dp
from rowlattice.plans import annotated_sql as asql
from rowlattice.plans import diff_summary as ds
from rowlattice.plans import mapping as mp
from rowlattice.plans import paths
from rowlattice.plans import quality as qa
from rowlattice.plans import schema as sc
from rowlattice.sources import io
from rowlattice.streaming import effects as fx


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- paths -------------------------------------------------------------------------


def test_keys():
    assert [k for k, _ in paths.tokens("abc[].def")] == ["name", "brackets", "dot", "name"]
    assert [k for k, _ in paths.tokens("$abc[].def")] == ["error", "name", "brackets", "dot", "name"]
    assert paths.key("") == paths.Root()
    wanted = paths.FieldKey("hijk", paths.ArrayKey(paths.ArrayKey(paths.FieldKey("edfg", paths.FieldKey("abcd")))))
    assert paths.key("abcd.edfg[][].hijk") == wanted and str(wanted) == "abcd.edfg[][].hijk" and wanted.first_name == "abcd"
    assert paths.combine(paths.key("a[]"), paths.key("b.c")) == paths.key("a[].b.c")
    assert [str(k) for k in paths.all_keys(paths.key("a.b[]"))] == ["a", "a.b", "a.b[]"]
    with pytest.raises(paths.PathError, match=r"\[\$\].*\[\(\]"):
        paths.key("$abc[].(edf")
    for bad in ("123", "a..b", "a.", "[]a", ".a", "a[]b"):
        with pytest.raises(paths.PathError):
            paths.key(bad)
    assert paths.field_name('"12.*+.-3"') == "12.*+.-3"
    with pytest.raises(paths.PathError):
        paths.field_name("12.*+.-3")


def test_indexes(spark):
    assert [str(paths.index(t)) for t in ("abc[1].defg", "abc[1][2][3].defg", "abc[-1].defg")] == ["abc[1].defg", "abc[1][2][3].defg", "abc[-1].defg"]
    df = spark.sql("SELECT array(named_struct('b', 1), named_struct('b', 2)) AS a")
    assert df.select(paths.value_at(paths.index("a[-1].b")), paths.value_at(paths.index("a[5].b"))).first()[:] == (2, None)
    assert df.select(paths.column_at(paths.key("a[].b"))).first()[0] == [1, 2]


# -- schemas ---------------------------------------------------------------------------

ATOMS = st.sampled_from([T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()])


def struct_of(kinds):
    names = st.lists(st.sampled_from(["a", "b", "c d", "e.f"]), unique=True, max_size=3)
    return names.flatmap(lambda ns: st.tuples(*[st.tuples(kinds, st.booleans()) for _ in ns]).map(lambda ks: T.StructType([T.StructField(n, k, nullable) for n, (k, nullable) in zip(ns, ks)])))


KINDS = st.recursive(ATOMS, lambda inner: st.one_of(inner.map(lambda k: T.ArrayType(k, True)), struct_of(inner)), max_leaves=5)


@settings(max_examples=200, deadline=None)
@given(struct_of(KINDS), struct_of(KINDS))
def test_changes_lead_from_one_schema_to_the_other(a, b):
    for change in sc.compare(a, b):
        a = sc.modify(a, change)
    left = [c for c in sc.compare(a, b) if c.kind not in ("set_nullable", "set_non_nullable")]
    assert left == []


def test_schema_changes_and_errors():
    a, b = (T._parse_datatype_string(s) for s in ("number int, name int", "rebmun int, name double"))
    changes = sc.compare(a, b)
    assert [(str(c.path), c.kind) for c in changes] == [("number", "remove"), ("name", "change_type"), ("rebmun", "add")]
    with pytest.raises(sc.SchemaError) as error:
        sc.assert_same(a, b)
    assert str(error.value) == "\nField number was not in the expected DataFrame.\nField name (int) was not the same datatype as expected (double).\nField rebmun was not in the original DataFrame."
    for change, why in ((changes[2], "duplicated"), (sc.SchemaChange(paths.key("x"), "remove"), "not found"), (sc.SchemaChange(paths.key("name.x"), "remove"), "unreachable")):
        with pytest.raises(sc.ModificationError, match=why):
            sc.modify(b, change)
    sc.assert_same(T.StructType([T.StructField("a", T.LongType(), False)]), T._parse_datatype_string("a bigint"), strict_nullability=False)


def test_schema_texts(spark):
    s = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.StringType())), T.StructField("c d", T.DateType())])
    assert sc.dataclass_text(s, "Row1") == "@dataclass\nclass Row1:\n    a: int\n    b: list | None\n    'c d': date | None"
    assert sc.one_line_class(s, "R") == "class R(a: int | None, b: list | None, c d: date | None)"
    assert spark.createDataFrame([], sc.ddl(s)).schema == s
    assert sc.quoted_name("a.b") == '"a.b"'


# -- sources -------------------------------------------------------------------------------


def test_sources(spark, tmp_path):
    df = io.json_frame("{a:1, b:'x'}", {"a": 2}, spark=spark)
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and rows(df) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        io.json_frame(spark=spark)
    assert rows(io.maps_frame([{"a": 1}, {"b": True, "c": None}], spark=spark)) == [("1", None, None), (None, "True", None)]
    assert io.literal_frame([(1,), (2,)], "a int", spark).rdd.getNumPartitions() == 1
    io.Write(df).option("compression", "gzip").mode("overwrite").parquet(str(tmp_path / "p"))
    assert rows(io.Read(spark).parquet(str(tmp_path / "p"))) == rows(df)
    with pytest.raises(Exception, match="already exists"):
        io.Write(df).parquet(str(tmp_path / "p"))
    io.Write(df.select("b")).mode("overwrite").text(str(tmp_path / "t"))
    assert sorted(r[0] for r in io.Read(spark).text(str(tmp_path / "t")).collect()) == ["", "x"]
    io.Write(df).format("json").save(str(tmp_path / "j"))
    assert io.json_files(str(tmp_path / "j"), str(tmp_path / "j"), spark=spark).count() == 4
    assert not df.is_cached and io.cached(df).is_cached and io.cached(df) is df
    df.unpersist()


# -- columns -------------------------------------------------------------------------------

FAMILY = "id string, family array<struct<name:string,age:int>>"


@pytest.fixture(scope="module")
def family(spark):
    return spark.createDataFrame([("1", [("John", 32), ("Mary", 31)]), ("2", [("Fred", 42), ("Elsa", 40), ("Daryll", 10)]), ("3", None)], FAMILY)


def test_array_functions(family):
    assert rows(family.select("id", fn.map_array("family", lambda p: p["name"]))) == [("1", ["John", "Mary"]), ("2", ["Fred", "Elsa", "Daryll"]), ("3", None)]
    young = fn.filter_array("family", lambda p: p["age"] < 18)
    assert rows(family.select("id", F.transform(young, lambda p: p["name"]))) == [("1", []), ("2", ["Daryll"]), ("3", None)]
    younger = fn.flat_map_array("family", lambda p: F.array(p["age"], (p["age"] / 2).cast("int")))
    assert rows(family.where("id = '1'").select(younger)) == [([32, 16, 31, 15],)]
    assert rows(family.select(fn.apply("id", lambda c: F.concat(c, F.lit("x"))))) == [("1x",), ("2x",), ("3x",)]
    assert rows(family.select(fn.apply("id", lambda v: v * 2, "string"))) == [("11",), ("22",), ("33",)]


def test_duplicate_columns(spark):
    df = spark.createDataFrame([("1", "John", 32), ("2", None, 31)], "id string, name string, age int")
    other = spark.createDataFrame([("1", "Jack", 1), ("2", "Mary", 2)], "id string, name string, age int")
    joined = df.join(other, df["id"] == other["id"])
    assert fn.coalesce_duplicates(joined).columns == ["id", "name", "age"]
    assert rows(fn.coalesce_duplicates(joined)) == [("1", "John", 32), ("2", "Mary", 31)]
    assert fn.rename_duplicates(joined).columns == ["id_0", "name_0", "age_0", "id_1", "name_1", "age_1"]
    assert fn.rename_duplicates(df).columns == df.columns
    assert fn.move(df, "name", "title").columns == ["id", "title", "age"]
    for bad in ("a.b", "nothing"):
        with pytest.raises(ValueError):
            fn.move(df, bad, "x")


def test_lens(spark, family):
    upper = fn.lens_pattern(family, "family/.*/name", lambda c, k: F.upper(c))
    assert upper.schema.simpleString() == family.schema.simpleString()
    assert rows(upper)[0] == ("1", [("JOHN", 32), ("MARY", 31)]) and rows(upper)[2] == ("3", None)
    older = fn.transform_at(family, "family[].age", lambda c: c + 1)
    assert rows(older)[0][1][0]["age"] == 33
    all_strings = fn.lens(family, lambda p, k: isinstance(k, T.StringType), lambda c, k: F.concat(c, F.lit("!")))
    assert rows(all_strings)[0] == ("1!", [("John!", 32), ("Mary!", 31)])
    nested = spark.sql("SELECT named_struct('name', 'x', 'age', CAST(NULL AS INT)) AS owner, CAST(NULL AS STRUCT<name:STRING>) AS gone")
    assert fn.transform_at(nested, "owner.age", lambda c: c + 1).first() == (("x", None), None)
    assert rows(fn.lens(family, lambda p, k: False, lambda c, k: c)) == rows(family)


def brute_dice(a, b):
    def pairs(t):
        return [w[i : i + 2] for w in t.split(" ") for i in range(max(1, len(w) - 1)) if w]

    if a == b:
        return 1.0
    x, y = pairs(a), pairs(b)
    if not x and not y:
        return 0.0
    shared = sum(min(x.count(p), y.count(p)) for p in set(x))
    return 2 * shared / (len(x) + len(y))


def test_dice(spark):
    rng = random.Random(1)
    texts = ["", " ", "a", "aa", "aaa", "night", "nacht", "a b", *("".join(rng.choices("ab ", k=6)) for _ in range(20))]
    pairs = [(a, b) for a in texts for b in texts] + [(None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fn.dice_similarity(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r["d"] is None if r["a"] is None else r["d"] == pytest.approx(brute_dice(r["a"], r["b"]))


def test_maps_and_records(spark):
    df = spark.sql("SELECT 'x' AS myName, named_struct('firstName', 'y', 'n', 1, 'none', CAST(NULL AS INT)) AS inner, array(1, 2) AS a")
    assert df.select(fn.to_map(df)).first()[0] == {"myName": "x", "inner.first_name": "y", "inner.n": "1", "a": '{"v":[1,2]}'}
    maps = spark.createDataFrame([({"name": "a", "age": "12", "z": "1"},), ({"name": "b", "age": "no"},)], "m map<string,string>")
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType(), False)])
    assert rows(maps.select(fn.from_map("m", kind).alias("r")).select("r.*")) == [("a", 12), ("b", None)]
    with pytest.raises(Exception, match="no value for age"):
        maps.select(fn.from_map("m", kind, strict=True)).collect()
    assert fn.snake_case("myLongName") == "my_long_name"
    assert spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b").select(fn.joined_key("a", "b")).first()[0] == "1§null"


# -- dumps -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def two_dumps(spark):
    return {d: spark.createDataFrame(r, "id int, a string, b int") for d, r in (("20240101", [(1, "a", 1), (2, "b", 22)]), ("20240201", [(1, "a", 3), (2, "b", 22)]))}


def test_compaction(two_dumps):
    packed = {r["id"]: r["xs"] for r in dp.compress(two_dumps, ["id"]).collect()}
    assert [tuple(x) for x in packed[1]] == [("a", 1, ["20240101"]), ("a", 3, ["20240201"])]
    assert [tuple(x) for x in packed[2]] == [("b", 22, ["20240101", "20240201"])]
    assert dp.changed_rows(dp.compress(two_dumps, ["id"])).count() == 1
    assert len(dp.compress_by(two_dumps, "id % 1").first()["xs"]) == 3
    assert dp.compress_by(two_dumps, "id").schema["xs"].dataType.elementType.names == ["id", "a", "b", "compressDumpDts"]
    assert [r["id"] for r in dp.compress_flat(two_dumps, sort_by=["id"]).collect()] == [1, 1, 2]
    assert rows(dp.compress_grouped(two_dumps, ["id"]).select("id", F.size("rest"))) == [(1, 2), (2, 1)]
    assert rows(dp.line_frequency(dp.compress(two_dumps, ["id"]), ["id"])) == [("20240101", 1, 2), ("20240201", 1, 2)]


def test_history_views_agree(spark, two_dumps):
    packed = dp.compress(two_dumps, ["id"])
    view = dp.history_view(packed)
    assert [tuple(r) for r in view.where("id = 1").orderBy("minDt").collect()] == [(1, "20240101", "20240101", None, None, True, False, "a", None, False, 1, None), (1, "20240201", "20240201", "20240101", "20240101", False, False, "a", "a", True, 3, 1)]
    packed.createOrReplaceTempView("packed_test")
    assert rows(spark.sql(dp.history_view_sql(packed.schema, "packed_test"))) == rows(view)


def test_different_lines(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert rows(dp.different_lines(left, right)) == [(2, 2, 1), (3, 0, 1), (None, 1, 0)]
    assert rows(dp.different_lines(left, right, legacy=True)) == [(2, 2, 1)]


def test_compaction_program(spark, two_dumps, tmp_path, capsys):
    for d, df in two_dumps.items():
        df.write.parquet(str(tmp_path / f"{d}_lines"))
    inputs = ",".join(str(tmp_path / f"{d}_lines") for d in two_dumps)
    assert dp.main(["-i", inputs, "-o", str(tmp_path / "out"), "-g", "id"], spark) == 1
    assert "1 keys have more than one version" in capsys.readouterr().out
    with pytest.raises(ValueError, match="same dump date"):
        dp.main(["-i", f"{tmp_path}/20240101_lines,{tmp_path}/20240101_lines", "-o", "x", "-g", "id"], spark)
    with pytest.raises(ValueError, match="no date"):
        dp.dump_id("/a/b")


# -- co-groups ---------------------------------------------------------------------------------------


def test_cogroup_and_nest(spark):
    persons = spark.createDataFrame([("1", "John", 32), ("2", "Mary", 32)], "id string, name string, age int")
    addresses = spark.createDataFrame([("1", "address1"), ("2", "address2"), ("1", "address3"), ("9", "lost"), (None, "null")], "idPerson string, name string")
    both = cg.cogroup({"p": (persons, ["id"]), "a": (addresses, ["idPerson"])})
    got = {r["id"]: ([x["name"] for x in r["p"]], [x["name"] for x in r["a"]]) for r in both.collect()}
    assert got == {"1": (["John"], ["address1", "address3"]), "2": (["Mary"], ["address2"]), "9": ([], ["lost"]), None: ([], ["null"])}
    nested = cg.nest(persons, "id", {"addresses": addresses}, part_key="idPerson")
    assert {r["id"]: [x["name"] for x in r["addresses"]] for r in nested.collect()} == {"1": ["address1", "address3"], "2": ["address2"]}
    with pytest.raises(ValueError, match="addresses"):
        cg.nest(persons, "id", {"addresses": addresses}, part_key="idPerson", strict=True)
    assert cg.cogroup_lists([1, 2, 3], [4, 6], lambda x: x % 2, lambda x: x % 3) == [(1, [1, 3], [4]), (0, [2], [6])]


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = cg.indexed(df, "n", order=["x"]).collect()
    assert len(got) == 1000 and all(r["n"] == r["x"] for r in got)
    assert sorted(r["n"] for r in cg.indexed(df, "n").collect()) == list(range(1000))
    assert cg.indexed(df.limit(0), "n").collect() == []


def test_scratch_tables_can_be_deleted(spark):
    from rowlattice import session

    kept = session.materialize(spark.range(3))
    path = kept.inputFiles()[0]
    assert session.clear_scratch(spark) > 0 and not __import__("os").path.exists(path.removeprefix("file://"))


def test_measures(spark):
    a, b = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, m double"), spark.createDataFrame([("a", 4.0), ("c", 7.0)], "k string, m double")
    r = cg.compare_measures(a, b, ["k"], ["m"]).first().asDict()
    assert r == {"measure": "m", "left_only": 5.0, "right_only": 7.0, "left_common": 3.0, "right_common": 4.0, "diff": 1.0, "diff2": 1.0, "n_left": 1, "n_right": 1, "n_common": 1, "n_zero": 0}


# -- comparison ------------------------------------------------------------------------------------------


def ints(spark, *values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` int").coalesce(1)


def test_ordered_equality(spark):
    cmp.assert_equal(ints(spark, 1, 2, 3), ints(spark, 1, 2, 3))
    with pytest.raises(cmp.ValueMismatch, match="in value at id, 3 was not equal to 2"):
        cmp.assert_equal(ints(spark, 1, 2, 3), ints(spark, 1, 3, 4))
    with pytest.raises(sc.NoCommonField):
        cmp.assert_equal(ints(spark, 1), ints(spark, 1, name="di"))
    with pytest.raises(cmp.ValueMismatch, match="no row"):
        cmp.assert_equal(ints(spark, 1, 2), ints(spark, 1))
    with pytest.raises(cmp.ValueMismatch):
        cmp.assert_equal(ints(spark, 1, 2, 3, name="id.a"), ints(spark, 2, 1, 4, name="id.a"))
    cmp.assert_equal(ints(spark, 1, 2, 3), ints(spark, 3, 2, 1), ordered=False)
    cmp.assert_equal(ints(spark, 1, 2, 3), ints(spark, 3, 2, 1), order=["id"])
    with pytest.raises(cmp.ValueMismatch, match="2 and 1 times"):
        cmp.assert_equal(ints(spark, 1, 1), ints(spark, 1), ordered=False)


def test_report_text(spark):
    a, b = io.json_frame("{a:1,b:true}", "{a:2,b:false}", spark=spark), io.json_frame("{a:1}", "{a:3}", spark=spark)
    with cmp.using(fail_on_missing_original=False), pytest.raises(cmp.ValueMismatch) as error:
        cmp.assert_equal(a, b)
    assert str(error.value) == "The data set content is different :\n\nin value at a, 3 was not equal to 2\ndataframe({a: 2})\ndataframe({a: 3})\n"
    with pytest.raises(sc.SchemaError):
        cmp.assert_equal(a, b)
    with cmp.using(fail_on_missing_original=False, fail_on_missing_expected=False):
        cmp.assert_equal(io.json_frame("{a:1,b:true}", spark=spark), io.json_frame("{a:1,c:false}", spark=spark))
    with pytest.raises(RuntimeError), cmp.using(max_row_error=1):
        raise RuntimeError
    assert cmp.policy == cmp.Policy()


def test_approximate_equality(spark):
    def doubles(*values):
        return spark.createDataFrame([(v,) for v in values], "number double").coalesce(1)

    cmp.assert_equal(doubles(1.11, 5.22, None), doubles(1.1, 5.2, None), approx=0.1)
    with pytest.raises(cmp.ValueMismatch):
        cmp.assert_equal(doubles(1.1), doubles(1.2), approx=0.05)
    nan = float("nan")
    cmp.assert_equal(doubles(nan), doubles(nan))
    with pytest.raises(cmp.ValueMismatch):
        cmp.assert_equal(doubles(nan), doubles(nan), approx=0.1)
    a, b = (spark.createDataFrame(r, "k int, x double") for r in ([(1, 1.0), (2, None), (3, 2.0)], [(1, 1.05), (2, 1.0), (3, 3.0)]))
    assert rows(cmp.approx_differences(a, b, ["k"], 0.1)) == [(2, "x"), (3, "x")]


def test_approximate_differences_of_keys_on_one_side(spark):
    a, b = (spark.createDataFrame(r, "k int, x double") for r in ([(1, 1.0), (2, 2.0), (None, 1.0)], [(1, 1.5), (3, 3.0), (None, 1.0)]))
    found = cmp.approx_differences(a, b, ["k"], 0.1, one_sided=True).collect()
    assert {tuple(r) for r in found} == {(1, "x", "both"), (2, None, "left"), (3, None, "right")} and len(found) == 3
    assert [tuple(r) for r in cmp.approx_differences(a, b, ["k"], 0.1).collect()] == [(1, "x")]


def test_nullability(spark):
    strict = cmp.set_nullable(ints(spark, 1, 2), "id", False)
    assert not strict.schema["id"].nullable
    cmp.assert_equal(strict, ints(spark, 1, 2))
    with cmp.using(fail_on_nullable=True), pytest.raises(sc.SchemaError, match="to be nullable"):
        cmp.assert_equal(strict, ints(spark, 1, 2))


def test_predicates_and_containment(spark):
    df = ints(spark, 1, 2, 3)
    cmp.should_exist(df, "id > 2")
    cmp.should_for_all(df, "id IS NOT NULL")
    cmp.should_for_all(ints(spark, 1, None), "id > 0")
    with pytest.raises(AssertionError, match="id=1"):
        cmp.should_for_all(df, "id > 1")
    with pytest.raises(AssertionError):
        cmp.should_exist(df, F.col("id") > 3)
    cmp.assert_contains(df, [1, 3])
    with pytest.raises(AssertionError, match="id=7"):
        cmp.assert_contains(df, [1, 7])
    pairs = spark.createDataFrame([(1, 1), (None, None)], "a int, b int")
    cmp.assert_columns_equal(pairs, "a", "b")
    with pytest.raises(AssertionError):
        cmp.assert_columns_equal(pairs.select("a", F.lit(2).alias("b")), "a", "b")
    assert cmp.order_columns(spark.sql("SELECT 1 AS b, 2 AS a")).columns == ["a", "b"]


def test_nested_value_changes():
    a = {"set": [["a"], ["b"]], "id": 1, "gone": None}
    b = {"set": [["a"]], "id": "1", "gone": 2}
    found = [(str(c.path), c.kind) for c in cmp.compare_values(a, b)]
    assert found == [("set[1]", "remove"), ("id", "change"), ("gone", "add")]


# -- mapping ------------------------------------------------------------------------------------------------


def mapped(spark, text, query, schema=None):
    made = mp.run(io.json_frame(text, spark=spark) if schema is None else spark.read.schema(schema).option("allowUnquotedFieldNames", True).json(spark.sparkContext.parallelize([text])), query)
    return [json.loads(r[0]) for r in made.select(F.to_json(F.struct("*"))).collect()]


def test_filter_and_union(spark):
    weight = mp.field("kg").as_("int")
    q = mp.record(parcel=mp.field("no")).where(weight.map(lambda w: w > 30).or_else(mp.field("kg").is_empty()))
    schema = "no int, kg int"
    assert mapped(spark, "{no:5, kg:31}", q, schema) == [{"parcel": 5}]
    assert mapped(spark, "{no:5, kg:30}", q, schema) == []
    assert mapped(spark, "{no:5}", q, schema) == [{"parcel": 5}]
    both = q.union(q.and_where(weight.map(lambda w: w < 40)))
    assert [len(mapped(spark, "{no:5, kg:%d}" % kg, both, schema)) for kg in (35, 45)] == [2, 1]
    with pytest.raises(Exception, match="no truth value"):
        mp.run(io.json_frame("{a:1}", spark=spark), mp.record(a=mp.field("a")).where(mp.field("b")), strict=True).collect()


def test_a_case_without_result_goes_on_to_the_default(spark):
    """A switch in the place of a result, and a switch as the default of another."""
    shelf = mp.field("genre").case_when(("poetry", mp.field("shelf.low")), ("atlas", mp.field("shelf.high")), otherwise="store")
    lent = mp.field("lent").case_when((True, mp.field("size").case_when(("large", "desk"), otherwise=shelf)))
    place = lent.or_else(mp.field("genre").case_when(("novel", "hall")).or_else(shelf))
    schema = "genre string, size string, lent boolean, shelf struct<low:string,high:string>"
    for text, wanted in (
        ('{"genre":"poetry","lent":true,"size":"large","shelf":{"low":"L4"}}', {"place": "desk"}),
        ('{"genre":"poetry","lent":true,"size":"small","shelf":{"low":"L4"}}', {"place": "L4"}),
        ('{"genre":"atlas","lent":false,"shelf":{"low":"L4","high":"H1"}}', {"place": "H1"}),
        ('{"genre":"novel"}', {"place": "hall"}),
        ('{"genre":"map"}', {"place": "store"}),
        ('{"genre":"poetry"}', {}),
    ):
        assert mapped(spark, text, mp.record(place=place), schema) == [wanted]


def test_annotations_name_what_was_missing_or_failed(spark):
    frame = spark.createDataFrame([(1, 6, 3, "2024-02-30"), (2, 6, 0, None), (3, None, None, "2024-02-29")], "id int, a int, b int, d string")
    ratio = mp.field("a").with_(mp.field("b")).map(lambda a, b: a % b)
    q = mp.record(id=mp.field("id"), ratio=ratio, day=mp.field("d").date_add("day", 1), other=mp.field("b").case_when((0, mp.field("nowhere")), otherwise=mp.field("a")))
    got = {r["id"]: (r["ratio"], r["day"], sorted((n["kind"], n["name"], tuple(n["scope"])) for n in r["annotations"])) for r in mp.annotated(frame, q).collect()}
    assert got[1] == (0, None, [("failed", "DateAdd", ("day",))])
    assert got[2] == (None, None, [("failed", "Apply", ("ratio",)), ("missing", "d", ("day",)), ("missing", "nowhere", ("other",))])
    assert got[3] == (None, "2024-03-01", [("missing", "a", ("other",)), ("missing", "a", ("ratio",))])
    assert [tuple(r) for r in mp.run(frame, mp.record(ratio=ratio)).collect()] == [(0,), (None,), (None,)]


def test_nulls_in_json_are_values_if_asked(spark):
    texts = spark.createDataFrame([(t,) for t in ('{"a":null,"s":{"b":null}}', '{"a":"x","s":{}}', "{}", "no json")], "t string")
    a, b = mp.field("a"), mp.field("s.b")
    q = mp.record(a=a, b=b.or_else("d"), e=a.is_empty(), k=a.case_when((None, "null"), ("x", "x"), otherwise="none"))
    strict = [json.loads(r[0]) for r in mp.run_json(texts, "t", "a string, s struct<b:string>", q, strict_nulls=True).collect()]
    assert strict == [{"a": None, "b": None, "e": False, "k": "null"}, {"a": "x", "b": "d", "e": False, "k": "x"}, *[{"b": "d", "e": True, "k": "none"}] * 2]
    loose = [json.loads(r[0]) for r in mp.run_json(texts, "t", "a string, s struct<b:string>", q).collect()]
    assert loose[0] == {"b": "d", "e": True, "k": "null"}


@pytest.mark.parametrize(
    ("text", "expr", "wanted"),
    [
        ("{a:1}", mp.field("a"), 1),
        ("{a:{b:1}}", mp.field("a.b"), 1),
        ("{a:{b:1}}", mp.field("a").select("b"), 1),
        ("{a:1}", mp.field("x"), None),
        ("{a:1}", mp.expr("1").as_("int"), 1),
        ("{a:1}", mp.expr("x").as_("int"), None),
        ("{a:1}", mp.expr("2.5").as_("decimal"), 2.5),
        ("{a:1}", mp.expr(75.0).as_("decimal"), 75),
        ("{a:1}", mp.expr(True).as_("boolean"), True),
        ("{a:1}", mp.expr("True").as_("boolean"), None),
        ("{a:1}", mp.expr(1.5).as_("string"), None),
        ("{a:1}", mp.expr("1.5").as_("double"), None),
        ("{a:1}", mp.expr(7).as_("string"), "7"),
        ("{a:13}", mp.field("a").as_("int").with_(12).map(lambda x, y: x % y).case_when((1, True), otherwise=False), True),
        ("{a:1}", mp.field("a").is_empty(), False),
        ("{b:1}", mp.field("a").is_empty(), True),
        ("{a:''}", mp.field("a").is_empty(), True),
        ("{a:true}", mp.field("a").case_when((True, "ok"), (False, "no")), "ok"),
        ("{a:false}", mp.field("a").case_when((True, "ok"), (False, "no")), "no"),
        ("{a:1}", mp.field("a").case_when((True, "ok"), (False, "no")), None),
        ("{a:1}", mp.expr(1).case_when(otherwise=mp.expr(1).case_when((2, None), otherwise=1)), 1),
        ("{at:'2031-04-30 06:15'}", mp.field("at").left(4), "2031"),
        ("{at:'2031-04-30 06:15'}", mp.field("at").date_add("day", 1), "2031-05-01"),
        ("{at:'2032-01-31'}", mp.field("at").date_add("month", 1), "2032-02-29"),
        ("{at:'2031-04-30'}", mp.field("at").date_add("decade", 1), None),
        ("{at:'yesterday'}", mp.field("at").date_add("day", 1), None),
        ("{b:1}", mp.field("at").date_add("day", 1), None),
        ("{from:'2030-05-17', to:'2030-05-19'}", mp.field("from").date_diff("day", mp.field("to")), 2),
        ("{from:'2030-05-17', to:'2030-05-19'}", mp.field("from").date_diff("month", mp.field("to")), 0),
        ("{from:'2030-05-17', to:'2031-08-16'}", mp.field("from").date_diff("month", mp.field("to")), 14),
        ("{rows:[{k:'u'},{k:'v'},{}]}", mp.field("rows").map(lambda a: F.array_join(F.transform(a, lambda x: x["k"]), "+")), "u+v"),
        ("{a:[1,2]}", mp.field("a").first_element(), 1),
        ("{a:[1,2]}", mp.field("a").last_element(), 2),
        ("{a:[1,2]}", mp.field("a").size(), 2),
        ("{a:'abc'}", mp.field("a").size(), 3),
        ("{a:5}", mp.field("a").size(), None),
        ("{a:'x'}", mp.field("a").remove("x", "y"), None),
        ("{a:'z'}", mp.field("a").remove("x", "y"), "z"),
        ("{a:true}", mp.field("a").and_(mp.field("b")), None),
        ("{a:true, b:false}", mp.field("a").or_(mp.field("b")), True),
    ],
)
def test_expressions(spark, text, expr, wanted):
    got = mapped(spark, text, mp.record(out=expr, one=1))[0]
    assert got.get("out") == wanted


def test_looking_at_expressions(spark):
    e = mp.field("a").case_when(("x", mp.field("b.c")), otherwise=mp.expr(3).with_(mp.field("d")).map(lambda x, y: x + y))
    assert mp.sources(e) == ["a", "b.c", "d"] and mp.literals(e) == ["x", 3]
    assert mp.listing(e).splitlines()[:2] == ["0 CaseWhen", "1   Field a"]
    assert mp.sources(mp.field("a").select("b")) == ["a.b"]
    df = io.json_frame("{a:'x', d:1}", spark=spark)
    assert mp.traced(df, mp.field("a").or_else(mp.field("z"))).first()["used"] == [0, 1]
    with pytest.raises(ValueError):
        mp.field("a[].b")


# -- quality ---------------------------------------------------------------------------------------------

AGE = qa.Rule(((lambda c: c < 0, "INVALID_AGE", True), (lambda c: c > 140, "INVALID_AGE", True), (lambda c: c < 13, "UNDER_13", False)))
NAME = qa.Rule(((lambda c: c == "", "EMPTY_NAME", True),))


@pytest.fixture(scope="module")
def persons(spark):
    return qa.QualityFrame(spark.createDataFrame([("Joe", 14), ("Timmy", 8), ("", -1)], "name string, age int"))


def notes(frame):
    return {r[0]: [tuple(n) for n in r["annotations"]] for r in frame.to_df().collect()}


def test_rules_make_annotations(persons):
    made = persons.select(name="name", age=AGE("age"))
    assert rows(made.to_df().select("name", "age")) == [("", None), ("Joe", 14), ("Timmy", 8)]
    assert notes(made) == {"Joe": [], "Timmy": [("UNDER_13", "age", ["age"], False, 1)], "": [("INVALID_AGE", "age", ["age"], True, 1)]}
    both = persons.select(n=NAME("name"), a=AGE("age"), k=qa.read("name").map(F.upper))
    assert sorted(notes(both)[None]) == [("EMPTY_NAME", "n", ["name"], True, 1), ("INVALID_AGE", "a", ["age"], True, 1)]
    assert rows(made.flagged().select("has_error", "has_warning")) == [(False, False), (False, True), (True, False)]


def test_every_call_counts(spark):
    frame = qa.QualityFrame(spark.createDataFrame([("Joe", 12)], "name string, age int"))
    inner = AGE("age") + AGE("age") - AGE("age")
    made = frame.select(age=AGE(inner)).to_df().first()
    assert made["age"] == 12 and [tuple(n) for n in made["annotations"]] == [("UNDER_13", "age", ["age"], False, 4)]


def test_annotations_through_a_plan(persons, spark):
    checked = persons.select(name="name", age=AGE("age"))
    kept = checked.where("name <> 'Joe'").order_by("name").limit(5)
    assert sum(map(len, notes(kept).values())) == 2
    twice = checked.union(checked).group_by("name").agg(n=F.count(F.lit(1)))
    assert notes(twice)["Timmy"] == [("UNDER_13", "age", ["age"], False, 2)]
    joined = checked.join(checked.select(name="name", other=AGE("age")), "name")
    assert [n[:2] for n in notes(joined)["Timmy"]] == [("UNDER_13", "age"), ("UNDER_13", "other")]
    summed = persons.group_by().agg(total=AGE("age").map(F.sum))
    assert summed.to_df().first()["total"] == 22
    assert sorted(tuple(n)[0] for n in summed.to_df().first()["annotations"]) == ["INVALID_AGE", "UNDER_13"]


def test_python_rules(spark, persons):
    rule = qa.python_rule(lambda v: (None, [("BAD", True)]) if v < 0 else (v, []), "int")
    assert notes(persons.select(name="name", age=rule("age")))[""] == [("BAD", "age", ["age"], True, 1)]
    qa.register_rule(spark, "to_age", lambda v: (None, [("BAD", True)]) if v < 0 else (v, []), "int", "int")
    persons.df.createOrReplaceTempView("persons_test")
    got = spark.sql("SELECT to_age(age) AS age, size(qa_raw_to_age(age).annotations) AS n FROM persons_test")
    assert rows(got) == [(14, 0), (8, 0), (None, 1)]


def test_built_records(spark):
    df = spark.createDataFrame([(5,)], "x int")
    good = qa.build_result(name=qa.Checked(F.lit("a")), greet=qa.Checked(F.lit(True)))
    assert df.select(good.alias("r")).first()["r"] == (("a", True), [])
    bad = qa.build_result(name=qa.from_error("string", "NO"), greet=qa.from_error("boolean", "NEITHER"))
    r = df.select(bad.alias("r")).first()["r"]
    assert r["value"] is None and [(n["message"], n["onField"]) for n in r["annotations"]] == [("MISSING_VALUE", "name"), ("MISSING_VALUE", "greet"), ("NO", "name"), ("NEITHER", "greet")]
    warned = qa.build_result(name=qa.from_warning(F.lit("a"), "W1"), greet=qa.from_warning(F.lit(True), "W2"))
    assert len(df.select(warned.alias("r")).first()["r"]["annotations"]) == 2
    twice = qa.read("x").then(AGE).then(AGE)
    assert df.select(twice.either().alias("e")).first()["e"] == (None, 5)
    assert [n["message"] for n in df.select(qa.from_error("int", "NO").either().alias("e")).first()["e"]["errors"]] == ["NO"]
    small = qa.read("x").filter(lambda c: c < 3, "TOO_LARGE").result()
    assert df.select(small.alias("r")).first()["r"]["value"] is None


# -- effects -----------------------------------------------------------------------------------------------


def outcome_of(tap, call):
    try:
        tap(call)
    except fx.Rejected:
        return "rejected"
    except ZeroDivisionError:
        return "failed"
    return "done"


def test_a_failing_service_is_left_alone_until_its_failures_are_old():
    tap = fx.CircuitTap(0.05, memory=40)
    assert [outcome_of(tap, lambda: 1 / 0) for _ in range(3)] == ["failed", "rejected", "rejected"]
    assert dict(tap.seen) == {"failed": 1, "rejected": 2} and tap.failed_share == pytest.approx(1 / 3)
    later = [outcome_of(tap, lambda: 1) for _ in range(200)]
    assert "rejected" in later and later[-1] == "done" and later.index("done") < 20
    assert tap.seen.total() == 203


def test_the_level_is_a_decaying_mean():
    tap = fx.CircuitTap(1.0, memory=9)
    wanted, weight = [], 9
    level = None
    for number, outcome in enumerate("dfdffdddf"):
        tap.note({"d": "done", "f": "failed"}[outcome])
        x = float(outcome == "f")
        if level is None:
            level = x
        else:
            level, weight = (level * weight + x) / (weight + 1), min(weight, number)
        wanted.append(level)
        assert tap.level == pytest.approx(level)
    assert 0 < wanted[-1] < 1
    for bad in (-0.1, 1.5):
        with pytest.raises(ValueError, match="share"):
            fx.CircuitTap(bad)


def test_errors_that_do_not_qualify_are_no_failures():
    tap = fx.CircuitTap(0.0, qualifies=lambda e: not isinstance(e, ZeroDivisionError))
    assert {outcome_of(tap, lambda: 1 / 0) for _ in range(5)} == {"failed"} and tap.seen["failed"] == 0 and tap.level == 0


def test_rows_come_back_as_they_were(spark):
    """Nulls beside large whole numbers, nested values and clashing names."""
    big = 2**53 + 1
    data = [(i, None if i % 3 else big + i, None if i % 4 else [i, None], "kept") for i in range(2500)]
    frame = spark.createDataFrame(data, "i int, n bigint, xs array<int>, ok string").coalesce(1)

    def call(row):
        if row["n"] is None:
            raise LookupError("none")
        return row["n"] + 1

    for keep_order in (True, False):
        got = fx.tapped_map(frame, call, "bigint", max_error=1.0, keep_order=keep_order).collect()
        wanted = {(i, n, None if xs is None else tuple(xs), n is not None, None if n is None else n + 1, "LookupError: none" if n is None else None) for i, n, xs, _ in data}
        assert {(r["i"], r["n"], None if r["xs"] is None else tuple(r["xs"]), r["ok"], r["result"], r["error"]) for r in got} == wanted and len(got) == 2500
    out, execution = fx.retry(frame, call, "bigint", max_passes=2, max_failures_in_a_row=10**9)
    assert execution.n_failure == sum(n is None for _, n, _, _ in data)
    assert {(r["i"], r["n"], r["result"]) for r in out.collect()} == {(i, n, None if n is None else n + 1) for i, n, _, _ in data}
    assert fx.tapped_map(frame.limit(0), call, "bigint").collect() == []


def test_limiter_waits_for_the_next_window():
    now, slept = [0.25], []

    def sleep(s):
        slept.append(s)

    limiter = fx.TaskLimiter(1.0, 2, lambda: now[0], sleep)
    assert [limiter.acquire() for _ in range(5)] == [0.0, 0.0, 0.75, 0.75, 1.75]
    now[0] = 10.0
    assert limiter.acquire() == 0.0 and slept == [0.75, 0.75, 1.75]


def test_iterators_release_once():
    log = []
    assert list(fx.from_managed(lambda: log.append("open") or 3, range, lambda r: log.append("close"))) == [0, 1, 2]
    assert log == ["open", "close"]
    it = fx.on_last(iter([1, 2]), lambda: log.append("end"))
    next(it)
    it.close()
    assert log[-1] == "end"

    def broken():
        yield 1
        raise KeyError("x")

    got = list(fx.with_last_error(broken()))
    assert got[0] == (1, None) and isinstance(got[1][1], KeyError)


@pytest.mark.parametrize("ordered", [True, False])
def test_concurrent_calls(ordered):
    level = fx.Resizable(2)
    busy, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.002)
        with lock:
            busy[0] -= 1
        if x % 7 == 0:
            raise ValueError(x)
        return x * 2

    got = list(fx.map_concurrent(range(50), call, 4, ordered, level))
    assert most[0] <= 2 and len(got) == 50
    assert ordered is False or [g[0] for g in got] == list(range(50))
    assert all((g[2] is not None) == (g[0] % 7 == 0) for g in got)


def test_tapped_map(spark):
    df = spark.range(100).coalesce(1)
    got = fx.tapped_map(df, lambda r: int(100 / (r["id"] - 50)), "int", max_error=0.5, workers=1)
    assert got.where("ok").count() == 99 and got.where("error LIKE 'ZeroDivision%'").count() == 1
    closed = fx.tapped_map(df, lambda r: 1 / 0, "int", workers=1)
    assert closed.where("error = 'rejected'").count() > 50


def test_retry(spark, tmp_path):
    folder = str(tmp_path)

    def flaky(r):
        import os

        mark = f"{folder}/{r['id']}"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("first call")
        return r["id"] * 10

    out, execution = fx.retry(spark.range(1, 20), flaky, "long", max_passes=3)
    assert execution == fx.Execution(0, 2)
    assert rows(out.select("id", "result", "ok")) == sorted([(i, i * 10, True) for i in range(1, 20)], key=repr)
    out, execution = fx.retry(spark.range(1, 40).coalesce(1), lambda r: 1 / 0, "int", max_passes=2, max_failures_in_a_row=5)
    assert execution == fx.Execution(39, 2)
    assert out.where("error = 'circuit open'").count() == 34 and not math.isnan(execution.passes)


# -- rules in SQL -------------------------------------------------------------------------------------------


@pytest.fixture
def people(spark):
    def to_age(text):
        if text is None:
            return None, [("EMPTY", True)]
        if not text.lstrip("-").isdigit():
            return None, [("NO_NUMBER", True)]
        return int(text), [("NEGATIVE", False)] if text.startswith("-") else []

    qa.register_rule(spark, "to_age", to_age, "string", "int")
    spark.createDataFrame([(1, "12", "a"), (2, "x", "a"), (3, "-5", "b"), (4, None, "b")], "id int, age string, g string").createOrReplaceTempView("people")
    spark.createDataFrame([("a", "A"), ("b", "B")], "g string, big string").createOrReplaceTempView("places")


def noted(spark, text):
    rows = asql.sql(spark, text).to_df().collect()
    return sorted([(*tuple(r)[:-1], [(n["message"], n["onField"], n["fromFields"], n["count"]) for n in r["annotations"]]) for r in rows], key=repr)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("select id, to_age(age) as age from people where id < 3", [(1, 12, []), (2, None, [("NO_NUMBER", "age", ["age"], 1)])]),
        ("select id, 1 + to_age(age) as next from people where to_age(age) < 0", [(3, -4, [("NEGATIVE", "next", ["age"], 1)])]),
        ("select p.id, q.big, to_age(p.age) n from people p join places q on p.g = q.g where p.id = 4", [(4, "B", None, [("EMPTY", "n", ["age"], 1)])]),
        ("select * from people left join places using (g) where id = 1", [("a", 1, "12", "A", [])]),
        ("select g, sum(to_age(age)) as total from people group by g having sum(to_age(age)) > 0", [("a", 12, [("NO_NUMBER", "total", ["age"], 1)])]),
        ("select g as k, count(*) n from (select g, to_age(age) a from people) t where a is null group by 1 order by k desc limit 1", [("b", 1, [("EMPTY", "a", ["age"], 1)])]),
        ("with c as (select g, to_age(age) a from people where id < 3) select distinct g from c union all select big from places where g = 'b'", [("B", []), ("a", [("NO_NUMBER", "a", ["age"], 1)])]),
        ("select p.id from people p left anti join (select g from places where big = 'A') q on p.g = q.g where p.id = 3", [(3, [])]),
        ("select to_age(age) a, count(*) n from people group by to_age(age) having count(*) = 1 order by a limit 1", [(-5, 1, [("NEGATIVE", "a", ["age"], 1)])]),
        ("select 1 as one", [(1, [])]),
    ],
)
def test_notes_travel_through_sql(spark, people, text, wanted):
    assert noted(spark, text) == wanted


def test_sql_that_cannot_be_annotated_is_refused(spark, people):
    with pytest.raises(NotImplementedError):
        asql.sql(spark, "select id from people where id in (select 1)")
    with pytest.raises(NotImplementedError):
        asql.sql(spark, "select id from people lateral view explode(array(1)) x as y")


def test_a_rule_runs_once_for_its_two_names(spark, people):
    plan = spark.sql("select to_age(age), qa_raw_to_age(age) from people")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.split("ArrowEvalPython [")[1].split("]")[0].count("qa_raw_to_age(") == 1


def test_nullability_is_declared_in_the_jvm(spark):
    schema = "n int, s string, t timestamp, xs array<int>, m map<string,int>, r struct<a:int>"
    frame = spark.createDataFrame([(1, "x", None, [1], {"a": 1}, (1,))], schema)
    for name in frame.columns:
        declared = cmp.set_nullable(frame, name, False)
        assert not declared.schema[name].nullable and cmp.set_nullable(declared, name, True).schema[name].nullable
        assert "Python" not in declared._jdf.queryExecution().executedPlan().toString()
        if name == "t":
            with pytest.raises(Exception, match="a null in t"):
                declared.collect()
        else:
            assert declared.collect() == frame.collect()


def test_an_assertion_shows_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(cmp, "MAX_SHOWN", 7)
    with cmp.using(max_row_error=0), pytest.raises(cmp.ValueMismatch) as error:
        cmp.assert_equal(spark.range(20), spark.range(1, 21), order=["id"])
    assert str(error.value).count("was not equal to") == 7 and "and more rows" in str(error.value)


def test_sets_go_to_the_centre_that_holds_them():
    assert ds.closest([0b0011, 0b1111, 0b0111], 0b0011) == 0
    assert ds.closest([0b1111, 0b0111], 0b0110) == 1
    assert ds.closest([0b0001, 0b1100], 0b0110) == min((0, 1), key=lambda i: ds.set_distance([0b0001, 0b1100][i], 0b0110))
