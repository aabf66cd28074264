"""Queries for the parts of the toolkit that assert, describe, register or call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.functions import columns as fn
from rowlattice.operators import cogroup as cg
from rowlattice.operators import compare as cmp
from rowlattice.operators import dumps as dp
from rowlattice.operators import keyed_diff as kd
from rowlattice.plans import annotated_sql, paths
from rowlattice.plans import diff_summary as ds
from rowlattice.plans import mapping as mp
from rowlattice.plans import quality as qa
from rowlattice.plans import schema as sc
from rowlattice.queries_core import _LINES, _PAIRS, _classes, _dumps, query, table
from rowlattice.session import active_session, scratch_path
from rowlattice.sources import io
from rowlattice.streaming import effects as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_add = query(QUERIES, ORACLES)


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _message(call) -> str:
    """The text of the error that a call raises, or nothing."""
    try:
        call()
    except Exception as error:  # noqa: BLE001
        return str(error)
    return ""


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return _rows(spark, list(enumerate(text.strip("\n").split("\n"))), "line int, text string")


def _lines_sql(*lines: str) -> str:
    quoted = ["'" + x.replace("'", "''") + "'" for x in lines]
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(quoted)) + ") t(line, text)"


# -- sources and sessions --------------------------------------------------------------


@_add("SELECT n_nationkey AS k, n_name AS name FROM nation")
def a5_literal_dataset(spark, sf_dir):
    """Rows given in the program, of the size of a small table, in one partition."""
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    frame = io.literal_frame(rows, "k int, name string", spark=spark)
    return frame.where(F.spark_partition_id() == 0)


@_add("SELECT o_orderpriority, count(*) AS n, true AS was_cached FROM orders GROUP BY 1")
def a8_cached_write(spark, sf_dir):
    """A frame cached once, also when asked again, and written from the cache."""
    orders = io.Write(table(spark, sf_dir, "orders").select("o_orderpriority")).cache()
    again = io.cached(orders)
    path = scratch_path(spark)
    io.Write(again).parquet(path)
    cached = again is orders and orders.is_cached
    orders.unpersist()
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("was_cached", F.lit(cached))


@_add("SELECT true AS same_session, count(*) AS n FROM region")
def a10_session(spark, sf_dir):
    here = active_session()
    n = io.Read(here).parquet(f"{sf_dir}/region.parquet").count()
    return _rows(spark, [(here.sparkContext.applicationId == spark.sparkContext.applicationId, n)], "same_session boolean, n bigint")


@_add(f"""{_PAIRS} SELECT section, count(*) AS n FROM c GROUP BY 1""")
def a12_analysis_json(spark, sf_dir):
    """An analysis written as a JSON text file and read from it."""
    path = scratch_path(spark)
    text = ds.to_json(ds.summarise(_classes(spark, sf_dir), coarse=True))
    _rows(spark, [(text,)], "value string").coalesce(1).write.text(path)
    summary = ds.from_json(spark.read.text(path).first()[0])
    rows = [("inner_equal", summary.rows_equal), ("inner_diff", summary.rows_not_equal), ("outer_left", summary.left_only.count), ("outer_right", summary.right_only.count)]
    return _rows(spark, [r for r in rows if r[1]], "section string, n bigint")


# -- columns and paths -------------------------------------------------------------------


@_add("SELECT row_id, CASE WHEN str IS NULL THEN NULL ELSE upper(str) END AS built, CASE WHEN str IS NULL THEN -1 ELSE length(str) END AS called FROM enum_rows")
def b12_column_functions(spark, sf_dir):
    """A function that builds an expression, and one of Python that sees nulls."""
    rows = table(spark, sf_dir, "enum_rows")
    return rows.select("row_id", fn.apply("str", F.upper).alias("built"), fn.apply("str", lambda s: -1 if s is None else len(s), "int").alias("called"))


@_add("SELECT id, x.a AS a, x.b * 10 AS b FROM (SELECT id, unnest(xs) AS x FROM compressed_dumps)")
def b16_transform_at_path(spark, sf_dir):
    changed = fn.transform_at(table(spark, sf_dir, "compressed_dumps"), "xs[].b", lambda b: b * 10)
    return changed.select("id", F.inline("xs")).select("id", "a", "b")


@_add("SELECT id, xs[1].a AS first_a, xs[-1].b AS last_b, xs[3].a AS third_a, len(xs) AS n FROM compressed_dumps")
def h19_values_by_path(spark, sf_dir):
    """Values at places, negative ones counted from the end, and all values at a key."""
    packed = table(spark, sf_dir, "compressed_dumps")
    at = {"first_a": "xs[0].a", "last_b": "xs[-1].b", "third_a": "xs[2].a"}
    return packed.select("id", *[paths.value_at(paths.index(p)).alias(n) for n, p in at.items()], F.size(paths.column_at(paths.key("xs[].b"))).cast("bigint").alias("n"))


@_add("SELECT * FROM (VALUES ('xs'), ('xs[]'), ('xs[].compressdumpdts'), ('xs[].compressdumpdts[]')) t(path)")
def h19_paths(spark, sf_dir):
    whole = paths.combine(paths.key("xs[]"), paths.key("compressdumpdts[]"))
    return _rows(spark, [(str(k),) for k in paths.all_keys(whole)], "path string")


@_add("SELECT * FROM (VALUES ('plain_name', 'plain_name'), ('two words', '\"two words\"'), ('a.b', '\"a.b\"')) t(name, written)")
def l4_column_names(spark, sf_dir):
    return _rows(spark, [(n, sc.quoted_name(n)) for n in ("plain_name", "two words", "a.b")], "name string, written string")


@_add("SELECT * FROM (VALUES ('r_regionkey', false, true), ('r_name', true, true)) t(name, nullable_now, kept)")
def b22_set_nullable(spark, sf_dir):
    """Nullability declared otherwise; what is read stays the same, in the JVM."""
    region = table(spark, sf_dir, "region")
    declared = cmp.set_nullable(cmp.set_nullable(region, "r_regionkey", False), "r_name", True)
    same = not cmp.multiset_differences(region, declared).limit(1).collect()
    return _rows(spark, [(f.name, f.nullable, same) for f in declared.schema.fields], "name string, nullable_now boolean, kept boolean")


@_add("SELECT * FROM (VALUES (0, 'event_id'), (1, 'ts'), (2, 'user_id'), (3, 'event_type'), (4, 'value'), (5, 'props')) t(place, name) WHERE name IN (SELECT column_name FROM (DESCRIBE events))")
def j9_field_names(spark, sf_dir):
    return _rows(spark, list(enumerate(sc.field_names(table(spark, sf_dir, "events")))), "place int, name string")


@_add(_lines_sql("class Region(r_regionkey: int | None, r_name: str | None)"))
def l6_one_line_class(spark, sf_dir):
    return _lines(spark, sc.one_line_class(table(spark, sf_dir, "region").schema, "Region"))


@_add(_lines_sql("Field c_name was not in the expected DataFrame.", "Field c_nationkey (int) was not the same datatype as expected (bigint).", "Field extra was not in the original DataFrame."))
def l2_schema_assertion(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    other = customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), F.lit("x").alias("extra"))
    return _lines(spark, _message(lambda: sc.assert_same(customer.schema, other.schema, strict_nullability=False)))


# -- assertions ----------------------------------------------------------------------------


@_add("""SELECT * FROM (SELECT 'all quantities positive' AS assertion, (SELECT bool_and(l_quantity > 0) FROM lineitem) AS holds
UNION ALL SELECT 'all quantities below 45', (SELECT bool_and(l_quantity < 45) FROM lineitem)
UNION ALL SELECT 'some quantity of 50', (SELECT bool_or(l_quantity = 50) FROM lineitem) UNION ALL SELECT 'some quantity of 51', (SELECT bool_or(l_quantity = 51) FROM lineitem)
UNION ALL SELECT 'regions in nations', (SELECT bool_and(r_regionkey IN (SELECT n_regionkey FROM nation)) FROM region) UNION ALL SELECT 'key 99 in nations', (SELECT bool_or(n_regionkey = 99) FROM nation)
UNION ALL SELECT 'discount is tax', (SELECT bool_and(l_discount IS NOT DISTINCT FROM l_tax) FROM lineitem))""")
def b19_assertions(spark, sf_dir):
    lines, nation = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey")
    calls = {
        "all quantities positive": lambda: cmp.should_for_all(lines, "l_quantity > 0"),
        "all quantities below 45": lambda: cmp.should_for_all(lines, F.col("l_quantity") < 45),
        "some quantity of 50": lambda: cmp.should_exist(lines, "l_quantity = 50"),
        "some quantity of 51": lambda: cmp.should_exist(lines, "l_quantity = 51"),
        "regions in nations": lambda: cmp.assert_contains(nation, region),
        "key 99 in nations": lambda: cmp.assert_contains(nation, [99]),
        "discount is tax": lambda: cmp.assert_columns_equal(lines, "l_discount", "l_tax"),
    }
    return _rows(spark, [(name, _message(call) == "") for name, call in calls.items()], "assertion string, holds boolean")


@_add("SELECT n_nationkey AS row_index, n_nationkey AS before, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 1 END AS after FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 25, NULL, 25")
def c10_positional_zip(spark, sf_dir):
    """Row by row in the order of delivery; a row beyond the other's end faces nothing."""
    a = table(spark, sf_dir, "nation").select("n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey")
    b = a.select(F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") + 1).otherwise(F.col("n_nationkey")).alias("n_nationkey")).union(spark.range(25, 26).select(F.col("id").cast("int"))).coalesce(1)
    return cmp.ordered_differences(a, b).select("row_index", F.col("left.n_nationkey").alias("before"), F.col("right.n_nationkey").alias("after"))


def _two(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    schema = "a int, b boolean, xs array<int>, s struct<c:double>"
    left = [(1, True, [1, 2], (1.0,)), (3, False, [1], (float("nan"),)), (5, None, None, (2.0,))]
    right = [(1, True, [1, 2, 9], (1.05,)), (2, False, [1], (float("nan"),)), (5, True, None, None)]
    return io.literal_frame(left, schema, spark=spark), io.literal_frame(right, schema, spark=spark)


@_add("""SELECT * FROM (VALUES (0, 'xs[2]', 'add', NULL, '9'), (0, 's.c', 'change', '1.0', '1.05'), (1, 'a', 'change', '3', '2'), (2, 'b', 'add', NULL, 'true'), (2, 's', 'remove', '{''c'': 2.0}', NULL)) t(row_index, path, kind, before, after)""")
def m1_value_changes(spark, sf_dir):
    """Changes of nested values, place by place."""
    found = []
    for i, (a, b) in enumerate(zip(*(frame.collect() for frame in _two(spark)))):
        found += [(i, str(c.path), c.kind, *[None if x is None else cmp.show(x) for x in (c.before, c.after)]) for c in cmp.compare_values(a, b)]
    return _rows(spark, found, "row_index int, path string, kind string, before string, after string")


@_add(_lines_sql("The data set content is different :", "", "in value at a, 2 was not equal to 3", "dataframe({a: 3, b: false})", "dataframe({a: 2, b: false})", "", "in value at b, true was added", "dataframe({b: null, a: 5})", "dataframe({b: true, a: 5})"))
def m4_assert_equal(spark, sf_dir):
    """The report of an assertion: what changed, and the rows, changed fields first."""
    left, right = (frame.select("a", "b") for frame in _two(spark))
    return _lines(spark, _message(lambda: cmp.assert_equal(left, right)))


@_add("SELECT 0.1::DOUBLE AS approx, 1 AS n_blocks UNION ALL SELECT 0.01, 2")
def m5_assert_approx_equal(spark, sf_dir):
    """Numbers may be so far apart; NaN differs from NaN then."""
    left, right = (io.literal_frame([(x,) for x in xs], "x double", spark=spark) for xs in ([1.0, 2.0, float("nan")], [1.05, 2.0, float("nan")]))
    texts = {approx: _message(lambda a=approx: cmp.assert_equal(left, right, approx=a)) for approx in (0.1, 0.01)}
    return _rows(spark, [(approx, text.count("in value at x")) for approx, text in texts.items()], "approx double, n_blocks int")


@_add("SELECT 3 AS shown, 3 AS n_blocks UNION ALL SELECT 0, 5")
def m6_reported_rows(spark, sf_dir):
    """As many rows as the policy shows; with no limit, all of these."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey").coalesce(1)
    other = nation.select(F.when(F.col("n_nationkey") < 5, -1 - F.col("n_nationkey")).otherwise(F.col("n_nationkey")).alias("n_nationkey"))
    out = []
    for shown in (3, 0):
        with cmp.using(max_row_error=shown):
            out.append((shown, _message(lambda: cmp.assert_equal(nation, other, order=None)).count("was not equal to")))
    return _rows(spark, out, "shown int, n_blocks int")


# -- summaries ---------------------------------------------------------------------------------


@_add("""WITH d AS (SELECT value, eulav FROM left_test UNION ALL SELECT value, eulav FROM right_test)
SELECT 'value' AS "column", count(*) AS count, count(*) FILTER (value IS NULL) AS nulls, sum(value)::BIGINT AS total FROM d UNION ALL SELECT 'eulav', count(*), count(*) FILTER (eulav IS NULL), count(eulav) FROM d""")
def d1_merged_descriptions(spark, sf_dir):
    """Descriptions of two tables, made apart and merged."""
    rows = []
    for column in ("value", "eulav"):
        parts = [ds.describe_column(table(spark, sf_dir, f"{side}_test"), column, 10**6) for side in ("left", "right")]
        whole = parts[0].merged(parts[1])
        total = sum(int(k) * n for k, n in whole.histograms["value"].values.items()) if column == "value" else whole.enums["value"].total
        rows.append((column, whole.count, whole.counts.get("nNull", 0), total))
    return _rows(spark, rows, "column string, count bigint, nulls bigint, total bigint")


@_add(f"""{_PAIRS}, x AS (SELECT * FROM c WHERE section LIKE 'inner%')
SELECT 'value' AS "column", count(*) FILTER (NOT list_contains(s, 'value')) AS n_equal, count(*) FILTER (list_contains(s, 'value')) AS n_not_equal, 1 AS n_zero FROM x""")
def d29_neutral_element(spark, sf_dir):
    """A delta merged with an empty one stays as it is."""
    delta = ds.summarise(_classes(spark, sf_dir)).by_column["value"]
    both = ds.Delta().merged(delta).merged(ds.Delta())
    return _rows(spark, [("value", both.n_equal, both.n_not_equal, int(both == delta))], "column string, n_equal bigint, n_not_equal bigint, n_zero int")


@_add(f"{_PAIRS} SELECT DISTINCT unnest(s) AS \"column\" FROM c WHERE section = 'inner_diff'")
def g7_union_of_key_sets(spark, sf_dir):
    """All columns that differ anywhere: the union of the sets, merged into one."""
    counted = {frozenset(r["diff_set"].split(",")): r["n"] for r in kd.diff_sets(_classes(spark, sf_dir)).collect()}
    merged = ds.compact_sets(counted, 1, lambda a, b: a + b)
    return _rows(spark, [(c,) for union in merged for c in union], "column string")


@_add("SELECT * FROM (VALUES ('left', 'left_test.parquet'), ('right', 'right_test.parquet')) t(side, file)")
def m10_dataset_info(spark, sf_dir):
    sources = ds.sources_of(*(table(spark, sf_dir, f"{side}_test") for side in ("left", "right")))
    names = [(side, next((p for p in f.split("/") if p.endswith("_test.parquet")), "")) for side, files in sources.items() for f in files]
    return _rows(spark, names, "side string, file string").distinct()


@_add("SELECT 'true' AS wide_enough, 6 AS n_bars")
def m9_console(spark, sf_dir):
    """Bars fit the console; there are as many as asked for."""
    histogram = ds.describe_column(table(spark, sf_dir, "part"), "p_size").histograms["value"]
    drawn = ds.bars(histogram, 6)
    return _rows(spark, [(str(max(map(len, drawn)) <= max(80, ds.console_width())).lower(), len(drawn))], "wide_enough string, n_bars int")


@_add(f"""{_PAIRS}, k AS (SELECT count(*) FILTER (section = 'inner_equal') AS e, count(*) FILTER (section = 'inner_diff') AS d, count(*) FILTER (section = 'outer_left') AS l, count(*) FILTER (section = 'outer_right') AS r FROM c)
SELECT unnest(['Number of equal rows: ' || e, 'Number of different rows: ' || d, 'Number of rows on the left only: ' || l, 'Number of rows on the right only: ' || r]) AS text FROM k""")
def m7_report_counts(spark, sf_dir):
    """The lines of the report that count rows."""
    lines = ds.render(ds.summarise(_classes(spark, sf_dir), coarse=True)).split("\n")
    return _rows(spark, [(x.strip(),) for x in lines if "Number of" in x and "rows" in x], "text string")


# -- dumps ------------------------------------------------------------------------------------------


@_add(f"{_LINES}, k AS (SELECT id, count(*) AS n FROM flat GROUP BY 1) SELECT id, n, row_number() OVER (ORDER BY id NULLS FIRST) - 1 AS place FROM k")
def f1_ordered_by_keys(spark, sf_dir):
    packed = dp.compress(_dumps(spark, sf_dir), ["id"], ordered=True)
    marked = packed.select("id", F.size("xs").cast("bigint").alias("n"), F.monotonically_increasing_id().alias("m"))
    return cg.indexed(marked, "place", ["m"]).select("id", "n", "place")


@_add(f"{_LINES}, m AS (SELECT id, a, b, min(d) AS first_dump FROM lines GROUP BY 1, 2, 3) SELECT id, a, b, first_dump, first_dump >= coalesce(lag(first_dump) OVER (PARTITION BY id ORDER BY first_dump), '') AS rises FROM m")
def f2_sorted_by_first_dump(spark, sf_dir):
    flat = dp.compress_flat(_dumps(spark, sf_dir), sort_by=["id"])
    marked = flat.select("id", "a", "b", F.array_min("dump_date").alias("first_dump"), F.monotonically_increasing_id().alias("m"))
    lines = marked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("m", "a", "b", "first_dump"))).alias("xs"))
    before = lines.select("id", "xs", F.posexplode("xs").alias("i", "x"))
    rises = F.when(F.col("i") == 0, True).otherwise(F.col("x.first_dump") >= F.get("xs", F.col("i") - 1)["first_dump"])
    return before.select("id", "x.a", "x.b", "x.first_dump", rises.alias("rises"))


@_add("SELECT * FROM (VALUES ('b', 2, 0), ('a', 1, 2), ('c', 0, 1)) t(k, n_left, n_right)")
def c14_in_memory_cogroup(spark, sf_dir):
    pairs = cg.cogroup_lists(["b1", "a1", "b2"], ["a3", "c1", "a2"], lambda x: x[0], lambda x: x[0])
    return _rows(spark, [(k, len(a), len(b)) for k, a, b in pairs], "k string, n_left int, n_right int")


# -- mapping -------------------------------------------------------------------------------------------


@_add("SELECT o_orderkey, strftime(o_orderdate::DATE + 3, '%Y-%m-%d') AS later, date_diff('day', o_orderdate::DATE, DATE '2001-02-03')::INT AS days, datesub('month', o_orderdate::DATE, DATE '2001-02-28')::INT AS months FROM orders")
def h4_date_differences(spark, sf_dir):
    day = mp.field("o_orderdate")
    q = mp.record(o_orderkey=mp.field("o_orderkey"), later=day.date_add("day", 3), days=day.date_diff("day", "2001-02-03"), months=day.date_diff("month", "2001-02-28"))
    return mp.run(table(spark, sf_dir, "orders"), q)


@_add("SELECT id, array_to_string(list_transform(xs, lambda x: coalesce(x.a, '')), '|') AS joined FROM compressed_dumps WHERE xs IS NOT NULL")
def h7_partial_function(spark, sf_dir):
    """A function of the structure of a value: the names in all elements."""
    names = mp.field("xs").map(lambda xs: F.array_join(F.transform(xs, lambda x: F.coalesce(x["a"], F.lit(""))), "|"))
    return mp.run(table(spark, sf_dir, "compressed_dumps").where("xs IS NOT NULL"), mp.record(id=mp.field("id"), joined=names))


@_add(_lines_sql("0 CaseWhen", "1   Field o_orderstatus", "2   Lit 'F'", "3   OrElse", "4     Field o_clerk", "5     Lit 'none'"))
def n3_listing(spark, sf_dir):
    return _lines(spark, mp.listing(mp.field("o_orderstatus").case_when(("F", mp.field("o_clerk").or_else("none")))))


@_add("SELECT * FROM (VALUES (0, 'CaseWhen'), (1, 'Cast'), (2, 'Field'), (1, 'Lit'), (1, 'Lit')) t(level, part)")
def n1_walked_parts(spark, sf_dir):
    e = mp.field("a").as_("int").case_when((1, "one"))
    return _rows(spark, [(level, type(x).__name__) for level, x in mp.walk(e)], "level int, part string")


@_add("SELECT row_id, CASE WHEN str IN ('', 'a') THEN NULL ELSE str END AS removed, true AS lowered FROM enum_rows")
def n5_lowered_expression(spark, sf_dir):
    """Taking values away is a switch, and does what the switch does."""
    removed = mp.field("str").remove("", "a")
    made = mp.run(table(spark, sf_dir, "enum_rows"), mp.record(row_id=mp.field("row_id"), removed=removed))
    return made.withColumn("lowered", F.lit(isinstance(mp.lower(removed), mp.CaseWhen)))


# -- rules in SQL -----------------------------------------------------------------------------------------


def _sized(value):
    """A rule of Python: no value below nothing, a note on large ones."""
    if value is None:
        return None, [("MISSING", True)]
    return (value, [("LARGE", False)]) if value > 30 else (value, [])


def _rule(spark: SparkSession, sf_dir: str, *names: str) -> None:
    qa.register_rule(spark, "sized", _sized, "double", "double")
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"noted_{name}")


@_add("SELECT l_orderkey, l_linenumber, l_quantity AS quantity, CASE WHEN l_quantity > 30 THEN 'LARGE' END AS note FROM lineitem")
def j1_registered_rule(spark, sf_dir):
    """A rule by its two names in plain SQL: its value, and the struct with its notes."""
    _rule(spark, sf_dir, "lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, sized(l_quantity) AS quantity, get(qa_raw_sized(l_quantity).annotations, 0).message AS note FROM noted_lineitem")


def _noted(frame: qa.QualityFrame, *keys: str) -> DataFrame:
    shown = frame.to_df().select(*keys, F.inline("annotations")).withColumn("fromFields", F.array_join("fromFields", ","))
    return shown.groupBy(*keys, "message", "onField", "fromFields", "isError").agg(F.sum("count").alias("n"))


@_add("""SELECT 'LARGE' AS message, 'twice' AS "onField", 'l_quantity' AS "fromFields", false AS "isError", count(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05
UNION ALL SELECT 'LARGE', 'plain', 'l_extendedprice', false, count(*) FROM lineitem WHERE l_extendedprice > 30 AND l_discount < 0.05""")
def j3_sql_annotations(spark, sf_dir):
    """Two calls of a rule in a select list, one below another function, behind a filter."""
    _rule(spark, sf_dir, "lineitem")
    return _noted(annotated_sql.sql(spark, "SELECT l_orderkey, sized(l_quantity) * 2 AS twice, sized(l_extendedprice) AS plain FROM noted_lineitem WHERE l_discount < 0.05"))


@_add("""WITH x AS (SELECT o_orderstatus, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS large FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 50000)
SELECT o_orderstatus AS status, 'LARGE' AS message, 'q' AS "onField", 'l_quantity' AS "fromFields", false AS "isError", sum(large)::BIGINT AS n FROM x GROUP BY 1 HAVING sum(large) > 0""")
def j3_sql_plan(spark, sf_dir):
    """Notes through a subquery, a join, a filter and a group."""
    _rule(spark, sf_dir, "lineitem", "orders")
    made = annotated_sql.sql(
        spark,
        """WITH priced AS (SELECT l_orderkey, sized(l_quantity) AS q FROM noted_lineitem)
        SELECT o.o_orderstatus AS status, sum(p.q) AS total FROM noted_orders o JOIN priced p ON o.o_orderkey = p.l_orderkey
        WHERE o.o_totalprice > 50000 GROUP BY o.o_orderstatus HAVING count(*) > 0""",
    )
    return _noted(made, "status")


@_add("""SELECT n_nationkey, 'NAME' AS message, 'pre.n_name' AS "onField", true AS flagged_error, true AS flagged_warning FROM nation""")
def h18_annotation_helpers(spark, sf_dir):
    """A value with a warning, an error without value, and a prefix for their field."""
    warned, failed = qa.from_warning(F.col("n_name"), "NAME"), qa.from_error("string", "GONE")
    both = warned.combine(failed, lambda a, b: F.coalesce(b, a))
    noted = qa.with_prefix(qa.located(both.all_notes(), "n_name", ["n_name"]), "pre.")
    frame = table(spark, sf_dir, "nation").select("n_nationkey", noted.alias("notes"))
    return frame.select("n_nationkey", F.col("notes")[0]["message"].alias("message"), F.col("notes")[0]["onField"].alias("onField"), qa.has_error("notes").alias("flagged_error"), qa.has_warning("notes").alias("flagged_warning"))


# -- effects ----------------------------------------------------------------------------------------------------


@_add("SELECT * FROM (VALUES (0, 'failed', 1.0::DOUBLE), (1, 'rejected', 0.75), (2, 'rejected', 0.375), (3, 'rejected', 0.1875), (4, 'failed', 0.59375), (5, 'rejected', 0.296875)) t(call, outcome, level)")
def i1_circuit_tap(spark, sf_dir):
    """Outcomes and levels of a tap over calls that fail at the first and the fifth."""
    tap, out = fx.CircuitTap(0.3, memory=3), []
    for number in range(6):
        failing = number in (0, 4)
        try:
            tap(lambda f=failing: 1 / 0 if f else 1)
            outcome = "done"
        except fx.Rejected:
            outcome = "rejected"
        except ZeroDivisionError:
            outcome = "failed"
        out.append((number, outcome, tap.level))
    return _rows(spark, out, "call int, outcome string, level double")


@_add("SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.0), (2, 0.75), (3, 0.75), (4, 1.75)) t(call, waited)")
def i7_rate_limit(spark, sf_dir):
    limiter = fx.TaskLimiter(1.0, 2, lambda: 0.25, lambda seconds: None)
    return _rows(spark, [(i, limiter.acquire()) for i in range(5)], "call int, waited double")


@_add("SELECT * FROM (VALUES (0, 'open'), (1, '0'), (2, '1'), (3, '2'), (4, 'close'), (5, 'ValueError')) t(step, what)")
def i3_lazy_iterator(spark, sf_dir):
    """A resource opened at the first item and closed at an error, before it is handed on."""
    log: list[str] = []

    def items(n: int):
        yield from range(n)
        raise ValueError("end")

    managed = fx.from_managed(lambda: log.append("open") or 3, items, lambda r: log.append("close"))
    for item, error in fx.with_last_error(managed):
        log.append(str(item) if error is None else type(error).__name__)
    return _rows(spark, list(enumerate(log)), "step int, what string")


@_add("SELECT 40 AS n, true AS in_order, true AS within_places")
def i5_resized_concurrency(spark, sf_dir):
    """Calls in flight stay within the places, also when these are made fewer."""
    import threading

    level, lock, state = fx.Resizable(4), threading.Lock(), {"busy": 0, "most": 0}

    def call(x: int) -> int:
        with lock:
            state["busy"] += 1
            state["most"] = max(state["most"], state["busy"])
        if x == 10:
            level.resize(2)
        with lock:
            state["busy"] -= 1
        return x

    got = [r for _, r, _ in fx.map_concurrent(range(40), call, 4, True, level)]
    return _rows(spark, [(len(got), got == sorted(got), state["most"] <= 4)], "n int, in_order boolean, within_places boolean")


@_add("SELECT count(*) FILTER (o_orderkey % 50 = 0) AS n_failure, 2 AS passes, count(*) AS n FROM orders")
def d28_retry_summary(spark, sf_dir):
    from rowlattice.queries_core import _doubled_or_failed

    out, execution = fx.retry(table(spark, sf_dir, "orders").select("o_orderkey"), _doubled_or_failed, "bigint", max_passes=2, max_failures_in_a_row=10**9)
    return out.agg(F.count(F.lit(1)).alias("n")).select(F.lit(fx.failure_count(out)).cast("bigint").alias("n_failure"), F.lit(execution.passes).alias("passes"), "n")

