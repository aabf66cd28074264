"""Queries over whole tables for the operators of the toolkit, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.functions import columns as fn
from rowlattice.operators import cogroup as cg
from rowlattice.operators import compare as cmp
from rowlattice.operators import dumps as dp
from rowlattice.operators import keyed_diff as kd
from rowlattice.operators.versions import version_list
from rowlattice.plans import diff_summary as ds
from rowlattice.plans import mapping as mp
from rowlattice.plans import quality as qa
from rowlattice.plans import schema as sc
from rowlattice.queries_general import compact_date
from rowlattice.sources import io
from rowlattice.session import scratch_path
from rowlattice.streaming import effects as fx
from rowlattice.streaming import structured

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(queries: dict[str, Callable], oracles: dict[str, str]) -> Callable:
    """A decorator that registers a query, with the SQL of the same result if there is one."""

    def with_sql(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return with_sql


_add = query(QUERIES, ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- keyed diff of the two copies ---------------------------------------------------

COPY = ["key", "value", "eulav", "amount", "flag", "seen_on", "ts"]

_ORDER = ", ".join(f"{c} NULLS FIRST" for c in COPY[1:])


def _one(side: str) -> str:
    return f"(SELECT {', '.join(COPY)} FROM {side}_test QUALIFY row_number() OVER (PARTITION BY key ORDER BY {_ORDER}) = 1)"


def _same(c: str) -> str:
    nan = f" AND NOT isnan(l.{c})" if c == "amount" else ""
    return f"((l.{c} IS NULL AND r.{c} IS NULL) OR coalesce(l.{c} = r.{c}{nan}, false))"


_SETS = "list_filter([" + ", ".join(f"CASE WHEN NOT {_same(c)} THEN '{c}' END" for c in COPY[1:]) + "], lambda x: x IS NOT NULL)"

_PAIRS = f"""WITH a AS (SELECT *, true AS here FROM {_one('left')}), b AS (SELECT *, true AS here FROM {_one('right')}),
j AS (SELECT l, r, l.here AS lh, r.here AS rh, CASE WHEN l.here AND r.here THEN list_sort({_SETS}) ELSE [] END AS s FROM a l FULL OUTER JOIN b r ON l.key IS NOT DISTINCT FROM r.key),
c AS (SELECT *, CASE WHEN rh IS NULL THEN 'outer_left' WHEN lh IS NULL THEN 'outer_right' WHEN len(s) = 0 THEN 'inner_equal' ELSE 'inner_diff' END AS section, array_to_string(s, ',') AS diff_set FROM j)"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (table(spark, sf_dir, f"{side}_test").select(*COPY) for side in ("left", "right"))
    return kd.classified(kd.paired(left, right, ["key"]))


@_add(f"{_PAIRS} SELECT section, count(*) AS n FROM c GROUP BY 1")
def c1_diff_sections(spark, sf_dir):
    return kd.sections(_classes(spark, sf_dir))


@_add(f"{_PAIRS} SELECT section, count(*) AS n FROM c GROUP BY 1")
def c2_diff_partitioned(spark, sf_dir):
    left, right = (table(spark, sf_dir, f"{side}_test").select(*COPY) for side in ("left", "right"))
    return kd.sections(kd.classified(kd.paired(left, right, ["key"], partitions=16)))


@_add(f"{_PAIRS} SELECT count(*) FILTER (section = 'inner_equal') AS rows_equal, count(*) FILTER (section = 'inner_diff') AS rows_not_equal FROM c")
def d4_inner_counts(spark, sf_dir):
    c = _classes(spark, sf_dir)
    return c.agg(F.count(F.when(F.col("section") == "inner_equal", 1)).alias("rows_equal"), F.count(F.when(F.col("section") == "inner_diff", 1)).alias("rows_not_equal"))


@_add(f"{_PAIRS} SELECT diff_set, count(*) AS n FROM c WHERE section = 'inner_diff' GROUP BY 1")
def d5_diff_sets(spark, sf_dir):
    return kd.diff_sets(_classes(spark, sf_dir))


def _describe_sql(c: str, side: str) -> str:
    x = f"{side}.{c}"
    role = "left" if side == "l" else "right"
    kind = {"value": ("value", f"CAST({x} AS BIGINT)", "NULL", "NULL"), "amount": ("value", "NULL", x, "NULL"), "eulav": ("value", "NULL", "NULL", x), "seen_on": ("date", f"CAST(epoch_ms({x}) AS BIGINT)", "NULL", "NULL"), "ts": ("timestamp", f"CAST(epoch_ms({x}) AS BIGINT)", "NULL", "NULL"), "flag": (None, "NULL", "NULL", "NULL")}[c]
    metric = f"CASE WHEN {x} THEN 'nTrue' ELSE 'nFalse' END" if kind[0] is None else f"'{kind[0]}'"
    return f"SELECT section, diff_set, '{c}' AS \"column\", '{role}' AS role, CASE WHEN {x} IS NULL THEN 'nNull' ELSE {metric} END AS metric, {kind[3]}::VARCHAR AS key_str, NULL::VARCHAR AS key_other, {kind[1]}::BIGINT AS key_long, {kind[2]}::DOUBLE AS key_double FROM c WHERE {side}h"


def _error_sql(c: str) -> str:
    a, b = f"l.{c}", f"r.{c}"
    metric, s, o, n, d = {
        "value": ("'value'", "NULL", "NULL", f"{a}::BIGINT - {b}::BIGINT", "NULL"),
        "amount": ("'value'", "NULL", "NULL", "NULL", f"{a} - {b}"),
        "eulav": ("'from_to'", a, b, "NULL", "NULL"),
        "flag": (f"CASE WHEN {a} THEN 'tf' ELSE 'ft' END", "NULL", "NULL", "NULL", "NULL"),
        "seen_on": ("'date'", "NULL", "NULL", f"epoch_ms({a}) - epoch_ms({b})", "NULL"),
        "ts": ("'timestamp'", "NULL", "NULL", f"epoch_ms({a}) - epoch_ms({b})", "NULL"),
    }[c]
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    keys = ", ".join(f"CASE WHEN {both} THEN {x} END::{t} AS {k}" for x, t, k in ((s, "VARCHAR", "key_str"), (o, "VARCHAR", "key_other"), (n, "BIGINT", "key_long"), (d, "DOUBLE", "key_double")))
    return f"SELECT section, diff_set, '{c}', 'error', CASE WHEN {a} IS NULL THEN 'rightToNull' WHEN {b} IS NULL THEN 'leftToNull' ELSE {metric} END, {keys} FROM c WHERE list_contains(s, '{c}')"


def _pair_sql(c: str) -> str:
    return f"SELECT section, diff_set, '{c}', 'pair', CASE WHEN list_contains(s, '{c}') THEN 'nNotEqual' ELSE 'nEqual' END, NULL, NULL, NULL, NULL FROM c WHERE section LIKE 'inner%'"


_FACTS = " UNION ALL ".join(x for c in COPY[1:] for x in (_describe_sql(c, "l"), _describe_sql(c, "r"), _error_sql(c), _pair_sql(c)))
_STATS = f"{_PAIRS}, facts AS ({_FACTS}), stats AS (SELECT section, diff_set, \"column\", role, metric, key_str, key_other, key_long, key_double, count(*) AS n FROM facts GROUP BY ALL)"


def _readable(stats: DataFrame) -> DataFrame:
    """NaN as a text of its own, so that results can be compared anywhere."""
    return stats.withColumn("key_str", F.when(F.isnan("key_double"), "NaN").otherwise(F.col("key_str"))).withColumn("key_double", F.when(F.isnan("key_double"), None).otherwise(F.col("key_double") + F.lit(0.0)))


_READABLE = "* REPLACE (CASE WHEN isnan(key_double) THEN 'NaN' ELSE key_str END AS key_str, CASE WHEN isnan(key_double) THEN NULL ELSE key_double + 0.0 END AS key_double)"


@_add(f"{_STATS} SELECT {_READABLE} FROM stats")
def d2_diff_statistics(spark, sf_dir):
    return _readable(kd.statistics(_classes(spark, sf_dir)))


@_add(f"{_STATS} SELECT {_READABLE} FROM stats WHERE section LIKE 'outer%'")
def d3_outer_statistics(spark, sf_dir):
    outer = _classes(spark, sf_dir).where(F.col("section").startswith("outer"))
    return _readable(kd.statistics(outer, roles=("left", "right")))


@_add(f'{_STATS} SELECT "column", metric, sum(n)::BIGINT AS n FROM stats WHERE role = \'pair\' GROUP BY 1, 2')
def d6_column_deltas(spark, sf_dir):
    return kd.column_deltas(_classes(spark, sf_dir))


@_add(f"{_STATS} SELECT {_READABLE} FROM stats WHERE role = 'error'")
def d7_errors(spark, sf_dir):
    return _readable(kd.statistics(_classes(spark, sf_dir), roles=("error",)))


@_add(f"""{_PAIRS} SELECT 'flag' AS "column", count(*) FILTER (l.flag AND r.flag) AS tt, count(*) FILTER (l.flag AND NOT r.flag) AS tf,
count(*) FILTER (NOT l.flag AND r.flag) AS ft, count(*) FILTER (NOT l.flag AND NOT r.flag) AS ff FROM c WHERE section LIKE 'inner%'""")
def d8_confusion(spark, sf_dir):
    return kd.confusion(_classes(spark, sf_dir))


@_add(f"{_STATS}, m AS (SELECT \"column\", role, metric, key_str, key_other, key_long, key_double, sum(n)::BIGINT AS n FROM stats WHERE section LIKE 'inner%' GROUP BY ALL) SELECT {_READABLE} FROM m")
def d9_by_column(spark, sf_dir):
    return _readable(kd.by_column(kd.statistics(_classes(spark, sf_dir))))


@_add("SELECT value, count(*) AS n FROM left_test GROUP BY 1")
def d10_exact_histogram(spark, sf_dir):
    return kd.value_counts(table(spark, sf_dir, "left_test"), "value")


@_add("""WITH s AS (SELECT c_acctbal AS x, pow(2.0, floor(log2(greatest(abs(c_acctbal), 1e-300))) - 6) AS step FROM customer)
SELECT CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * floor(abs(x) / step) * step END AS bucket, count(*) AS n FROM s GROUP BY 1""")
def d11_bounded_histogram(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(kd.bucket_floor(F.col("c_acctbal")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_add("""WITH e AS (SELECT min(p_size) AS low, greatest((max(p_size) - min(p_size)) / 5.0, 1.0) AS step FROM part), b AS (SELECT unnest(range(6)) AS bin),
c AS (SELECT greatest(0, ceil((p_size - low) / step - 0.5))::INT AS bin, count(*) AS n FROM part, e GROUP BY 1)
SELECT b.bin::INT AS bin, low + b.bin * step AS centre, coalesce(n, 0) AS n FROM b CROSS JOIN e LEFT JOIN c USING (bin)""")
def d12_bins(spark, sf_dir):
    return kd.bins(table(spark, sf_dir, "part"), "p_size", 6, 1.0)


@_add("""WITH s AS (SELECT p_size AS x, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM part), q AS (SELECT unnest([0.0, 0.25, 0.5, 0.9, 1.0]) AS p)
SELECT p::DOUBLE AS p, x::DOUBLE AS low, x::DOUBLE AS high FROM q JOIN s ON i = least(floor(p * n), n - 1)""")
def d13_quantile_bounds(spark, sf_dir):
    histogram = ds.describe_column(table(spark, sf_dir, "part"), "p_size").histograms["value"]
    return spark.createDataFrame([(p, *map(float, histogram.quantile_bounds(p))) for p in (0.0, 0.25, 0.5, 0.9, 1.0)], "p double, low double, high double")


@_add("""WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), q AS (SELECT unnest([0.0, 0.25, 0.5, 0.9, 1.0]) AS p)
SELECT p::DOUBLE AS p, true AS inside, true AS narrow FROM q JOIN s ON i = least(floor(p * n), n - 1)""")
def d13_large_quantile_bounds(spark, sf_dir):
    """Of very many distinct numbers: the bounds hold the quantile and are a bucket apart."""
    orders = table(spark, sf_dir, "orders")
    histogram = ds.describe_column(orders, "o_totalprice").histograms["value"]
    bounds = [(p, *map(float, histogram.quantile_bounds(p))) for p in (0.0, 0.25, 0.5, 0.9, 1.0)]
    # below a bound are at most as many rows as the quantile has before it, up to the other more
    counts = [[F.count_if(F.col("o_totalprice") < low).alias(f"a{i}"), F.count_if(F.col("o_totalprice") <= high).alias(f"b{i}")] for i, (_, low, high) in enumerate(bounds)]
    found = orders.agg(F.count("o_totalprice").alias("n"), *[c for pair in counts for c in pair])
    rank = [F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1) for p, _, _ in bounds]
    rows = [F.struct(F.lit(p).alias("p"), ((F.col(f"a{i}") <= rank[i]) & (F.col(f"b{i}") > rank[i])).alias("inside"), F.lit(high - low <= low / 32).alias("narrow")) for i, (p, low, high) in enumerate(bounds)]
    return found.select(F.inline(F.array(*rows)))


@_add("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def d14_frequency_enum(spark, sf_dir):
    enum = ds.describe_column(table(spark, sf_dir, "customer"), "c_mktsegment").enums["value"]
    return spark.createDataFrame(enum.heavy_hitters(), "c_mktsegment string, n bigint")


@_add("""WITH c AS (SELECT str, count(*) AS n FROM enum_rows WHERE str IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, str) AS place, sum(n) OVER () AS total, count(*) OVER () AS kinds FROM c)
SELECT str, n, total::BIGINT AS total, (kinds - 256)::BIGINT AS rest_keys, true AS estimates_hold FROM r WHERE place <= 256""")
def d15_approximate_enum(spark, sf_dir):
    """The 256 most frequent strings, exactly; of all others the total, their number and a sketch."""
    rows = table(spark, sf_dir, "enum_rows")
    enum = ds.describe_column(rows, "str").enums["value"]
    kept = spark.createDataFrame(enum.heavy_hitters(), "str string, n bigint")
    # no estimate is below the count, and with the sketch's chance none above it by a thousandth of the rows not kept
    counted = ds.estimates(kd.value_counts(rows.where("str IS NOT NULL"), "str"), "value", enum)
    hold = counted.agg(F.bool_and((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + enum.rest // 1000 + 1)).alias("estimates_hold"))
    return kept.select("str", "n", F.lit(enum.total).cast("bigint").alias("total"), F.lit(enum.rest_keys).cast("bigint").alias("rest_keys"), F.lit(hold.first()[0]).alias("estimates_hold"))


@_add(f"""{_STATS} SELECT section, diff_set, "column", role, metric, sum(n)::BIGINT AS n, count(*) > 256 AS is_large FROM stats GROUP BY 1, 2, 3, 4, 5""")
def d16_bounded_totals(spark, sf_dir):
    """Bounding the statistics loses no row of any group."""
    bound = kd.bounded(_readable(kd.statistics(_classes(spark, sf_dir))))
    return bound.groupBy(*kd.GROUP).agg(F.sum("n").alias("n"), F.bool_or("is_large").alias("is_large"))


@_add()
def d16_bounded_statistics(spark, sf_dir):
    return kd.bounded(_readable(kd.statistics(_classes(spark, sf_dir))))


@_add(f"{_PAIRS} SELECT diff_set, count(*) AS n, true AS inside, true AS few, sum(count(*)) OVER ()::BIGINT AS merged_total FROM c WHERE section = 'inner_diff' GROUP BY 1")
def d17_compacted_sets(spark, sf_dir):
    """Each set once, inside the union it was merged into, and what the unions add up to."""
    counted = {frozenset(r["diff_set"].split(",")): r["n"] for r in kd.diff_sets(_classes(spark, sf_dir)).collect()}  # at most 63 sets of 6 columns
    merged = ds.compact_sets({s: (n, [s]) for s, n in counted.items()}, 8, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    rows = [(",".join(sorted(s)), counted[s], s <= union, len(merged) <= 8, sum(n for n, _ in merged.values())) for union, (_, members) in merged.items() for s in members]
    return spark.createDataFrame(rows, "diff_set string, n bigint, inside boolean, few boolean, merged_total bigint")


@_add()
def d17_merged_sets(spark, sf_dir):
    """Each merged set with its rows and the sets merged into it."""
    sets = {frozenset(r["diff_set"].split(",")): r["n"] for r in kd.diff_sets(_classes(spark, sf_dir)).collect()}
    merged = ds.compact_sets({s: (n, [s]) for s, n in sets.items()}, 8, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    rows = [(",".join(sorted(u)), n, sorted(",".join(sorted(s)) for s in members)) for u, (n, members) in merged.items()]
    return spark.createDataFrame(rows, "diff_set string, n bigint, members array<string>")


@_add(f"""{_PAIRS}, k AS (SELECT count(*) FILTER (section LIKE 'outer%') AS o, count(*) FILTER (section = 'inner_diff') AS d, count(*) FILTER (list_contains(s, 'flag')) AS f, count(*) FILTER (list_contains(s, 'value')) AS v FROM c)
SELECT 'no_outer' AS demand, o = 0 AS holds FROM k UNION ALL SELECT 'no_inner', d = 0 FROM k UNION ALL SELECT 'is_similar', o = 0 AND d = 0 FROM k UNION ALL SELECT 'column_changes(flag, value)', f > 0 AND v > 0 FROM k UNION ALL SELECT 'column_keeps(value)', v = 0 FROM k""")
def k6_constraints(spark, sf_dir):
    summary = ds.summarise(_classes(spark, sf_dir))
    demands = [ds.no_outer(), ds.no_inner(), ds.is_similar(), ds.column_changes("flag", "value"), ds.column_keeps("value")]
    failed = {c.name for c in ds.check(summary, *demands).failed}
    return spark.createDataFrame([(c.name, c.name not in failed) for c in demands], "demand string, holds boolean")


@_add(f"""{_PAIRS} SELECT CASE section WHEN 'inner_diff' THEN diff_set ELSE section END AS part, count(*) AS n FROM c GROUP BY 1""")
def m8_summary_round_trip(spark, sf_dir):
    """Rows of each part and set of differing columns, as the JSON has them that was read and written again."""
    whole = json.loads(ds.to_json(ds.from_json(ds.to_json(ds.summarise(_classes(spark, sf_dir), coarse=True)))))["result"]
    rows = [("inner_equal", whole["inner"]["countRowEqual"]), ("outer_left", whole["outer"]["left"]["count"]), ("outer_right", whole["outer"]["right"]["count"])]
    rows += [(",".join(x["key"]), x["value"]["count"]) for x in whole["inner"]["countDeltaByRow"]]
    return spark.createDataFrame([r for r in rows if r[1]], "part string, n bigint")


@_add(f'{_STATS} SELECT "column", role, sum(n)::BIGINT AS n FROM stats WHERE section LIKE \'inner%\' GROUP BY 1, 2')
def m8_summary_counts(spark, sf_dir):
    """Values counted by the summary, after a round trip through JSON."""
    summary = ds.from_json(ds.to_json(ds.summarise(_classes(spark, sf_dir), coarse=True)))
    rows = [(c, role, n) for c, d in summary.by_column.items() for role, n in (("left", d.left.count), ("right", d.right.count), ("error", d.error.count), ("pair", d.n_equal + d.n_not_equal)) if n]
    return spark.createDataFrame(rows, "column string, role string, n bigint")


@_add()
def m7_report(spark, sf_dir):
    lines = ds.render(ds.summarise(_classes(spark, sf_dir))).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


# -- dumps ---------------------------------------------------------------------------------


def _dumps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """All lines, and the column that names their dump; lines without a readable date are in none."""
    return table(spark, sf_dir, "dump_lines").select("id", "a", "b", compact_date(F.col("compressdumpdt")).alias("d")), "d"


def _dumps_apart(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines, name = _dumps(spark, sf_dir)
    return {d: lines.where(F.col(name) == d).drop(name) for d in version_list(lines, name)}


_LINES = r"""WITH lines AS (SELECT id, a, b, replace(replace(regexp_extract(compressdumpdt, '(\d{4}[-/]?\d{2}[-/]?\d{2})', 1), '-', ''), '/', '') AS d FROM dump_lines),
flat AS (SELECT id, a, b, array_to_string(list_sort(list(DISTINCT d)), ',') AS dumps FROM lines GROUP BY 1, 2, 3)"""


@_add(f"{_LINES} SELECT id, a, b, dumps FROM flat")
def d18_compress(spark, sf_dir):
    packed = dp.compress(_dumps(spark, sf_dir), ["id"], ordered=False)
    return packed.select("id", F.inline("xs")).select("id", "a", "b", F.array_join(dp.DUMPS, ",").alias("dumps"))


@_add(f"{_LINES} SELECT id % 7 AS grp, id, a, b, dumps FROM flat")
def d19_compress_by_expression(spark, sf_dir):
    packed = dp.compress_by(_dumps(spark, sf_dir), "id % 7", "grp")
    return packed.select("grp", F.inline("xs")).select("grp", "id", "a", "b", F.array_join(dp.DUMPS, ",").alias("dumps"))


@_add(f"{_LINES} SELECT id, a, b, dumps FROM flat")
def d20_compress_flat(spark, sf_dir):
    return dp.compress_flat(_dumps(spark, sf_dir)).select("id", "a", "b", F.array_join("dump_date", ",").alias("dumps"))


@_add(f"{_LINES} SELECT id, a, b, dumps FROM flat")
def d21_compress_grouped(spark, sf_dir):
    packed = dp.compress_grouped(_dumps(spark, sf_dir), ["id"])
    return packed.select("id", F.inline("rest")).select("id", "a", "b", F.array_join("dump_date", ",").alias("dumps"))


@_add(f"{_LINES}, x AS (SELECT DISTINCT * FROM lines), p AS (SELECT id, d AS dump, count(*) AS n_lines FROM x GROUP BY 1, 2) SELECT dump, n_lines, count(*) AS n_keys FROM p GROUP BY 1, 2")
def d23_line_frequency(spark, sf_dir):
    return dp.line_frequency(dp.compress(_dumps(spark, sf_dir), ["id"], ordered=False), ["id"])


def _different(condition: str) -> str:
    return f"""WITH u AS (SELECT key, value, eulav, 1 AS l, 0 AS r FROM left_test UNION ALL SELECT key, value, eulav, 0, 1 FROM right_test),
c AS (SELECT key, value, eulav, sum(l)::BIGINT AS "nbLeft", sum(r)::BIGINT AS "nbRight" FROM u GROUP BY 1, 2, 3) SELECT * FROM c WHERE {condition}"""


@_add(_different('NOT ("nbLeft" = 1 AND "nbRight" = 1)'))
def d24_different_lines(spark, sf_dir):
    return dp.different_lines(*(table(spark, sf_dir, f"{side}_test").select("key", "value", "eulav") for side in ("left", "right")))


@_add(_different('NOT ("nbLeft" = 1 AND "nbRight" = 1) AND "nbLeft" + "nbRight" <> 1'))
def d24_different_lines_legacy(spark, sf_dir):
    return dp.different_lines(*(table(spark, sf_dir, f"{side}_test").select("key", "value", "eulav") for side in ("left", "right")), legacy=True)


_VIEW = f"""{_LINES}, x AS (SELECT id, a, b, min(d) AS "minDt", max(d) AS "maxDt" FROM lines GROUP BY 1, 2, 3),
g AS (SELECT *, lag("minDt") OVER w AS "minDt_prev", lag("maxDt") OVER w AS "maxDt_prev", lag(a) OVER w AS a_prev, lag(b) OVER w AS b_prev FROM x
WINDOW w AS (PARTITION BY id ORDER BY "minDt", "maxDt", a NULLS FIRST, b NULLS FIRST))
SELECT id, "minDt", "maxDt", "minDt_prev", "maxDt_prev", "minDt_prev" IS NULL AS "isInit", "minDt_prev" IS NOT NULL AND a IS DISTINCT FROM a_prev AS "a_hasChanged", a, a_prev,
"minDt_prev" IS NOT NULL AND b IS DISTINCT FROM b_prev AS "b_hasChanged", b, b_prev FROM g"""


@_add(_VIEW)
def e1_history_view(spark, sf_dir):
    return dp.history_view(dp.compress(_dumps(spark, sf_dir), ["id"], ordered=False))


@_add(_VIEW)
def e1_history_view_sql(spark, sf_dir):
    packed = dp.compress(_dumps(spark, sf_dir), ["id"], ordered=False)
    packed.createOrReplaceTempView("packed_dumps")
    return spark.sql(dp.history_view_sql(packed.schema, "packed_dumps"))


@_add(f"{_LINES} SELECT id, count(*) AS n_versions FROM flat GROUP BY 1 HAVING count(*) > 1")
def b25_changed_rows(spark, sf_dir):
    changed = dp.changed_rows(dp.compress(_dumps(spark, sf_dir), ["id"], ordered=False))
    return changed.select("id", F.size("xs").cast("bigint").alias("n_versions"))


@_add("SELECT id, array_to_string(list_sort(list(DISTINCT d)), ',') AS dumps FROM (SELECT id, unnest(x.compressdumpdts) AS d FROM (SELECT id, unnest(xs) AS x FROM compressed_dumps)) GROUP BY 1")
def c13_nested_rows(spark, sf_dir):
    lines = dp.unpacked(table(spark, sf_dir, "compressed_dumps"), "xs", "compressdumpdts")
    return lines.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("dump")), ",").alias("dumps"))


@_add(f"{_LINES} SELECT id, a, b, d AS dump FROM (SELECT DISTINCT * FROM lines)")
def c13_unpacked_dumps(spark, sf_dir):
    """Compacted and taken apart again: each line once in each of its dumps."""
    return dp.unpacked(dp.compress(_dumps(spark, sf_dir), ["id"], ordered=False))


@_add(f"{_LINES} SELECT id, a, b, dumps FROM flat")
def g3_dumps_by_name(spark, sf_dir):
    """Dumps given one by one, matched by the names of their columns."""
    apart = {d: f.select(*(["b", "id", "a"] if i % 2 else ["id", "a", "b"])) for i, (d, f) in enumerate(_dumps_apart(spark, sf_dir).items())}
    return dp.compress_flat(apart).select("id", "a", "b", F.array_join("dump_date", ",").alias("dumps"))


# -- co-grouping and comparison ---------------------------------------------------------------


@_add("""WITH o AS (SELECT o_custkey AS k, list_sort(list(o_orderkey)) AS x FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(c_name, '') AS names, coalesce(array_to_string(x, ','), '') AS orders FROM customer FULL JOIN o ON c_custkey = k""")
def c3_cogroup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    both = cg.cogroup({"customers": (customers, ["c_custkey"]), "placed": (orders, ["o_custkey"])})
    return both.select("c_custkey", F.array_join("customers.c_name", ",").alias("names"), F.array_join("placed.o_orderkey", ",").alias("orders"))


@_add("""WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey, c_nationkey, coalesce(n, 0)::BIGINT AS n_orders, top AS top_price FROM customer LEFT JOIN o ON c_custkey = k""")
def c4_nest(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    nested = cg.nest(customers, "c_custkey", {"placed": orders})
    return nested.select("c_custkey", "c_nationkey", F.size("placed").cast("bigint").alias("n_orders"), F.array_max("placed.o_totalprice").alias("top_price"))


@_add("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT n_nationkey, 1::BIGINT AS n_nations, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def c5_cogroup_many(spark, sf_dir):
    grouped = cg.cogroup({"nations": (table(spark, sf_dir, "nation"), ["n_nationkey"]), "customers": (table(spark, sf_dir, "customer"), ["c_nationkey"]), "suppliers": (table(spark, sf_dir, "supplier"), ["s_nationkey"])})
    return grouped.select("n_nationkey", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("nations", "customers", "suppliers")])


@_add("""WITH k AS (SELECT n_nationkey AS k, 1 AS n, 0 AS c, 0 AS s FROM nation UNION ALL SELECT c_nationkey, 0, 1, 0 FROM customer UNION ALL SELECT s_nationkey, 0, 0, 1 FROM supplier)
SELECT k AS n_nationkey, sum(n)::BIGINT AS nations, sum(c)::BIGINT AS customers, sum(s)::BIGINT AS suppliers FROM k GROUP BY 1""")
def c5_group_sizes(spark, sf_dir):
    return cg.group_sizes({"nations": (table(spark, sf_dir, "nation"), ["n_nationkey"]), "customers": (table(spark, sf_dir, "customer"), ["c_nationkey"]), "suppliers": (table(spark, sf_dir, "supplier"), ["s_nationkey"])})


@_add("""WITH a AS (SELECT key AS k, sum(value)::DOUBLE AS x FROM left_test GROUP BY 1), b AS (SELECT key AS k, sum(value)::DOUBLE AS y FROM right_test GROUP BY 1),
j AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y, a.k IS NOT NULL OR (a.k IS NULL AND b.k IS NULL) AS l, b.k IS NOT NULL OR (a.k IS NULL AND b.k IS NULL) AS r FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k)
SELECT 'value' AS measure, coalesce(sum(x) FILTER (l AND NOT r), 0) AS left_only, coalesce(sum(y) FILTER (r AND NOT l), 0) AS right_only, coalesce(sum(x) FILTER (l AND r), 0) AS left_common, coalesce(sum(y) FILTER (l AND r), 0) AS right_common,
coalesce(sum(y - x) FILTER (l AND r), 0) AS diff, coalesce(sum((y - x) * (y - x)) FILTER (l AND r), 0) AS diff2, count(*) FILTER (l AND NOT r) AS n_left, count(*) FILTER (r AND NOT l) AS n_right, count(*) FILTER (l AND r) AS n_common, count(*) FILTER (l AND r AND x = y) AS n_zero FROM j""")
def c7_measures(spark, sf_dir):
    return cg.compare_measures(table(spark, sf_dir, "left_test"), table(spark, sf_dir, "right_test"), ["key"], ["value"])


@_add("""WITH u AS (SELECT key, value, 1 AS l, 0 AS r FROM left_test UNION ALL SELECT key, value, 0, 1 FROM right_test)
SELECT key, value, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right FROM u GROUP BY 1, 2 HAVING sum(l) <> sum(r)""")
def c8_multiset_differences(spark, sf_dir):
    return cmp.multiset_differences(*(table(spark, sf_dir, f"{side}_test").select("key", "value") for side in ("left", "right")))


@_add("""WITH a AS (SELECT key, value, row_number() OVER (ORDER BY key NULLS FIRST, value NULLS FIRST) - 1 AS i FROM left_test), b AS (SELECT key, value, row_number() OVER (ORDER BY key NULLS FIRST, value NULLS FIRST) - 1 AS i FROM right_test)
SELECT coalesce(a.i, b.i) AS row_index, a.key AS left_key, a.value AS left_value, b.key AS right_key, b.value AS right_value FROM a FULL JOIN b USING (i)
WHERE a.i IS NULL OR b.i IS NULL OR a.key IS DISTINCT FROM b.key OR a.value IS DISTINCT FROM b.value""")
def c9_ordered_differences(spark, sf_dir):
    found = cmp.ordered_differences(*(table(spark, sf_dir, f"{side}_test").select("key", "value") for side in ("left", "right")), order=["key", "value"])
    return found.select("row_index", F.col("left.key").alias("left_key"), F.col("left.value").alias("left_value"), F.col("right.key").alias("right_key"), F.col("right.value").alias("right_value"))


@_add(f"""{_PAIRS}, x AS (SELECT r.key AS key, unnest(list_filter([
CASE WHEN coalesce(abs(l.amount - r.amount) > 0.01 OR isnan(l.amount) OR isnan(r.amount), (l.amount IS NULL) <> (r.amount IS NULL)) THEN 'amount' END,
CASE WHEN l.value IS DISTINCT FROM r.value THEN 'value' END], lambda y: y IS NOT NULL)) AS "column" FROM c WHERE section LIKE 'inner%') SELECT * FROM x""")
def m2_approx_differences(spark, sf_dir):
    sides = []
    for side in ("left", "right"):
        one = kd.one_per_key(table(spark, sf_dir, f"{side}_test").select(*COPY), ["key"], "r")
        sides.append(one.select("key", "r.amount", "r.value"))
    return cmp.approx_differences(*sides, ["key"], 0.01)


@_add("SELECT DISTINCT key, value FROM left_test l WHERE NOT EXISTS (SELECT 1 FROM right_test r WHERE r.key IS NOT DISTINCT FROM l.key AND r.value IS NOT DISTINCT FROM l.value)")
def b20_missing_values(spark, sf_dir):
    return cmp.missing_values(*(table(spark, sf_dir, f"{side}_test").select("key", "value") for side in ("right", "left")))


@_add("SELECT count(*) AS n FROM lineitem WHERE l_discount IS DISTINCT FROM l_tax")
def b24_columns_differ(spark, sf_dir):
    return cmp.columns_differ(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n"))


@_add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity < 45)")
def b18_violations(spark, sf_dir):
    return cmp.violations(table(spark, sf_dir, "lineitem"), "l_quantity < 45").select("l_orderkey", "l_linenumber", "l_quantity")


@_add("SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
def b23_order_columns(spark, sf_dir):
    return cmp.order_columns(table(spark, sf_dir, "customer"))


@_add("SELECT n_nationkey, n_name FROM nation")
def b21_aligned_columns(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    with cmp.using(fail_on_missing_original=False, fail_on_missing_expected=False, fail_on_changed_type=False):
        return cmp.align(nation, nation.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.lit(1).alias("other")))[0].select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@_add("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def e2_row_index(spark, sf_dir):
    return cg.indexed(table(spark, sf_dir, "orders").select("o_orderkey"), order=["o_orderkey"])


# -- columns -------------------------------------------------------------------------------------


@_add("SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def b13_coalesce_duplicates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return fn.coalesce_duplicates(orders.join(customers, orders["k"] == customers["k"]))


@_add("SELECT n_nationkey, n_regionkey AS key_0, n_name, r_regionkey AS key_1, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def b14_rename_duplicates(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("key"), "n_name")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "key")
    return fn.rename_duplicates(nation.join(region, nation["key"] == region["key"]))


@_add("SELECT r_regionkey AS id, r_name FROM region")
def b15_move(spark, sf_dir):
    return fn.move(table(spark, sf_dir, "region"), "r_regionkey", "id")


@_add("SELECT id, upper(x.a) AS a, x.b + 1 AS b FROM (SELECT id, unnest(xs) AS x FROM compressed_dumps)")
def b17_lens(spark, sf_dir):
    packed = table(spark, sf_dir, "compressed_dumps")
    changed = fn.lens(packed, lambda path, kind: path in ("xs/[]/a", "xs/[]/b"), lambda c, kind: F.upper(c) if isinstance(kind, T.StringType) else c + 1)
    return changed.select("id", F.inline("xs")).select("id", "a", "b")


@_add("SELECT id, count(*) AS n FROM (SELECT id, unnest(xs) AS x FROM compressed_dumps) WHERE x.b > 100 GROUP BY 1")
def h9_array_functions(spark, sf_dir):
    packed = table(spark, sf_dir, "compressed_dumps")
    kept = packed.withColumn("xs", fn.filter_array("xs", lambda x: x["b"] > 100))
    flat = kept.select("id", F.explode(fn.flat_map_array("xs", lambda x: F.array(x["a"]))).alias("a"))
    return flat.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _pairs_sql(c: str) -> str:
    return f"flatten(list_transform(string_split_regex({c}, '\\s'), lambda w: CASE WHEN length(w) = 0 THEN []::VARCHAR[] WHEN length(w) = 1 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) END))"


@_add(f"""WITH p AS (SELECT p_partkey, p_name AS a, p_type AS b, {_pairs_sql('p_name')} AS x, {_pairs_sql('p_type')} AS y FROM part),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda e: least(len(list_filter(x, lambda z: z = e)), len(list_filter(y, lambda z: z = e))))), 0) AS shared FROM p)
SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN len(x) + len(y) = 0 THEN 0.0 ELSE 2.0::DOUBLE * shared::DOUBLE / (len(x) + len(y))::DOUBLE END::DOUBLE AS similarity FROM s""")
def h10_dice_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.dice_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@_add("SELECT p_partkey, levenshtein(p_name, p_brand)::INT AS distance FROM part")
def h12_levenshtein(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.byte_levenshtein(F.col("p_name").cast("binary"), F.col("p_brand").cast("binary")).alias("distance"))


@_add("""WITH x AS (SELECT id, x.a AS a, x.b AS b FROM (SELECT id, unnest(xs) AS x FROM compressed_dumps)), e AS (SELECT id, unnest([{'k': 'id', 'v': id::VARCHAR}, {'k': 'line.first_name', 'v': a}, {'k': 'line.b', 'v': b::VARCHAR}]) AS e FROM x)
SELECT e.k AS k, e.v AS v, count(*) AS n FROM e WHERE e.v IS NOT NULL GROUP BY 1, 2""")
def h13_to_map(spark, sf_dir):
    lines = table(spark, sf_dir, "compressed_dumps").select("id", F.inline("xs")).select("id", F.struct(F.col("a").alias("firstName"), "b").alias("line"))
    return lines.select(F.explode(fn.to_map(lines)).alias("k", "v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))


@_add("SELECT c_custkey, c_name, NULL::INT AS missing FROM customer")
def h14_from_map(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    kind = T._parse_datatype_string("c_custkey bigint, c_name string, missing int")
    return customers.select(fn.from_map(fn.to_map(customers), kind).alias("r")).select("r.*")


@_add(r"SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, '(.)([A-Z])', '\1_\2', 'g'), '([^_])([A-Z])', '\1_\2', 'g')) AS snake FROM customer")
def h15_snake_case(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fn.snake_case_column(F.col("c_name")).alias("snake"))


@_add("SELECT o_orderkey::VARCHAR || '§' || coalesce(o_orderstatus, 'null') AS k FROM orders")
def h16_joined_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(fn.joined_key("o_orderkey", "o_orderstatus").alias("k"))


@_add("SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS millis FROM events")
def h17_to_timestamp(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return events.select("event_id", F.unix_millis(fn.to_timestamp(events, "ts")).alias("millis"))


# -- mapping language ---------------------------------------------------------------------------------


@_add("""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS status, o_orderkey::VARCHAR AS text, left(o_orderpriority, 1) AS priority, length(o_orderpriority)::INT AS size FROM orders WHERE o_totalprice > 1000""")
def b1_record(spark, sf_dir):
    status = mp.field("o_orderstatus").case_when(("F", "done"), ("O", "open"), otherwise="other")
    q = mp.record(id=mp.field("o_orderkey"), status=status, text=mp.field("o_orderkey").as_("string"), priority=mp.field("o_orderpriority").left(1), size=mp.field("o_orderpriority").size())
    return mp.run(table(spark, sf_dir, "orders"), q.where(mp.field("o_totalprice").map(lambda x: x > 1000)))


@_add("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer")
def b2_merged_record(spark, sf_dir):
    a = mp.record(id=mp.field("c_custkey"), name=mp.field("c_mktsegment"))
    return mp.run(table(spark, sf_dir, "customer"), a.merge(mp.record(name=mp.field("c_name"), nation=mp.field("c_nationkey"))))


@_add("""SELECT row_id, TRY_CAST(CASE WHEN regexp_full_match(str, '[+-]?\\d+') THEN str END AS INTEGER) AS whole, CASE str WHEN 'true' THEN true WHEN 'false' THEN false END AS truth, str IS NULL OR str = '' AS empty, coalesce(str, colname) AS first_of, CASE WHEN str = '' THEN NULL ELSE str END AS kept,
NULL::DOUBLE AS never FROM enum_rows""".replace("\\\\", "\\"))
def b5_casts_and_defaults(spark, sf_dir):
    s = mp.field("str")
    q = mp.record(row_id=mp.field("row_id"), whole=s.as_("int"), truth=s.as_("boolean"), empty=s.is_empty(), first_of=s.or_else(mp.field("colname")), kept=s.remove(""), never=s.as_("double"))
    return mp.run(table(spark, sf_dir, "enum_rows"), q)


@_add("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' ELSE 'more' END AS size_name, 'never' AS strict, (p_size > 10 AND p_retailprice > 1000) AS both_large FROM part""")
def b7_value_switch(spark, sf_dir):
    large = mp.field("p_size").map(lambda x: x > 10).and_(mp.field("p_retailprice").map(lambda x: x > 1000))
    q = mp.record(p_partkey=mp.field("p_partkey"), size_name=mp.field("p_size").case_when((1, "one"), otherwise="more"), strict=mp.field("p_size").case_when(("1", "text"), otherwise="never"), both_large=large)
    return mp.run(table(spark, sf_dir, "part"), q)


@_add("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def g1_query_union(spark, sf_dir):
    base = mp.record(id=mp.field("o_orderkey"), price=mp.field("o_totalprice"))
    q = base.where(mp.field("o_orderstatus").case_when(("F", True), otherwise=False)).union(base.where(mp.field("o_totalprice").map(lambda x: x > 100_000)))
    return mp.run(table(spark, sf_dir, "orders"), q)


@_add("""SELECT o_orderkey AS id, strftime(o_orderdate::DATE + 1, '%Y-%m-%d') AS next_day, strftime(o_orderdate::DATE + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, strftime(o_orderdate::DATE + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year,
date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS days FROM orders""")
def h3_dates(spark, sf_dir):
    day = mp.field("o_orderdate")
    q = mp.record(id=mp.field("o_orderkey"), next_day=day.date_add("day", 1), next_month=day.date_add("month", 1), next_year=day.date_add("year", 1), days=day.date_diff("day", "2000-01-01"))
    return mp.run(table(spark, sf_dir, "orders"), q)


@_add("SELECT c_custkey, array_to_string(list_reverse([c_name, c_mktsegment]), '/') AS joined, c_name AS first_one, c_mktsegment AS last_one, 2 AS size, c_nationkey % 3 AS rest FROM customer")
def h6_elements_and_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("names", F.array("c_name", "c_mktsegment"))
    names = mp.field("names")
    q = mp.record(c_custkey=mp.field("c_custkey"), joined=names.map(lambda a: F.array_join(F.reverse(a), "/")), first_one=names.first_element(), last_one=names.last_element(), size=names.size(), rest=mp.field("c_nationkey").with_(3).map(lambda a, b: a % b))
    return mp.run(rows, q)


@_add("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def b4_nested_field(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return mp.run(events, mp.record(event_id=mp.field("event_id"), k=mp.field("props.k")))


@_add("""SELECT '{"c":' || json_extract(props, '$.k')::BIGINT || '}' AS value FROM events""")
def a16_json_records(spark, sf_dir):
    return mp.run_json(table(spark, sf_dir, "events"), "props", "k bigint", mp.record(c=mp.field("k")))


@_add("SELECT path, level FROM (VALUES ('o_orderstatus', 1), ('o_custkey', 2)) t(path, level)")
def n2_sources(spark, sf_dir):
    found = mp.sources(mp.field("o_orderstatus").case_when(("F", mp.field("o_custkey"))))
    return spark.createDataFrame([(path, i) for i, path in enumerate(found, 1)], "path string, level int")


@_add("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0,1,2,3' WHEN 'O' THEN '0,1,2,4,5' ELSE '0,1,2,4,6' END AS used FROM orders")
def n4_used_parts(spark, sf_dir):
    """0 is the switch, 1 its field, 2 and 3 the first case, 4 and 5 the second, 6 the default."""
    e = mp.field("o_orderstatus").case_when(("F", "done"), ("O", "open"), otherwise="other")
    return mp.traced(table(spark, sf_dir, "orders"), e).select("o_orderkey", F.array_join("used", ",").alias("used"))


@_add("""WITH n AS (SELECT unnest(list_filter([CASE WHEN value IS NULL THEN 'missing value in part' END, CASE WHEN value IS NOT NULL AND amount IS NULL THEN 'missing amount in part' END,
CASE WHEN value = 0 AND amount IS NOT NULL THEN 'failed Apply in part' END, CASE WHEN eulav IS NULL THEN 'missing eulav in text' END, CASE WHEN eulav IS NULL AND value IS NULL THEN 'missing value in text' END], lambda x: x IS NOT NULL)) AS note FROM left_test)
SELECT note, count(*) AS n FROM n GROUP BY 1""")
def h8_annotated_mapping(spark, sf_dir):
    """Missing fields and failed functions, under the branches that were taken."""
    part = mp.field("value").with_(mp.field("amount")).map(lambda v, a: F.floor(a).cast("bigint") % v)
    text = mp.field("eulav").or_else(mp.field("value").as_("string"))
    made = mp.annotated(table(spark, sf_dir, "left_test").withColumn("amount", F.nanvl("amount", F.lit(0.0))), mp.record(part=part, text=text))
    note = F.concat_ws(" ", "kind", "name", F.lit("in"), F.array_join("scope", "."))
    return made.select(F.inline("annotations")).select(note.alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


_JSON_ROWS = """CASE row_id % 4 WHEN 0 THEN '{"row":' || row_id || '}' WHEN 1 THEN '{"row":' || row_id || ',"x":null}' WHEN 2 THEN '{"row":' || row_id || ',"x":""}' ELSE '{"row":' || row_id || ',"x":"a"}' END"""


@_add("""SELECT CASE row_id % 4 WHEN 0 THEN '{"row":' || row_id || ',"first_of":"d","empty":true}' WHEN 1 THEN '{"row":' || row_id || ',"x":null,"first_of":null,"empty":false}'
WHEN 2 THEN '{"row":' || row_id || ',"x":"","first_of":"","empty":true}' ELSE '{"row":' || row_id || ',"x":"a","first_of":"a","empty":false}' END AS value FROM enum_rows WHERE row_id IS NOT NULL""")
def b6_json_nulls(spark, sf_dir):
    """A null that is there is neither absent nor empty, and comes out again."""
    texts = table(spark, sf_dir, "enum_rows").where("row_id IS NOT NULL").select(F.expr(_JSON_ROWS).alias("t"))
    x = mp.field("x")
    return mp.run_json(texts, "t", "row bigint, x string", mp.record(row=mp.field("row"), x=x, first_of=x.or_else("d"), empty=x.is_empty()), strict_nulls=True)


# -- quality annotations ---------------------------------------------------------------------------------

QUANTITY = qa.Rule(((lambda c: c > 45, "TOO_MANY", True), (lambda c: c > 30, "MANY", False)))
DISCOUNT = qa.Rule(((lambda c: c >= 0.09, "CHEAP", False),))


def _checked(spark: SparkSession, sf_dir: str) -> qa.QualityFrame:
    frame = qa.QualityFrame(table(spark, sf_dir, "lineitem"))
    return frame.select(l_orderkey="l_orderkey", l_returnflag="l_returnflag", quantity=QUANTITY("l_quantity"), price=DISCOUNT("l_discount").combine(qa.read("l_extendedprice"), lambda d, p: p * (1 - d)))


_NOTES = """WITH n AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_quantity > 45 THEN 'TOO_MANY' ELSE 'MANY' END AS message, 'quantity' AS "onField", 'l_quantity' AS "fromFields", l_quantity > 45 AS "isError" FROM lineitem WHERE l_quantity > 30
UNION ALL SELECT l_orderkey, l_returnflag, 'CHEAP', 'price', 'l_discount,l_extendedprice', false FROM lineitem WHERE l_discount >= 0.09)"""


def _shown(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.inline("annotations")).withColumn("fromFields", F.array_join("fromFields", ","))


@_add(f'{_NOTES} SELECT message, "onField", "fromFields", "isError", count(*) AS n FROM n GROUP BY ALL')
def j2_annotated_select(spark, sf_dir):
    notes = _shown(_checked(spark, sf_dir).to_df())
    return notes.groupBy("message", "onField", "fromFields", "isError").agg(F.sum("count").alias("n"))


@_add(f'{_NOTES} SELECT l_returnflag, message, "onField", "fromFields", "isError", count(*) AS count FROM n GROUP BY ALL')
def d26_annotated_group_by(spark, sf_dir):
    grouped = _checked(spark, sf_dir).group_by("l_returnflag").agg(n=F.count(F.lit(1)))
    return _shown(grouped.to_df(), "l_returnflag")


@_add("""SELECT count(*) AS n, count(*) FILTER (l_quantity > 45) AS n_error, count(*) FILTER ((l_quantity > 30 AND l_quantity <= 45) OR l_discount >= 0.09) AS n_warning, count(*) FILTER (l_quantity <= 45) AS n_value FROM lineitem""")
def j5_flags(spark, sf_dir):
    flagged = _checked(spark, sf_dir).flagged()
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("has_error"), 1)).alias("n_error"), F.count(F.when(F.col("has_warning"), 1)).alias("n_warning"), F.count("quantity").alias("n_value"))


@_add("""WITH a AS (SELECT o_orderkey AS k, o_totalprice > 100000 AS e FROM orders), b AS (SELECT l_orderkey AS k, l_quantity > 30 AS e FROM lineitem)
SELECT (a.e::INT + b.e::INT)::INT AS n_notes, count(*) AS n FROM a JOIN b USING (k) GROUP BY 1""")
def c12_annotated_join(spark, sf_dir):
    dear = qa.Rule(((lambda c: c > 100_000, "DEAR", False),))
    orders = qa.QualityFrame(table(spark, sf_dir, "orders")).select(k="o_orderkey", price=dear("o_totalprice"))
    lines = qa.QualityFrame(table(spark, sf_dir, "lineitem")).select(k="l_orderkey", quantity=QUANTITY("l_quantity"))
    joined = orders.join(lines, "k").to_df()
    return joined.groupBy(F.size("annotations").alias("n_notes")).agg(F.count(F.lit(1)).alias("n"))


@_add("""WITH x AS (SELECT l_quantity > 45 AS a, l_discount IS NULL AS b FROM lineitem) SELECT NOT (a OR b) AS complete, (a::INT * 2 + b::INT)::INT AS n_errors, count(*) AS n FROM x GROUP BY 1, 2""")
def j8_build_result(spark, sf_dir):
    result = qa.build_result(quantity=QUANTITY("l_quantity"), discount=qa.read("l_discount"))
    rows = table(spark, sf_dir, "lineitem").select(result.alias("r"))
    errors = F.size(F.filter("r.annotations", lambda n: n["isError"]))
    return rows.groupBy(F.col("r.value").isNotNull().alias("complete"), errors.alias("n_errors")).agg(F.count(F.lit(1)).alias("n"))


@_add("SELECT 'NOTE' AS message, l_linenumber::BIGINT AS count, count(*) AS n FROM lineitem GROUP BY 2")
def d25_fused_annotations(spark, sf_dir):
    notes = F.array_repeat(qa.annotation("NOTE", False), F.col("l_linenumber"))
    fused = table(spark, sf_dir, "lineitem").select(F.inline(qa.fuse(notes)))
    return fused.groupBy("message", "count").agg(F.count(F.lit(1)).alias("n"))


# -- schemas, sources, effects ----------------------------------------------------------------------------


@_add("""SELECT * FROM (VALUES ('c_custkey', 'remove', 'bigint', NULL), ('c_name', 'remove', 'string', NULL), ('c_nationkey', 'change_type', 'int', 'bigint'), ('c_acctbal', 'remove', 'double', NULL), ('c_mktsegment', 'remove', 'string', NULL), ('extra', 'add', NULL, 'string')) t(path, kind, type_before, type_after)""")
def l1_schema_changes(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    other = customer.select(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), F.lit("x").cast("string").alias("extra"))
    return sc.changes_frame(spark, [c for c in sc.compare(customer.schema, other.schema) if not c.kind.startswith("set")])


@_add("SELECT 1::BIGINT AS a, true AS b UNION ALL SELECT 2, false")
def a2_json_literals(spark, sf_dir):
    return io.json_frame("{a:1, b:true}", "{'a':2, 'b':false}", spark=spark)


@_add("SELECT r_regionkey, r_name FROM region")
def a6_reader(spark, sf_dir):
    return io.Read(spark).option("mergeSchema", "false").parquet(f"{sf_dir}/region.parquet")


@_add("SELECT count(*) AS n FROM nation")
def a9_sql(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_table")
    return io.Read(spark).sql("SELECT count(*) AS n FROM nation_table")


@_add("SELECT '1' AS a, NULL AS b UNION ALL SELECT NULL, 'x'")
def a15_maps(spark, sf_dir):
    return io.maps_frame([{"a": 1}, {"b": "x"}], spark=spark)


@_add("SELECT key, value, CASE WHEN value IS NOT NULL THEN 9007199254740993 + value END AS result, value IS NOT NULL AS ok FROM left_test")
def i4_tapped_map(spark, sf_dir):
    """Nullable whole numbers beyond those that a double can hold."""

    def shifted(row: dict) -> int:
        return 2**53 + 1 + row["value"]

    called = fx.tapped_map(table(spark, sf_dir, "left_test").select("key", "value"), shifted, "bigint", max_error=1.0)
    return called.select("key", "value", "result", "ok")


def _doubled_or_failed(row: dict) -> int:
    if row["o_orderkey"] % 50 == 0:
        raise ValueError("no answer")
    return row["o_orderkey"] * 2


@_add("SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey * 2 END AS result, o_orderkey % 50 <> 0 AS ok, CASE WHEN o_orderkey % 50 = 0 THEN 'ValueError: no answer' END AS error FROM orders")
def i4_tapped_orders(spark, sf_dir):
    """A tap that stays closed: only failing calls fail."""
    called = fx.tapped_map(table(spark, sf_dir, "orders").select("o_orderkey"), _doubled_or_failed, "bigint", max_error=1.0, limiter=lambda: fx.TaskLimiter(0.01, 1_000))
    return called.select("o_orderkey", "result", "ok", "error")


def _failed_if_finished(row: dict) -> int:
    if row["o_orderstatus"] == "F":
        raise ValueError("no answer")
    return row["o_orderkey"]


@_add("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_failing, 0::BIGINT AS n_failing_ok, 0::BIGINT AS n_wrong, true AS opened FROM orders")
def i4_open_tap(spark, sf_dir):
    """A tap that opens; which rows it rejects depends on their order."""
    called = fx.tapped_map(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _failed_if_finished, "bigint")
    failing, rejected = F.col("o_orderstatus") == "F", F.col("error") == "rejected"
    right = F.when(F.col("ok"), F.col("result") == F.col("o_orderkey")).otherwise(rejected | failing)
    return called.agg(F.count(F.lit(1)).alias("n"), F.count_if(failing).alias("n_failing"), F.count_if(failing & F.col("ok")).alias("n_failing_ok"), F.count_if(~right).alias("n_wrong"), F.bool_or(rejected).alias("opened"))


@_add("SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey * 2 END AS result, o_orderkey % 50 <> 0 AS ok, 3 AS passes FROM orders")
def i6_retried_orders(spark, sf_dir):
    """Rows that fail in each pass, besides those done in the first."""
    called, execution = fx.retry(table(spark, sf_dir, "orders").select("o_orderkey"), _doubled_or_failed, "bigint")
    return called.select("o_orderkey", "result", "ok", F.lit(execution.passes).alias("passes"))


@_add("SELECT row_id, CASE WHEN str IS NOT NULL THEN length(str) + 9007199254740993 END AS result, str IS NOT NULL AS ok FROM enum_rows")
def i6_retry(spark, sf_dir):
    called, _ = fx.retry(table(spark, sf_dir, "enum_rows").select("row_id", "str"), lambda r: len(r["str"]) + 2**53 + 1, "bigint", max_passes=2, max_failures_in_a_row=10**9)
    return called.select("row_id", "result", "ok")


@_add("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 10")
def f4_top_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return cg.top_rows(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 10)


@_add("""WITH l AS (SELECT key, CASE WHEN bool_or(value IS NULL) THEN NULL ELSE min(value) END AS value FROM left_test GROUP BY 1), r AS (SELECT key, CASE WHEN bool_or(value IS NULL) THEN NULL ELSE min(value) END AS value FROM right_test GROUP BY 1),
j AS (SELECT CASE WHEN l.k IS NULL THEN 'outer_right' WHEN r.k IS NULL THEN 'outer_left' WHEN l.value IS NOT DISTINCT FROM r.value THEN 'inner_equal' ELSE 'inner_diff' END AS section
FROM (SELECT *, 1 AS k FROM l) l FULL JOIN (SELECT *, 1 AS k FROM r) r ON l.key IS NOT DISTINCT FROM r.key)
SELECT section, count(*) AS n FROM j GROUP BY 1""")
def a1_csv_pair(spark, sf_dir):
    paths = []
    for side in ("left", "right"):
        paths.append(scratch_path(spark))
        io.Write(table(spark, sf_dir, f"{side}_test").select("key", "value")).option("header", "true").option("sep", ";").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").format("csv").save(paths[-1])
    left, right = io.csv_pair(*paths, spark=spark)
    return kd.sections(kd.classified(kd.paired(left, right, ["key"])))


@_add("SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation UNION ALL SELECT n_name, n_nationkey::BIGINT FROM nation")
def a4_json_files(spark, sf_dir):
    path = scratch_path(spark)
    io.Write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).format("json").save(path)
    return io.json_files(path, path, spark=spark)


@_add("SELECT c_custkey, c_name FROM customer")
def a7_writer(spark, sf_dir):
    path = scratch_path(spark)
    io.Write(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).option("compression", "gzip").mode("overwrite").parquet(path)
    return io.Read(spark).parquet(path)


@_add(f"{_LINES}, x AS (SELECT id, a, b, d AS dump FROM (SELECT DISTINCT * FROM lines)) SELECT id, count(*) AS n_dumps FROM x GROUP BY 1")
def a11_compaction_program(spark, sf_dir):
    paths = []
    for date, frame in _dumps_apart(spark, sf_dir).items():
        paths.append(f"{scratch_path(spark)}/{date}_lines")
        frame.write.parquet(paths[-1])
    out = scratch_path(spark)
    dp.main(["-i", ",".join(paths), "-o", out, "-g", "id"], spark)
    lines = spark.read.parquet(out).select("id", F.inline("xs"))
    return lines.groupBy("id").agg(F.sum(F.size(dp.DUMPS)).cast("bigint").alias("n_dumps"))


@_add("""SELECT * FROM (VALUES (0, '@dataclass'), (1, 'class Region:'), (2, '    r_regionkey: int | None'), (3, '    r_name: str | None')) t(line, text)""")
def l5_class_text(spark, sf_dir):
    text = sc.dataclass_text(table(spark, sf_dir, "region").schema, "Region")
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@_add("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, NULL::VARCHAR AS extra FROM customer")
def l3_evolved_schema(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    wanted = T._parse_datatype_string("c_custkey bigint, c_nationkey bigint, extra string")
    schema = customer.schema
    for change in sc.compare(schema, wanted):
        schema = sc.modify(schema, change)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in customer.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return customer.select(*columns)


@_add("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, 'LARGE' AS message, count(*) AS count FROM events WHERE value > 100 GROUP BY 1
UNION ALL SELECT time_bucket(INTERVAL 1 DAY, ts), 'MISSING', count(*) FROM events WHERE value IS NULL GROUP BY 1""")
def s1_stream_annotations(spark, sf_dir):
    """Annotations of a stream of events per day, as a finished stream has them."""
    rule = qa.Rule(((lambda c: c > 100, "LARGE", False), (lambda c: c.isNull(), "MISSING", True)))
    path = f"{sf_dir}/events.parquet"
    still = spark.read.parquet(path)
    reader = spark.readStream.schema(still.schema)
    single = len(still.inputFiles()) == 1 and still.inputFiles()[0].endswith("/events.parquet")  # a stream reads folders
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    frame = qa.QualityFrame(stream.withColumn("at", F.col("ts").cast("timestamp"))).select(at="at", value=rule("value"))
    counts = structured.annotation_counts(frame, "at", "1 day", "1 day")
    name = f"stream_{abs(hash((sf_dir, id(spark)))) % 10**9}"
    running = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "message", "count")
