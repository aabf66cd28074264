"""Queries p1, p3 and p4: snapshots, history and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.operators.history import coalesced_history
from rowlattice.operators.reconcile import reconcile, summary
from rowlattice.operators.snapshot_changes import snapshot_changes
from rowlattice.operators.versions import version_list


def compact_date(column: Column) -> Column:
    """yyyymmdd out of a date in any of the delivered spellings, else null."""
    digits = F.regexp_replace(F.regexp_extract(column, r"(\d{4}[-/]?\d{2}[-/]?\d{2})", 1), "[-/]", "")
    compact = (F.length(column) == 8) & (F.translate(column, "0123456789", "") == "")
    return F.when(compact, column).when(digits != "", digits)


def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all dumps, compacted or not, with dates and blanks put right."""
    packed = spark.read.parquet(f"{sf_dir}/compressed_dumps.parquet")
    unpacked = packed.select("id", F.inline("xs")).select("id", "a", "b", F.explode("compressdumpdts").alias("compressdumpdt"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"))
    lines = spark.read.parquet(f"{sf_dir}/dump_lines.parquet").select("id", "a", "b", "compressdumpdt", F.col("loaded_at").cast("timestamp_ntz"))
    both = unpacked.unionByName(lines)
    return both.select("id", F.trim("a").alias("a"), "b", compact_date(F.col("compressdumpdt")).alias("compressdumpdt"), "loaded_at")


def dump_dates(spark: SparkSession, sf_dir: str) -> list[str]:
    """The dates of all dumps; only their distinct spellings are looked at."""
    packed = spark.read.parquet(f"{sf_dir}/compressed_dumps.parquet").select(F.explode(F.flatten("xs.compressdumpdts")).alias("d"))
    spelled = packed.union(spark.read.parquet(f"{sf_dir}/dump_lines.parquet").select("compressdumpdt")).distinct()
    return version_list(spelled.select(compact_date(F.col("d")).alias("d")), "d")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dump_rows(spark, sf_dir)
    return snapshot_changes(rows, ["id"], "compressdumpdt", ["a", "b"], order="loaded_at", versions=dump_dates(spark, sf_dir))


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("compressdumpdt", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dump_rows(spark, sf_dir)
    return coalesced_history(rows, ["id"], "compressdumpdt", ["a", "b"], order="loaded_at", versions=dump_dates(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_history(spark, sf_dir).select("id", "mindt", "maxdt")


FIELDS = ["value", "eulav", "amount", "flag", "seen_on", "ts"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (spark.read.parquet(f"{sf_dir}/{side}_test.parquet") for side in ("left", "right"))
    return reconcile(left, right, "key", FIELDS, order="loaded_at", normalise_key=lambda k: F.upper(F.trim(k)), tolerances={"amount": 0.000001})


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(p4_found(spark, sf_dir), "key")


QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts, "p3_found": p3_found, "p3_history": p3_history, "p4_found": p4_found, "p4_summary": p4_summary}

_DUMPS = r"""
packed AS (SELECT id, unnest(xs) AS x FROM compressed_dumps),
unpacked AS (SELECT id, x.a AS a, x.b AS b, unnest(x.compressdumpdts) AS d, CAST(NULL AS TIMESTAMP) AS loaded_at FROM packed),
every_line AS (SELECT * FROM unpacked UNION ALL SELECT id, a, b, compressdumpdt, loaded_at FROM dump_lines),
clean AS (SELECT id, trim(a) AS a, b, replace(replace(regexp_extract(d, '(\d{4}[-/]?\d{2}[-/]?\d{2})', 1), '-', ''), '/', '') AS d, loaded_at FROM every_line WHERE id IS NOT NULL),
valid AS (SELECT id, a, b, d FROM clean WHERE d <> '' QUALIFY row_number() OVER (PARTITION BY id, d ORDER BY loaded_at DESC NULLS LAST, a DESC NULLS LAST, b DESC NULLS LAST) = 1),
dumps AS (SELECT d, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS k FROM (SELECT DISTINCT d FROM clean WHERE d <> '')),
placed AS (SELECT id, a, b, d, k FROM valid JOIN dumps USING (d))"""

_P1 = f"""WITH {_DUMPS},
pairs AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.k, o.k + 1) AS k, n.k AS nk, o.k AS ok, n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b AS differs
  FROM placed n FULL OUTER JOIN placed o ON n.id = o.id AND n.k = o.k + 1),
found AS (SELECT pairs.id, dumps.d AS compressdumpdt, CASE WHEN ok IS NULL THEN 'added' WHEN nk IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM pairs JOIN dumps USING (k) WHERE k > 1 AND (ok IS NULL OR nk IS NULL OR differs))"""

_P3 = f"""WITH {_DUMPS},
marked AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND lag(a) OVER w IS NOT DISTINCT FROM a AND lag(b) OVER w IS NOT DISTINCT FROM b THEN 0 ELSE 1 END AS begins
  FROM placed WINDOW w AS (PARTITION BY id ORDER BY k)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY k) AS run FROM marked),
runs AS (SELECT id, first(a) AS a, first(b) AS b, min(d) AS mindt, max(d) AS maxdt FROM numbered GROUP BY id, run)"""

_P4 = """WITH l AS (SELECT * REPLACE (upper(trim(key)) AS key) FROM left_test WHERE key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(trim(key)) ORDER BY loaded_at DESC NULLS LAST, value DESC NULLS LAST, eulav DESC NULLS LAST, amount DESC NULLS LAST) = 1),
r AS (SELECT * REPLACE (upper(trim(key)) AS key) FROM right_test WHERE key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(trim(key)) ORDER BY loaded_at DESC NULLS LAST, value DESC NULLS LAST, eulav DESC NULLS LAST, amount DESC NULLS LAST) = 1),
j AS (SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.key IS NULL THEN ['left_only'] WHEN l.key IS NULL THEN ['right_only'] ELSE [
  CASE WHEN l.value IS DISTINCT FROM r.value THEN 'value' END, CASE WHEN l.eulav IS DISTINCT FROM r.eulav THEN 'eulav' END,
  CASE WHEN l.amount IS DISTINCT FROM r.amount AND NOT coalesce(NOT isnan(l.amount) AND NOT isnan(r.amount) AND abs(l.amount - r.amount) <= 0.000001, false) THEN 'amount' END,
  CASE WHEN l.flag IS DISTINCT FROM r.flag THEN 'flag' END, CASE WHEN l.seen_on IS DISTINCT FROM r.seen_on THEN 'seen_on' END,
  CASE WHEN l.ts IS DISTINCT FROM r.ts THEN 'ts' END] END AS kinds FROM l FULL OUTER JOIN r ON l.key = r.key),
found AS (SELECT key, difference FROM (SELECT key, unnest(kinds) AS difference FROM j) WHERE difference IS NOT NULL)"""

ORACLES = {
    "p1_found": f"{_P1} SELECT * FROM found",
    "p1_change_counts": f"{_P1} SELECT compressdumpdt, change_kind, count(*) AS n FROM found GROUP BY 1, 2",
    "p3_found": f"{_P3} SELECT id, mindt, maxdt FROM runs",
    "p3_history": f"{_P3} SELECT id, a, b, mindt, maxdt FROM runs",
    "p4_found": f"{_P4} SELECT * FROM found",
    "p4_summary": f"{_P4} SELECT difference, count(*) AS n_keys FROM found GROUP BY 1 UNION ALL SELECT 'rows_not_equal', count(DISTINCT key) FROM found WHERE difference NOT IN ('left_only', 'right_only')",
}
