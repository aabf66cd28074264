"""Queries p2 and p5 to p8, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.llm import frequent, language, leakage, mixing, quantiles

PERCENTS = [5, 25, 50, 75, 95, 99]


def _describes(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Each Describe once, with the statistics kept under ``value``."""
    rows = spark.read.parquet(f"{sf_dir}/describes.parquet").select("describe_id", "colname", "seen_on", F.try_element_at(column, F.lit("value")).alias("kept"))
    return frequent.once(rows, "describe_id", ["colname", "seen_on", "kept"])


def string_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """colname, str, n: strings of enum_rows and of the Describes."""
    rows = frequent.once(spark.read.parquet(f"{sf_dir}/enum_rows.parquet").select("row_id", "colname", "str"), "row_id", ["colname", "str"])
    counted = _describes(spark, sf_dir, "enums").select("colname", F.explode("kept").alias("str", "n"))
    return rows.select("colname", "str", F.lit(1).cast("bigint").alias("n")).union(counted)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = frequent.frequent_values(string_counts(spark, sf_dir), "colname", "str", "n", 50)
    return top.where(F.col("n") * 50 >= F.col("total")).select("colname", "str")


def p2_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_values(string_counts(spark, sf_dir), "colname", "str", "n", 20)


def number_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """colname, seen_on, n, times: numbers of number_rows and of the Describes."""
    rows = frequent.once(spark.read.parquet(f"{sf_dir}/number_rows.parquet").select("row_id", "colname", "seen_on", "n"), "row_id", ["colname", "seen_on", "n"])
    kept = _describes(spark, sf_dir, "histograms")
    one = F.lit(1).cast("bigint")
    negatives = kept.select("colname", "seen_on", F.explode("kept.negatives").alias("m", "times")).select("colname", "seen_on", (-F.col("m")).alias("n"), "times")
    zeros = kept.select("colname", "seen_on", F.lit(0).cast("bigint").alias("n"), F.col("kept.countzero").alias("times"))
    positives = kept.select("colname", "seen_on", F.explode("kept.positives").alias("n", "times"))
    return rows.select("colname", "seen_on", "n", one.alias("times")).union(negatives).union(zeros).union(positives)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quantiles.summarise(number_counts(spark, sf_dir), "colname", "n", "times")
    asked = quantiles.percentiles(kept, PERCENTS, "colname", "n")
    return asked.select("colname", F.col("pct").cast("int").alias("pct"), "n")


def p5_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each column and month."""
    rows = number_counts(spark, sf_dir).withColumn("g", F.concat_ws(" ", "colname", F.date_format("seen_on", "yyyy-MM")))
    kept = quantiles.summarise(rows, "g", "n", "times")
    asked = quantiles.percentiles(kept, PERCENTS, "g", "n")
    return asked.select(F.split("g", " ")[0].alias("colname"), F.split("g", " ")[1].alias("month"), F.col("pct").cast("int").alias("pct"), "n", "rows")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_shares(spark, sf_dir).select("doc_id", "item_id")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the share of their words that a document holds."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "text")
    return leakage.leaked_items(documents, items)


def p6_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked, by suite, and in how many documents."""
    suites = spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "suite")
    return p6_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs")).join(suites, "item_id").select("item_id", "suite", "n_docs")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), spark.read.parquet(f"{sf_dir}/source_targets.parquet")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: whole documents, repeated and shuffled."""
    return mixing.mixture(*_corpus(spark, sf_dir)).documents


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: tokens there were, target share, rate, share reached."""
    return mixing.mixture(*_corpus(spark, sf_dir)).report


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with a target: are share, cap and repeatability kept?"""
    made, again = (mixing.mixture(*_corpus(spark, sf_dir)) for _ in range(2))
    drawn = made.documents.groupBy("source").agg(F.max("copy_no").alias("most"), F.count(F.lit(1)).alias("drawn"), F.sum(F.xxhash64("doc_id", "copy_no").cast("decimal(38,0)")).alias("which"))
    same = again.documents.groupBy("source").agg(F.sum(F.xxhash64("doc_id", "copy_no").cast("decimal(38,0)")).alias("again"))
    report = made.report.where("scaled_share > 0").join(drawn, "source", "left").join(same, "source", "left")
    near = F.abs(F.col("reached_share") - F.col("scaled_share")) <= 5 * F.col("standard_error") + 1e-9
    return report.select("source", "n_documents", F.round("scaled_share", 9).alias("scaled_share"), near.alias("share_is_near"), (F.col("most") <= F.col("max_repeats")).alias("cap_is_kept"), (F.col("drawn") == F.col("n_copies")).alias("counted"), (F.col("which") == F.col("again")).alias("same_again"))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language and segments, with their confidence."""
    return language.label_languages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.corrections(p8_languages(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_top20": p2_top20, "p5_found": p5_found, "p5_monthly": p5_monthly, "p6_found": p6_found, "p6_shares": p6_shares, "p6_leaked_items": p6_leaked_items, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_languages": p8_languages}

_STRINGS = """WITH r AS (SELECT DISTINCT ON (row_id) colname, str FROM enum_rows),
d AS (SELECT DISTINCT ON (describe_id) colname, enums['value'] AS m FROM describes),
e AS (SELECT colname, unnest(map_entries(m)) AS e FROM d),
u AS (SELECT colname, str, 1 AS n FROM r WHERE str IS NOT NULL UNION ALL SELECT colname, e.key, e.value FROM e),
c AS (SELECT colname, str, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1, 2),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY colname) AS BIGINT) AS total FROM c)"""

_NUMBERS = """WITH r AS (SELECT DISTINCT ON (row_id) colname, seen_on, n FROM number_rows),
d AS (SELECT DISTINCT ON (describe_id) colname, seen_on, histograms['value'] AS h FROM describes),
e AS (SELECT colname, seen_on, unnest(map_entries(h.negatives)) AS e, -1 AS sign FROM d UNION ALL SELECT colname, seen_on, unnest(map_entries(h.positives)), 1 FROM d),
u AS (SELECT colname, seen_on, n, 1 AS times FROM r WHERE n IS NOT NULL UNION ALL SELECT colname, seen_on, sign * e.key, e.value FROM e
  UNION ALL SELECT colname, seen_on, 0, h.countzero FROM d WHERE h.countzero > 0)"""

_PERCENTS = ", ".join(f"({p})" for p in PERCENTS)

ORACLES = {
    "p7_checks": """WITH d AS (SELECT lower(trim(source)) AS source, count(*) AS n, count(*) FILTER (length(text) > 0) AS filled FROM documents GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, max(target_share) AS share, max(max_repeats) AS cap FROM source_targets WHERE source IS NOT NULL GROUP BY 1),
j AS (SELECT d.source, n, share, cap FROM d JOIN t ON d.source = t.source WHERE share > 0 AND cap > 0 AND filled > 0)
SELECT source, n AS n_documents, round(share / sum(share) OVER (), 9) AS scaled_share, true AS share_is_near, true AS cap_is_kept, true AS counted, true AS same_again FROM j""",
    "p2_found": f"{_STRINGS} SELECT colname, str FROM t WHERE n >= 0.02 * total",
    "p2_top20": f"{_STRINGS} SELECT colname, str, n, total FROM t QUALIFY row_number() OVER (PARTITION BY colname ORDER BY n DESC, str) <= 20",
    "p5_found": f"""{_NUMBERS}, c AS (SELECT colname, n, sum(times) AS times FROM u GROUP BY 1, 2),
s AS (SELECT colname, n, sum(times) OVER (PARTITION BY colname ORDER BY n) AS below, sum(times) OVER (PARTITION BY colname) AS total FROM c)
SELECT colname, CAST(pct AS INTEGER) AS pct, CAST(min(n) AS BIGINT) AS n FROM s, (VALUES {_PERCENTS}) AS p(pct) WHERE below * 100 >= pct * total GROUP BY 1, 2""",
    "p5_monthly": f"""{_NUMBERS}, c AS (SELECT colname, strftime(seen_on, '%Y-%m') AS month, n, sum(times) AS times FROM u GROUP BY 1, 2, 3),
s AS (SELECT colname, month, n, sum(times) OVER (PARTITION BY colname, month ORDER BY n) AS below, sum(times) OVER (PARTITION BY colname, month) AS total FROM c)
SELECT colname, month, CAST(pct AS INTEGER) AS pct, CAST(min(n) AS BIGINT) AS n, CAST(max(total) AS BIGINT) AS rows FROM s, (VALUES {_PERCENTS}) AS p(pct) WHERE below * 100 >= pct * total GROUP BY 1, 2, 3""",
}
