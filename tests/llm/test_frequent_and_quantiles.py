"""Frequent values and percentiles against brute force and their error bounds."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowlattice.llm import frequent, quantiles


def top(spark, rows, k):
    frame = spark.createDataFrame([(*r, 5) for r in rows], "g string, v string, w long, n long")
    found = frequent.frequent_values(frame.withColumnRenamed("n", "extra"), "g", "v", "w", k)
    return {(r["g"], r["v"]): (r["n"], r["total"]) for r in found.collect()}


def brute(rows, k):
    counts, totals = Counter(), Counter()
    for g, v, w in rows:
        if v is not None and w is not None and w > 0:
            counts[g, v] += w
            totals[g] += w
    out = {}
    for g in {g for g, _ in counts}:
        best = sorted(((-n, v) for (h, v), n in counts.items() if h == g))[:k]
        out.update({(g, v): (-n, totals[g]) for n, v in best})
    return out


def test_frequent_values_with_nulls_ties_and_a_hot_value(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["", "x", "X", "x ", None, *(f"v{i}" for i in range(300))]), rng.choice([1, 1, 2, None, 0, -1])) for _ in range(3000)]
    rows += [("a", "hot", 1)] * 1500
    for k in (1, 5, 1000):
        assert top(spark, rows, k) == brute(rows, k)


@pytest.mark.parametrize("rows", [[], [("a", None, 1)], [("a", "x", 0)]])
def test_frequent_values_of_nothing(spark, rows):
    assert top(spark, rows, 3) == {}


def test_numbers_can_be_counted(spark):
    frame = spark.createDataFrame([("g", x, 1) for x in (1.5, 1.5, float("nan"), float("nan"), float("nan"))], "g string, v double, w long")
    assert [(str(r["v"]), r["n"]) for r in frequent.frequent_values(frame, "g", "v", "w", 2).orderBy("n").collect()] == [("1.5", 2), ("nan", 3)]


def test_runs_go_across_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(["g"] * len(v)), pa.array(v), pa.array([1] * len(v))], names=["g", "v", "n"]) for v in (["a", "a"], ["a", "b"], ["b"], ["b", "c"])]
    out = pa.Table.from_batches(list(frequent.runs(iter(batches)))).to_pydict()
    assert (out["v"], out["n"]) == (["a", "b", "c"], [3, 3, 1])


def test_each_delivery_counts_once(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", None), (2, "a", None)], "row_id long, colname string, str string")
    assert sorted((r["str"] or "") for r in frequent.once(frame, "row_id", ["colname", "str"]).collect()) == ["", "x"]


def test_rows_without_key_are_all_kept(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "a", "y"), (None, "a", "y"), (None, "b", None)], "row_id long, colname string, str string")
    assert Counter(tuple(r) for r in frequent.once(frame, "row_id", ["colname", "str"]).collect()) == {("a", "x"): 1, ("a", "y"): 2, ("b", None): 1}


PCTS = [1, 5, 25, 50, 75, 95, 99, 100]


def exact(values, pct):
    return values[max(1, math.ceil(pct * len(values) / 100)) - 1]


@pytest.mark.parametrize("kind", ["uniform", "skewed", "sorted", "constant", "ends"])
def test_rank_error_stays_in_its_bound(kind):
    rng = np.random.default_rng(5)
    n = 50_000
    values = {"uniform": rng.integers(-1000, 1_000_000, n), "skewed": rng.geometric(0.001, n), "sorted": np.arange(n), "constant": np.full(n, 7), "ends": rng.choice(np.array([-(2**63), 2**63 - 1, 0]), n)}[kind].astype(np.int64)
    parts = []
    for chunk in np.array_split(values, 13):
        s = quantiles.Summary(256)
        s.add(chunk)
        parts.append(s)
    whole = quantiles.Summary(256)
    for s in parts:
        whole.merge(s.arrays(), s.n, s.error)
    assert whole.n == n == sum(len(a) << j for j, a in enumerate(whole.arrays()))
    assert sum(len(a) for a in whole.arrays()) < 2 * 256 * 14
    assert whole.error <= n * len(whole.levels) / (2 * 256) + len(whole.levels)
    ordered = np.sort(values)
    for pct, got in zip(PCTS, whole.percentiles(PCTS)):
        rank = max(1, math.ceil(pct * n / 100))
        low, high = np.searchsorted(ordered, got, "left") + 1, np.searchsorted(ordered, got, "right")
        assert low - whole.error <= rank <= high + whole.error


def test_weights_are_repetitions():
    values, counts = np.array([5, -3, 9, 0]), np.array([1000, 3, 70_000, 0])
    s = quantiles.Summary(64)
    s.add(values, counts)
    assert s.n == 71_003
    assert s.percentiles([0.001, 1, 50, 100]) == [-3, 5, 9, 9]


def test_small_groups_are_exact_and_combine(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 50)]), rng.choice([1, 2, None, 0])) for _ in range(600)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "g string, v int, w long, n long").repartition(5)
    halves = [quantiles.summarise(frame.where(c), "g", "v", "w") for c in ("v < 0", "v >= 0")]
    for kept in (quantiles.summarise(frame, "g", "v", "w"), quantiles.combine(halves[0].union(halves[1]))):
        got = {(r["g"], r["pct"]): (r["v"], r["rows"], r["error"]) for r in quantiles.percentiles(kept, PCTS, "g", "v").collect()}
        for g in ("a", "b", None):
            values = sorted(v for h, v, w in rows if h == g and v is not None and w for _ in range(w))
            for pct in PCTS:
                assert got[g, pct] == (exact(values, pct), len(values), 0)


def test_doubles_nan_and_nothing(spark):
    frame = spark.createDataFrame([("a", 1.5), ("a", float("nan")), ("a", None), ("b", None)], "g string, v double")
    got = quantiles.percentiles(quantiles.summarise(frame, "g", "v"), [50, 100], "g", "v").orderBy("pct").collect()
    assert [(r["g"], str(r["v"])) for r in got] == [("a", "1.5"), ("a", "nan")]
    assert quantiles.summarise(frame.limit(0), "g", "v").count() == 0


def test_queries_find_the_shares(spark, sf_dir):
    from rowlattice.llm.queries import QUERIES

    assert QUERIES["p2_found"](spark, sf_dir).columns == ["colname", "str"]
    found = QUERIES["p5_found"](spark, sf_dir)
    assert found.dtypes == [("colname", "string"), ("pct", "int"), ("n", "bigint")]
    assert found.count() == 24
