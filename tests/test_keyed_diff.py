"""Keyed diff: sections, statistics, summary, constraints, JSON and report."""

import datetime
import random
from collections import Counter

import pytest

from rowlattice import queries_core
from rowlattice.operators import keyed_diff as kd
from rowlattice.plans import diff_summary as ds
from rowlattice.plans.schema import SchemaError
from rowlattice.sources.io import csv_pair


def classes(spark, left, right, schema, keys, **more):
    a, b = (spark.createDataFrame(rows, schema) for rows in (left, right))
    return kd.classified(kd.paired(a, b, keys, **more))


def summary(spark, left, right, schema, keys, **more):
    return ds.summarise(classes(spark, left, right, schema, keys), **more)


LONGS = ("key string, col1 bigint", ["key"])


@pytest.fixture(scope="module")
def longs(spark):
    return summary(spark, [("0", 1), ("1", 2), ("2", 3), ("3", 4)], [("0", 5), ("1", 6), ("2", 3)], *LONGS)


def test_long_column(longs):
    assert (longs.rows_equal, longs.rows_not_equal) == (1, 2)
    assert (longs.left_only.count, longs.right_only.count) == (1, 0)
    assert {tuple(s): d.count for s, d in longs.by_set.items()} == {("col1",): 2}
    delta = longs.by_column["col1"]
    assert delta.error.histograms["value"].values == {-4: 2}
    assert delta.left.histograms["value"].values == {1: 1, 2: 1, 3: 1}
    assert delta.right.histograms["value"].values == {5: 1, 6: 1, 3: 1}


def test_string_column(spark):
    s = summary(spark, [(1, "a", 1), (2, "b", 2)], [(1, "a", 1), (2, "b2", 3)], "id bigint, col1 string, n bigint", ["id"])
    assert (s.rows_equal, s.rows_not_equal) == (1, 1)
    assert s.by_column["col1"].error.enums["from_to"].values == {("b", "b2"): 1}


def test_boolean_column(spark):
    left = [(1, True), (2, True), (3, False), (4, False), (5, False), (6, False)]
    right = [(1, False), (2, True), (3, False), (4, True), (5, False)]
    frame = classes(spark, left, right, "id bigint, b boolean", ["id"])
    delta = ds.summarise(frame).by_column["b"]
    assert (delta.n_equal, delta.n_not_equal) == (3, 2)
    assert delta.as_boolean == {"tt": 1, "tf": 1, "ft": 1, "ff": 2}
    assert kd.confusion(frame).first().asDict() == {"column": "b", "tt": 1, "tf": 1, "ft": 1, "ff": 2}


def test_confusion_matches_counting(spark):
    rng = random.Random(7)
    pairs = [(i, rng.random() < 0.5, rng.random() < 0.3) for i in range(200)]
    s = summary(spark, [(i, a) for i, a, _ in pairs], [(i, b) for i, _, b in pairs], "id int, b boolean", ["id"])
    want = {n: sum((a, b) == v for _, a, b in pairs) for n, v in (("tt", (True, True)), ("tf", (True, False)), ("ft", (False, True)), ("ff", (False, False)))}
    assert s.by_column["b"].as_boolean == want


def test_dates_and_timestamps(spark):
    day = datetime.date(2019, 7, 15)
    dates = summary(spark, [(i, day + datetime.timedelta(3 + i)) for i in (1, 2, 3)], [(i, day) for i in (1, 2, 3, 4)], "id int, d date", ["id"])
    assert (dates.rows_equal, dates.rows_not_equal, dates.right_only.count) == (0, 3, 1)
    assert dates.by_column["d"].error.histograms["date"].values == {d * 86_400_000: 1 for d in (4, 5, 6)}
    at = datetime.datetime(2019, 7, 19, 12, 56, 43)
    for kind in ("timestamp", "timestamp_ntz"):
        times = summary(spark, [(1, at), (2, at)], [(1, at), (2, at + datetime.timedelta(seconds=4))], f"id int, t {kind}", ["id"])
        assert times.by_column["t"].error.histograms["timestamp"].values == {-4000: 1}


def test_nulls_match_nulls(spark):
    s = summary(spark, [(1, "a"), (2, "b"), (3, None), (4, None), (None, "n")], [(1, None), (2, "b"), (3, "c"), (4, None), (5, "e"), (None, "n")], "id int, s string", ["id"])
    assert (s.rows_equal, s.rows_not_equal, s.right_only.count) == (3, 2, 1)
    assert s.by_column["s"].error.counts == {"leftToNull": 1, "rightToNull": 1}


def test_nan_binary_and_what_has_no_statistics(spark):
    schema = "id int, d double, b binary, a array<int>, m map<string,int>"
    left = [(1, float("nan"), b"abc", [1], {"k": 1}), (2, 1.0, b"x", [1], {"k": 1})]
    right = [(1, float("nan"), b"abd", [1], {"k": 1}), (2, 1.0, b"x", [2], {"k": 2})]
    s = summary(spark, left, right, schema, ["id"])
    assert {tuple(sorted(k)): d.count for k, d in s.by_set.items()} == {("b", "d"): 1, ("a", "m"): 1}
    assert s.by_column["b"].error.histograms["levenshtein"].values == {1: 1}
    assert s.by_column["d"].left.counts == s.by_column["d"].error.counts == {"nNaN": 1}
    assert "# not a number: 1" in ds.render(s) and ds.from_json(ds.to_json(s)) == s
    assert s.by_column["m"].left.counts == {"nUnsupported": 2}


def test_one_row_per_key_whatever_the_order(spark):
    left = [(1, "b"), (1, "a"), (2, "c")]
    for rows in (left, left[::-1]):
        frame = classes(spark, rows, [(1, "a"), (2, "c")], "id int, s string", ["id"])
        assert {r["section"]: r["n"] for r in kd.sections(frame).collect()} == {"inner_equal": 2}
        assert kd.duplicates(frame).first().asDict() == {"left_extra_rows": 1, "right_extra_rows": 0}


def test_empty_sides_key_only_and_several_keys(spark):
    assert summary(spark, [], [], *LONGS) == ds.DiffSummary(columns=["col1"])
    assert summary(spark, [("a", 1)], [], *LONGS).left_only.count == 1
    frame = classes(spark, [("a",)], [("a",), ("b",)], "key string", ["key"])
    assert {r["section"]: r["n"] for r in kd.sections(frame).collect()} == {"inner_equal": 1, "outer_right": 1}
    two = classes(spark, [("a§b", "c", 1)], [("a", "b§c", 1)], "x string, y string, n int", ["x", "y"])
    assert {r["section"] for r in kd.sections(two).collect()} == {"outer_left", "outer_right"}


def test_columns_named_like_ours(spark):
    s = summary(spark, [(1, "x", 1, "n")], [(1, "y", 1, "n")], "k0 int, l string, section int, diff_set string", ["k0"])
    assert [tuple(x) for x in s.by_set] == [("l",)]


def test_schemas_must_agree(spark):
    a, b = spark.createDataFrame([("0", 1)], "key string, col1 bigint"), spark.createDataFrame([("0", 1, 1)], "key string, col1 bigint, col2 bigint")
    with pytest.raises(SchemaError, match="Field col2 was not in the original DataFrame"):
        kd.paired(a, b, ["key"])
    with pytest.raises(ValueError, match="key"):
        kd.paired(a, a, [])


def test_csv_pair(spark, tmp_path):
    rows = [(c, i, c) for i, c in enumerate("abcdefghij")]
    other = [(k, 77 if k == "h" else 99 if k == "j" else v, "ii" if k == "i" else "jj" if k == "j" else e) for k, v, e in rows]
    for name, data in (("l", rows), ("r", other)):
        (tmp_path / f"{name}.csv").write_text("key;value;eulav\n" + "\n".join(";".join(map(str, r)) for r in data))
    left, right = csv_pair(str(tmp_path / "l.csv"), str(tmp_path / "r.csv"), spark=spark)
    s = ds.summarise(kd.classified(kd.paired(left, right, ["key"])))
    assert s.rows_equal == 7
    assert {tuple(sorted(k)): d.count for k, d in s.by_set.items()} == {("value",): 1, ("eulav",): 1, ("eulav", "value"): 1}


def test_many_keys_become_buckets(spark):
    rows = [(i, (i - 500) * 37, f"s{i % 700}", i / 7) for i in range(1000)]
    s = summary(spark, rows, rows, "id int, n bigint, s string, d double", ["id"], exact_keys=50)
    column = s.by_column
    for name in "nd":
        h = column[name].left.histograms["value"]
        assert h.large and h.count == 1000 and len(h.values) < 1000
        values = sorted(r[1] if name == "n" else r[3] for r in rows)
        for i, v in enumerate(values):
            low, high = h.quantile_bounds(i / 999)
            assert low - 1e-9 <= values[min(int(i / 999 * 1000), 999)] <= high + 1e-9
            assert h.min <= v <= h.max
    e = column["s"].left.enums["value"]
    assert e.large and len(e.values) == 50 and set(e.values.values()) == {2}
    assert e.estimate("never") == 0


def test_strings_that_are_not_kept_are_counted(spark):
    # "s" has a long tail on equal rows, pairs of changed rows too
    left = [(i, f"s{i % 97 if i % 3 else i}") for i in range(900)]
    right = [(i, s if i % 2 else f"{s}'") for i, s in left]
    s = summary(spark, left, right, "id int, s string", ["id"], exact_keys=40)
    equal, delta = s.equal_rows.by_column["s"], s.by_column["s"]
    assert equal.count == 450 and equal.enums["value"].total == 450
    assert delta.left.count == delta.right.count == 900 and delta.left.enums["value"].total == 900
    pairs = delta.error.enums["from_to"]
    assert delta.error.count == pairs.total == 450 and pairs.rest > 0
    for describe, seen in ((equal, Counter(a for (i, a) in left if i % 2)), (delta.left, Counter(a for _, a in left))):
        e = describe.enums["value"]
        assert e.large and e.rest > 0 and all(n <= e.estimate(k) <= n + 3 for k, n in seen.items())
        assert [n for _, n in e.heavy_hitters(40)] == [n for _, n in seen.most_common(40)]
    assert all(pairs.estimate((a, f"{a}'")) >= 1 for i, a in left if i % 2 == 0)
    assert ds.from_json(ds.to_json(s)) == s and "all strings: 900" in ds.render(s)


def test_bounded_statistics_lose_no_row(spark):
    stats = kd.statistics(classes(spark, [(i, f"s{i}") for i in range(500)], [(i, f"t{i // 2}") for i in range(500)], "id int, s string", ["id"]))
    bound = kd.bounded(stats, 30).collect()
    assert sum(r["n"] for r in bound) == stats.agg({"n": "sum"}).first()[0]
    rest = {(r["role"], r["n"], r["rest_keys"]) for r in bound if r["rest_keys"] is not None}
    assert rest == {("left", 470, 470), ("right", 440, 220), ("error", 470, 470)}


def test_coarse_statistics_bound_every_number(spark):
    rows = [(i, (i - 500) * 37, i / 7) for i in range(1000)]
    s = summary(spark, rows, rows, "id int, n bigint, d double", ["id"], coarse=True)
    for name, place in (("n", 1), ("d", 2)):
        h, values = s.by_column[name].left.histograms["value"], sorted(r[place] for r in rows)
        assert h.large and h.count == 1000
        for i in range(0, 1000, 50):
            low, high = h.quantile_bounds(i / 1000)
            assert low - 1e-9 <= values[i] <= high + 1e-9
    assert s.by_column["n"].error.empty


def test_json_round_trip(spark, longs):
    assert ds.from_json(ds.to_json(longs)) == longs
    s = summary(spark, [(1, "a", 1.5, True, None)], [(1, "b", 2.5, False, 3), (2, "c", 0.0, None, 3)], "id int, s string, d double, b boolean, n int", ["id"])
    assert ds.from_json(ds.to_json(s)) == s


def test_constraints(spark, longs):
    same = summary(spark, [("0", 0)], [("0", 0)], *LONGS)
    assert ds.check(same, ds.is_similar(), ds.no_outer(), ds.no_inner(), ds.column_keeps("col1")).passed
    out = ds.check(longs, ds.no_inner(), ds.column_changes("col1"), ds.is_similar(), ds.column_keeps("col1"))
    assert [c.name for c in out.failed] == ["no_inner", "is_similar", "column_keeps(col1)"]
    with pytest.raises(KeyError):
        ds.check(longs, ds.column_changes("other"))


def test_report(longs):
    text = ds.render(longs)
    for line in ("Number of equal rows: 1", "Number of different rows: 2", "col1: 2", "Number of rows on the left only: 1"):
        assert line in text
    assert "-4.00 | oooooooooooooooooooooo 2" in text


def test_bins(spark):
    h = ds.Histogram({float(x): 1 for x in range(22, 43)}, whole=False)
    bins = h.bins(6)
    assert len(bins) == 6 and bins[0][0] == 22 and bins[-1][0] == 42 and sum(n for _, n in bins) == 21
    frame = spark.createDataFrame([(float(x),) for x in range(22, 43)] + [(None,)], "x double")
    assert [(r["centre"], r["n"]) for r in kd.bins(frame, "x", 6, 0.01).orderBy("bin").collect()] == bins
    assert sum(n for _, n in ds.Histogram({100: 10}).bins(6)) == 10
    assert ds.Histogram().bins(6) == [] and kd.bins(frame.limit(0), "x", 6, 1.0).collect() == []


def test_sets_are_compacted():
    def key(s):
        return frozenset(s)

    def merge(a, b):
        return a + b

    assert ds.compact_sets({key("12"): 3, key("23"): 2}, 1, merge) == {key("123"): 5}
    assert ds.compact_sets({key("12"): 3, key("23"): 2}, 2, merge) == {key("12"): 3, key("23"): 2}
    sets = {key("12"): 1, key("13"): 2, key("23"): 2, key("56"): 4, key("57"): 2, key("67"): 2}
    best = [ds.compact_sets(sets, 2, merge, seed) for seed in range(10)]
    assert {key("123"): 5, key("567"): 8} in best
    for out in best:
        assert len(out) <= 2 and sum(out.values()) == 13
        assert ds.compact_sets(sets, 2, merge, 0) == best[0]


def test_many_sets_are_merged_before_they_are_collected(spark, monkeypatch):
    names = [f"c,{i}" for i in range(6)]
    schema = "id int, " + ", ".join(f"`{n}` int" for n in names)
    left = [(i, *[0] * 6) for i in range(64)]
    right = [(i, *[i >> b & 1 for b in range(6)]) for i in range(64)]
    for listed in (2000, 5):
        monkeypatch.setattr(ds, "LISTED_SETS", listed)
        s = summary(spark, left, right, schema, ["id"], max_sets=4)
        assert len(s.by_set) <= 5 and s.rows_not_equal == 63 and s.rows_equal == 1
        assert {c: d.n_not_equal for c, d in s.by_column.items()} == dict.fromkeys(names, 32)
        for union, delta in s.by_set.items():
            assert {c for c, d in delta.by_column.items() if d.n_not_equal} <= union


def test_rare_sets_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ds, "LISTED_SETS", 5)
    schema = "id int, " + ", ".join(f"c{i} int" for i in range(8))
    left = [(i, *[0] * 8) for i in range(64)]
    right = [(i, *[(i >> b & 1) if i < 8 else (i - 8) % 8 == b for b in range(8)]) for i in range(64)]
    right = [(r[0], *map(int, r[1:8]), 0) for r in right]  # c7 never differs
    s = summary(spark, left, right, schema, ["id"], max_sets=4)
    assert len(s.by_set) <= 4 and s.rows_not_equal == sum(any(r[1:]) for r in right) and s.rows_equal == sum(not any(r[1:]) for r in right)
    for union, delta in s.by_set.items():
        assert {c for c, d in delta.by_column.items() if d.n_not_equal} == union
    assert {c: d.n_not_equal for c, d in s.by_column.items()} == {f"c{b}": sum(r[b + 1] for r in right) for b in range(8)}


def test_merged_sets_hold_the_rows_of_their_members(spark, sf_dir):
    counts = {r["diff_set"]: r["n"] for r in kd.diff_sets(queries_core._classes(spark, sf_dir)).collect()}
    merged = queries_core.d17_merged_sets(spark, sf_dir).collect()
    assert 1 <= len(merged) <= 8 and sorted(s for r in merged for s in r["members"]) == sorted(counts)
    for r in merged:
        assert r["n"] == sum(counts[s] for s in r["members"])
        assert set(r["diff_set"].split(",")) == {c for s in r["members"] for c in s.split(",")}


def test_distance_of_sets():
    assert ds.set_distance(0b11, 0b11) == 0
    assert ds.set_distance(0b11, 0b01) == pytest.approx(1 * (1 + 4**0.5))
