"""Snapshot changes, coalesced history and reconciliation against brute force."""

import math
import random

import pytest

from rowlattice.operators import finite_field as gf
from rowlattice.operators.history import coalesced_history
from rowlattice.operators import reconcile as rc
from rowlattice.operators.reconcile import points_of, reconcile, solve_bucket, summary
from rowlattice.operators.snapshot_changes import snapshot_changes

SCHEMA = "id int, d string, a string, b int, o int, pair string, change_kind string"


def lines(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def valid(rows):
    best = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        rank = tuple((x is not None, x) for x in (r[4], r[2], r[3]))
        if r[:2] not in best or rank > best[r[:2]][0]:
            best[r[:2]] = (rank, r[2:4])
    return {k: v[1] for k, v in best.items()}


def brute_changes(rows):
    state, dumps = valid(rows), sorted({r[1] for r in rows if r[1] is not None})
    out = set()
    for old, new in zip(dumps, dumps[1:]):
        for key in {k[0] for k in state}:
            a, b = state.get((key, old)), state.get((key, new))
            if a != b:
                out.add((key, new, "added" if a is None else "removed" if b is None else "changed"))
    return out


def brute_history(rows):
    state, dumps = valid(rows), sorted({r[1] for r in rows if r[1] is not None})
    out = set()
    for key in {k[0] for k in state}:
        run = None
        for d in [*dumps, None]:
            now = state.get((key, d))
            if run and run[0] != now:
                out.add((key, *run[0], run[1], run[2]))
                run = None
            if now is not None:
                run = (now, run[1] if run else d, d)
    return out


def random_rows(seed, n_ids=60, dumps=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n_ids):
        a, b = rng.choice(["x", "y", None, ""]), rng.choice([1, 2, None])
        for d in range(dumps):
            if rng.random() < 0.2:
                a, b = rng.choice(["x", "y", None, ""]), rng.choice([1, 2, None])
            for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3])):
                rows.append((i, f"d{d}", a, b, rng.choice([None, 1, 2])))
    rows += [(None, "d1", "x", 1, 1), (None, None, None, None, None), (3, None, "x", 1, 1)]
    rows += [(7, "d2", "x", 2, 1)] * (len(rows) // 2)  # a third of all rows is one key's
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk_keys", [1, 16])
def test_changes_match_brute_force(spark, seed, chunk_keys):
    rows = random_rows(seed)
    got = snapshot_changes(lines(spark, rows), ["id"], "d", ["a", "b"], order="o", chunk_keys=chunk_keys).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_changes(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_history_matches_brute_force(spark, seed):
    rows = random_rows(seed)
    got = coalesced_history(lines(spark, rows), ["id"], "d", ["a", "b"], order="o").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_history(rows)


def test_changes_of_many_snapshots(spark):
    """50,000 snapshots, few keys in each: memory follows the rows there are."""
    schema = "id int, d int, a string, b int, o int, pair string, change_kind string"
    rows = [(i, d, "x", d // 10_000, 1) for i in range(3) for d in range(i, 50_000, 500 + i)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = {tuple(r) for r in snapshot_changes(frame, ["id"], "d", ["a", "b"], versions=list(range(50_000)), chunk_keys=1000).collect()}
    there = {r[:2] for r in rows}
    wanted = {(i, d, "added") for i, d in there if d and (i, d - 1) not in there} | {(i, d + 1, "removed") for i, d in there if d < 49_999 and (i, d + 1) not in there}
    assert got == wanted


def test_a_cut_without_a_chunk_border_changes_nothing(spark, monkeypatch):
    from rowlattice.operators import snapshot_changes as sc

    rows = random_rows(9, 400)
    monkeypatch.setattr(sc, "MAX_OPEN_ROWS", 50)
    found = set()
    table = None
    import pyarrow as pa

    def batches():
        for at in range(0, table.num_rows, 20):
            yield table.slice(at, 20)

    state = valid(rows)
    keys = sorted(state)
    table = pa.RecordBatch.from_arrays([pa.array([k[0] * 7919 + 1 for k in keys], pa.int64()), pa.array([int(k[1][1:]) for k in keys], pa.int32()), *[pa.array([hash((seed, k[0], state[k])) for k in keys], pa.int64()) for seed in (1, 2)], pa.array([k[0] for k in keys], pa.int32())], names=["__key", "__ord", "__h1", "__h2", "k0"])
    for batch in sc.changed_rows(batches(), 7, 1 << 40):
        found |= {(r["k0"], f"d{r['pair']}", sc.KINDS[r["kind"]]) for r in batch.to_pylist()}
    assert found == brute_changes(rows)


def test_changes_are_shuffled_twice(spark):
    frame = snapshot_changes(lines(spark, random_rows(5)), ["id"], "d", ["a", "b"], order="o", versions=[f"d{i}" for i in range(7)])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "rangepartitioning" not in plan


def test_history_shuffles_once_after_validity(spark):
    frame = coalesced_history(lines(spark, random_rows(5)), ["id"], "d", ["a", "b"], order="o", versions=[f"d{i}" for i in range(7)])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("rows", [[], [(1, "d1", "x", 1, 1)], [(None, "d1", "x", 1, 1)]])
def test_snapshots_of_little(spark, rows):
    frame = lines(spark, rows)
    assert snapshot_changes(frame, ["id"], "d", ["a", "b"]).collect() == []
    assert {tuple(r) for r in coalesced_history(frame, ["id"], "d", ["a", "b"]).collect()} == brute_history(rows)


def test_maps_and_nan_in_the_payload(spark):
    frame = spark.createDataFrame([(1, "d1", float("nan"), {"k": 1}), (1, "d2", float("nan"), {"k": 1}), (1, "d3", 1.0, {"k": 2})], "id int, d string, x double, m map<string,int>")
    assert [tuple(r) for r in snapshot_changes(frame, ["id"], "d", ["x", "m"]).collect()] == [(1, "d3", "changed")]
    kept = coalesced_history(frame, ["id"], "d", ["x", "m"]).orderBy("mindt").collect()
    assert [(r["m"], r["mindt"], r["maxdt"]) for r in kept] == [({"k": 1}, "d1", "d2"), ({"k": 2}, "d3", "d3")]


def test_field_arithmetic():
    import numpy as np

    rng = random.Random(5)
    a, b = ([rng.randrange(gf.P) for _ in range(500)] + [0, 1, gf.P - 1, gf.P - 1] for _ in range(2))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert gf.mul(x, y).tolist() == [i * j % gf.P for i, j in zip(a, b)]
    assert gf.sub(x, y).tolist() == [(i - j) % gf.P for i, j in zip(a, b)]
    assert gf.add(x, y).tolist() == [(i + j) % gf.P for i, j in zip(a, b)]
    starts = np.array([0, 1, 8, 300])
    wanted = [math.prod(a[i:j]) % gf.P for i, j in zip([0, 1, 8, 300], [1, 8, 300, 504])]
    assert gf.segment_products(x[:, None], starts)[:, 0].tolist() == wanted


@pytest.mark.parametrize(("here", "there"), [(0, 0), (3, 0), (0, 4), (2, 5), (6, 6)])
def test_bucket_is_solved_once_the_degree_suffices(here, there):
    rng = random.Random(here * 10 + there)
    shared, left, right = ([rng.randrange(gf.P) for _ in range(n)] for n in (12, here, there))
    for degree in (4, 8, 16):
        points = points_of(degree)
        values = [[math.prod(z - x for x in side) % gf.P for z in points] for side in (shared + left, shared + right)]
        found = solve_bucket(*values, here - there, degree)
        if found is None:
            assert here + there >= degree
            continue
        for poly, roots in zip(found, (left, right)):
            assert len(poly) - 1 == len(roots)
            assert all(gf.poly_at(poly, x) == 0 for x in roots)
        return
    raise AssertionError("never solved")


def test_a_row_hash_among_the_points_is_solved_in_the_next_round():
    point = points_of(8)[3]
    for degree, solved in ((8, False), (16, True)):
        values = [[math.prod(z - x for x in xs) % gf.P for z in points_of(degree)] for xs in ([point, 5, 7], [5])]
        assert (solve_bucket(*values, 2, degree) is not None) == solved
    assert not set(points_of(8)) & set(points_of(16)) and not set(points_of(16)) & set(points_of(32))


def test_the_doubling_ends():
    import pyarrow as pa

    width = len(points_of(128))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([True]), pa.array([3]), pa.array([[0] * width])], names=["bucket", "is_left", "n", "points"])
    with pytest.raises(RuntimeError, match="several rounds"):
        list(rc.solve(iter([batch]), 128))


SIDE = "key string, value int, amount double, o int, difference string"


def side(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], SIDE)


def brute_differences(left, right, tolerance=1e-6):
    def kept(rows):
        best = {}
        for key, value, amount, o in rows:
            if key is not None:
                rank = tuple((x is not None, x) for x in (o, value, amount))
                k = key.strip().upper()
                if k not in best or rank > best[k][0]:
                    best[k] = (rank, value, amount)
        return best

    a, b = kept(left), kept(right)
    out = set()
    for k in a.keys() | b.keys():
        if k not in b or k not in a:
            out.add((k, "left_only" if k in a else "right_only"))
            continue
        if a[k][1] != b[k][1]:
            out.add((k, "value"))
        x, y = a[k][2], b[k][2]
        if x is None or y is None:
            if x is not y:
                out.add((k, "amount"))
        elif not (x == y or math.isnan(x) and math.isnan(y) or abs(x - y) <= tolerance):
            out.add((k, "amount"))
    return out


def compared(spark, left, right, **more):
    from pyspark.sql import functions as F

    return reconcile(side(spark, left), side(spark, right), "key", ["value", "amount"], order="o", normalise_key=lambda k: F.upper(F.trim(k)), tolerances={"amount": 1e-6}, **more)


@pytest.mark.parametrize("bucket_rows", [1, 16, 10_000])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_reconcile_matches_brute_force(spark, bucket_rows, broadcast, monkeypatch):
    monkeypatch.setattr(rc, "BROADCAST_POLYNOMIALS", broadcast)
    rng = random.Random(bucket_rows)
    amounts = [1.5, None, float("nan"), 0.0, -0.0, 1e15]
    left, right = [], []
    for i in range(300):
        value, amount = rng.choice([1, 2, None]), rng.choice(amounts)
        key = rng.choice([f"k{i}", f" K{i} "])
        if rng.random() < 0.95:
            left.append((key, value, amount, 2))
        if rng.random() < 0.95:
            if rng.random() < 0.1:
                value = rng.choice([1, 2, 3, None])
            if amount is not None and rng.random() < 0.3:
                amount += rng.choice([1e-9, 5e-7, 1e-3])
            right.append((f"k{i}", value, amount, 2))
            right.append((f"k{i}", 99, 99.0, 1))
    left += [(None, 1, 1.0, 1)] * 3 + [left[0]] * 200
    found = compared(spark, left, right, bucket_rows=bucket_rows)
    got = found.collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_differences(left, right)
    counted = {r["difference"]: r["n_keys"] for r in summary(found, "key").collect()}
    assert counted["rows_not_equal"] == len({k for k, d in brute_differences(left, right) if d in ("value", "amount")})


@pytest.mark.parametrize(("left", "right"), [([], []), ([("a", 1, 1.0, 1)], []), ([], [("a", 1, 1.0, 1), ("b", 1, 1.0, 1)]), ([("a", 1, 1.0, 1)], [("A ", 1, 1.0, None)])])
def test_reconcile_of_little(spark, left, right):
    assert {tuple(r) for r in compared(spark, left, right).collect()} == brute_differences(left, right)


def test_reconcile_refuses_other_types(spark):
    with pytest.raises(TypeError, match="value"):
        reconcile(side(spark, []), spark.createDataFrame([], "key string, value string"), "key", ["value"])
