"""Differences between two copies of a dataset.

Set reconciliation by characteristic polynomials. Each side is a set of row
hashes in GF(2**61 - 1), split over buckets by key. A side sends, for each
bucket, the values of its characteristic polynomial at a few points and no
rows. The quotient of both sides' values is a rational function whose
numerator and denominator have the differing row hashes as their roots; it is
interpolated for a bound on the degree that doubles until the function is
verified at points not used to find it. Each side then looks up which of its
own hashes are roots, and only those rows are fetched and compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators import finite_field as gf
from rowlattice.operators.versions import comparable, latest_lines, quoted, row_hash
from rowlattice.session import materialize, maybe_broadcast, ship_package

#: Points beyond the degree bound, kept to verify what the others give.
CHECK_POINTS = 2
#: Buckets solved by one task, about.
SOLVED_BY_TASK = 20_000
#: Polynomials of buckets with differences that are broadcast at most.
BROADCAST_POLYNOMIALS = 100_000
#: Rows times points evaluated at once.
BLOCK_VALUES = 1 << 19

_EVALUATED = "bucket bigint, is_left boolean, n bigint, points array<bigint>"
_SOLVED = "bucket bigint, verified boolean, left_poly array<bigint>, right_poly array<bigint>"


def _runs(sorted_ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1])) if len(sorted_ids) else np.zeros(0, np.int64)


def points_of(degree: int) -> tuple[int, ...]:
    """The points of a degree bound; no bound that is twice another has any of the other's.

    A point that is the hash of a row tells nothing of its bucket: then the
    next round does.
    """
    return gf.sample_points(degree + CHECK_POINTS, 4 * degree)


def evaluate(batches: Iterator[pa.RecordBatch], degree: int, is_left: bool) -> Iterator[pa.RecordBatch]:
    """Values of the characteristic polynomial of each run of a bucket."""
    z = np.array(points_of(degree), np.uint64)
    rows = max(1, BLOCK_VALUES // len(z))
    for batch in batches:
        buckets = batch.column(0).to_numpy(zero_copy_only=False)
        hashes = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(buckets), rows):
            b, x = buckets[at : at + rows], hashes[at : at + rows]
            starts = _runs(b)
            values = gf.segment_products(gf.sub(z[None, :], x[:, None]), starts)
            flat = pa.array(values.astype(np.int64).ravel())
            offsets = pa.array(np.arange(0, values.size + 1, len(z), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[starts]), pa.array(np.full(len(starts), is_left)), pa.array(np.diff(np.append(starts, len(b)))), pa.ListArray.from_arrays(offsets, flat)],
                names=["bucket", "is_left", "n", "points"],
            )


@lru_cache(maxsize=8)
def _interpolator(degree: int) -> gf.Interpolator:
    return gf.Interpolator(points_of(degree)[:degree])


def solve_bucket(left: list[int], right: list[int], excess: int, degree: int) -> tuple[list[int], list[int]] | None:
    """Polynomials of the hashes on one side only, or None: not verified."""
    if excess == 0 and left == right:
        return [1], [1]
    if abs(excess) >= degree or 0 in left or 0 in right:
        return None
    quotients = [a * pow(b, -1, gf.P) % gf.P for a, b in zip(left[:degree], right[:degree])]
    found = _interpolator(degree).rational(quotients, excess)
    if found is None:
        return None
    for z, a, b in zip(points_of(degree)[degree:], left[degree:], right[degree:]):
        if gf.poly_at(found[0], z) * b % gf.P != gf.poly_at(found[1], z) * a % gf.P:
            return None
    return found


def solve(batches: Iterator[pa.RecordBatch], degree: int) -> Iterator[pa.RecordBatch]:
    """Solve each bucket; in: partial values of both sides, sorted by bucket.

    A degree above the number of a bucket's rows is enough for it; one that is
    not verified at four times that has its hashes on the points of several
    rounds, which is an error.
    """
    width = degree + CHECK_POINTS
    state: dict = {}

    def flush() -> tuple:
        left, right = state[True], state[False]
        found = solve_bucket(left[1], right[1], left[0] - right[0], degree)
        if found is None and degree > 4 * (left[0] + right[0]) + 64:
            raise RuntimeError(f"bucket {state['bucket']} has row hashes among the points of several rounds")
        return (state["bucket"], found is not None, *(found or ([], [])))

    def fresh(bucket: int) -> dict:
        return {"bucket": bucket, True: [0, [1] * width], False: [0, [1] * width]}

    for batch in batches:
        out = []
        points = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for bucket, is_left, n, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), points.tolist()):
            if state.get("bucket") != bucket:
                if state:
                    out.append(flush())
                state = fresh(bucket)
            side = state[is_left]
            side[1] = values if side[0] == 0 else [a * b % gf.P for a, b in zip(side[1], values)]
            side[0] += n
        if out:
            yield _solved(out)
    if state:
        yield _solved([flush()])


def _solved(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "verified", "left_poly", "right_poly"])


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose hash (column 0) is a root of the polynomial (column 1)."""
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        offsets, flat = offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        length = np.diff(offsets)
        total = np.zeros(len(x), np.uint64)
        for power in range(int(length.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero(length > power)
            total[live] = gf.add(gf.mul(total[live], x[live]), flat[offsets[live] + power])
        keep = np.flatnonzero((total == 0) & (length > 1))
        if len(keep):
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in batch.columns[2:]], names=batch.schema.names[2:])


def _canonical(name: str, kind: T.DataType, tolerance: float | None) -> Column:
    """What enters the hash: equal in this form means equal in the comparison."""
    column = comparable(name, kind)
    if tolerance and isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(column.cast("double") / F.lit(tolerance / 10)) + F.lit(0.0)
    return column


def _differs(left: Column, right: Column, kind: T.DataType, tolerance: float | None) -> Column:
    unequal = ~left.eqNullSafe(right)
    if tolerance and isinstance(kind, (T.DoubleType, T.FloatType)):
        close = F.abs(left.cast("double") - right.cast("double")) <= F.lit(tolerance)
        return unequal & ~F.coalesce(close & ~F.isnan(left) & ~F.isnan(right), F.lit(False))
    return unequal


def reconcile(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: Sequence[str],
    *,
    order: str | None = None,
    normalise_key=None,
    tolerances: Mapping[str, float] | None = None,
    bucket_rows: int = 16,
    first_degree: int = 8,
) -> DataFrame:
    """Keys missing on a side, and the differing fields of keys on both.

    Returns ``key`` and ``difference``: ``left_only``, ``right_only`` or the
    name of a field; a key has one row per differing field.

    Defined results: ``normalise_key`` (a function of a column) is applied to
    the key first and equal results are one record; rows whose key is then
    null are ignored; of several rows of a key the greatest ``order`` is
    valid (then the greatest fields), so repeated rows count once; null equals
    null only and NaN equals NaN only; numbers no further apart than their
    tolerance are equal; two empty tables give no rows, and an empty side
    makes every key of the other missing. Other columns are ignored. Both
    sides must have the key and the fields, of the same types.
    """
    spark = left.sparkSession
    ship_package(spark)
    tolerances = dict(tolerances or {})
    kinds = {f.name: f.dataType for f in left.schema.fields}
    theirs = {f.name: f.dataType for f in right.schema.fields}
    for name in [key, *fields]:
        if kinds[name] != theirs[name]:
            raise TypeError(f"{name} is {kinds[name].simpleString()} on the left and {theirs[name].simpleString()} on the right")
    # a whole number of buckets in each partition of the shuffle by key
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_each = min(-(-max(left.count(), right.count()) // (bucket_rows * partitions)), (1 << 30) // partitions)
    buckets = partitions * max(1, in_each)
    names = [f"f{i}" for i in range(len(fields))]

    def prepared(side: DataFrame) -> DataFrame:
        column = F.col(quoted(key))
        wanted = side.select((normalise_key(column) if normalise_key else column).alias("key"), (F.col(quoted(order)) if order else F.lit(0)).alias("o"), *[F.col(quoted(c)).alias(n) for n, c in zip(names, fields)])
        valid = latest_lines(wanted.where(F.col("key").isNotNull()), ["key"], "o", names)
        parts = [F.col("key"), *[_canonical(n, kinds[c], tolerances.get(c)) for n, c in zip(names, fields)]]
        reduced = F.shiftrightunsigned(row_hash(parts, 5), 3)
        # the hash that placed the key: its bucket is where its row is already
        hashed = valid.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets)).cast("bigint"))
        hashed = hashed.withColumn("h", F.when(reduced == gf.P, F.lit(0).cast("bigint")).otherwise(reduced))
        return materialize(hashed.sortWithinPartitions("bucket"))

    sides = {True: prepared(left), False: prepared(right)}
    solved, open_buckets, open_count, degree = [], None, buckets, first_degree
    while True:
        values = []
        for is_left, rows in sides.items():
            part = rows.select("bucket", "h")
            if open_buckets is not None:
                part = part.join(open_buckets, "bucket", "left_semi").select("bucket", "h").sortWithinPartitions("bucket")
            values.append(part.mapInArrow(lambda it, d=degree, s=is_left: evaluate(it, d, s), _EVALUATED))
        # few bytes but much to compute: a number of tasks that is not joined into fewer
        tasks = max(spark.sparkContext.defaultParallelism, -(-open_count // SOLVED_BY_TASK))
        gathered = values[0].union(values[1]).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        result = materialize(gathered.mapInArrow(lambda it, d=degree: solve(it, d), _SOLVED))
        solved.append(result.where("verified"))
        left_over = result.where("not verified").select("bucket")
        remaining = left_over.count()
        if not remaining:
            break
        open_buckets, open_count, degree = maybe_broadcast(left_over, remaining), remaining, degree * 2

    polynomials = solved[0]
    for more in solved[1:]:
        polynomials = polynomials.union(more)
    found = {}
    for is_left, rows in sides.items():
        poly = polynomials.select("bucket", F.col("left_poly" if is_left else "right_poly").alias("poly")).where(F.size("poly") > 1)
        wanted = T.StructType([f for f in rows.schema.fields if f.name in ("bucket", "h", "key", *names)])
        found[is_left] = _with_roots(rows, poly, wanted).select("key", *names)
    a, b = found[True].alias("a").withColumn("here", F.lit(True)), found[False].alias("b").withColumn("there", F.lit(True))
    a = a.select("key", "here", *[F.col(n).alias(f"a{n}") for n in names])
    b = b.select("key", "there", *[F.col(n).alias(f"b{n}") for n in names])
    both = a.join(b, "key", "full_outer")
    changed = [F.when(_differs(*_pair(n, kinds[c]), kinds[c], tolerances.get(c)), F.lit(c)) for n, c in zip(names, fields)]
    kind = F.when(F.col("there").isNull(), F.array(F.lit("left_only"))).when(F.col("here").isNull(), F.array(F.lit("right_only"))).otherwise(F.filter(F.array(*changed) if changed else F.array().cast("array<string>"), lambda x: x.isNotNull()))
    return both.select(F.col("key"), F.explode(kind).alias("difference")).withColumnRenamed("key", key)


def _with_roots(rows: DataFrame, poly: DataFrame, wanted: T.StructType) -> DataFrame:
    """The rows whose hash is a root of their bucket's polynomial."""

    def looked_up(kind: T.StructType, poly: DataFrame) -> DataFrame:
        joined = rows.join(poly, "bucket").select(F.col("h").alias("__h"), "poly", *[quoted(f.name) for f in kind.fields])
        return joined.mapInArrow(roots, kind)

    count = poly.count()
    if count <= BROADCAST_POLYNOMIALS:
        return looked_up(wanted, F.broadcast(poly))
    # only hashes are shuffled to find which rows they are
    few = materialize(looked_up(T.StructType([wanted["bucket"], wanted["h"]]), poly).distinct())
    return rows.join(maybe_broadcast(few, few.count()), ["bucket", "h"], "left_semi").select(*[quoted(f.name) for f in wanted.fields])


def _pair(name: str, kind: T.DataType) -> tuple[Column, Column]:
    return comparable(f"a{name}", kind), comparable(f"b{name}", kind)


def summary(differences: DataFrame, key: str) -> DataFrame:
    """Keys per kind of difference, and ``rows_not_equal`` in all for keys on both sides."""
    kinds = differences.groupBy("difference").agg(F.count(F.lit(1)).alias("n_keys"))
    both = differences.where(~F.col("difference").isin("left_only", "right_only"))
    return kinds.union(both.select(quoted(key)).distinct().agg(F.lit("rows_not_equal"), F.count(F.lit(1))))
