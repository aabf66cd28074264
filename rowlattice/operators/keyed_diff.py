"""Keyed diff of two frames as Catalyst programs.

``paired`` joins both sides once on null-safe keys; sections, sets of
differing columns and all statistics are aggregates over that join, in long
form, so nothing but small summaries ever has to leave the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlattice.operators.versions import comparable, has_map, quoted
from rowlattice.plans.schema import assert_same
from rowlattice.session import materialize, maybe_broadcast

#: Distinct keys up to which histograms and enums stay exact in a summary.
EXACT_KEYS = 256
#: Significant bits kept of a number in a bounded histogram.
BITS = 7
#: Cells in a row of the sketch of strings that are not kept, and its rows: an
#: estimate is over by more than 0.001 of their rows with a chance of e ** -8.
SKETCH_WIDTH, SKETCH_ROWS = 2719, 8

_INTEGERS = (T.IntegerType, T.LongType)
_DOUBLES = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType)

STATISTIC = "struct<column:string,role:string,metric:string,key_str:string,key_other:string,key_long:bigint,key_double:double>"
ROLES = ("left", "right", "error", "pair")
GROUP = ["section", "diff_set", "column", "role", "metric"]


def one_per_key(df: DataFrame, keys: Sequence[str], marker: str) -> DataFrame:
    """Keys, one row of the others as struct ``marker``, and how many there were.

    Of several rows of a key the smallest is taken (nulls first), whatever the
    row order. The aggregate combines on the map side.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    others = [c for c in df.columns if c not in keys]
    values = F.struct(*([F.col(quoted(c)) for c in others] or [F.lit(True).alias("__any")]))
    rank = F.struct(*([comparable(c, kinds[c]).alias(f"r{i}") for i, c in enumerate(others)] or [F.lit(True).alias("r0")]))
    chosen = F.min_by(values, rank) if any(has_map(kinds[c]) for c in others) else F.min(values)
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(chosen.alias(marker), F.count(F.lit(1)).alias(f"{marker}_rows"))


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], *, partitions: int | None = None, unique: bool = False, strict_nullability: bool = False) -> DataFrame:
    """Full outer join of both sides: keys, structs ``l`` and ``r``, row counts.

    Keys match null-safely. ``unique`` skips the reduction to one row per key
    where the caller vouches for it; ``partitions`` fixes their number.
    """
    if not keys:
        raise ValueError("at least one key column is needed")
    assert_same(left.schema, right.schema, strict_nullability=strict_nullability)
    right = right.select(*[F.col(quoted(c)) for c in left.columns])
    sides = []
    for frame, marker in ((left, "l"), (right, "r")):
        if partitions:
            frame = frame.repartition(partitions, *[F.col(quoted(k)) for k in keys])
        if unique:
            others = [c for c in frame.columns if c not in keys]
            packed = frame.select(*[F.col(quoted(k)) for k in keys], F.struct(*([F.col(quoted(c)) for c in others] or [F.lit(True).alias("__any")])).alias(marker), F.lit(1).cast("bigint").alias(f"{marker}_rows"))
        else:
            packed = one_per_key(frame, keys, marker)
        sides.append(packed.select(*[F.col(quoted(k)).alias(f"{marker}_k{i}") for i, k in enumerate(keys)], marker, f"{marker}_rows"))
    on = None
    for i in range(len(keys)):
        same = F.col(f"l_k{i}").eqNullSafe(F.col(f"r_k{i}"))
        on = same if on is None else on & same
    joined = sides[0].join(sides[1], on, "full_outer")
    here = F.col("l_rows").isNotNull()
    names = [F.when(here, F.col(f"l_k{i}")).otherwise(F.col(f"r_k{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*names, "l", "r", "l_rows", "r_rows")


def _canonical(path: str, kind: T.DataType) -> Column:
    column = F.col(path)
    if isinstance(kind, T.MapType) and not has_map(kind.keyType) and not has_map(kind.valueType):
        return F.array_sort(F.map_entries(column))
    return F.to_json(F.struct(column)) if has_map(kind) else column


def equal(name: str, kind: T.DataType) -> Column:
    """Both null, or the same value; NaN differs from NaN."""
    a, b = (_canonical(f"{side}.{quoted(name)}", kind) for side in "lr")
    same = (a == b) & ~F.isnan(a) if isinstance(kind, _DOUBLES) else a == b
    return F.coalesce((a.isNull() & b.isNull()) | same, F.lit(False))


def compared_columns(frame: DataFrame) -> list[T.StructField]:
    return [f for f in frame.schema["l"].dataType.fields if f.name != "__any"]


def classified(pairs: DataFrame) -> DataFrame:
    """Add ``diff_set`` (names of differing columns) and ``section``."""
    unequal = [F.when(~equal(f.name, f.dataType), F.lit(f.name)) for f in compared_columns(pairs)]
    found = F.filter(F.array(*unequal), lambda x: x.isNotNull()) if unequal else F.array().cast("array<string>")
    both = F.col("l_rows").isNotNull() & F.col("r_rows").isNotNull()
    section = F.when(F.col("r_rows").isNull(), "outer_left").when(F.col("l_rows").isNull(), "outer_right").when(F.size("diff_set") == 0, "inner_equal").otherwise("inner_diff")
    return pairs.withColumn("diff_set", F.when(both, found).otherwise(F.array().cast("array<string>"))).withColumn("section", section)


def sections(classes: DataFrame) -> DataFrame:
    """Rows per section."""
    return classes.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def diff_sets(classes: DataFrame) -> DataFrame:
    """Rows of keys on both sides per set of differing columns (comma-joined, sorted)."""
    inner = classes.where(F.col("section") == "inner_diff")
    return inner.groupBy(F.array_join(F.array_sort("diff_set"), ",").alias("diff_set")).agg(F.count(F.lit(1)).alias("n"))


def duplicates(pairs: DataFrame) -> DataFrame:
    """Rows that stood behind another row of their key, per side."""
    extra = [F.sum(F.coalesce(F.col(f"{s}_rows") - 1, F.lit(0))).alias(n) for s, n in (("l", "left_rows"), ("r", "right_rows"))]
    return pairs.agg(*[F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(extra, ("left_extra_rows", "right_extra_rows"))])


def _fact(column: str, role: str, metric: str | Column, key_str=None, key_other=None, key_long=None, key_double=None) -> Column:
    parts = [F.lit(column), F.lit(role), metric if isinstance(metric, Column) else F.lit(metric)]
    kinds = ["string"] * 3 + ["string", "string", "bigint", "double"]
    parts += [F.lit(None) if x is None else x for x in (key_str, key_other, key_long, key_double)]
    names = ["column", "role", "metric", "key_str", "key_other", "key_long", "key_double"]
    return F.struct(*[p.cast(k).alias(n) for p, k, n in zip(parts, kinds, names)])


def millis(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint") * 86_400_000
    if isinstance(kind, T.TimestampNTZType):
        column = column.cast("timestamp")
    return F.unix_millis(column)


def describe_fact(column: Column, kind: T.DataType, name: str, role: str) -> Column:
    """What one value adds to the description of its column."""
    null = F.when(column.isNull(), _fact(name, role, "nNull"))
    if isinstance(kind, T.BooleanType):
        return null.otherwise(_fact(name, role, F.when(column, "nTrue").otherwise("nFalse")))
    if isinstance(kind, T.StringType):
        return null.otherwise(_fact(name, role, "value", key_str=column))
    if isinstance(kind, _INTEGERS):
        return null.otherwise(_fact(name, role, "value", key_long=column))
    if isinstance(kind, _DOUBLES):
        return null.otherwise(_fact(name, role, "value", key_double=column))
    if isinstance(kind, (T.DateType, *_TIMES)):
        return null.otherwise(_fact(name, role, "date" if isinstance(kind, T.DateType) else "timestamp", key_long=millis(column, kind)))
    if isinstance(kind, T.BinaryType):
        return null.otherwise(_fact(name, role, "length", key_long=F.length(column)))
    return null.otherwise(_fact(name, role, "nUnsupported"))


def error_fact(a: Column, b: Column, kind: T.DataType, name: str) -> Column:
    """What one unequal pair adds to the column's error: left minus right."""
    nulls = F.when(a.isNull(), _fact(name, "error", "rightToNull")).when(b.isNull(), _fact(name, "error", "leftToNull"))
    if isinstance(kind, T.BooleanType):
        return nulls.otherwise(_fact(name, "error", F.when(a, "tf").otherwise("ft")))
    if isinstance(kind, T.StringType):
        return nulls.otherwise(_fact(name, "error", "from_to", key_str=a, key_other=b))
    if isinstance(kind, _INTEGERS):
        gap = F.try_subtract(a.cast("bigint"), b.cast("bigint"))
        return nulls.otherwise(_fact(name, "error", F.when(gap.isNull(), "nUnsupported").otherwise("value"), key_long=gap))
    if isinstance(kind, _DOUBLES):
        return nulls.otherwise(_fact(name, "error", "value", key_double=a.cast("double") - b.cast("double")))
    if isinstance(kind, (T.DateType, *_TIMES)):
        metric = "date" if isinstance(kind, T.DateType) else "timestamp"
        return nulls.otherwise(_fact(name, "error", metric, key_long=millis(a, kind) - millis(b, kind)))
    if isinstance(kind, T.BinaryType):
        text = [F.decode(x, "ISO-8859-1") for x in (a, b)]
        return nulls.otherwise(_fact(name, "error", "levenshtein", key_long=F.levenshtein(*text)))
    return nulls.otherwise(_fact(name, "error", "nUnsupported"))


def statistics(classes: DataFrame, coarse: bool = False, label: Column | None = None, roles: Sequence[str] = ROLES) -> DataFrame:
    """All statistics in long form: one aggregate over the classified pairs.

    Only facts of the ``roles`` asked for are made and shuffled. Where counts
    are enough, :func:`column_deltas` and :func:`confusion` shuffle no values.

    ``coarse`` puts numbers into their buckets (:func:`bucket_floor`) before
    the aggregate, so that the shuffle is bounded for them as well; whole
    numbers below ``2 ** BITS`` and zero stay as they are. ``label`` takes the
    place of the joined ``diff_set``.

    Columns: section, diff_set, column, role (left, right, error or pair),
    metric, the key in one of ``key_str`` (and ``key_other``), ``key_long``
    and ``key_double``, and ``n``. Metrics of role pair are nEqual, nNotEqual.
    """
    facts = []
    for f in compared_columns(classes):
        a, b = F.col(f"l.{quoted(f.name)}"), F.col(f"r.{quoted(f.name)}")
        inner = F.col("section").startswith("inner")
        differs = F.array_contains("diff_set", f.name)
        made = {
            "left": F.when(F.col("l_rows").isNotNull(), describe_fact(a, f.dataType, f.name, "left")),
            "right": F.when(F.col("r_rows").isNotNull(), describe_fact(b, f.dataType, f.name, "right")),
            "error": F.when(inner & differs, error_fact(a, b, f.dataType, f.name)),
            "pair": F.when(inner, _fact(f.name, "pair", F.when(differs, "nNotEqual").otherwise("nEqual"))),
        }
        facts += [made[role] for role in roles]
    every = F.filter(F.array(*facts), lambda x: x.isNotNull()) if facts else F.array().cast(f"array<{STATISTIC}>")
    label = F.array_join(F.array_sort("diff_set"), ",") if label is None else label
    long_form = classes.select("section", label.alias("__label"), F.inline(every)).withColumnRenamed("__label", "diff_set")
    if coarse:
        number = F.coalesce(F.col("key_long").cast("double"), F.col("key_double"))
        rounded = F.when(F.isnan(number), number).otherwise(bucket_floor(number))
        long_form = long_form.withColumn("key_double", rounded).withColumn("key_long", F.lit(None).cast("bigint"))
    return long_form.groupBy(*GROUP, "key_str", "key_other", "key_long", "key_double").agg(F.count(F.lit(1)).alias("n"))


def by_column(stats: DataFrame) -> DataFrame:
    """Statistics of the inner part per column, over all sets of differences."""
    inner = stats.where(F.col("section").startswith("inner"))
    return inner.groupBy("column", "role", "metric", "key_str", "key_other", "key_long", "key_double").agg(F.sum("n").alias("n"))


def column_deltas(classes: DataFrame) -> DataFrame:
    """Equal and unequal pairs of each column: column, metric, n.

    Conditional counts in one pass over the pairs; no value is shuffled.
    """
    inner = classes.where(F.col("section").startswith("inner"))
    names = [f.name for f in compared_columns(classes)]
    differs = [F.array_contains("diff_set", name) for name in names]
    counted = inner.agg(*[F.count_if(x).alias(f"d{i}") for i, x in enumerate(differs)], *[F.count_if(~x).alias(f"e{i}") for i, x in enumerate(differs)])
    rows = [F.struct(F.lit(name).alias("column"), F.lit(metric).alias("metric"), F.col(f"{mark}{i}").alias("n")) for i, name in enumerate(names) for metric, mark in (("nNotEqual", "d"), ("nEqual", "e"))]
    flat = counted.select(F.inline(F.array(*rows) if rows else F.array().cast("array<struct<column:string,metric:string,n:bigint>>")))
    return flat.where("n > 0")


def confusion(classes: DataFrame) -> DataFrame:
    """tt, tf, ft and ff of each boolean column of the inner part: pairs by
    their values left and right, those with a null left out.

    Conditional counts in one pass over the pairs.
    """
    inner = classes.where(F.col("section").startswith("inner"))
    names = [f.name for f in compared_columns(classes) if isinstance(f.dataType, T.BooleanType)]
    marks = {"tt": (True, True), "tf": (True, False), "ft": (False, True), "ff": (False, False)}
    counts = [F.count_if((F.col(f"l.{quoted(name)}") == x) & (F.col(f"r.{quoted(name)}") == y)).alias(f"{mark}{i}") for i, name in enumerate(names) for mark, (x, y) in marks.items()]
    if not names:
        return inner.sparkSession.createDataFrame([], "column string, tt bigint, tf bigint, ft bigint, ff bigint")
    rows = [F.struct(F.lit(name).alias("column"), *[F.col(f"{mark}{i}").alias(mark) for mark in marks]) for i, name in enumerate(names)]
    return inner.agg(*counts).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """How often each value is there: value, n. Exact, of any size; null is a value."""
    return df.groupBy(F.col(quoted(value)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bucket_floor(column: Column, bits: int = BITS) -> Column:
    """The number with all but its leading ``bits`` bits cleared, towards zero.

    Numbers of one sign with the same result make a bucket whose width is at
    most ``2 ** (1 - bits)`` of its values; buckets of any two histograms agree.
    """
    size = F.abs(column.cast("double"))
    power = F.floor(F.log2(F.greatest(size, F.lit(1e-300))))
    step = F.pow(F.lit(2.0), power - (bits - 1))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.signum(column.cast("double")) * F.floor(size / step) * step)


def sketch_cells(key: str, other: str | None = None) -> list[int]:
    """The cells of a string or pair, one in each row of the sketch."""
    raw = key.encode(errors="replace")
    digest = hashlib.md5(b"%d:%b%b" % (len(raw), raw, (other or "").encode(errors="replace")), usedforsecurity=False).hexdigest()
    first, step = int(digest[:8], 16), 1 + int(digest[8:16], 16) % (SKETCH_WIDTH - 1)
    return [i * SKETCH_WIDTH + (first + i * step) % SKETCH_WIDTH for i in range(SKETCH_ROWS)]


def _cells() -> Column:
    """:func:`sketch_cells` of key_str and key_other."""
    digest = F.md5(F.concat(F.octet_length("key_str").cast("string"), F.lit(":"), F.col("key_str"), F.coalesce("key_other", F.lit(""))))
    first, step = (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    step = 1 + step % (SKETCH_WIDTH - 1)
    return F.array(*[(i * SKETCH_WIDTH + (first + i * step) % SKETCH_WIDTH).cast("int") for i in range(SKETCH_ROWS)])


def top_strings(rows: DataFrame, group: Sequence[str], most: int) -> DataFrame:
    """Add ``__top``: is the string one of the ``most`` most frequent of its group?

    Taken in two steps, so no task sees a whole group.
    """
    part = F.pmod(F.xxhash64("key_str", "key_other"), F.lit(64))
    order = [F.desc("n"), F.asc("key_str"), F.asc("key_other")]
    near = rows.withColumn("__part", part).withColumn("__near", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order)) <= most)
    # strings that are out already stay spread
    near = near.withColumn("__part", F.when(F.col("__near"), -1).otherwise(F.col("__part")))
    place = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    return near.withColumn("__top", F.col("__near") & (place <= most)).drop("__part", "__near")


def bounded(stats: DataFrame, exact_keys: int = EXACT_KEYS) -> DataFrame:
    """Statistics in bounded size: groups of many keys are made approximate.

    Adds ``is_large``, ``rest_keys`` and ``sketch``. A large numeric group
    keeps ``key_double`` = floor of the key's bucket (:func:`bucket_floor`). A
    large string group keeps its ``exact_keys`` most frequent keys and, in the
    inner part, those of its column over all sets, each with its exact count.
    All its other strings are one row without a key: ``n`` is their sum,
    ``rest_keys`` their number, and ``sketch`` has the cells (of
    :func:`sketch_cells`) that are not 0, whose least is no less than a
    string's count. The sum of ``n`` is that of ``stats``.
    """
    stats = materialize(stats)  # read several times below
    sizes = materialize(stats.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("__keys")).where(F.col("__keys") > exact_keys))
    on = None
    s, z = stats.alias("s"), maybe_broadcast(sizes, sizes.count(), 20_000).alias("z")
    for c in GROUP:
        same = F.col(f"s.{c}") == F.col(f"z.{c}")
        on = same if on is None else on & same
    marked = s.join(z, on, "left").select("s.*", F.col("z.__keys").isNotNull().alias("is_large"))
    keys = ["key_str", "key_other", "key_long", "key_double"]
    small = marked.where("not is_large")
    numbers = marked.where(F.col("is_large") & F.col("key_str").isNull())
    value = F.coalesce(F.col("key_long").cast("double"), F.col("key_double"))
    coarse = numbers.withColumn("key_double", F.when(F.isnan(value), value).otherwise(bucket_floor(value))).withColumn("key_long", F.lit(None).cast("bigint"))
    coarse = coarse.groupBy(*GROUP, *keys, "is_large").agg(F.sum("n").alias("n"))
    columns = [*GROUP, *keys, "n", "is_large"]
    exact = small.select(*columns).union(coarse.select(*columns))
    exact = exact.withColumn("rest_keys", F.lit(None).cast("bigint")).withColumn("sketch", F.lit(None).cast("array<struct<cell:int,n:bigint>>"))
    return exact.union(_bounded_strings(stats, marked, exact_keys).select(*exact.columns))


def _bounded_strings(stats: DataFrame, marked: DataFrame, exact_keys: int) -> DataFrame:
    """The large string groups of :func:`bounded`."""
    over = ["column", "role", "metric"]
    inner = stats.where(F.col("section").startswith("inner") & F.col("key_str").isNotNull())
    merged = top_strings(inner.groupBy(*over, "key_str", "key_other").agg(F.sum("n").alias("n")), over, exact_keys).where("__top")
    frequent = merged.select(*[F.col(c).alias(f"__{c}") for c in [*over, "key_str", "key_other"]], F.lit(True).alias("__frequent"))
    ranked = top_strings(marked.where(F.col("is_large") & F.col("key_str").isNotNull()), GROUP, exact_keys)
    on = F.col("section").startswith("inner") & F.col("key_other").eqNullSafe(F.col("__key_other"))
    for c in [*over, "key_str"]:
        on &= F.col(c) == F.col(f"__{c}")
    kept = F.col("__top") | F.col("__frequent").isNotNull()
    cells = F.when(kept, F.array(F.lit(None).cast("int"))).otherwise(_cells())
    flat = ranked.join(frequent, on, "left").select(*GROUP, *[F.when(kept, F.col(c)).alias(c) for c in ("key_str", "key_other")], "n", F.explode(cells).alias("cell"))
    # combined on the map side: what is not kept is a number of cells
    summed = flat.groupBy(*GROUP, "key_str", "key_other", "cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("__keys"))
    once = F.col("cell") < SKETCH_WIDTH
    sketch = F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "n")))
    packed = summed.groupBy(*GROUP, "key_str", "key_other").agg(F.sum(F.when(F.col("cell").isNull() | once, F.col("n"))).alias("__n"), F.sum(F.when(once, F.col("__keys"))).alias("rest_keys"), F.array_sort(sketch).alias("sketch"))
    rest = F.col("rest_keys").isNotNull()
    return packed.select("*", F.col("__n").alias("n"), F.lit(None).cast("bigint").alias("key_long"), F.lit(None).cast("double").alias("key_double"), F.lit(True).alias("is_large")).withColumn("sketch", F.when(rest, F.col("sketch")))


def bins(values: DataFrame, value: str, count: int, min_step: float, weight: str | None = None) -> DataFrame:
    """``count`` equal bins between least and greatest value: centre and n.

    The centres begin at the least value and are ``max((max - min) / (count -
    1), min_step)`` apart; a bin takes what lies within half a step, its upper
    end included. No values, no bins; empty bins are there with 0.
    """
    plain = values.select(F.col(value).cast("double").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("w")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high = plain.agg(F.min("v"), F.max("v")).first()
    spark = values.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, centre double, n bigint")
    step = max((high - low) / max(1, count - 1), float(min_step))
    place = F.greatest(F.lit(0), F.ceil((F.col("v") - F.lit(low)) / F.lit(step) - 0.5)).cast("int")
    counted = plain.groupBy(place.alias("bin")).agg(F.sum("w").alias("n"))
    frame = spark.range(count).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * F.lit(step)).alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))
