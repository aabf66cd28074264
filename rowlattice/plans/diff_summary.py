"""The collected summary of a keyed diff: structure, JSON, constraints, report."""

from __future__ import annotations

import json
import math
import random
import shutil
from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlattice.operators import keyed_diff as kd
from rowlattice.session import materialize, ship_package

#: Sets of differing columns that a summary keeps apart.
MAX_SETS = 128
#: Sets that are told apart before they are merged into these.
LISTED_SETS = 2_000


@dataclass
class Histogram:
    """Numbers and how often each was seen.

    A large one holds for each key all numbers of its bucket, from the key
    (included) away from zero up to the next key of ``BITS`` leading bits.
    """

    values: dict[float, int] = field(default_factory=dict)
    large: bool = False
    whole: bool = True

    @property
    def count(self) -> int:
        return sum(self.values.values())

    def _sorted(self) -> list[tuple[float, int]]:
        return sorted(self.values.items())

    def span(self, key: float) -> tuple[float, float]:
        """The least and greatest number that a key may stand for."""
        if not self.large or key == 0:
            return key, key
        step = 2.0 ** (math.floor(math.log2(abs(key))) - (kd.BITS - 1))
        far = abs(key) + step
        return (key, far) if key > 0 else (-far, key)

    @property
    def min(self) -> float:
        return self.span(self._sorted()[0][0])[0]

    @property
    def max(self) -> float:
        return self.span(self._sorted()[-1][0])[1]

    def quantile_bounds(self, p: float) -> tuple[float, float]:
        """Numbers between which the p-quantile lies; equal if exact."""
        ranked = self._sorted()
        if not ranked:
            raise ValueError("no values")
        ends, total = [], 0
        for _, n in ranked:
            total += n
            ends.append(total)
        rank = min(int(math.floor(p * total)), total - 1)
        return self.span(ranked[bisect_right(ends, rank)][0])

    def bins(self, n: int) -> list[tuple[float, int]]:
        """(centre, count) of ``n`` equal bins; a number on an edge is in the lower."""
        ranked = self._sorted()
        if not ranked or n < 1:
            return []
        low, high = ranked[0][0], ranked[-1][0]
        step = max((high - low) / max(1, n - 1), 1.0 if self.whole else 0.01)
        counts = [0] * n
        for key, times in ranked:
            counts[min(n - 1, max(0, math.ceil((key - low) / step - 0.5)))] += times
        return [(low + i * step, c) for i, c in enumerate(counts)]

    def merged(self, other: Histogram) -> Histogram:
        return Histogram(_added(self.values, other.values), self.large or other.large, self.whole and other.whole)


@dataclass
class Enum:
    """Strings, or (left, right) pairs of them, and how often each was seen.

    A large one keeps the most frequent; of the others it has ``rest``, how
    often they were seen, ``rest_keys``, how many they are (those of merged
    enums counted in each), and the ``cells`` of their sketch. ``mixed``: a
    kept string may be among the others too.
    """

    values: dict = field(default_factory=dict)
    large: bool = False
    rest: int = 0
    rest_keys: int = 0
    cells: dict[int, int] = field(default_factory=dict)
    mixed: bool = False

    @property
    def total(self) -> int:
        return sum(self.values.values()) + self.rest

    def estimate(self, key) -> int:
        """The count of a key, or more if large and not kept; unknown and not large, an error."""
        if key in self.values and not self.mixed:
            return self.values[key]
        if self.large:
            places = kd.sketch_cells(*key) if isinstance(key, tuple) else kd.sketch_cells(key)
            return self.values.get(key, 0) + min(self.cells.get(i, 0) for i in places)
        return self.values[key]

    def heavy_hitters(self, n: int = 256) -> list:
        return sorted(self.values.items(), key=lambda x: (-x[1], x[0]))[:n]

    def add(self, key, n: int = 1) -> Enum:
        return Enum(_added(self.values, {key: n}), self.large, self.rest, self.rest_keys, self.cells, self.mixed or bool(self.rest and key not in self.values))

    def merged(self, other: Enum) -> Enum:
        mixed = self.mixed or other.mixed or bool(self.rest or other.rest)
        return Enum(_added(self.values, other.values), self.large or other.large, self.rest + other.rest, self.rest_keys + other.rest_keys, _added(self.cells, other.cells), mixed)


def _added(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + v
    return out


@dataclass
class Describe:
    """Summary of the values of a column."""

    count: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    histograms: dict[str, Histogram] = field(default_factory=dict)
    enums: dict[str, Enum] = field(default_factory=dict)

    def merged(self, other: Describe) -> Describe:
        def joined(a: dict, b: dict) -> dict:
            return {k: a[k].merged(b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}

        return Describe(self.count + other.count, _added(self.counts, other.counts), joined(self.histograms, other.histograms), joined(self.enums, other.enums))

    @property
    def empty(self) -> bool:
        return not (self.count or self.counts or self.histograms or self.enums)


@dataclass
class Delta:
    """Summary of the pairs of values of a column."""

    n_equal: int = 0
    n_not_equal: int = 0
    left: Describe = field(default_factory=Describe)
    right: Describe = field(default_factory=Describe)
    error: Describe = field(default_factory=Describe)

    def merged(self, other: Delta) -> Delta:
        return Delta(self.n_equal + other.n_equal, self.n_not_equal + other.n_not_equal, self.left.merged(other.left), self.right.merged(other.right), self.error.merged(other.error))

    @property
    def as_boolean(self) -> dict[str, int]:
        """Pairs by their values left and right, where nulls are not involved."""
        tf, ft = self.error.counts.get("tf", 0), self.error.counts.get("ft", 0)
        tt = self.left.counts.get("nTrue", 0) - tf
        return {"tt": tt, "tf": tf, "ft": ft, "ff": self.n_equal - tt}


@dataclass
class DeltaByRow:
    count: int = 0
    by_column: dict[str, Delta] = field(default_factory=dict)

    def merged(self, other: DeltaByRow) -> DeltaByRow:
        names = [*self.by_column, *(c for c in other.by_column if c not in self.by_column)]
        return DeltaByRow(self.count + other.count, {c: self.by_column.get(c, Delta()).merged(other.by_column.get(c, Delta())) for c in names})


@dataclass
class DescribeByRow:
    count: int = 0
    by_column: dict[str, Describe] = field(default_factory=dict)


@dataclass
class DiffSummary:
    """Everything a keyed diff found, small enough for one machine."""

    rows_equal: int = 0
    by_set: dict[frozenset, DeltaByRow] = field(default_factory=dict)
    equal_rows: DescribeByRow = field(default_factory=DescribeByRow)
    left_only: DescribeByRow = field(default_factory=DescribeByRow)
    right_only: DescribeByRow = field(default_factory=DescribeByRow)
    sources: dict[str, list[str]] = field(default_factory=lambda: {"left": [], "right": []})
    columns: list[str] = field(default_factory=list)

    @property
    def rows_not_equal(self) -> int:
        return sum(d.count for d in self.by_set.values())

    @property
    def by_column(self) -> dict[str, Delta]:
        """Deltas of the inner part over all sets, equal rows included."""
        out: dict[str, Delta] = {}
        for c, d in self.equal_rows.by_column.items():
            out[c] = Delta(self.equal_rows.count, 0, d, d)
        for one in self.by_set.values():
            for c, delta in one.by_column.items():
                out[c] = out.get(c, Delta()).merged(delta)
        return out


def summarise(classes: DataFrame, exact_keys: int = kd.EXACT_KEYS, max_sets: int = MAX_SETS, sources: dict | None = None, seed: int = 0, coarse: bool = False) -> DiffSummary:
    """Collect the bounded statistics of classified pairs.

    ``coarse`` makes every histogram of numbers approximate from the start;
    choose it where columns have very many distinct numbers.
    """
    spark = classes.sparkSession
    out = DiffSummary(columns=[f.name for f in kd.compared_columns(classes)])
    if sources:
        out.sources = sources
    # one pass for sections and sets, one for the statistics
    counted = materialize(classes.groupBy("section", F.array_sort("diff_set").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    for row in counted.groupBy("section").agg(F.sum("n").alias("n")).collect():
        if row["section"] == "inner_equal":
            out.rows_equal = out.equal_rows.count = row["n"]
        elif row["section"] != "inner_diff":
            (out.left_only if row["section"] == "outer_left" else out.right_only).count = row["n"]
    labels, unions = _labels(counted, out.columns, max_sets, seed)
    labelled = classes.join(labels, F.array_sort("diff_set") == F.col("__set"), "left")
    stats = kd.statistics(labelled, coarse, F.coalesce("__label", F.lit("none")))
    for row in kd.bounded(stats, exact_keys).collect():
        section, column, role = row["section"], row["column"], row["role"]
        if section == "inner_diff":
            by_row = out.by_set.setdefault(unions[int(row["diff_set"])], DeltaByRow())
            delta = by_row.by_column.setdefault(column, Delta())
            if role == "pair":
                if row["metric"] == "nEqual":
                    delta.n_equal += row["n"]
                else:
                    delta.n_not_equal += row["n"]
            else:
                _put(getattr(delta, role), row, coarse)
        elif section == "inner_equal":
            if role == "left":
                _put(out.equal_rows.by_column.setdefault(column, Describe()), row, coarse)
        else:
            _put((out.left_only if section == "outer_left" else out.right_only).by_column.setdefault(column, Describe()), row, coarse)
    for by_row in out.by_set.values():
        some = next(iter(by_row.by_column.values()))
        by_row.count = some.n_equal + some.n_not_equal
    return out


def _labels(counted: DataFrame, columns: Sequence[str], most: int, seed: int) -> tuple[DataFrame, list[frozenset]]:
    """Each set of differing columns (``__set``) and the place, as text, of the union it is merged into.

    The ``LISTED_SETS`` most frequent sets are merged here. Each rarer one goes
    to the nearest of their unions on the executors; the unions then take in
    the columns of all their sets.
    """
    spark = counted.sparkSession
    inner = counted.where(F.col("section") == "inner_diff")
    found = [frozenset(r["s"]) for r in inner.orderBy(F.desc("n"), "s").limit(LISTED_SETS).collect()]
    merged = compact_sets({s: [s] for s in found}, most, lambda a, b: a + b, seed)
    unions = sorted(merged, key=sorted)
    place = {s: i for i, u in enumerate(unions) for s in merged[u]}
    labels = F.broadcast(spark.createDataFrame([(sorted(s), i) for s, i in place.items()], "__set array<string>, __place int"))
    if len(found) == LISTED_SETS:
        ship_package(spark)
        bit = {c: 1 << i for i, c in enumerate(columns)}
        centres = [sum(bit[c] for c in u) for u in unions]
        rarer = inner.join(labels, F.col("s") == F.col("__set"), "left_anti").select(F.col("s").alias("__set"))
        nearest = materialize(rarer.mapInArrow(lambda batches: _nearest(batches, bit, centres), "__set array<string>, __place int"))
        for row in nearest.select("__place", F.explode("__set").alias("c")).groupBy("__place").agg(F.collect_set("c").alias("cs")).collect():
            unions[row["__place"]] |= frozenset(row["cs"])
        labels = labels.union(nearest)
    final = sorted(set(unions), key=sorted)  # some may have become the same
    names = F.array(*[F.lit(str(final.index(u))) for u in unions]).cast("array<string>")
    return labels.select("__set", F.get(names, F.col("__place")).alias("__label")), final


def _nearest(batches: Iterable[pa.RecordBatch], bit: dict[str, int], centres: list[int]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        points = [sum(bit[c] for c in s) for s in batch.column(0).to_pylist()]
        places = [closest(centres, p) for p in points]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int32())], names=["__set", "__place"])


def describe_column(df: DataFrame, column: str, exact_keys: int = kd.EXACT_KEYS) -> Describe:
    """The bounded description of one column of a frame.

    Histograms and enums are exact up to ``exact_keys`` distinct values; of
    more, an enum keeps that many of the most frequent, and the total.
    """
    fact = kd.describe_fact(F.col(column), df.schema[column].dataType, column, "left")
    facts = df.select(F.lit("all").alias("section"), F.lit("").alias("diff_set"), F.inline(F.array(fact)))
    stats = facts.groupBy(*kd.GROUP, "key_str", "key_other", "key_long", "key_double").agg(F.count(F.lit(1)).alias("n"))
    out = Describe()
    for row in kd.bounded(stats, exact_keys).collect():
        _put(out, row, False)
    return out


def estimates(df: DataFrame, column: str, enum: Enum) -> DataFrame:
    """The frame with ``estimate``, an enum's count of each string; 0 of a null.

    The enum is of bounded size and goes to all executors.
    """
    ship_package(df.sparkSession)
    schema = df.drop("estimate").withColumn("estimate", F.lit(0).cast("bigint")).schema
    place = schema.names.index(column)

    def estimated(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [0 if s is None or (not enum.large and s not in enum.values) else enum.estimate(s) for s in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

    return df.drop("estimate").mapInArrow(estimated, schema)


def sources_of(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    """The files behind both sides, for ``summarise(sources=...)``."""
    return {"left": left.inputFiles(), "right": right.inputFiles()}


def _put(describe: Describe, row, coarse: bool) -> None:
    metric, n = row["metric"], row["n"]
    describe.count += n
    if row["rest_keys"] is not None:
        enum = describe.enums.setdefault(metric, Enum())
        enum.large = True
        enum.rest += n
        enum.rest_keys += row["rest_keys"]
        enum.cells = _added(enum.cells, dict(row["sketch"]))
    elif row["key_str"] is not None:
        key = row["key_str"] if row["key_other"] is None else (row["key_str"], row["key_other"])
        enum = describe.enums.setdefault(metric, Enum())
        enum.values[key] = enum.values.get(key, 0) + n
        enum.large |= row["is_large"]
    elif row["key_double"] is not None and math.isnan(row["key_double"]):
        describe.counts["nNaN"] = describe.counts.get("nNaN", 0) + n
    elif row["key_long"] is not None or row["key_double"] is not None:
        whole = row["key_long"] is not None
        histogram = describe.histograms.setdefault(metric, Histogram(whole=whole))
        key = row["key_long"] if whole else row["key_double"]
        histogram.values[key] = histogram.values.get(key, 0) + n
        histogram.large |= row["is_large"] or (coarse and key != 0)
    else:
        describe.counts[metric] = describe.counts.get(metric, 0) + n


# -- fewer sets of columns ---------------------------------------------------------


def set_distance(centre: int, point: int) -> float:
    """Distance of two sets given as bits: what they do not share, more for larger ones."""
    a, b, shared = centre.bit_count(), point.bit_count(), (centre & point).bit_count()
    return ((a - shared) + (b - shared)) * (1 + math.sqrt(a + b + shared))


def closest(centres: Sequence[int], point: int) -> int:
    """The centre that holds all of the point with the fewest bits besides,
    else the nearest one; the first of several."""
    holding = [i for i, c in enumerate(centres) if point & ~c == 0]
    if holding:
        return min(holding, key=lambda i: ((centres[i] & ~point).bit_count(), i))
    return min(range(len(centres)), key=lambda i: (set_distance(centres[i], point), i))


def k_modes(points: dict[int, int], k: int, rounds: int = 20, seed: int = 0) -> dict[int, int]:
    """Assign each point (bits) to one of ``k`` centres; returns point -> centre.

    A bit stays in a centre if at least a quarter of its points have it.
    """
    rng = random.Random(seed)
    centres = rng.sample(sorted(points), min(k, len(points)))
    nearest: dict[int, int] = {}
    for _ in range(rounds):
        nearest = {p: closest(centres, p) for p in sorted(points)}
        moved = []
        for i, old in enumerate(centres):
            members = [p for p, c in nearest.items() if c == i]
            bits = 0
            for bit in range(max((p.bit_length() for p in members), default=0)):
                if sum(p >> bit & 1 for p in members) * 4 >= len(members) > 0:
                    bits |= 1 << bit
            moved.append(bits if members else old)
        if moved == centres:
            break
        centres = moved
    return {p: centres[c] for p, c in nearest.items()}


def compact_sets(sets: dict[frozenset, object], most: int, merge: Callable, seed: int = 0) -> dict:
    """Merge sets of columns until at most ``most`` are left; a merged set is the union."""
    if len(sets) <= most:
        return dict(sets)
    if most <= 1:
        groups = [list(sets)]
    else:
        names = sorted({c for s in sets for c in s})
        place = {c: i for i, c in enumerate(names)}
        bits = {s: sum(1 << place[c] for c in s) for s in sets}
        centre = k_modes({b: 1 for b in bits.values()}, most, seed=seed)
        by_centre: dict[int, list] = {}
        for s in sorted(sets, key=sorted):
            by_centre.setdefault(centre[bits[s]], []).append(s)
        groups = list(by_centre.values())
    out: dict[frozenset, object] = {}
    for group in groups:
        union = frozenset().union(*group)
        for s in group:
            out[union] = merge(out[union], sets[s]) if union in out else sets[s]
    return out


# -- constraints --------------------------------------------------------------------------


@dataclass(frozen=True)
class Constraint:
    """A named demand on a summary."""

    name: str
    holds: Callable[[DiffSummary], bool]

    def __repr__(self) -> str:
        return self.name


def no_outer() -> Constraint:
    return Constraint("no_outer", lambda s: s.left_only.count == 0 and s.right_only.count == 0)


def no_inner() -> Constraint:
    return Constraint("no_inner", lambda s: s.rows_not_equal == 0)


def is_similar() -> Constraint:
    return Constraint("is_similar", lambda s: no_outer().holds(s) and no_inner().holds(s))


def _changed(summary: DiffSummary, column: str) -> bool:
    if column not in summary.columns:
        raise KeyError(column)
    delta = summary.by_column.get(column)
    return delta is not None and delta.n_not_equal > 0


def column_changes(*columns: str) -> Constraint:
    """All of these columns differ somewhere; an unknown one raises KeyError."""
    return Constraint(f"column_changes({', '.join(columns)})", lambda s: all([_changed(s, c) for c in columns]))


def column_keeps(*columns: str) -> Constraint:
    """None of these columns differs."""
    return Constraint(f"column_keeps({', '.join(columns)})", lambda s: not any([_changed(s, c) for c in columns]))


@dataclass(frozen=True)
class Outcome:
    """Passed, or the constraints that failed, in the order given."""

    failed: tuple[Constraint, ...] = ()

    @property
    def passed(self) -> bool:
        return not self.failed


def check(summary: DiffSummary, *constraints: Constraint) -> Outcome:
    return Outcome(tuple(c for c in constraints if not c.holds(summary)))


# -- JSON -------------------------------------------------------------------------------------


# The names of the parts and of what is counted, here and in LABELS.
def to_json(summary: DiffSummary) -> str:
    """The summary as JSON; :func:`from_json` gives the same summary back."""

    def histogram(h: Histogram) -> dict:
        data = [[str(k), n] for k, n in h._sorted()]
        return {"kind": "long" if h.whole else "double", "large": h.large, "data": data}

    def enum(e: Enum) -> dict:
        out = {"large": e.large, "data": [[list(k) if isinstance(k, tuple) else k, n] for k, n in e.heavy_hitters(len(e.values))]}
        return out | {"rest": e.rest, "restKeys": e.rest_keys, "cells": sorted(e.cells.items()), "mixed": e.mixed} if e.rest else out

    def describe(d: Describe) -> dict | None:
        if d.empty:
            return None
        return {"count": d.count, "counts": d.counts, "histograms": {k: histogram(h) for k, h in d.histograms.items()}, "enums": {k: enum(e) for k, e in d.enums.items()}}

    def delta(d: Delta) -> dict:
        return {"nEqual": d.n_equal, "nNotEqual": d.n_not_equal, "describe": {"left": describe(d.left), "right": describe(d.right)}, "error": describe(d.error)}

    def by_row(d: DescribeByRow) -> dict:
        return {"count": d.count, "byColumn": {c: describe(x) for c, x in d.by_column.items()}}

    sets = sorted(summary.by_set.items(), key=lambda x: sorted(x[0]))
    return json.dumps(
        {
            "datasetInfo": summary.sources,
            "columns": summary.columns,
            "result": {
                "inner": {
                    "countRowEqual": summary.rows_equal,
                    "countRowNotEqual": summary.rows_not_equal,
                    "countDeltaByRow": [{"key": sorted(s), "value": {"count": d.count, "byColumn": {c: delta(x) for c, x in d.by_column.items()}}} for s, d in sets],
                    "equalRows": by_row(summary.equal_rows),
                    "byColumn": {c: delta(d) for c, d in summary.by_column.items()},
                },
                "outer": {"left": by_row(summary.left_only), "right": by_row(summary.right_only)},
            },
        },
        sort_keys=True,
    )


def from_json(text: str) -> DiffSummary:
    def histogram(x: dict) -> Histogram:
        cast = int if x["kind"] == "long" else float
        return Histogram({cast(k): n for k, n in x["data"]}, x["large"], x["kind"] == "long")

    def enum(x: dict) -> Enum:
        values = {tuple(a) if isinstance(a, list) else a: n for a, n in x["data"]}
        return Enum(values, x["large"], x.get("rest", 0), x.get("restKeys", 0), dict(x.get("cells", ())), x.get("mixed", False))

    def describe(x: dict | None) -> Describe:
        if x is None:
            return Describe()
        enums = {k: enum(e) for k, e in x["enums"].items()}
        return Describe(x["count"], dict(x["counts"]), {k: histogram(h) for k, h in x["histograms"].items()}, enums)

    def delta(x: dict) -> Delta:
        return Delta(x["nEqual"], x["nNotEqual"], describe(x["describe"]["left"]), describe(x["describe"]["right"]), describe(x["error"]))

    def by_row(x: dict) -> DescribeByRow:
        return DescribeByRow(x["count"], {c: describe(d) for c, d in x["byColumn"].items()})

    whole = json.loads(text)
    inner, outer = whole["result"]["inner"], whole["result"]["outer"]
    sets = {frozenset(x["key"]): DeltaByRow(x["value"]["count"], {c: delta(d) for c, d in x["value"]["byColumn"].items()}) for x in inner["countDeltaByRow"]}
    return DiffSummary(inner["countRowEqual"], sets, by_row(inner["equalRows"]), by_row(outer["left"]), by_row(outer["right"]), whole["datasetInfo"], whole["columns"])


# -- report -----------------------------------------------------------------------------------

#: How counts are called in a report.
LABELS = {
    "nTrue": "# true",
    "nFalse": "# false",
    "nNull": "# null",
    "nNaN": "# not a number",
    "nUnsupported": "# unsupported",
    "tf": "# true -> false",
    "ft": "# false -> true",
    "rightToNull": "# null -> not null",
    "leftToNull": "# not null -> null",
}

BAR = 22


def console_width() -> int:
    return shutil.get_terminal_size((80, 25)).columns


def bars(histogram: Histogram, n: int = 6) -> list[str]:
    found = histogram.bins(n)
    most = max((c for _, c in found), default=0)
    labels = [f"{centre:.2f}" for centre, _ in found]
    wide, digits = max(map(len, labels), default=0), len(str(most))
    return [f"{label:>{wide}} | {'o' * (round(BAR * c / most) if most else 0):<{BAR}} {c:>{digits}}" for label, (_, c) in zip(labels, found)]


def _describe_lines(d: Describe) -> list[str]:
    out = [f"{LABELS.get(k, k)}: {n}" for k, n in sorted(d.counts.items())]
    for name, histogram in sorted(d.histograms.items()):
        out += ["Histogram:" if name == "value" else f"Histogram of {name}:", *_indented(bars(histogram))]
    for name, enum in sorted(d.enums.items()):
        out.append("Most frequent:" if name == "value" else f"Most frequent {name}:")
        shown = [(" -> ".join(k) if isinstance(k, tuple) else k, n) for k, n in enum.heavy_hitters(10)]
        out += _indented([f"{k}: {n}" for k, n in shown])
        if enum.rest:
            out += _indented([f"all strings: {enum.total}"])
    return out


def _indented(lines: Iterable[str]) -> list[str]:
    return ["    " + x for x in lines]


def _beside(left: Sequence[str], right: Sequence[str]) -> list[str]:
    wide = max([0, *map(len, left)]) + 2
    if wide + max([0, *map(len, right)]) > max(80, console_width()):
        return [*left, *right]
    rows = max(len(left), len(right))
    return [f"{left[i] if i < len(left) else '':<{wide}}{right[i] if i < len(right) else ''}".rstrip() for i in range(rows)]


def render(summary: DiffSummary) -> str:
    """The summary as indented text."""
    inner = [f"Number of equal rows: {summary.rows_equal}", f"Number of different rows: {summary.rows_not_equal}"]
    if summary.by_set:
        inner.append("Differences by set of columns:")
        inner += _indented([f"{', '.join(sorted(s))}: {d.count}" for s, d in sorted(summary.by_set.items(), key=lambda x: (-x[1].count, sorted(x[0])))])
    inner.append("Delta by column:")
    for column, delta in sorted(summary.by_column.items()):
        block = [f"Number of similarities: {delta.n_equal}", f"Number of differences: {delta.n_not_equal}"]
        block += _beside(["Left:", *_indented(_describe_lines(delta.left))], ["Right:", *_indented(_describe_lines(delta.right))])
        if delta.n_not_equal:
            block += ["Error (left - right):", *_indented(_describe_lines(delta.error))]
        inner += _indented([f"{column}:", *_indented(block)])
    outer = [f"Number of rows on the left only: {summary.left_only.count}", f"Number of rows on the right only: {summary.right_only.count}"]
    for column in sorted({*summary.left_only.by_column, *summary.right_only.by_column}):
        a, b = (side.by_column.get(column, Describe()) for side in (summary.left_only, summary.right_only))
        outer += [f"{column}:", *_indented(_beside(["Left:", *_indented(_describe_lines(a))], ["Right:", *_indented(_describe_lines(b))]))]
    return "\n".join(["Difference:", *_indented(["Inner:", *_indented(inner), "Outer:", *_indented(outer)])])
