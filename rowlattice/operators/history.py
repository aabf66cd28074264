"""History of entity attributes by tree-reduction of unit intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlattice.operators.versions import comparable, has_map, latest_lines, quoted, version_list, version_of, with_ordinal


def coalesced_history(
    lines: DataFrame,
    keys: Sequence[str],
    version: str,
    payload: Sequence[str],
    *,
    order: str | None = None,
    versions: Sequence | None = None,
    first: str = "mindt",
    last: str = "maxdt",
) -> DataFrame:
    """Every version of each entity with the first and last snapshot of it.

    Each snapshot is a unit interval. In round r, blocks of ``2**r``
    neighbouring snapshots are joined pairwise: the run that ends at the
    middle and the run that begins there become one where entity and payload
    agree. After ``ceil(log2(n))`` rounds the runs are the longest ones. The
    rows are placed by entity once; the rounds shuffle nothing.

    Defined results: as in ``snapshot_changes``: null equals null only, NaN
    equals NaN, lines with a null key or no version are no records, the
    greatest ``order`` wins within a snapshot, repeated lines count once. An
    absence from a snapshot ends a run; an empty table gives no rows. Columns
    that are neither key, version nor payload are ignored.
    """
    versions = list(versions if versions is not None else version_list(lines, version))
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    known = lines.dropna(subset=[quoted(k) for k in keys])
    ranked = known if order else known.withColumn("__order", F.lit(0))
    valid = latest_lines(ranked, [*keys, version], order or "__order", payload)
    numbered = with_ordinal(valid, version, versions, "__ord")
    key_names = [f"k{i}" for i in range(len(keys))]
    value_names = [f"p{i}" for i in range(len(payload))]
    carried = [f"m{i}" for i, c in enumerate(payload) if has_map(kinds[c])]
    runs = numbered.select(
        *[F.col(quoted(k)).alias(n) for n, k in zip(key_names, keys)],
        *[comparable(c, kinds[c]).alias(n) for n, c in zip(value_names, payload)],
        *[F.col(quoted(c)).alias(f"m{i}") for i, c in enumerate(payload) if has_map(kinds[c])],
        F.col("__ord").alias("lo"),
        F.col("__ord").alias("hi"),
    ).repartition(*key_names)
    for step in range((len(versions) - 1).bit_length()):
        block = 2 ** (step + 1)
        middle = (F.floor(F.col("lo") / block) * block + block // 2).cast("int")
        touches = (F.col("hi") == middle - 1) | (F.col("lo") == middle)
        runs = (
            runs.withColumn("seam", F.when(touches, middle).otherwise(-1 - F.col("lo")))
            .groupBy(*key_names, *value_names, "seam")
            .agg(*[F.first(m).alias(m) for m in carried], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .drop("seam")
        )
    dated = version_of(version_of(runs, "lo", versions, kinds[version], "__first"), "hi", versions, kinds[version], "__last")
    originals = [F.col(f"m{i}" if has_map(kinds[c]) else f"p{i}").alias(c) for i, c in enumerate(payload)]
    return dated.select(*[F.col(n).alias(k) for n, k in zip(key_names, keys)], *originals, F.col("__first").alias(first), F.col("__last").alias(last))
