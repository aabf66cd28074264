"""What changed between consecutive full snapshots.

All snapshots are placed by the hash of the key and sorted by key together,
then cut into content-defined chunks: a chunk begins at each key whose hash is
divisible by ``chunk_keys``, so an added or removed row moves no boundary but
its own. A chunk of one snapshot whose digest equals that of the same chunk in
the next snapshot is discarded with all its rows; only rows of unmatched chunks
are joined, by a merge of neighbours in key order, to classify the changes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlattice.operators.versions import comparable, latest_lines, quoted, row_hash, version_list, version_of, with_ordinal
from rowlattice.session import ship_package

#: Rows held back while no chunk begins. Then a cut is made at the last key, in
#: all snapshots at once, as they lie together: chunks get smaller, no row is lost.
MAX_OPEN_ROWS = 500_000
#: Kinds of change by number, as the merge gives them.
KINDS = ("added", "removed", "changed")


def changed_rows(batches: Iterator[pa.RecordBatch], versions: int, chunk_keys: int) -> Iterator[pa.RecordBatch]:
    """Changes of the rows of unmatched chunks.

    In: columns ``__key``, ``__ord``, ``__h1``, ``__h2`` and keys ``k0``…,
    sorted by key and ``__ord``. Out: the keys, ``pair`` (place of the later
    snapshot) and ``kind`` (a place in ``KINDS``).
    """
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        new_key, starts = _borders(table, chunk_keys)
        where = np.flatnonzero(starts)
        if len(where) == 0 or where[-1] == 0:
            if len(new_key) < MAX_OPEN_ROWS:
                carry = table
                continue
            where = np.flatnonzero(new_key)
            if where[-1] == 0:
                carry = table
                continue
        cut = int(where[-1])
        carry = table.slice(cut)
        yield from _classified(table.slice(0, cut), new_key[:cut], starts[:cut], versions)
    if carry is not None and len(carry):
        yield from _classified(carry, *_borders(carry, chunk_keys), versions)


def _borders(table: pa.Table, chunk_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a key begins, and where a chunk does."""
    key = table["__key"].to_numpy()
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    return new_key, new_key & (key.view(np.uint64) % np.uint64(chunk_keys) == 0)


def _classified(table: pa.Table, new_key: np.ndarray, starts: np.ndarray, versions: int) -> Iterator[pa.RecordBatch]:
    place = table["__ord"].to_numpy().astype(np.int64)
    h1, h2 = (table[name].to_numpy().view(np.uint64) for name in ("__h1", "__h2"))
    # a digest for each snapshot that has rows in a chunk, however many snapshots there are
    code, group, count = np.unique(np.cumsum(starts) * (versions + 1) + place, return_inverse=True, return_counts=True)
    digest = np.zeros((2, len(code)), np.uint64)
    for total, h in zip(digest, (h1, h2)):
        np.add.at(total, group, h)
    matched = np.zeros(len(code), bool)  # the snapshot before has the same chunk
    matched[1:] = (code[1:] == code[:-1] + 1) & (count[1:] == count[:-1]) & (digest[:, 1:] == digest[:, :-1]).all(0)
    matched_later = np.append(matched[1:], False)
    # merge join of the rows that are left: a row's neighbour is its key's row in the next snapshot
    n = len(place)
    follows = np.zeros(n + 1, bool)  # the row before is the same key's in the snapshot before
    follows[1:n] = ~new_key[1:] & (place[1:] == place[:-1] + 1)
    unequal = np.zeros(n, bool)
    unequal[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    open_before = ~matched[group] & (place >= 1)
    found = (
        (open_before & ~follows[:n], 0, 0),
        (~matched_later[group] & (place < versions - 1) & ~follows[1:], 1, 1),
        (open_before & follows[:n] & unequal, 0, 2),
    )
    keys = table.drop_columns(["__key", "__ord", "__h1", "__h2"])
    for rows, later, kind in found:
        rows = np.flatnonzero(rows)
        if len(rows):
            taken = keys.take(pa.array(rows))
            taken = taken.append_column("pair", pa.array((place[rows] + later).astype(np.int32)))
            yield from taken.append_column("kind", pa.array(np.full(len(rows), kind, np.int32))).combine_chunks().to_batches()


def snapshot_changes(
    lines: DataFrame,
    keys: Sequence[str],
    version: str,
    payload: Sequence[str],
    *,
    order: str | None = None,
    versions: Sequence | None = None,
    chunk_keys: int = 4,
) -> DataFrame:
    """Keys added, removed or changed between consecutive snapshots.

    ``lines`` holds the rows of all snapshots, told apart by ``version``. A
    chunk has ``chunk_keys`` keys on average: about as many as one in which a
    key differs, so more where fewer keys change. The result is the same for
    any. Returns the keys, ``version`` (the later of the two snapshots) and
    ``change_kind``: ``added``, ``removed`` or ``changed``.

    Defined results: a null equals a null only; NaN equals NaN; rows with a
    null in a key column or without a version are no records; several lines
    of a key in one snapshot are settled by the greatest ``order`` (then the
    greatest payload); repeated lines count once; an empty table, or one
    snapshot, gives no rows. Other columns of ``lines`` are ignored.
    """
    spark = lines.sparkSession
    ship_package(spark)
    versions = list(versions if versions is not None else version_list(lines, version))
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    known = lines.dropna(subset=[quoted(k) for k in keys])
    ranked = known if order else known.withColumn("__order", F.lit(0))
    valid = latest_lines(ranked, [*keys, version], order or "__order", payload)
    numbered = with_ordinal(valid, version, versions, "__ord")
    key_columns = [comparable(k, kinds[k]) for k in keys]
    values = [comparable(c, kinds[c]) for c in payload]
    hashed = numbered.select(
        *[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)],
        row_hash(key_columns, 11).alias("__key"),
        F.col("__ord"),
        row_hash([*key_columns, *values], 1).alias("__h1"),
        row_hash([*key_columns, *values], 2).alias("__h2"),
    )
    names = [f"k{i}" for i in range(len(keys))]
    ordered = hashed.repartition(*names).sortWithinPartitions(*names, "__ord")
    count = max(1, len(versions))
    schema = ", ".join([*[f"{n} {kinds[k].simpleString()}" for n, k in zip(names, keys)], "pair int, kind int"])
    found = ordered.mapInArrow(lambda it: changed_rows(it, count, chunk_keys), schema)
    changes = found.withColumn("change_kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1))
    dated = version_of(changes, "pair", versions, kinds[version], "__later")
    return dated.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("__later").alias(version), "change_kind")
