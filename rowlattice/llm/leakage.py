"""Evaluation passages inside a corpus, by a prefix-filtered set join.

An item is a set of shingles. One pass over the corpus turns each document
into the set of those shingles of its own that any item has. Counted over all
documents, these give the order of rarity. A pair that passes the verification
has ``need`` shingles in common (:func:`need_of`), so in this order the
document must hold one of the item's first ``n - need + 1`` (its prefix): the
documents are joined with the prefixes, and what is found is bounded by length,
by the positions in the order and by the number of common shingles. Then it is
verified word by word in windows as wide as the item around the shingles it
shares: runs of equal words, apart by small edits only, make passages, and the
passages that follow each other in item and document make up the contained
share. No bound drops a pair that passes.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rowlattice.llm.text import words
from rowlattice.session import materialize, ship_package, spread

#: Bytes of item texts looked for in one pass over the corpus: about 20,000
#: items of 200 words. Their words and shingles are what is broadcast.
BLOCK_BYTES = 24_000_000
#: Words of a shingle, and of the shortest run of equal words.
SHINGLE, RUN = 5, 3
#: Words between two runs of a passage, words a passage spans at least, and its share of equal ones.
GAP, LONG, DENSE = 4, 20, 0.87
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(code: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The code of a run of words, one word longer."""
    code = (code ^ ids) * _FACTOR
    return code ^ (code >> np.uint64(29))


def codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for each ``size`` neighbouring word ids."""
    n = max(0, len(ids) - size + 1)
    wide, code = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(size if n else 0):
        code = mixed(code, wide[k : n + k])
    return code


@lru_cache(maxsize=4096)
def fewest_places(span: int, size: int) -> int:
    """Places at which a passage of ``span`` words of an item has a whole shingle, at least.

    With ``e`` edits it has at most ``e + 1`` runs, and a run of ``r`` words
    has ``r - size + 1`` places. At most ``e`` words of the item are edited,
    and the share ``DENSE`` of equal words and edits together is equal.
    """
    least, edits = span - size + 1, 0
    while True:
        edits += 1
        equal = max(span - edits, math.ceil(edits * DENSE / (1 - DENSE) - 1e-9))
        if equal > span:
            return max(0, least)
        least = min(least, equal - (size - 1) * (edits + 1))


@lru_cache(maxsize=1)
def _places_a_word() -> float:
    # from 200 words on a passage has more than 0.33 places a word
    return min(fewest_places(span, SHINGLE) / span for span in range(LONG, 200))


def shingle_size(length: int) -> int:
    """Words of an item's shingles: fewer where a short item could lose all."""
    size = min(SHINGLE, length)
    while size > 1 and length < LONG and not fewest_places(length, size):
        size -= 1
    return size


def need_of(times: np.ndarray, length: int, least_words: float) -> int:
    """Lowest number of an item's shingles in a document that passes verification.

    ``times`` is how often each shingle is in the item, of ``length`` words.
    Passages overlap by ``GAP`` words, fewer than a shingle has, so their
    places are apart; as few shingles as can fill these places are needed.
    """
    if not len(times):
        return 1
    if length < LONG:
        places = fewest_places(length, shingle_size(length))
    else:
        places = max(min(fewest_places(k, SHINGLE) for k in range(LONG, 2 * LONG)), math.ceil(_places_a_word() * least_words * length - 1e-6))
    return 1 + int(np.searchsorted(np.cumsum(np.sort(times)[::-1]), max(1, places)))


class Block:
    """The words and shingles of a block of items, as numbers."""

    def __init__(self, items: list[tuple], least_words: float = 0.45) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list = []
        self.words: list[np.ndarray] = []
        for item_id, text in items:
            tokens = words(text or "")
            if tokens:
                self.items.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens], np.int32))
        counted = [np.unique(codes(w, shingle_size(len(w))), return_counts=True) for w in self.words]
        every = np.concatenate([*(c for c, _ in counted), np.zeros(0, np.uint64)])
        self.table, flat = np.unique(every, return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.sizes = np.array([len(c) for c, _ in counted], np.int32)
        self.offsets = np.append(0, np.cumsum(self.sizes, dtype=np.int64))
        lengths = [len(w) for w in self.words]
        self.need = np.array([need_of(t, n, least_words) for (_, t), n in zip(counted, lengths)], np.int32)
        self.shortest = np.array([math.floor(DENSE * max(least_words * n, min(LONG, n))) for n in lengths], np.int32)
        self.shingle_sizes = sorted({shingle_size(n) for n in lengths}, reverse=True)
        self.least = int(self.need.min(initial=1 << 30))

    def shingles(self, item: int) -> np.ndarray:
        return self.flat[self.offsets[item] : self.offsets[item + 1]]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in word ids where one of the block's shingles begins, and which.

        An id below 0 is a word of no item, or the end of a text.
        """
        places, shingles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known = ids >= 0
        for size in self.shingle_sizes:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            run = known[:n].copy()
            for k in range(1, size):
                run &= known[k : n + k]
            at = np.flatnonzero(run)
            code = np.zeros(len(at), np.uint64)
            for k in range(size):
                code = mixed(code, ids[at + k].astype(np.uint64))
            place = np.minimum(np.searchsorted(self.table, code), len(self.table) - 1)
            there = self.table[place] == code
            places.append(at[there])
            shingles.append(place[there])
        return np.concatenate(places), np.concatenate(shingles)


def matches(batches: Iterator[pa.RecordBatch], block: Block, together: int = 1024) -> Iterator[pa.RecordBatch]:
    """Per document: places of the block's shingles, which they are, and its words if they suffice."""
    get, lists = block.vocabulary.get, pa.list_(pa.int32())
    for batch in batches:
        for first in range(0, batch.num_rows, together):
            part = batch.slice(first, together)
            flat: list[int] = []
            ends = []  # of each document, where a place that is no word parts it from the next
            for text in part.column(1).to_pylist():
                if text:
                    flat += [get(w, -1) for w in words(text)]
                ends.append(len(flat))
                flat.append(-1)
            ids, begins = np.array(flat, np.int32), np.append(0, np.array(ends[:-1], np.int64) + 1)
            place, shingle = block.hits(ids)
            doc = np.searchsorted(ends, place)
            by = np.lexsort((place, doc))
            doc, place, shingle = doc[by], (place - begins[doc])[by], shingle[by]
            there, starts = np.unique(doc, return_index=True)
            if not len(there):
                continue
            offsets = np.append(starts, len(doc))
            kept = []
            for d, a, b in zip(there.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                enough = b - a >= block.least and len(np.unique(shingle[a:b])) >= block.least
                kept.append(ids[begins[d] : ends[d]] if enough else None)
            ends_of = pa.array(offsets, pa.int32())
            columns = [pa.ListArray.from_arrays(ends_of, pa.array(x.astype(np.int32))) for x in (shingle, place)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(there)), *columns, pa.array(kept, lists)], names=["doc", "shingles", "places", "words"])


def equal_runs(item: np.ndarray, document: np.ndarray, anchor: int) -> list[tuple[int, int, int]]:
    """Maximal runs (item place, document place, length) of equal words."""
    anchor = min(anchor, len(item), len(document))
    if anchor == 0:
        return []
    mine, theirs = codes(item, anchor), codes(document, anchor)
    order = np.argsort(mine, kind="stable")
    low = np.searchsorted(mine[order], theirs, "left")
    high = np.searchsorted(mine[order], theirs, "right")
    at = np.flatnonzero(high > low)
    if not len(at):
        return []
    times = (high - low)[at]
    p = np.repeat(at, times)
    first = np.repeat(low[at] - np.append(0, np.cumsum(times)[:-1]), times)
    i = order[np.arange(len(p)) + first]
    by = np.lexsort((p, p - i))
    p, i = p[by], i[by]
    starts = np.flatnonzero(np.append(True, (np.diff(p - i) != 0) | (np.diff(p) != 1)))
    lengths = np.diff(np.append(starts, len(p))) + anchor - 1
    return sorted(zip(i[starts].tolist(), p[starts].tolist(), lengths.tolist()), key=lambda r: (r[1], r[0]))


def passages(runs: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs joined over small edits: (item from, to, document from, to, equal words, edits)."""
    out: list[tuple] = []
    open_ones: list[tuple] = []
    for i, p, n in runs:
        best, shared, edits = None, 0, 0
        still = []
        for one in open_ones:
            if p - one[3] > gap + n:
                out.append(one)
                continue
            still.append(one)
            over = max(one[1] - i, one[3] - p, 0)
            mine, theirs = i + over - one[1], p + over - one[3]
            if over < n and i > one[0] and max(mine, theirs) <= gap and i + n > one[1] and (best is None or one[4] > best[4]):
                best, shared, edits = one, n - over, max(mine, theirs)
        open_ones = still
        if best is None:
            open_ones.append((i, i + n, p, p + n, n, 0))
        else:
            open_ones.remove(best)
            open_ones.append((best[0], i + n, best[2], p + n, best[4] + shared, best[5] + edits))
    return out + open_ones


def contained_share(item: np.ndarray, runs: list[tuple[int, int, int]]) -> float:
    """Share of the item's words in long passages that keep their order.

    A passage spans at least ``LONG`` words of the item (or all of it) and a
    share ``DENSE`` of its words is equal, the others being edits: sentences
    that only follow the same pattern with other names stay below that.
    """
    length = len(item)
    kept = [x for x in passages(runs, GAP) if x[1] - x[0] >= min(LONG, length) and x[4] >= DENSE * (x[4] + x[5])]
    kept.sort(key=lambda x: (x[3], x[1]))
    # heaviest chain that rises in both texts; passages are few, but a prefix
    # maximum over item places keeps it fast for any number
    ends, totals = [0], [0]
    pending: list[tuple[int, int, int]] = []
    for a, b, p, q, _, _ in kept:
        for done in sorted(x for x in pending if x[0] <= p + GAP):
            _raise(ends, totals, done[1], done[2])
        pending = [x for x in pending if x[0] > p + GAP]
        before = totals[bisect_right(ends, a + GAP) - 1]
        pending.append((q, b, before + b - a))
    for done in pending:
        _raise(ends, totals, done[1], done[2])
    return min(1.0, totals[-1] / length) if length else 0.0


def _raise(ends: list[int], totals: list[int], end: int, total: int) -> None:
    """Keep the staircase of best totals by item place rising."""
    at = bisect_right(ends, end)
    if totals[at - 1] >= total:
        return
    stop = at
    while stop < len(ends) and totals[stop] <= total:
        stop += 1
    ends[at:stop], totals[at:stop] = [end], [total]


def windows(length: int, places: np.ndarray, document: int) -> list[tuple[int, int]]:
    """Parts of a document that any passage of an item lies in.

    A passage holds a common shingle and is no longer than the item with its
    edits, so each place is in the middle of a window of twice that; windows
    that meet are one.
    """
    reach = math.ceil(length / DENSE) + GAP
    low, high = np.maximum(0, places - reach), np.minimum(document, places + SHINGLE + reach)
    begins = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return list(zip(low[begins].tolist(), high[np.append(begins[1:], len(low)) - 1].tolist()))


@dataclass
class Prefixes:
    """The items by the shingles of their prefixes: ``first`` is where those of
    a shingle begin; ``positions`` are theirs in the order of rarity."""

    order: np.ndarray
    first: np.ndarray
    items: np.ndarray
    positions: np.ndarray


def prefixes(block: Block, rarity: np.ndarray) -> Prefixes:
    """The prefixes by how often each shingle is in all documents and items."""
    order = np.empty(len(rarity), np.int64)
    order[np.argsort(rarity + np.bincount(block.flat, minlength=len(rarity)), kind="stable")] = np.arange(len(rarity))
    owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
    by = np.lexsort((order[block.flat], owner))
    position = np.arange(len(by)) - block.offsets[owner]
    inside = position <= block.sizes[owner] - block.need[owner]
    shingle, owner, position = block.flat[by][inside], owner[inside], position[inside]
    by = np.argsort(shingle, kind="stable")
    return Prefixes(order, np.searchsorted(shingle[by], np.arange(len(rarity) + 1)), owner[by].astype(np.int32), position[by].astype(np.int32))


def candidates(shingles: np.ndarray, length: int, kept: Prefixes, block: Block) -> np.ndarray:
    """Items with a prefix that a document meets, within the bounds of length and position."""
    ranked = shingles[np.argsort(kept.order[shingles], kind="stable")]
    low = kept.first[ranked]
    times = kept.first[ranked + 1] - low
    ends = np.cumsum(times)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(ranked)), times)
    flat = np.arange(ends[-1]) + np.repeat(low - ends + times, times)
    items, first = np.unique(kept.items[flat], return_index=True)  # where item and document meet first
    room = np.minimum(len(ranked) - place[first], block.sizes[items] - kept.positions[flat[first]])
    return items[(room >= block.need[items]) & (length >= block.shortest[items])]


def verified(batches: Iterator[pa.RecordBatch], block: Block, kept: Prefixes, least_words: float, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Documents and the items they contain, with the share."""
    there, mine = np.zeros(len(block.table), bool), np.zeros(len(block.table), bool)
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            shingles, places, document = (batch.column(c)[row].values.to_numpy() for c in (1, 2, 3))
            distinct = np.unique(shingles)
            there[distinct] = True
            for item in candidates(distinct, len(document), kept, block).tolist():
                own, text = block.shingles(item), block.words[item]
                if there[own].sum() < block.need[item]:
                    continue
                mine[own] = True
                at = places[mine[shingles]]
                mine[own] = False
                runs = [(i, p + low, n) for low, high in windows(len(text), at, len(document)) for i, p, n in equal_runs(text, document[low:high], RUN)]
                share = contained_share(text, runs)
                if share >= least_words:
                    rows.append((batch.column(0)[row].as_py(), block.items[item], share))
            there[distinct] = False
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [batch.column(0).type, item_type, pa.float64()])], names=["doc", "item", "share"])


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_words: float = 0.45,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents that contain at least ``least_words`` of an item's words.

    Returns ``doc_id`` and ``item_id``, of the types they have, and ``share``.
    The corpus is read once for each ``block_bytes`` of item texts.

    Defined results: texts are read without markup and regardless of case,
    punctuation, spacing and character encoding; null or empty texts contain
    nothing and items without words are contained nowhere; items shorter than
    a shingle are looked for as a whole; repeated rows of the corpus are
    reported as often as they are there, repeated items once for each; very
    long texts are read whole; an empty side gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = documents.sparkSession
    ship_package(spark)
    wanted = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    corpus = spread(documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")))
    kinds = [frame.schema[0].dataType for frame in (corpus, wanted)]
    doc_kind, item_kind = (kind.simpleString() for kind in kinds)
    item_type = to_arrow_type(kinds[1])
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    results = []
    for number in range(blocks):
        part = wanted.where(F.col("t").isNotNull() & (F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number))
        block = Block(sorted(((r[0], r[1]) for r in part.collect()), key=repr), least_words)
        if not block.items:
            continue
        shared = spark.sparkContext.broadcast(block)
        table = materialize(corpus.mapInArrow(lambda it, b=shared: matches(it, b.value), f"doc {doc_kind}, shingles array<int>, places array<int>, words array<int>"))
        counted = table.select(F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).toPandas()
        rarity = np.zeros(len(block.table), np.int64)
        rarity[counted["s"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        kept = spark.sparkContext.broadcast(prefixes(block, rarity))
        enough = table.where(F.col("words").isNotNull())
        results.append(enough.mapInArrow(lambda it, b=shared, k=kept: verified(it, b.value, k.value, least_words, item_type), f"doc {doc_kind}, item {item_kind}, share double"))
    if not results:
        return spark.createDataFrame([], f"{doc_id} {doc_kind}, {item_id} {item_kind}, share double")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.toDF(doc_id, item_id, "share")
