"""Mixing sources to target weights by hash-seeded Poisson replication.

Sizes in tokens give each source a mean number of copies (its rate). A document
gets as many copies as the inverse of the source's Poisson distribution has at
a number in [0, 1) that is a hash of the document's id and the seed: any
executor comes to the same answer, also after a loss. Counts above the source's
cap are put at the cap, and the Poisson mean is raised so that the mean of the
capped counts is the rate; a source that needs all its cap has exactly that many
copies of each document. The copies are shuffled globally by another hash.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlattice.session import materialize, ship_package, spread

#: Vocabulary of ranks; the pattern that splits texts is the usual one for it.
VOCABULARY = os.environ.get("ROWLATTICE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where PATTERN begins a new token whatever is there: before a single blank,
#: and after a letter or digit that no other follows. A contraction begins with
#: a sign, so none is cut.
SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
#: Characters from which on a text is cut at such a place.
PIECE = 100_000
#: Thresholds of all sources that are broadcast at most, and parts that a
#: source's documents are spread over where they are not.
BROADCAST_THRESHOLDS, SALTS = 1_000_000, 64

_encoders: dict = {}


def encoder(path: str, pattern: str):
    """The byte-level tokenizer of a file of ranks, once per process."""
    if (path, pattern) not in _encoders:
        import tiktoken

        there = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        with open(there, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def pieces(text: str) -> Iterator[str]:
    """Parts of a text that PATTERN splits as it would the whole.

    Cuts are only made at SAFE places, the first after PIECE characters; a
    stretch that has none, such as one very long word, stays in one part.
    """
    at = 0
    while len(text) - at > PIECE:
        cut = SAFE.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def count_tokens(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Add the number of tokens in place of the last column, the text."""
    encode = encoder(path, pattern).encode_ordinary
    parts = pieces if pattern == PATTERN else lambda t: [t]
    for batch in batches:
        counts = [sum(len(encode(part)) for part in parts(t)) if t else 0 for t in batch.columns[-1].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])


def chances(mean: float, cap: int) -> tuple[int, np.ndarray]:
    """A number of copies that a Poisson count reaches for certain, and the
    chances of no more than it, than one more, … up to ``cap - 1`` copies.

    Twelve standard deviations from the mean and beyond, chances are below
    what a hash of 53 bits can tell from 0 or 1. Logarithms serve any mean.
    """
    reach = 12 * math.sqrt(mean) + 40
    low, high = min(cap, max(0, math.floor(mean - reach))), min(cap, math.ceil(mean + reach))
    if low >= high:
        return low, np.zeros(0)
    k = np.arange(low, high, dtype=np.float64)
    factorials = math.lgamma(low + 1) + np.append(0.0, np.cumsum(np.log(k[1:])))
    return low, np.minimum(1.0, np.cumsum(np.exp(k * math.log(mean) - mean - factorials)))


def whole_and_thresholds(rate: float, cap: int) -> tuple[int, np.ndarray]:
    """Copies of every document, and thresholds of those beyond them.

    A document gets one copy more for each threshold that its number is not
    below. The counts are those of a Poisson distribution cut at ``cap``, whose
    mean is raised so that the mean of the cut counts is ``rate``. At a rate of
    ``cap`` or more every document has ``cap`` copies: nothing is random.
    """
    if cap <= 0 or rate <= 0:
        return 0, np.zeros(0)
    if rate >= cap:
        return cap, np.zeros(0)

    def copies(mean: float) -> float:
        whole, below = chances(mean, cap)
        return whole + float((1 - below).sum())

    low, high = rate, rate + 1.0
    while copies(high) < rate * (1 - 1e-12) and high < 1e15:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if copies(middle) < rate else (low, middle)
    return chances(high, cap)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole copies, thresholds and variance of copies per source. In: source, rate, max_repeats."""
    for batch in batches:
        plans = [whole_and_thresholds(r or 0.0, c or 0) for r, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        spread = []
        for whole, below in plans:
            # of the copies beyond the whole ones
            more = 1 - below
            spread.append(float(((2 * np.arange(len(more)) + 1) * more).sum() - more.sum() ** 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in plans], pa.int32()), pa.array([b.tolist() for _, b in plans], pa.list_(pa.float64())), pa.array(spread, pa.float64())], names=["source", "whole", "cdf", "spread"])


@dataclass
class Mixture:
    documents: DataFrame
    report: DataFrame


def clean_source(column: Column) -> Column:
    return F.lower(F.trim(column))


def unit(*columns: Column | str) -> Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def mixture(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: float | None = None,
    seed: int = 42,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> Mixture:
    """A mixture whose sources have their target shares of the tokens.

    ``targets`` has ``source, target_share, max_repeats``. The shares are
    scaled to 1 over the targets that have tokens. ``total_tokens`` is the
    size of the mixture; without it, the greatest size is taken at which each
    such source reaches its share within its cap. Returns the documents (all
    columns, ``source`` in clean spelling, and ``copy_no`` from 1) in globally
    shuffled order, and a report with one row per source, with the share that
    was reached and its standard error (that of the random counts).

    Defined results: spellings of a source that differ in case or blanks at
    the ends are one source; documents without source or with one that has no
    target, and texts that are null or empty, are not in the mixture (the
    report names the former); a target without documents reaches no share; a
    share or cap that is null, zero or negative gives nothing; a column
    ``copy_no`` of the input is replaced; repeated
    targets of a source: the greatest share and cap; documents with the same
    id share their number of copies; empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(vocabulary)  # for executors that lack the path
    kept_columns = [c for c in documents.columns if c not in ("copy_no", "__whole", "__cdf", "__u", "__copies", "__place", "__source", "__part", "__salt")]
    cleaned = documents.select(*kept_columns).withColumn(source, clean_source(F.col(source)))
    sizes = cleaned.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), F.col(text).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema.fields}
    counted = materialize(spread(sizes).mapInArrow(lambda it: count_tokens(it, vocabulary, pattern), f"source string, id {kinds['id']}, n_tokens bigint"))
    by_source = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares"))
    wanted = targets.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    wanted = wanted.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    joined = by_source.join(wanted, by_source["source"].eqNullSafe(wanted["source"]), "full_outer").select(F.coalesce(by_source["source"], wanted["source"]).alias("source"), "tokens", "documents", "squares", "share", "cap")
    usable = (F.col("tokens") > 0) & (F.col("share") > 0) & (F.col("cap") > 0) & ~F.isnan("share")
    joined = materialize(joined.withColumn("usable", F.coalesce(usable, F.lit(False))))
    share_sum = joined.where("usable").agg(F.sum("share")).first()[0] or 1.0
    scaled = joined.withColumn("scaled", F.when(F.col("usable"), F.col("share") / F.lit(share_sum)).otherwise(0.0))
    if total_tokens is None:
        total_tokens = scaled.where("usable").agg(F.min(F.col("cap") * F.col("tokens") / F.col("scaled"))).first()[0] or 0.0
    rate = F.when(F.col("usable"), F.least(F.col("cap").cast("double"), F.col("scaled") * F.lit(float(total_tokens)) / F.col("tokens"))).otherwise(0.0)
    planned = scaled.withColumn("rate", rate)
    plans = planned.where("usable").select("source", "rate", "cap").mapInArrow(_plan, "source string, whole int, cdf array<double>, spread double")
    plans = materialize(plans)
    listed = plans.agg(F.sum(F.size("cdf") + 4)).first()[0] or 0
    thresholds = plans.toDF("__source", "__whole", "__cdf", "__spread").drop("__spread")

    def copies(frame: DataFrame, id_column: str, source_column: str) -> DataFrame:
        same = F.col(source_column) == F.col("__source")
        if listed <= BROADCAST_THRESHOLDS:
            joined = frame.join(F.broadcast(thresholds), same)
        else:  # shuffled, the documents of a source over many tasks
            part = F.pmod(F.xxhash64(F.lit(3), F.col(id_column)), F.lit(SALTS))
            salted = thresholds.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            joined = frame.withColumn("__part", part).join(salted, same & (F.col("__part") == F.col("__salt"))).drop("__part", "__salt")
        drawn = joined.drop("__source").withColumn("__u", unit(F.lit(seed), F.col(id_column)))
        return drawn.withColumn("__copies", F.col("__whole") + F.size(F.filter("__cdf", lambda c: F.col("__u") >= c))).drop("__whole", "__cdf", "__u")

    kept = copies(cleaned.where(F.length(text) > 0), doc_id, source).where(F.col("__copies") > 0)
    repeated = kept.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")
    place = F.xxhash64(F.lit(seed + 1), F.col(doc_id), F.col("copy_no"))
    shuffled = repeated.withColumn("__place", place).repartition("__place").sortWithinPartitions("__place").drop("__place")

    reached = copies(counted.where("n_tokens > 0"), "id", "source").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("__copies")).alias("mixed"), F.sum("__copies").cast("bigint").alias("copies"))
    counts = planned.join(reached, planned["source"].eqNullSafe(reached["source"]), "left").select(planned["source"], "documents", "tokens", "squares", "share", "cap", "scaled", "rate", F.coalesce("mixed", F.lit(0)).alias("mixed"), F.coalesce("copies", F.lit(0)).alias("copies"))
    full = materialize(counts.join(plans.select(F.col("source").alias("__source"), "spread"), F.col("source") == F.col("__source"), "left").drop("__source").withColumn("variance", F.coalesce(F.col("spread") * F.col("squares"), F.lit(0.0))))
    whole, variance = full.agg(F.sum("mixed"), F.sum("variance")).first()
    reached_share = F.col("mixed") / F.lit(float(max(1, whole or 0)))
    # of the share, to first order: its own tokens scatter, and those of all others
    error = F.sqrt(F.pow(1 - reached_share, 2) * F.col("variance") + F.pow(reached_share, 2) * (F.lit(variance or 0.0) - F.col("variance"))) / F.lit(float(max(1, whole or 0)))
    report = full.select(
        "source",
        F.coalesce("documents", F.lit(0)).alias("n_documents"),
        F.coalesce("tokens", F.lit(0)).alias("n_tokens"),
        F.col("share").alias("target_share"),
        F.col("cap").alias("max_repeats"),
        F.col("scaled").alias("scaled_share"),
        "rate",
        F.col("copies").alias("n_copies"),
        F.col("mixed").alias("mixed_tokens"),
        reached_share.alias("reached_share"),
        error.alias("standard_error"),
    )
    return Mixture(shuffled, report)
