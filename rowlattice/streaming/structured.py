"""The toolkit on Structured Streaming frames.

Rules, mappings and lenses are projections and run on a stream unchanged. What
needs state is here: line counts of both sides within a watermark, and the
changes that each new full dump of a stream of dumps brings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowlattice.operators.snapshot_changes import snapshot_changes
from rowlattice.operators.versions import quoted
from rowlattice.plans import quality


def annotation_counts(frame: quality.QualityFrame, time: str, window: str, late: str) -> DataFrame:
    """Annotations per window of event time, field and message.

    Late rows count while the watermark allows; the state is one count for
    each window, field and message.
    """
    notes = frame.to_df().withWatermark(time, late).select(F.col(quoted(time)).alias("at"), F.explode(quality.NAME).alias("n"))
    grouped = notes.groupBy(F.window("at", window), "n.message", "n.onField", "n.isError")
    return grouped.agg(F.sum("n.count").alias("count")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "message", "onField", "isError", "count")


def line_counts(left: DataFrame, right: DataFrame, columns: Sequence[str], time: str, window: str, late: str) -> DataFrame:
    """How often each line came on two streams, per window of event time.

    One stateful aggregate over the union; lines with equal counts are left in
    for the reader to filter once their window is closed.
    """
    sides = []
    for frame, side in ((left, 1), (right, 0)):
        sides.append(frame.select(*[F.col(quoted(c)) for c in columns], F.col(quoted(time)).alias("__at"), F.lit(side).alias("__left")))
    both = sides[0].union(sides[1]).withWatermark("__at", late)
    grouped = both.groupBy(F.window("__at", window).alias("__w"), *[F.col(quoted(c)) for c in columns])
    counted = grouped.agg(F.sum("__left").alias("nbLeft"), F.sum(1 - F.col("__left")).alias("nbRight"))
    return counted.select(F.col("__w.start").alias("start"), *[F.col(quoted(c)) for c in columns], "nbLeft", "nbRight")


def stream_changes(
    dumps: DataFrame,
    keys: Sequence[str],
    version: str,
    payload: Sequence[str],
    previous: Callable[[], DataFrame | None],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """For each micro-batch of whole dumps, hand the changes to ``sink``.

    ``previous`` gives the rows of the last dump before the batch, or None.
    A batch is given again under the same number after a failure, so a sink
    that overwrites by number delivers exactly once.
    """

    def each(batch: DataFrame, number: int) -> None:
        before = previous()
        rows = batch if before is None else batch.unionByName(before.select(*[F.col(quoted(c)) for c in batch.columns]))
        sink(snapshot_changes(rows, keys, version, payload), number)

    return dumps.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
