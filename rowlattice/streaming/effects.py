"""Calls to outside services from Spark tasks: taps, limits, retries.

State is kept per partition; a task that is lost and run again starts afresh.
"""

from __future__ import annotations

import threading
import time
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rowlattice.session import materialize, ship_package


class Rejected(Exception):
    """A call the tap did not make."""


class CircuitTap:
    """Lets calls through while the share of recent failures is low enough.

    ``level`` is that share: the first outcome sets it, each later one moves it
    towards 1 (a failure) or 0 (anything else) by one part in ``weight + 1``.
    The weight is ``memory`` for the second outcome and, from then on, never
    more than the outcomes there were when it was last set. A rejection is an
    outcome without failure, so a tap that rejects calls takes them again.
    Only errors that ``qualifies`` accepts are failures. Safe for threads.
    """

    FAILED, DONE, REJECTED = "failed", "done", "rejected"

    def __init__(self, max_error: float, qualifies: Callable[[Exception], bool] = lambda e: True, rejected: Callable[[], Exception] = Rejected, memory: int = 1000) -> None:
        if not 0 <= max_error <= 1:
            raise ValueError(f"{max_error} is no share")
        if memory < 1:
            raise ValueError("memory must be positive")
        self.max_error, self.qualifies, self.rejected = max_error, qualifies, rejected
        self.seen: Counter = Counter()
        self.level, self._weight = 0.0, memory
        self._lock = threading.Lock()

    @property
    def failed_share(self) -> float:
        """Failures among all outcomes, old ones counting in full."""
        return self.seen[self.FAILED] / max(1, self.seen.total())

    def note(self, outcome: str) -> None:
        """Count an outcome and move the level."""
        target = float(outcome == self.FAILED)
        before = self.seen.total()
        if before:
            self.level += (target - self.level) / (self._weight + 1)
            self._weight = min(self._weight, before)
        else:
            self.level = target
        self.seen[outcome] += 1

    def __call__(self, call: Callable[[], object]):
        with self._lock:
            if self.level > self.max_error:
                self.note(self.REJECTED)
                raise self.rejected()
        outcome = self.DONE
        try:
            return call()
        except Exception as error:
            if self.qualifies(error):
                outcome = self.FAILED
            raise
        finally:
            with self._lock:
                self.note(outcome)


class TaskLimiter:
    """At most ``limit`` calls in each window of ``period`` seconds.

    Windows begin at multiples of the period; a call beyond the limit waits
    for the next window that has room.
    """

    def __init__(self, period: float, limit: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if period <= 0 or limit <= 0:
            raise ValueError("period and limit must be positive")
        self.period, self.limit, self.clock, self.sleep = period, limit, clock, sleep
        self._window, self._used, self._lock = -1, 0, threading.Lock()

    def acquire(self) -> float:
        """Wait for a place; returns the seconds waited."""
        with self._lock:
            now = self.clock()
            window = int(now // self.period)
            if window > self._window:
                self._window, self._used = window, 0
            if self._used >= self.limit:
                self._window, self._used = self._window + 1, 0
            self._used += 1
            delay = max(0.0, self._window * self.period - now)
        if delay:
            self.sleep(delay)
        return delay

    def __call__(self, call: Callable[[], object]):
        self.acquire()
        return call()


# -- lazy iterators -------------------------------------------------------------------


def on_last(items: Iterable, release: Callable[[], object]) -> Iterator:
    """The items; ``release`` is called once, at their end, at an error or when closed."""
    try:
        yield from items
    finally:
        release()


def from_managed(acquire: Callable[[], object], items: Callable[[object], Iterable], release: Callable[[object], object]) -> Iterator:
    """Items of a resource that is opened at the first and closed at the last."""
    resource = acquire()
    yield from on_last(items(resource), lambda: release(resource))


def with_last_error(items: Iterable) -> Iterator[tuple[object, Exception | None]]:
    """(item, None) for each, and (None, error) at last if one ended them."""
    try:
        for item in items:
            yield item, None
    except Exception as error:  # noqa: BLE001
        yield None, error


class Resizable:
    """A number of places that can change while some are taken."""

    def __init__(self, places: int, most: int = 16) -> None:
        self.most = most
        self._places, self._taken, self._free = min(places, most), 0, threading.Condition()

    def resize(self, places: int) -> None:
        with self._free:
            self._places = max(1, min(places, self.most))
            self._free.notify_all()

    def __enter__(self) -> Resizable:
        with self._free:
            self._free.wait_for(lambda: self._taken < self._places)
            self._taken += 1
        return self

    def __exit__(self, *_: object) -> None:
        with self._free:
            self._taken -= 1
            self._free.notify_all()


def map_concurrent(items: Iterable, call: Callable, workers: int = 4, ordered: bool = True, level: Resizable | None = None) -> Iterator[tuple[object, object, Exception | None]]:
    """(item, result, error) of a call on each item, ``workers`` at a time.

    No more than twice as many items are taken ahead of those given back.
    ``level`` bounds the calls in flight and may be resized meanwhile.
    """

    def one(item: object) -> tuple[object, object, Exception | None]:
        try:
            if level is None:
                return item, call(item), None
            with level:
                return item, call(item), None
        except Exception as error:  # noqa: BLE001
            return item, None, error

    with ThreadPoolExecutor(level.most if level else workers) as pool:
        waiting: deque[Future] = deque()
        for item in items:
            waiting.append(pool.submit(one, item))
            while len(waiting) >= 2 * workers:
                yield from _take(waiting, ordered)
        while waiting:
            yield from _take(waiting, ordered)


def _take(waiting: deque[Future], ordered: bool) -> Iterator:
    if ordered:
        yield waiting.popleft().result()
        return
    done, rest = wait(waiting, return_when=FIRST_COMPLETED)
    waiting.clear()
    waiting.extend(rest)
    for future in done:
        yield future.result()


# -- over frames ---------------------------------------------------------------------------


def _called(df: DataFrame, per_partition: Callable[[Iterator[tuple[int, dict]]], Iterator[tuple[int, object, str | None]]], returns: str | T.DataType) -> DataFrame:
    """Each row with ``ok``, ``result`` and ``error`` of the call on it.

    Rows come from Arrow batches and go back as they came: a null is None, a
    whole number stays whole. ``ok``, ``result`` and ``error`` of the input,
    if any, are replaced.
    """
    ship_package(df.sparkSession)
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    df = df.drop("ok", "result", "error")
    schema = T.StructType([*df.schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("result", kind), T.StructField("error", T.StringType())])
    result_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: deque = deque()  # batches that have rows under way: (batch, number of its first row)
        taken = 0

        def rows() -> Iterator[tuple[int, dict]]:
            nonlocal taken
            for batch in batches:
                first, taken = taken, taken + batch.num_rows
                kept.append((batch, first))
                yield from enumerate(batch.to_pylist(), first)

        def packed(found: list[tuple]) -> pa.RecordBatch:
            numbers = [n for n, _, _ in found]
            low = min(numbers)
            while kept and kept[0][1] + kept[0][0].num_rows <= low and kept[0][1] + kept[0][0].num_rows <= done_below:
                kept.popleft()
            table = pa.Table.from_batches([b for b, _ in kept]).combine_chunks()
            part = table.take(pa.array([n - kept[0][1] for n in numbers])).combine_chunks()
            out = [column.chunk(0) for column in part.columns]
            out += [pa.array([e is None for _, _, e in found]), pa.array([r for _, r, _ in found], result_type), pa.array([e for _, _, e in found], pa.string())]
            return pa.RecordBatch.from_arrays(out, names=[*part.schema.names, "ok", "result", "error"])

        waiting: list[tuple] = []
        returned: set[int] = set()
        done_below = 0  # all rows with lower numbers were given back
        for number, result, error in per_partition(rows()):
            waiting.append((number, result, error))
            if len(waiting) >= 1000:
                yield packed(waiting)
                returned.update(n for n, _, _ in waiting)
                while done_below in returned:
                    returned.remove(done_below)
                    done_below += 1
                waiting = []
        if waiting:
            yield packed(waiting)

    return df.mapInArrow(run, schema)


def tapped_map(df: DataFrame, call: Callable[[dict], object], returns: str | T.DataType, *, max_error: float = 0.05, memory: int = 1000, workers: int = 4, keep_order: bool = True, limiter: Callable[[], TaskLimiter] | None = None) -> DataFrame:
    """Call a service for each row through one tap per partition.

    Adds ``ok``, ``result`` and ``error``; a row that the tap rejected has the
    error ``rejected``. ``limiter`` makes a partition's limiter; divide a
    global limit by the partitions.
    """

    def per_partition(rows: Iterator[tuple[int, dict]]) -> Iterator[tuple[int, object, str | None]]:
        tap = CircuitTap(max_error, memory=memory)
        limit = limiter() if limiter else (lambda f: f())
        for (number, _), result, error in map_concurrent(rows, lambda r: tap(lambda: limit(lambda: call(r[1]))), workers, keep_order):
            yield number, result, None if error is None else "rejected" if isinstance(error, Rejected) else f"{type(error).__name__}: {error}"

    return _called(df, per_partition, returns)


@dataclass(frozen=True)
class Execution:
    """Where a retried job ended: failures left, and passes made."""

    n_failure: int
    passes: int


def retry(df: DataFrame, call: Callable[[dict], object], returns: str | T.DataType, *, max_passes: int = 3, max_failures_in_a_row: int = 10) -> tuple[DataFrame, Execution]:
    """Call a service for each row, and again for those that failed.

    A pass only has the rows that failed before. A partition that fails
    ``max_failures_in_a_row`` times makes no more calls in that pass. The
    result of each pass is written to the shared folder, so that no call is
    repeated when an executor is lost later on.
    """

    def per_partition(rows: Iterator[tuple[int, dict]]) -> Iterator[tuple[int, object, str | None]]:
        in_a_row = 0
        for number, row in rows:
            if in_a_row >= max_failures_in_a_row:
                yield number, None, "circuit open"
                continue
            try:
                result = call(row)
            except Exception as error:  # noqa: BLE001
                in_a_row += 1
                yield number, None, f"{type(error).__name__}: {error}"
            else:
                in_a_row = 0
                yield number, result, None

    names = [c for c in df.columns if c not in ("ok", "result", "error")]
    done, rest, passes, failures = [], df, 0, 0
    while passes < max(1, max_passes):
        made = materialize(_called(rest, per_partition, returns))
        passes += 1
        failures = failure_count(made)
        if not failures or passes >= max_passes:
            done.append(made)
            break
        done.append(made.where("ok"))
        rest = made.where("not ok").select(*names)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out, Execution(failures, passes)


def failure_count(called: DataFrame) -> int:
    return called.agg(F.count(F.when(~F.col("ok"), 1))).first()[0]
