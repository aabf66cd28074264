"""Session set-up, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast without a look at their width.
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()
_written: list[str] = []
_own_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the operators count on."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rowlattice")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def active_session() -> SparkSession:
    session = SparkSession.getActiveSession()
    if session is None:
        raise RuntimeError("no active Spark session")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests), a local session gets a temporary
    folder; a cluster without it is refused, as a machine-local folder
    would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        app = spark.sparkContext.applicationId
        if app in _own_dirs:
            return _own_dirs[app]
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rowlattice-")
    return named.rstrip("/")


@atexit.register
def _clear_at_exit() -> None:
    """Leave nothing behind where the program ends in an orderly way."""
    context = SparkContext._active_spark_context
    if _written and context is not None and context._jsc is not None:
        with contextlib.suppress(Exception):
            clear_scratch(SparkSession(context))


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by :func:`clear_scratch`."""
    path = f"{shared_dir(spark)}/rowlattice-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage in a way that outlives any executor, and unlike a
    checkpoint of rows it keeps column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialize` wrote in this program.

    Frames made from them can't be read after that. Returns how many there were.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` stay below ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, least_bytes: int = 2 << 20) -> DataFrame:
    """Deal out the rows of a small input before much work is done on each.

    A small file is read by one task, whatever the work. Where the sources of
    the frame are estimated at under ``least_bytes`` for each core, rows are
    shuffled to as many tasks as there are cores; all larger inputs are read
    where they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * least_bytes else df


def ship_package(spark: SparkSession) -> None:
    """Give executors on other machines this package, once per application."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="rowlattice-"), "rowlattice.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
