"""Tables written to the shared folder, and joins of a checked size."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Rows that go to Python at once, and bytes of a row group that is held while it is written.
BATCH_ROWS, ROW_GROUP = 256, 16 << 20
#: A table of fewer bytes than this for each core is dealt anew.
SMALL_PART = 32 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_made: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of our own
    if the whole session is one process (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/umbra"


@contextmanager
def small_batches(spark: SparkSession):
    """While this holds, rows go to Python at most ``BATCH_ROWS`` at once: batches
    of texts are held several times over, in the JVM and in the worker."""
    before = spark.conf.get(_BATCH)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its
    lineage is cut and lost executors take nothing with them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/umbra-{uuid.uuid4().hex}/{name}"
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    _made.append((spark, path.rpartition("/")[0]))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is the cluster's to clean
            return


def sized(side: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``limit`` rows. ``side``
    must be cheap to count (a written table) unless ``rows`` is given."""
    return F.broadcast(side) if (side.count() if rows is None else rows) <= limit else side


#: A key with more rows than this is joined by broadcast, so that its rows stay where they are.
HEAVY = 1000


def spread_join(rows: DataFrame, side: DataFrame, on: str, weight: str, heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined (inner) to ``side``, which has each key once and, in
    ``weight``, how many of ``rows`` have it. A small side is broadcast whole.
    Of a larger one the heavy keys are, if there are few enough (they are at
    most one in ``heavy`` rows), and only the rest is shuffled by key. Both
    should be written tables, as both are read twice."""
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), on)
    top = side.filter(F.col(weight) > heavy)
    if not 0 < top.count() <= BROADCAST_ROWS:
        return rows.join(side, on)
    rest = rows.join(F.broadcast(top.select(on)), on, "left_anti").join(side.filter(F.col(weight) <= heavy), on)
    return rows.join(F.broadcast(top), on).unionByName(rest)


def spread(table: DataFrame) -> DataFrame:
    """A table of few bytes dealt to all cores: a scan can't split a file's only
    row group. A large table, of many row groups, stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size < cores * SMALL_PART else table
