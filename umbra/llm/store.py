"""Tables written to the shared folder, and joins of a checked size."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..tables import BATCH_ROWS, BROADCAST_ROWS, sized, spread_join, written

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "shared", "sized", "spread_join", "written"]


@contextmanager
def shared(spark: SparkSession, value):
    """A broadcast that is given up at the end, once what reads it is written."""
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()
