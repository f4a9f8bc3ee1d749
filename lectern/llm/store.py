"""Bounds on what goes to Python; written tables and bounded broadcasts come from the library."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..store import bounded, drop, materialize, setting, shared_dir

__all__ = ["bounded", "drop", "materialize", "setting", "shared_dir", "small_batches"]

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 200, most: int = 4 << 20) -> None:
    """Bounds the rows and the bytes that go to Python at once, as texts may be long."""
    if int(spark.conf.get(_ROWS, "10000")) > rows:
        spark.conf.set(_ROWS, str(rows))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES)) > most:
        spark.conf.set(_BYTES, str(most))
