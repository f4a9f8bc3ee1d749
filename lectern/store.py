"""Written intermediate tables: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes a query's shuffle files as soon as the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the session's checkpoint folder.

    Where neither is set, a local session gets a temporary one, as in tests;
    on a cluster that is an error, as a folder of one machine would not do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            found = found.rsplit("/", 1)[0]
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and returns the written table.

    The write ends the query below it, whose shuffle files are then removed.
    The table itself is removed when the driver's Python ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, _CLEAN, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables of ``materialize`` that no later query reads."""
    for df in tables:
        _remove(df.sparkSession, df._lectern_path)


#: Bytes of a table's rows that may go to every executor.
BROADCAST = 16 << 20


def _width(table: DataFrame):
    """Bytes of a row: eight a column, and what strings, binaries and arrays of numbers hold."""
    out = F.lit(16 + 8 * len(table.columns)).cast("long")
    for f in table.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind == "array<string>":
            out = out + F.coalesce(F.aggregate(f.name, F.lit(0).cast("long"), lambda n, x: n + 8 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind.startswith("array"):
            inner = 8 * max(1, kind.count(":")) + (16 if "struct" in kind else 0)
            out = out + inner * F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0))
    return out


def small(table: DataFrame, most: int = BROADCAST) -> bool:
    """Whether the written table's measured bytes are within the bound."""
    return (table.agg(F.sum(_width(table))).first()[0] or 0) <= most


def bounded(table: DataFrame, most: int = BROADCAST) -> DataFrame:
    """The written table, marked for broadcast if its measured bytes are within the bound."""
    return F.broadcast(table) if small(table, most) else table
