"""Tables that are replaced as a whole or not at all, and logs of batches that count once.

A table's parts are folders below ``_parts`` that are written first; the file
``_current`` then names those that count.  It is renamed into place in one step
of the file system, so readers see the table before or after a change, and a
writer that dies leaves what was there.  Parts that no longer count are removed
by the next change.  One writer at a time changes a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

CURRENT, PARTS = "_current", "_parts"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another, in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    one, two = hadoop.Path(source), hadoop.Path(target)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(two.toUri(), spark._jsc.hadoopConfiguration()).rename(one, two, options)


def parts(spark: SparkSession, path: str) -> list[dict] | None:
    """The parts that count, or None where there is no such table: folder, and run and number of a batch, or upto (the last number of each run) of what was compacted."""
    fs, where = _fs(spark, f"{path}/{CURRENT}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, now: list[dict]) -> None:
    before = f"{path}/{CURRENT}-{uuid.uuid4().hex}"
    fs, where = _fs(spark, before)
    out = fs.create(where, True)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    _rename(spark, before, f"{path}/{CURRENT}")
    _sweep(spark, path, {p["folder"] for p in now})


def _sweep(spark: SparkSession, path: str, kept: set[str]) -> None:
    """Removes parts that do not count; those that a reader may still hold, as they counted until now, only the next time."""
    fs, where = _fs(spark, f"{path}/{PARTS}")
    for status in fs.listStatus(where) if fs.exists(where) else ():
        part = status.getPath()
        if part.getName() in kept:
            continue
        left = spark._jvm.org.apache.hadoop.fs.Path(part, "_left")
        if fs.exists(left):
            fs.delete(part, True)
        else:
            fs.create(left, True).close()


def _write(df: DataFrame, path: str, form: str) -> str:
    folder = uuid.uuid4().hex
    df.write.format(form).save(f"{path}/{PARTS}/{folder}")
    return folder


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes the table anew: readers see the old rows until all new ones are there."""
    _swap(df.sparkSession, path, [{"folder": _write(df, path, form)}])


def withdraw(spark: SparkSession, path: str) -> None:
    """Takes a table away: without its list of parts there is none; then its files go."""
    for name in (f"{path}/{CURRENT}", path):
        fs, where = _fs(spark, name)
        fs.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders to read: those that count, or the path itself where it is no such table."""
    found = parts(spark, path)
    return [path] if found is None else [f"{path}/{PARTS}/{p['folder']}" for p in found]


def read(spark: SparkSession, path: str, schema, form: str = "parquet", but: str | None = None) -> DataFrame:
    """The rows that count, but for those of one run; none where there is no such table."""
    found = [f"{path}/{PARTS}/{p['folder']}" for p in parts(spark, path) or () if but is None or p.get("run") != but]
    return spark.read.schema(schema).format(form).load(found) if found else spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str, run: str, number: int) -> bool:
    """Whether a run's batch is there, or was compacted."""
    return any(p.get("run") == run and p["number"] == number or number <= p.get("upto", {}).get(run, -1) for p in parts(spark, path) or ())


def commit(df: DataFrame, path: str, run: str, number: int, form: str = "parquet") -> bool:
    """Adds the batch of a run; one that is there already changes nothing, as it is there as a whole."""
    spark = df.sparkSession
    if committed(spark, path, run, number):
        return False
    folder = _write(df, path, form)
    _swap(spark, path, [*(parts(spark, path) or ()), {"run": run, "number": number, "folder": folder}])
    return True


def compact(spark: SparkSession, path: str, schema, form: str = "parquet", files: int = 1) -> int:
    """Writes all parts that count as one; returns how many there were.  Batches of a run are committed in their order, so its last number tells all."""
    now = parts(spark, path) or []
    if len(now) > 1:
        upto: dict[str, int] = {}
        for p in now:
            for run, number in [(p["run"], p["number"])] if "run" in p else p.get("upto", {}).items():
                upto[run] = max(number, upto.get(run, -1))
        folder = _write(read(spark, path, schema, form).coalesce(files), path, form)
        _swap(spark, path, [{"upto": upto, "folder": folder}])
    return len(now)
