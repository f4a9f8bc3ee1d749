"""Fingerprints of a run's files, held with its configuration: a run that goes on with other files is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

FILES = "name string, bytes long, sha256 string"
#: Hexadecimal digits of a name's digest that deal files out: the second level of the tree has a node for each.
DIGITS = 3


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """name (the path below the folder), bytes and sha256 of each file; Spark reads no empty ones."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    bare = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return files.select(F.substring(bare, len(root) + 1, 1 << 30).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _combined(rows: DataFrame, keys: list[str], name: Column, told: Column) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(name.alias("n"), told.alias("s")))), lambda x: F.concat_ws(" ", x["s"], x["n"]))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def tree_digest(files: DataFrame) -> str:
    """One digest of all files, whatever order they are in: of the digests of their parts, in the order of the parts' names.

    A part holds the files whose names' digests begin alike, so no task sees
    more than a few thousandths of them.
    """
    part = F.substring(F.sha2("name", 256), 1, DIGITS)
    parts = _combined(files.withColumn("part", part), ["part"], F.col("name"), F.col("sha256"))
    return _combined(parts, [], F.col("part"), F.col("sha256")).first()["sha256"]


def read_configuration(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The configuration that a run began with, one row, or None where none began there."""
    if versions.parts(spark, f"{path}/configuration") is None:
        return None
    return versions.read(spark, f"{path}/configuration", schema, "json")


def begin(config: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Begins a run, or goes on with it: returns its configuration, one row with the files' digest as corpus_sha256.

    A run that began with another configuration or other files is refused, by
    the names of at most ten files that differ.
    """
    from ..operators.ledger import same_run

    spark = config.sparkSession
    now = config.withColumn("corpus_sha256", F.lit(tree_digest(files)))
    before = read_configuration(spark, path, now.schema)
    if before is None:
        versions.replace(files.select("name", "bytes", "sha256"), f"{path}/files")
        versions.replace(now, f"{path}/configuration", "json")
        return read_configuration(spark, path, now.schema)
    if not same_run(now, before).first()["equal"]:
        changed = drift(versions.read(spark, f"{path}/files", FILES), files)
        names = [f"{r['name']} ({r['change']})" for r in changed.orderBy("name").limit(10).collect()]
        raise ValueError("run configuration changed: choose another folder" + "".join(f"; {n}" for n in names))
    return before


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """name and change (added, removed, altered) of the files that are not as they were."""
    one, two = before.select("name", F.col("sha256").alias("was")), now.select("name", F.col("sha256").alias("is"))
    both = one.join(two, "name", "full").filter(~F.col("was").eqNullSafe(F.col("is")))
    return both.select("name", F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("altered").alias("change"))
