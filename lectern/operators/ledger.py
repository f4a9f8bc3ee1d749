"""Resumable runs: what is left to do, what to export, whether sets and runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, records: DataFrame) -> DataFrame:
    """Items without a record."""
    return items.join(records.select("id"), "id", "left_anti")


def export(items: DataFrame, records: DataFrame) -> DataFrame:
    """Every item once, with its answer or the empty text; pos keeps the order."""
    answers = records.select("id", "answer")
    return items.select("pos", "id").join(answers, "id", "left").select("pos", "id", F.coalesce("answer", F.lit("")).alias("answer"))


def missing(wanted: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Keys that are wanted but not known; none if the one set holds the other."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def same_sets(one: DataFrame, two: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many keys only the one and only the other side has, and whether both are equal."""
    sides = one.select(key).distinct().withColumn("l", F.lit(1)).join(two.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    only = sides.agg(F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"))
    return only.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def same_run(config: DataFrame, other: DataFrame) -> DataFrame:
    """One row: whether two one-row configurations are equal, field by field, nulls included."""
    one, two = (c.select(F.to_json(F.struct(*sorted(c.columns)), {"ignoreNullFields": "false"}).alias("j")) for c in (config, other))
    return one.withColumnRenamed("j", "a").crossJoin(two).select((F.col("a") == F.col("j")).alias("equal"))
