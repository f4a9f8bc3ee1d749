"""A run's parameters, its choice of items and essays, its configuration, and a rehearsal without any answer."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import essay_class
from .ledger import missing, same_run

#: Prefix of the session's settings that are a run's parameters.
PREFIX = "spark.lectern."


@dataclass(frozen=True)
class Parameters:
    """What a run may be told; from a mapping of texts or the session's settings."""

    base_url: str = "http://127.0.0.1:8080"
    temperature: float = 0.0
    max_tokens: int = 768
    essay_tokens: int = 3072
    ids: tuple[str, ...] | None = None
    essay_ids: tuple[str, ...] | None = None
    no_essays: bool = False
    validate_only: bool = field(default=False)

    def __post_init__(self):
        if self.no_essays and self.essay_ids:
            raise ValueError("choose essay_ids or no_essays")

    @classmethod
    def of(cls, given: Mapping[str, str]) -> "Parameters":
        """From texts: lists by white space, booleans as true or false; an unknown name is an error."""
        known = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        read = {"float": float, "int": int, "bool": lambda v: {"true": True, "false": False}[v.lower()], "str": str}
        return cls(**{k: tuple(v.split()) if known[k].startswith("tuple") else read[known[k]](v) for k, v in given.items()})

    @classmethod
    def of_session(cls, spark: SparkSession) -> "Parameters":
        """From the session's settings below the prefix."""
        found = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(cls)}
        return cls.of({k: v for k, v in found.items() if v is not None})


def _check_known(spark: SparkSession, wanted: Iterable[str], items: DataFrame, what: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in wanted], "id string")
    unknown = [r["id"] for r in missing(asked, items.select("id")).orderBy("id").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}")
    return asked


def classified(items: DataFrame) -> DataFrame:
    """id and kind of each item: essay, uncertain or short."""
    return items.select("id", essay_class(F.col("question"), F.col("max_points")).alias("kind"))


def choose_essays(items: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """The ids of essays: those that are told, none, or those that are found; uncertain ones are an error unless told."""
    if parameters.no_essays:
        return items.select("id").limit(0)
    if parameters.essay_ids is not None:
        return _check_known(items.sparkSession, parameters.essay_ids, items, "essay ids")
    kinds = classified(items)
    uncertain = [r["id"] for r in kinds.filter("kind = 'uncertain'").select("id").orderBy("id").limit(20).collect()]
    if uncertain:
        raise ValueError(f"ambiguous essays: {', '.join(uncertain)}; tell essay_ids or no_essays")
    return kinds.filter("kind = 'essay'").select("id")


def select_items(items: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """The items of a run: all, or those that are told; an unknown id is an error."""
    if parameters.ids is None:
        return items
    return items.join(_check_known(items.sparkSession, parameters.ids, items, "ids").distinct(), "id", "left_semi")


def check_same(config: DataFrame, earlier: DataFrame) -> None:
    """An error if the run's configuration is not the one that it began with."""
    if not same_run(config, earlier).first()["equal"]:
        raise ValueError("run configuration changed: choose another folder")


def rehearse(items: DataFrame, essays: DataFrame, contexts: DataFrame, images: DataFrame) -> DataFrame:
    """id, essay, context_chars, n_images and ready for every item, without asking anything.

    ``images`` has id and ok, a row for each image, as ``verified_images`` gives.
    """
    shown = images.groupBy("id").agg(F.count("*").alias("n_images"), F.min(F.col("ok").cast("int")).alias("sound"))
    rows = items.select("id", "question").join(essays.select("id").withColumn("essay", F.lit(True)), "id", "left").join(contexts.select("id", "context"), "id", "left").join(shown, "id", "left")
    essay = F.coalesce("essay", F.lit(False))
    chars = F.when(essay, F.length(F.coalesce("context", F.lit("")))).otherwise(0)
    return rows.select("id", essay.alias("essay"), chars.cast("long").alias("context_chars"), F.coalesce("n_images", F.lit(0)).alias("n_images"), (F.coalesce("sound", F.lit(1)) == 1).alias("ready"))
