"""A training-data pipeline over ``documents``: five stages, each one operator of lectern.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.jaccard import jaccard_classes
from lectern.llm.line_chunks import dedup_lines
from lectern.llm.mixing import curriculum_mix
from lectern.llm.quality import classify
from lectern.llm.sentencepiece_bpe import decode, encode
from lectern.llm.store import bounded, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null and blank texts go, equal texts fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs.select(*COLUMNS), labels=labels).filter("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; one that loses all its text goes, n_chars follows the text.

    Null and empty texts, and rows without doc_id, stay as they are; repeated
    rows of a document count as one.
    """
    out = dedup_lines(docs.select(*COLUMNS)).filter("n_removed = 0 or length(text) > 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a doc_id for each row: those without one, or without one of their own, are ``lost`` and get numbers behind all others'."""
    docs = docs.select(*COLUMNS, F.col("doc_id").alias("was"))
    twice = materialize(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "twice")
    if not twice.limit(1).count() and not docs.filter("doc_id is null").limit(1).count():
        return docs.withColumn("lost", F.lit(False))
    last = docs.agg(F.max("doc_id")).first()[0]
    lost = docs.filter("doc_id is null").unionByName(docs.join(twice, "doc_id", "left_semi"))
    lost = lost.withColumn("doc_id", F.monotonically_increasing_id() + F.lit(max(0, last or 0) + 1)).withColumn("lost", F.lit(True))
    rest = docs.filter("doc_id is not null").join(twice, "doc_id", "left_anti").withColumn("lost", F.lit(False))
    return rest.unionByName(materialize(lost, "lost"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class whose five-word shingles are alike to 0.8: the one with the smallest doc_id.

    Rows without doc_id, or whose doc_id other rows have too, are documents of
    their own that come after all others; of equal rows one stays.  Null and
    empty texts are like nothing and stay.
    """
    docs = numbered(docs)
    kept = materialize(jaccard_classes(docs, k=5, percent=80).filter("doc_id = component_id").select("doc_id"), "kept")
    out = docs.join(bounded(kept), "doc_id", "left_semi")
    return out.withColumn("doc_id", F.when(F.col("lost"), F.col("was")).otherwise(F.col("doc_id"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, sources mixed to their target weights; repeated ones once for each copy, also those without doc_id.

    A copy that a source's target takes in part is cut there; n_chars follows the text.
    """
    return curriculum_mix(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count, the digest of its ids, and whether decoding gives the text back; a null text counts as empty."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(docs.select("doc_id", "source", "text"), path)
    coded = coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join("ids", ","), 256)})
    out = decode(coded, path)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: No stage but the mix can be told in SQL; tests/llm compares each stage's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
