"""Rows told apart where several have one doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def digest(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and part of all rows with a doc_id; and each row's doc_id, part and digest.

    ``part`` is 0 where the rows of a doc_id have one text, else the text's
    rank by digest among them.
    """
    digests = materialize(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    seen = F.xxhash64("digest")
    clash = digests.groupBy("doc_id").agg(F.min(seen).alias("a"), F.max(seen).alias("b")).filter("a < b").select("doc_id")
    if not clash.limit(1).count():
        out = digests.withColumn("part", F.lit(0))
        out._lectern_path = digests._lectern_path
        return docs.withColumn("part", F.lit(0)), out
    parts = digests.join(clash, "doc_id", "left_semi").distinct().withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("digest")) - 1)
    parts = materialize(parts, "parts")
    both = digests.join(parts, ["doc_id", "digest"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    both = materialize(both, "digests")
    parts = parts.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "part")
    rows = docs.join(parts, (F.col("doc_id") == F.col("_doc")) & (digest(F.col("text")) == F.col("_digest")), "left")
    return rows.select(*docs.columns, F.coalesce("part", F.lit(0)).alias("part")), both


def apart(docs: DataFrame, *known: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns other than the known ones under names that nothing here uses, and their own names by those."""
    back = {f"own{i}": c for i, c in enumerate(c for c in docs.columns if c not in known)}
    return home(docs, {c: name for name, c in back.items()}), back


def home(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows with some columns renamed, all at once."""
    return rows.select(*[F.col("`" + c.replace("`", "``") + "`").alias(names.get(c, c)) for c in rows.columns])
