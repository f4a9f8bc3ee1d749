"""Corpus, exam and artefact readers with enforced schemas."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import SPAN, doc_span, entry_span
from ..functions.text import is_blank, terms
from .versions import folders

TIMELINE = "id string, section_path string, date_text string, event_text string, source_text string, citation_refs string, source_url string, revision_id string"
NOTES = "id string, title string, years array<int>, date_text string, tags array<string>, text string, source_url string, status string"
KB = "id string, tytul string, tekst string, dzial string, daty array<string>, postacie array<string>, pojecia array<struct<termin: string>>, zrodlo string"
EXAM = "exam_id string, items array<struct<id: string, question: string, source_text: string, answer_format: string, max_points: double, images: array<struct<path: string, sha256: string>>>>"
RECORD = (
    "struct<answer: string, seconds: double, finish_reason: string, truncated: boolean, usage: struct<completion_tokens: int, prompt_tokens: int, "
    "total_tokens: int, prompt_tokens_details: struct<cached_tokens: int>>, word_count: int>"
)
ANSWERS = "exam_id string, answers array<struct<id: string, answer: string>>"
CORPUS = ("kind", "id", "title", "date_text", "text", "span", "terms")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, blank ones skipped, a broken one an error, with ``line``: the place in the load order.

    Files are read in whatever pieces and order; a row's place is its file, the
    start of the piece in it, and the order within the piece, which one task reads.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(folders(spark, path))
    return rows.select(*rows.columns, at.alias("line"))


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Timeline rows with a date; the span is of the years in it."""
    return timeline_rows(_lines(spark, path, TIMELINE))


def timeline_rows(rows: DataFrame) -> DataFrame:
    """Corpus columns from raw timeline rows; those without a date are dropped."""
    rows = rows.filter(F.coalesce("date_text", F.lit("")) != "").withColumns({"kind": F.lit("timeline"), "title": F.col("section_path"), "text": F.col("event_text"), "span": doc_span(F.col("date_text"))})
    return rows.withColumn("terms", terms(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Supplementary notes; their two years are the span."""
    return note_rows(_lines(spark, path, NOTES))


def note_rows(rows: DataFrame) -> DataFrame:
    """Corpus columns from raw notes."""
    span = F.when(F.size("years") >= 2, F.struct(F.element_at("years", 1).alias("lo"), F.element_at("years", 2).alias("hi")))
    rows = rows.withColumns({"kind": F.lit("context"), "date_text": F.coalesce("date_text", F.lit("")), "span": span.cast(SPAN)})
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return rows.withColumn("terms", terms(text))


def load_corpus(first: DataFrame | None, second: DataFrame | None) -> DataFrame:
    """Both sources, either of them optional, with doc_index: the first's rows in their order, then the second's."""
    parts = [p.withColumn("_part", F.lit(i)) for i, p in enumerate((first, second)) if p is not None]
    if not parts:
        raise ValueError("a corpus needs at least one source")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    # numbering within pieces of files; only each piece's count meets in one place
    rows = rows.withColumn("_range", F.struct("line.file", "line.block"))
    sizes = rows.groupBy("_part", "_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part", "_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part", "_range").orderBy("line.nth"))
    out = rows.withColumn("_nth", nth).join(sizes, ["_part", "_range"]).withColumn("doc_index", F.col("_before") + F.col("_nth") - 1)
    return out.drop("_part", "_range", "_nth", "_before", "line")


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """The alternate corpus with terms by field; a repeated id or a blank text is an error."""
    return kb_rows(_lines(spark, path, KB))


def kb_rows(rows: DataFrame) -> DataFrame:
    """Checked rows of the alternate corpus with title_terms, meta_terms, terms and span."""
    twice = rows.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate id: {twice[0]['id']}")
    blank = rows.filter(is_blank(F.col("tekst"))).select("id").limit(1).collect()
    if blank:
        raise ValueError(f"missing text: {blank[0]['id']}")
    none = F.array().cast("array<string>")
    title = F.concat_ws(" ", "tytul", F.coalesce("dzial", F.lit("")))
    meta = F.concat_ws(" ", F.array_join(F.coalesce("postacie", none), " "), F.array_join(F.transform("pojecia", lambda p: F.coalesce(p["termin"], F.lit(""))), " "))
    return rows.withColumns({
        "kind": F.lit("kb"), "title": F.col("tytul"), "text": F.col("tekst"), "span": entry_span(F.coalesce("daty", none)),
        "title_terms": terms(title), "meta_terms": terms(meta), "terms": terms(F.concat_ws(" ", title, "tekst", meta)),
    })


def exam_items(spark: SparkSession, path: str) -> DataFrame:
    """One row per item with exam_id and pos, its place; ids are text, and must be there and differ."""
    exam = spark.read.schema(EXAM).option("multiLine", True).json(folders(spark, path))
    items = exam.select("exam_id", F.posexplode("items").alias("pos", "item")).select("exam_id", "pos", "item.*")
    bad = items.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count(F.when(F.coalesce("id", F.lit("")) == "", 1)).alias("blank")).first()
    if bad["n"] != bad["ids"] or bad["blank"]:
        raise ValueError("item ids must be unique and not empty")
    return items


def records(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: a JSON object of records by id; an absent file gives no rows."""
    try:
        text = spark.read.text(folders(spark, path), wholetext=True)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        text = spark.createDataFrame([], "value string")
    rows = text.select(F.explode(F.from_json("value", f"map<string, {RECORD}>")).alias("id", "r"))
    return rows.select("id", "r.*")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Exported answers with their places."""
    rows = spark.read.schema(ANSWERS).option("multiLine", True).json(folders(spark, path))
    return rows.select("exam_id", F.posexplode("answers").alias("pos", "a")).select("exam_id", "pos", "a.*")


def contained(root: str, path: str) -> str:
    """The path below the root; one that leaves it, by its parts or by a link of a local folder, is an error."""
    scheme, bare = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(.*)", root, re.S).groups()
    bare = posixpath.normpath(bare)
    full = posixpath.normpath(posixpath.join(bare, path))
    if not scheme or scheme in ("file:", "file://"):
        inside = posixpath.commonpath([posixpath.realpath(bare), posixpath.realpath(full)]) == posixpath.realpath(bare)
    else:
        inside = full == bare or full.startswith(bare.rstrip("/") + "/")
    if not inside:
        raise ValueError(f"path outside the folder: {path}")
    return (scheme or "") + full


def binaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, content and sha256 of files."""
    return spark.read.format("binaryFile").load(paths).withColumn("sha256", F.sha2("content", 256))


def verified_images(items: DataFrame, files: DataFrame) -> DataFrame:
    """Each item's images with their files; ``ok`` tells whether a named checksum holds.

    ``items`` has id and images, ``files`` path (as the items name it), content and sha256.
    """
    wanted = items.select("id", F.posexplode("images").alias("nth", "image")).select("id", "nth", F.col("image.path").alias("path"), F.col("image.sha256").alias("expected"))
    joined = wanted.join(files, "path", "left")
    return joined.withColumn("ok", F.col("content").isNotNull() & (F.coalesce("expected", F.lit("")).isin("") | (F.col("expected") == F.col("sha256"))))


def inventory(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """name and bytes of expected files, by their paths below a folder; bytes are null for absent ones."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/"
    bare = lambda p: F.regexp_replace(p, "^([a-z]+:)/+", "$1/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(bare(F.col("path")).alias("path"), F.col("length").alias("bytes"))
    wanted = spark.createDataFrame([(p,) for p in paths], "name string").withColumn("path", bare(F.concat(F.lit(root), F.col("name"))))
    return wanted.join(found, "path", "left").select("name", "bytes")


def total_bytes(files: DataFrame) -> DataFrame:
    """One row: the bytes of all files; absent ones count nothing."""
    return files.agg(F.coalesce(F.sum(F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("bytes"))


def optional_text(spark: SparkSession, path: str) -> str | None:
    """A side file's text without white space at its ends, or None where there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()[0].strip()
